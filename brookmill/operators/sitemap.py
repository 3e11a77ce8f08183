"""Sitemaps: locations of documents, traversal of indexes as bounded joins, link supplement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmill.functions import page as G
from brookmill.functions import url as U

MAX_SITEMAPS = 50


def unescape(text: Column) -> Column:
    return reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")), text)


def locations(docs: DataFrame) -> DataFrame:
    """(url, pos, loc, is_sitemap) for each <loc> of documents (url, body)."""
    is_index = F.contains(F.lower("body"), F.lit("<sitemapindex"))
    locs = docs.select("url", is_index.alias("idx"), F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("pos", "raw"))
    loc = unescape(F.trim(F.col("raw")))
    absolute = F.when(loc.rlike("^https?://"), loc).when(loc.startswith("/"), F.concat(U.origin(F.col("url")), loc))
    return locs.select("url", "pos", absolute.alias("loc"), (F.col("idx") | F.lower(U.path(absolute)).rlike(r"\.xml(?:\.gz)?$")).alias("is_sitemap")).where("loc IS NOT NULL")


def declared(robots: DataFrame) -> DataFrame:
    """Sitemap lines of robots bodies (origin, body), or /sitemap.xml where there is none."""
    lines = robots.select("origin", F.posexplode_outer(F.regexp_extract_all("body", F.lit(r"(?im)^sitemap:[ \t]*(\S+)"), F.lit(1))).alias("pos", "url"))
    return lines.select("origin", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("url", F.concat("origin", F.lit("/sitemap.xml"))).alias("url"))


def traverse(start: DataFrame, docs: DataFrame, depth: int = 4) -> DataFrame:
    """Page locations reached from the sitemaps in ``start`` (url) over documents (url, body): loc, level, pos; each once,
    at its first place. Levels are joins; the depth is bounded like the number of sitemaps."""
    all_locs = locations(docs)
    level, found, seen = start.select("url").distinct(), [], start.select("url").distinct()
    for n in range(depth):
        here = level.join(all_locs, "url")
        found.append(here.where("NOT is_sitemap").select("loc", F.lit(n).alias("level"), "url", "pos"))
        level = here.where("is_sitemap").select(F.col("loc").alias("url")).distinct().join(seen, "url", "left_anti")
        seen = seen.union(level)
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("loc").agg(F.min(F.struct("level", "url", "pos")).alias("at")).select("loc", "at.level", F.col("at.url").alias("sitemap"), "at.pos")


def home_links(pages: DataFrame) -> DataFrame:
    return pages.select("url", F.explode(G.links(F.col("html"))).alias("href"))
