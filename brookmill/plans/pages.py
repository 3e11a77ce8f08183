"""Queries over raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookmill.functions import page as G
from brookmill.functions import patterns as P
from brookmill.functions.sqltext import contains_any, lit
from brookmill.plans.registry import query
from brookmill.sources.tables import table

C = F.col
VISIBLE = f"regexp_replace(regexp_replace(substr(html, 1, {P.SCAN_MOST}), {lit(P.INVISIBLE)}, '', 'g'), '<[^>]+>', ' ', 'g')"
HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1))"
WORDS = lambda t: f"len(regexp_extract_all({t}, {lit(P.WORD)}))"
SQUEEZE = lambda t: f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"
COUNT = lambda t, p: f"len(regexp_extract_all({t}, {lit(p)}))"
HAS = lambda t, p: f"regexp_matches({t}, {lit(p)})"
LOW = "lower(substr(html, 1, 20000))"
PAGE_TYPE = f"""CASE WHEN {contains_any('lower(url)', P.ACADEMIC_URLS)} OR {HAS(LOW, P.LATEX)} THEN 'academic'
  WHEN {HOST} IN ('github.com', 'www.github.com', 'raw.githubusercontent.com') OR {contains_any('lower(url)', P.REPOSITORY_URLS)} THEN 'repository'
  WHEN {contains_any('lower(url)', P.DOCUMENTATION_URLS)} THEN 'documentation'
  WHEN {contains_any(LOW, P.ARTICLE_MARKS)} THEN 'article' WHEN {contains_any(LOW, P.FORUM_MARKS)} THEN 'forum'
  WHEN {HAS(LOW, P.PRODUCT)} THEN 'product'
  WHEN {contains_any(LOW, P.LISTING_MARKS)} OR {COUNT(LOW, 'class="result')} + {COUNT(LOW, 'class="item')} >= 3 THEN 'listing'
  WHEN {HAS(LOW, P.COLLECTION)} AND {COUNT(LOW, '<img')} >= 3 THEN 'collection' ELSE 'webpage' END"""
HEAD = "lower(substr(html, 1, 3000))"
BOT = f"({HAS(HEAD, P.BOT_BLOCK)} OR (length(html) < 500 AND length({SQUEEZE(f'''regexp_replace({HEAD}, '<[^>]+>', ' ', 'g')''')}) < 100))"
SCAN_JS = "trim(substr(html, 1, 50000))"
SHOWN_JS = "length(" + SQUEEZE(f"regexp_replace(regexp_replace({SCAN_JS}, {lit(P.INVISIBLE_JS)}, ' ', 'g'), '<[^>]+>', ' ', 'g')") + ")"
NEEDS_JS = f"""CASE WHEN {HAS('url', P.STATIC_SITES)} THEN FALSE WHEN {HAS('url', P.JS_REQUIRED)} THEN TRUE
  ELSE ({HAS(SCAN_JS, P.SPA)} AND {SHOWN_JS} < 200) OR {SHOWN_JS} < 200 OR {HAS(f'lower({SCAN_JS})', P.CHALLENGE)}
    OR (NOT {contains_any(SCAN_JS, ('<p>', '<article', '<main'))} AND {SHOWN_JS} < 500) END"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


@query("page_route_summary", f"""
SELECT {HOST} AS host, {PAGE_TYPE} AS page_type, count(*) AS n_pages, sum({WORDS(VISIBLE)})::BIGINT AS n_words,
       avg({WORDS(VISIBLE)}) AS mean_words, sum(CASE WHEN {BOT} THEN 1 ELSE 0 END)::BIGINT AS n_blocked, sum(CASE WHEN {NEEDS_JS} THEN 1 ELSE 0 END)::BIGINT AS n_js
FROM pages GROUP BY ALL""")
def page_route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host and type: visible words, bot walls, pages that need rendering."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    p = pages(spark, sf_dir).select(
        G.host(C("url")).alias("host"),
        G.page_type(C("html"), C("url")).alias("page_type"),
        G.count_words(G.visible_text(C("html"))).alias("words"),
        G.is_bot_block(C("html")).alias("blocked"),
        G.needs_js(C("html"), C("url")).alias("js"),
    )
    return p.groupBy("host", "page_type").agg(F.count("*").alias("n_pages"), F.sum("words").alias("n_words"), F.avg("words").alias("mean_words"), one(C("blocked")).alias("n_blocked"), one(C("js")).alias("n_js"))


@query("page_signals", f"""
SELECT page_id, {PAGE_TYPE} AS page_type, {HAS('substr(html, 1, 60000)', P.NEWS_META)} AS news, {BOT} AS bot_block, {NEEDS_JS} AS needs_js,
  ({HAS('lower(substr(html, 1, 100000))', r'<meta\b[^>]*(?:citation_title)[^>]*>')} AND {HAS('lower(substr(html, 1, 100000))', r'<meta\b[^>]*(?:citation_author|citation_doi|citation_journal_title|citation_pdf_url)[^>]*>')})
  OR {HAS('lower(substr(html, 1, 100000))', P.SCHOLARLY_LD)} OR {HAS('lower(substr(html, 1, 100000))', P.LATEX)} AS scholarly FROM pages""")
def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, u = C("html"), C("url")
    return pages(spark, sf_dir).select("page_id", G.page_type(h, u).alias("page_type"), G.is_news(h).alias("news"), G.is_bot_block(h).alias("bot_block"), G.needs_js(h, u).alias("needs_js"), G.is_scholarly(h).alias("scholarly"))


@query("visible_text", f"SELECT page_id, length({VISIBLE}) AS n_chars, md5({VISIBLE}) AS text_md5, {WORDS(VISIBLE)} AS n_words, greatest({WORDS(VISIBLE)}, {COUNT(VISIBLE, P.CJK)} // 2) AS n_units FROM pages")
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = pages(spark, sf_dir).select("page_id", G.visible_text(C("html")).alias("t"))
    return t.select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"), G.count_words(C("t")).alias("n_words"), G.content_units(C("t")).alias("n_units"))


@query("raw_text", f"SELECT page_id, md5({SQUEEZE(f'''regexp_replace(regexp_replace(html, {lit(P.RAW_DROP)}, ' ', 'g'), '<[^>]+>', ' ', 'g')''')}) AS text_md5 FROM pages")
def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", F.md5(G.raw_text(C("html"))).alias("text_md5"))


TOKENS = lambda t: f"list_concat(list_filter(regexp_extract_all(replace(lower({t}), 'ß', 'ss'), {lit(P.TOKEN)}), lambda x: length(x) > 1 OR regexp_matches(x, '^\\p{{Nd}}$')), regexp_extract_all(replace(lower({t}), 'ß', 'ss'), {lit(P.CJK)}))"


@query("quality_tokens", f"SELECT page_id, token, count(*) AS n FROM (SELECT page_id, unnest({TOKENS(VISIBLE)}) AS token FROM pages) GROUP BY ALL")
def quality_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", F.explode(G.quality_tokens(G.visible_text(C("html")))).alias("token")).groupBy("page_id", "token").agg(F.count("*").alias("n"))


@query("structure_signals", f"""
SELECT page_id, least({COUNT('substr(html,1,100000)', '(?i)<table')}, 2) + (CASE WHEN {COUNT('substr(html,1,100000)', '(?i)<table')} > 0 AND {HAS('substr(html,1,100000)', '(?i)(?:rowspan|colspan) *=')} THEN 1 ELSE 0 END)
  + (CASE WHEN {COUNT('substr(html,1,100000)', '(?i)<pre')} >= 2 OR {COUNT('substr(html,1,100000)', '(?i)<code')} >= 4 THEN 1 ELSE 0 END) + (CASE WHEN {HAS('substr(html,1,100000)', P.MATH_MARKUP)} THEN 1 ELSE 0 END)
  + (CASE WHEN {COUNT('substr(html,1,100000)', r'(?i)<li[^n]')} >= 20 THEN 1 ELSE 0 END) + (CASE WHEN {COUNT('substr(html,1,100000)', r'(?i)<a[ >]')} >= 80 THEN 1 ELSE 0 END) AS score,
  array_to_string(list_filter([CASE WHEN {HAS('substr(html,1,100000)', '(?i)<h[1-6]')} AND NOT {HAS(VISIBLE, P.MD_HEADING)} THEN 'headings_missing' END,
    CASE WHEN {HAS('substr(html,1,100000)', '(?i)<li[^n]')} AND NOT {HAS(VISIBLE, P.MD_LIST_ITEM)} THEN 'lists_missing' END], lambda x: x IS NOT NULL), ',') AS losses FROM pages""")
def structure_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = C("html")
    return pages(spark, sf_dir).select("page_id", G.structure_score(h).alias("score"), F.array_join(G.structure_losses(h, G.visible_text(h)), ",").alias("losses"))


LINKS = f"list_filter(list_transform(regexp_extract_all(html, {lit(P.LINK)}, 1), lambda x: trim(x)), lambda h: h <> '' AND length(h) <= 4096 AND NOT regexp_matches(h, '^(?:javascript|mailto|tel|data):'))"
ORIGIN = r"regexp_extract(url, '^(https?://[^/?#]+)', 1)"


@query("page_links", f"""
WITH l AS (SELECT page_id, {ORIGIN} AS origin, unnest({LINKS}) AS href, generate_subscripts({LINKS}, 1) AS pos FROM pages),
a AS (SELECT page_id, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(origin, '^https?:', 0) || href WHEN starts_with(href, '/') THEN origin || href END AS link, pos FROM l),
d AS (SELECT page_id, link, min(pos) AS pos FROM a WHERE link IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS nth, sum(length(link)) OVER w AS chars FROM d WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT page_id, nth, link FROM r WHERE nth <= 1000 AND chars <= 256000""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered distinct absolute links of each page, at most 1000 and 256 000 characters."""
    p = pages(spark, sf_dir).select("page_id", F.regexp_extract("url", r"^(https?://[^/?#]+)", 1).alias("origin"), F.posexplode(G.links(C("html"))).alias("pos", "href"))
    href = C("href")
    link = F.when(href.rlike("^https?://"), href).when(href.startswith("//"), F.concat(F.regexp_extract("origin", "^https?:", 0), href)).when(href.startswith("/"), F.concat("origin", href))
    d = p.select("page_id", link.alias("link"), "pos").where("link IS NOT NULL").groupBy("page_id", "link").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("page_id", "link", F.row_number().over(Window.partitionBy("page_id").orderBy("pos")).alias("nth"), F.sum(F.length("link")).over(w).alias("chars"))
    return d.where("nth <= 1000 AND chars <= 256000").select("page_id", F.col("nth").cast("bigint").alias("nth"), "link")


@query("link_density", f"""
SELECT page_id, len({LINKS}) AS n_links, octet_length(encode({VISIBLE})) AS text_bytes, octet_length(encode(html)) AS html_bytes,
  least(1.0::DOUBLE, octet_length(encode({VISIBLE}))::DOUBLE / greatest(1, octet_length(encode(html)))) AS text_density FROM pages""")
def link_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).select("page_id", F.size(G.links(C("html"))).alias("n_links"), F.octet_length(G.visible_text(C("html"))).alias("text_bytes"), F.octet_length("html").alias("html_bytes"))
    return p.withColumn("text_density", F.least(F.lit(1.0), C("text_bytes") / F.greatest(F.lit(1), C("html_bytes"))))


@query("page_metadata", r"""
SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, regexp_extract(html, '(?i)<html[^>]*\blang="([^"]*)"', 1) AS language,
  regexp_extract(html, '(?i)<meta charset="?([A-Za-z0-9_-]+)', 1) AS charset, len(regexp_extract_all(html, '(?i)<p[ >]')) AS n_paragraphs FROM pages""")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = C("html")
    return pages(spark, sf_dir).select(
        "page_id", F.trim(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.regexp_extract(h, r'(?i)<html[^>]*\blang="([^"]*)"', 1).alias("language"),
        F.regexp_extract(h, r'(?i)<meta charset="?([A-Za-z0-9_-]+)', 1).alias("charset"), F.regexp_count(h, F.lit("(?i)<p[ >]")).alias("n_paragraphs"),
    )


@query("decision_inputs", "SELECT page_id AS row_id, 'track-' || page_id AS track_id, url, sha256(html) AS html_sha256 FROM pages")
def decision_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label-free projection of the pages."""
    return pages(spark, sf_dir).select(C("page_id").alias("row_id"), F.concat(F.lit("track-"), C("page_id")).alias("track_id"), "url", F.sha2("html", 256).alias("html_sha256"))


@query("body_limits", "SELECT page_id, octet_length(encode(html)) <= 20000 AS accepted, CASE WHEN octet_length(encode(html)) > 20000 THEN 'body_too_large' END AS error FROM pages")
def body_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded bodies: those over the byte bound keep their row, with an error (a bound of 20 000 bytes, so that some are over it)."""
    ok = F.octet_length("html") <= 20000
    return pages(spark, sf_dir).select("page_id", ok.alias("accepted"), F.when(~ok, "body_too_large").alias("error"))


@query("grounding", f"""
WITH s AS (SELECT page_id, t, count(*) AS n FROM (SELECT page_id, unnest({TOKENS(VISIBLE)}) AS t FROM pages) GROUP BY ALL),
o AS (SELECT page_id, t, count(*) AS n FROM (SELECT page_id, unnest({TOKENS("regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '<[^>]+>', ' ', 'g')")}) AS t FROM pages) GROUP BY ALL),
g AS (SELECT s.page_id, sum(least(s.n, coalesce(o.n, 0))) AS hit, sum(s.n) AS ns FROM s LEFT JOIN o USING (page_id, t) GROUP BY ALL),
c AS (SELECT page_id, sum(n) AS no FROM o GROUP BY ALL)
SELECT page_id, hit / ns AS source_coverage, hit / no AS output_grounding FROM g JOIN c USING (page_id)""")
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset-token coverage of each page by its article, in both directions."""
    p = pages(spark, sf_dir)
    bag = lambda text: p.select("page_id", F.explode(G.quality_tokens(text)).alias("t")).groupBy("page_id", "t").agg(F.count("*").alias("n"))
    article = F.regexp_replace(F.regexp_extract("html", r"(?is)<article[^>]*>(.*?)</article>", 1), r"<[^>]+>", " ")
    s, o = bag(G.visible_text(C("html"))), bag(article)
    both = s.join(o.withColumnRenamed("n", "m"), ["page_id", "t"], "left").groupBy("page_id").agg(F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("hit"), F.sum("n").alias("ns"))
    return both.join(o.groupBy("page_id").agg(F.sum("n").alias("no")), "page_id").select("page_id", (C("hit") / C("ns")).alias("source_coverage"), (C("hit") / C("no")).alias("output_grounding"))
