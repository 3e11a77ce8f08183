"""Queries over crawl frontiers and link graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.functions import page as G
from brookmill.operators import frontier as Fr
from brookmill.plans.pages import HOST, pages
from brookmill.plans.registry import query
from brookmill.sources.tables import table

C = F.col
ENTRIES = f"SELECT page_id, {HOST} AS host, page_id % 5 AS priority, page_id AS ord, (page_id % 11)::DOUBLE AS ready_at FROM pages"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", G.host(C("url")).alias("host"), (C("page_id") % 5).alias("priority"), C("page_id").alias("ord"), (C("page_id") % 11).cast("double").alias("ready_at"))


ORDERED = f"""e AS ({ENTRIES}), t AS (SELECT *, row_number() OVER w AS turn, first_value(priority) OVER w AS head FROM e WINDOW w AS (PARTITION BY host ORDER BY priority DESC, ord)),
o AS (SELECT page_id, host, turn, row_number() OVER (PARTITION BY turn ORDER BY head DESC, host) AS place FROM t)"""


@query("frontier_order", f"WITH {ORDERED} SELECT page_id, turn, place FROM o")
def frontier_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fr.fair_order(entries(spark, sf_dir)).select("page_id", C("turn").cast("bigint").alias("turn"), C("place").cast("bigint").alias("place"))


@query("frontier_budgets", f"WITH {ORDERED}, b AS (SELECT *, row_number() OVER (ORDER BY turn, place) AS n FROM o) SELECT page_id, CASE WHEN turn > 4 THEN 'host_fetch_budget' WHEN n > 100 THEN 'global_fetch_budget' END AS reason FROM b")
def frontier_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fr.within_budgets(Fr.fair_order(entries(spark, sf_dir)), 100, 4).select("page_id", "reason")


@query("frontier_metrics", f"WITH {ORDERED}, b AS (SELECT CASE WHEN turn > 4 THEN 'terminal' ELSE 'queued' END AS state, CASE WHEN turn > 4 THEN 'host_fetch_budget' END AS reason FROM o) SELECT coalesce(state, '*') AS state, coalesce(reason, '*') AS reason, count(*) AS n FROM b GROUP BY GROUPING SETS ((state), (state, reason), ())")
def frontier_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Fr.fair_order(entries(spark, sf_dir))
    b = o.select(F.when(C("turn") > 4, "terminal").otherwise("queued").alias("state"), F.when(C("turn") > 4, "host_fetch_budget").alias("reason"))
    g = b.groupingSets([[C("state")], [C("state"), C("reason")], []], C("state"), C("reason")).agg(F.count("*").alias("n"))
    return g.select(F.coalesce("state", F.lit("*")).alias("state"), F.coalesce("reason", F.lit("*")).alias("reason"), "n")


@query("frontier_wake", f"SELECT host, greatest(min(ready_at), CASE WHEN ends_with(host, '.org') THEN 6.5 ELSE 0.0 END, 2.0) AS wake_at FROM ({ENTRIES}) GROUP BY host")
def frontier_wake(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    delayed = e.select("host").distinct().where(F.endswith("host", F.lit(".org"))).withColumn("next_allowed_at", F.lit(6.5))
    return Fr.next_wake(e, delayed, 2.0)


# Pages as nodes that link to two and three times their number, modulo the count.
LINKS = "SELECT page_id AS src, page_id * k % n AS dst FROM pages, (SELECT count(*) AS n FROM pages), (VALUES (2), (3)) v(k)"


@query("bfs_depth", f"WITH RECURSIVE g AS ({LINKS}), b(id, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, depth + 1 FROM b JOIN g ON src = id WHERE depth < 5) SELECT id, min(depth) AS depth FROM b GROUP BY id")
def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).select(C("page_id").alias("src"))
    n = p.agg(F.count("*").alias("n"))
    links = p.select("src", F.explode(F.array(F.lit(2), F.lit(3))).alias("k")).select("src", (C("src") * C("k") % n.scalar()).alias("dst"))
    return Fr.crawl_depths(spark.range(1, 2), links, 5).select("id", "depth")


@query("link_priorities", f"SELECT page_id, 7 AS constant, -(page_id % 4) AS breadth_first, (('0x' || substr(sha256('5' || chr(0) || page_id), 1, 16))::UBIGINT % 9223372036854775808)::BIGINT AS random, len(list_intersect(['en', 'page', 'www'], string_split(regexp_replace(lower(url), '[^a-z]+', ' ', 'g'), ' '))) * 1000 - page_id % 4 AS anchor_overlap FROM pages")
def link_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    depth, terms = C("page_id") % 4, F.split(F.regexp_replace(F.lower("url"), "[^a-z]+", " "), " ")
    overlap = F.size(F.array_intersect(F.array(*map(F.lit, ("en", "page", "www"))), terms))
    return p.select("page_id", Fr.priority("constant", depth, constant=7).alias("constant"), Fr.priority("breadth_first", depth).alias("breadth_first"), Fr.priority("random", depth, ident=C("page_id").cast("string"), seed=5).alias("random"), Fr.priority("anchor_overlap", depth, overlap=overlap).alias("anchor_overlap"))


@query("yield_curve", "SELECT ord, sum(CASE WHEN t THEN 1 ELSE 0 END) OVER w::BIGINT AS hits, sum(CASE WHEN t THEN 0 ELSE b END) OVER w::BIGINT AS wasted_bytes, sum(CASE WHEN t THEN 1 ELSE 0 END) OVER w / 50 AS share FROM (SELECT page_id AS ord, page_id % 5 = 0 AS t, octet_length(encode(html)) AS b FROM pages) WINDOW w AS (ORDER BY ord)".replace(" OVER w::BIGINT", " OVER w"))
def yield_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = pages(spark, sf_dir).select(C("page_id").alias("ord"), (C("page_id") % 5 == 0).alias("target"), F.octet_length("html").alias("payload_bytes"))
    return Fr.yield_curve(trace, 50)


@query("host_admissions", f"""
WITH c AS (SELECT {HOST} AS host, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://' || {HOST} || '/' END AS canonical, page_id % 3 AS depth, page_id % 5 AS priority, page_id AS ord FROM pages)
SELECT canonical, arg_min(host, ord) AS host, min(depth) AS depth, max(priority) AS priority, count(*) - 1 AS n_duplicates FROM c WHERE canonical NOT IN (SELECT url FROM pages WHERE page_id % 10 = 0) GROUP BY canonical""")
def host_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    c = p.select(F.when(C("page_id") % 2 == 0, C("url")).otherwise(F.concat(F.lit("https://"), G.host(C("url")), F.lit("/"))).alias("canonical"), G.host(C("url")).alias("host"), (C("page_id") % 3).alias("depth"), (C("page_id") % 5).alias("priority"), F.lit(0.0).alias("ready_at"), C("page_id").alias("ord"))
    known = p.where("page_id % 10 = 0").select(C("url").alias("canonical"), F.lit(0).alias("depth"), F.lit(0).alias("priority"), F.lit(0.0).alias("ready_at"), F.lit("queued").alias("state"))
    return Fr.admit(c, known)[0].select("canonical", "host", "depth", "priority", "n_duplicates")


@query("rate_limits")
def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-bucket starts of the events' users, each as a host; tests compare it with a loop."""
    e = table(spark, sf_dir, "events").select(C("user_id").cast("string").alias("host"), (F.unix_micros(C("ts").cast("timestamp")) / 1e6).alias("at"))
    return Fr.token_bucket(e)


@query("span_compatibility", "SELECT a.i AS a, b.i AS b FROM (SELECT page_id AS i, page_id % 50 AS s, page_id % 50 + page_id % 7 + 1 AS e, page_id % 3 AS g FROM pages) a JOIN (SELECT page_id AS i, page_id % 50 AS s, page_id % 3 AS g FROM pages) b ON a.g = b.g AND a.e <= b.s AND b.s - a.e < 3")
def span_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval pairs that follow each other within three characters: a range join, made an equality join on cells of the bound's width."""
    p = pages(spark, sf_dir).select(C("page_id").alias("i"), (C("page_id") % 50).alias("s"), (C("page_id") % 50 + C("page_id") % 7 + 1).alias("e"), (C("page_id") % 3).alias("g"))
    a = p.select(C("i").alias("a"), "e", "g", F.explode(F.array(F.floor(C("e") / 3), F.floor(C("e") / 3) + 1)).alias("cell"))
    b = p.select(C("i").alias("b"), "s", "g", F.floor(C("s") / 3).alias("cell"))
    return a.join(b, ["g", "cell"]).where("e <= s AND s - e < 3").select("a", "b")


@query("stream_scope", f"SELECT {HOST} AS host, count(*) AS n FROM pages WHERE ends_with({HOST}, '.org') GROUP BY ALL")
def stream_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = G.host(C("url"))
    return pages(spark, sf_dir).where(F.endswith(h, F.lit(".org"))).groupBy(h.alias("host")).agg(F.count("*").alias("n"))


