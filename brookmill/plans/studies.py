"""Queries over evaluation studies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookmill.functions import grams as N
from brookmill.functions import page as G
from brookmill.functions import scoring as K
from brookmill.operators import studies as U
from brookmill.plans.evaluation import pairs
from brookmill.plans.gates import ARTICLE_SQL, article
from brookmill.plans.pages import HOST, TOKENS, VISIBLE, pages
from brookmill.plans.registry import query
from brookmill.sources.tables import spread, table

C = F.col
METRICS = ("text", "code", "formula", "table_edit", "table_teds")
# Scores made of events: a metric fails for some rows.
SCORES_SQL = "SELECT event_id, event_type, CASE WHEN event_id % 5 > 0 THEN value / 100 END AS text, CASE WHEN event_id % 7 > 0 THEN value % 7 / 7 END AS code, CASE WHEN event_id % 3 > 0 THEN value % 11 / 11 END AS formula, value % 13 / 13 AS table_edit, CASE WHEN event_type <> 'error' THEN value % 3 / 3 END AS table_teds FROM events"
STATS_SQL = ", ".join(f"round(coalesce(avg({n}), 0), 9) AS {n}, count({n}) AS {n}_successful, count(*) - count({n}) AS {n}_failed, min({n}) AS {n}_min, max({n}) AS {n}_max, round(coalesce(stddev_samp({n}), 0), 9) AS {n}_std" for n in METRICS)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v = C("event_id"), C("value")
    return table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.when(i % 5 > 0, v / 100).alias("text"), F.when(i % 7 > 0, v % 7 / 7).alias("code"), F.when(i % 3 > 0, v % 11 / 11).alias("formula"), (v % 13 / 13).alias("table_edit"),
        F.when(C("event_type") != "error", v % 3 / 3).alias("table_teds"),
    )


def rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


@query("fine_grained_metrics", f"WITH s AS ({SCORES_SQL}), a AS (SELECT event_type, {STATS_SQL}, (coalesce(avg(text), 0) + coalesce(avg(code), 0) + coalesce(avg(formula), 0) + coalesce(avg(table_edit), 0) + coalesce(avg(table_teds), 0)) / 5 AS o FROM s GROUP BY event_type) SELECT * EXCLUDE (o), round(o, 9) AS overall FROM a")
def fine_grained_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five metrics, each aggregated over the pages where it succeeded, and their mean."""
    out = U.metric_aggregate(scores(spark, sf_dir), ["event_type"], list(METRICS))
    return rounded(out, [*METRICS, *[f"{n}_std" for n in METRICS], "overall"])


DELTA_SQL = ", ".join(f"round(coalesce(avg({n}) FILTER (event_id % 2 = 1), 0) - coalesce(avg({n}) FILTER (event_id % 2 = 0), 0), 9) AS {n}_delta" for n in METRICS)
COUNTS_SQL = ", ".join(f"count({n}) FILTER (event_id % 2 = 1) - count({n}) FILTER (event_id % 2 = 0) AS {n}_successful_delta, (count(*) FILTER (event_id % 2 = 1 AND {n} IS NULL)) - (count(*) FILTER (event_id % 2 = 0 AND {n} IS NULL)) AS {n}_failed_delta" for n in METRICS)


@query("aggregate_delta", f"WITH s AS ({SCORES_SQL}), d AS (SELECT event_type, {DELTA_SQL}, {COUNTS_SQL}, {' AND '.join(f'(coalesce(avg({n}) FILTER (event_id % 2 = 1), 0) >= coalesce(avg({n}) FILTER (event_id % 2 = 0), 0) AND count(*) FILTER (event_id % 2 = 1 AND {n} IS NULL) <= count(*) FILTER (event_id % 2 = 0 AND {n} IS NULL))' for n in METRICS)} AS promoted FROM s GROUP BY event_type) SELECT *, round((text_delta + code_delta + formula_delta + table_edit_delta + table_teds_delta) / 5, 7) AS overall_delta FROM d")
def aggregate_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd events as candidate, even ones as baseline: differences of the aggregates and the gate over them."""
    s = scores(spark, sf_dir)
    parts = [U.metric_aggregate(s.where(C("event_id") % 2 == k), ["event_type"], list(METRICS)) for k in (0, 1)]
    out = U.aggregate_delta(*parts, ["event_type"], list(METRICS))
    return rounded(out, [f"{n}_delta" for n in METRICS]).withColumn("overall_delta", F.round("overall_delta", 7))


@query("provider_pairs", """WITH e AS (SELECT event_id // 10 AS task, user_id % 7 AS cluster, event_type AS provider, event_id AS attempt, value AS f1, value % 9 AS latency FROM events),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task, provider ORDER BY attempt) AS n FROM e) WHERE n = 1),
l AS (SELECT task, cluster, provider, 'f1' AS metric, f1 AS value FROM f UNION ALL SELECT task, cluster, provider, 'latency', latency FROM f),
p AS (SELECT a.provider AS "left", b.provider AS "right", metric, a.cluster, a.value - b.value AS d FROM l a JOIN l b USING (task, metric) WHERE a.provider < b.provider),
c AS (SELECT "left", "right", metric, cluster, avg(d) AS m, count(*) AS n, count(*) FILTER (d > 0) AS up, count(*) FILTER (d < 0) AS down FROM p GROUP BY ALL)
SELECT "left", "right", metric, round(avg(m), 9) AS mean_delta, sum(n)::BIGINT AS n_tasks, count(*) AS n_clusters, sum(up)::BIGINT AS n_left_better, sum(down)::BIGINT AS n_right_better FROM c GROUP BY ALL""")
def provider_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of event types as providers over ten-event tasks, clustered by user."""
    i, v = C("event_id"), C("value")
    e = table(spark, sf_dir, "events").select(F.expr("event_id div 10").alias("task"), (C("user_id") % 7).alias("cluster"), C("event_type").alias("provider"), i.alias("attempt"), v.alias("f1"), (v % 9).alias("latency"))
    return rounded(U.provider_pairs(e, ["f1", "latency"]), ["mean_delta"])


@query("run_gates", """WITH r AS (SELECT user_id % 20 AS experiment, user_id % 40 // 20 AS w, CASE WHEN user_id % 80 < 40 THEN 'cold' ELSE 'warm' END AS m, CASE WHEN user_id % 20 = 3 THEN user_id % 2 + user_id // 40 ELSE 0 END AS corpus, user_id % 20 // 19 * (user_id // 20) AS protocol, user_id % 20 <> 7 AS verified FROM (SELECT DISTINCT user_id FROM events) WHERE user_id < 80),
w AS (SELECT experiment, w, count(*) FILTER (m = 'cold') AS cold, count(*) FILTER (m = 'warm') AS warm FROM r GROUP BY ALL), o AS (SELECT experiment, count(*) FILTER (cold <> 1 OR warm <> 1) AS odd, count(*) AS n FROM w GROUP BY experiment),
a AS (SELECT experiment, min(corpus) <> max(corpus) AS c, min(protocol) <> max(protocol) AS p, bool_and(verified) AS v FROM r GROUP BY experiment),
x AS (SELECT experiment, n AS n_windows, array_to_string(list_filter([CASE WHEN c THEN 'corpora_differ' END, CASE WHEN p THEN 'protocols_differ' END, CASE WHEN n < 2 THEN 'too_few_windows' END, CASE WHEN odd > 0 THEN 'window_not_paired' END, CASE WHEN NOT v THEN 'artifacts_unverified' END], lambda z: z IS NOT NULL), ',') AS reasons FROM a JOIN o USING (experiment))
SELECT experiment, n_windows, reasons = '' AS passed, reasons FROM x""")
def run_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiments of paired cold and warm runs made of user numbers."""
    u = C("user_id")
    runs = table(spark, sf_dir, "events").where("user_id < 80").select("user_id").distinct().select(
        (u % 20).alias("experiment"), F.expr("user_id % 40 div 20").alias("window"), F.when(u % 80 < 40, "cold").otherwise("warm").alias("mode"), F.when(u % 20 == 3, u % 2 + F.expr("user_id div 40")).otherwise(0).alias("corpus"),
        F.expr("user_id % 20 div 19 * (user_id div 20)").alias("protocol"), (u % 20 != 7).alias("verified"),
    )
    return U.run_gate(runs)


@query("representability", f"""WITH p AS (SELECT page_id, {HOST} AS host, octet_length(encode(html)) AS n, CASE WHEN length(html) > 8000 THEN 'too_large' WHEN contains(html, '<br>') THEN 'void_in_text' ELSE 'accepted' END AS reason FROM pages)
SELECT reason, count(*) AS n_pages, avg(CASE WHEN reason = 'accepted' THEN 1.0 ELSE 0 END) AS accepted, sum(n)::BIGINT AS n_bytes, quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.95) AS p95, count(DISTINCT host) AS n_hosts FROM p GROUP BY reason""")
def representability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep over pages: how many are accepted, why others are not, nearest-rank sizes."""
    reason = F.when(F.length("html") > 8000, "too_large").when(F.contains("html", F.lit("<br>")), "void_in_text").otherwise("accepted")
    p = pages(spark, sf_dir).select(G.host(C("url")).alias("host"), F.octet_length("html").alias("n"), reason.alias("reason"))
    rank = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY n)").cast("int")
    return p.groupBy("reason").agg(F.count("*").alias("n_pages"), F.avg(F.when(C("reason") == "accepted", 1.0).otherwise(0.0)).alias("accepted"), F.sum("n").alias("n_bytes"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), F.countDistinct("host").alias("n_hosts"))


BAG_SQL = f"""WITH a AS (SELECT page_id, t, count(*) AS n FROM (SELECT page_id, unnest({TOKENS(ARTICLE_SQL)}) AS t FROM pages) GROUP BY ALL), b AS (SELECT page_id, t, count(*) AS m FROM (SELECT page_id, unnest({TOKENS(VISIBLE)}) AS t FROM pages) GROUP BY ALL)
SELECT page_id, round(sum(least(n, coalesce(m, 0)))::DOUBLE / sum(n), 9) AS agreement FROM a LEFT JOIN b USING (page_id, t) GROUP BY page_id"""


@query("bag_agreement", BAG_SQL)
def bag_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each article's tokens that its page has."""
    p = spread(pages(spark, sf_dir)).select("page_id", G.quality_tokens(article()).alias("a"), G.quality_tokens(G.visible_text(C("html"))).alias("b"))
    return p.where(F.size("a") > 0).select("page_id", F.round(K.bag_share("a", "b"), 9).alias("agreement"))


@query("subsequences")
def subsequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each page's article runs through its visible text in order, and the aligned share."""
    p = spread(pages(spark, sf_dir)).select("page_id", G.quality_tokens(article()).alias("a"), G.quality_tokens(G.visible_text(C("html"))).alias("b"))
    return p.select("page_id", K.subsequence("a", "b").alias("n_in_order"), aligned("a", "b").alias("n_aligned"), F.size("a").alias("n_tokens"))


@F.pandas_udf(T.LongType())
def aligned(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        yield pd.Series([len(U.alignment(list(x), list(y))) for x, y in zip(a, b, strict=True)])


@query("example_scores")
def example_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against their benchmark item as truth and the next two as lies: quality, leakage, margin and joint utility."""
    p = spread(pairs(spark, sf_dir).select(C("l").alias("doc_id"), "r", C("lt").alias("text"), C("rt").alias("truth")))
    b = table(spark, sf_dir, "benchmark")
    n = b.agg(F.count("*")).first()[0]
    lie = lambda k: b.select(((C("item_id") + n - k) % n).alias("r"), C("text").alias(f"lie{k}"))
    t = p.join(F.broadcast(lie(1)) if n <= 10_000 else lie(1), "r").join(F.broadcast(lie(2)) if n <= 10_000 else lie(2), "r")
    t = t.select("doc_id", N.example_parts("text", "truth", F.array("lie1", "lie2")).alias("f"))
    return t.select("doc_id", U.example_score(C("f.whole"), C("f.positional"), C("f.ordered"), C("f.best_window"), C("f.leaks")).alias("s")).select("doc_id", "s.*")


@query("clustered_bootstrap")
def clustered_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the difference of two arms over documents, drawn by clusters (sources) within languages.

    Units are averaged per cluster where they are; only the clusters' means, one per source and language, reach the draws.
    """
    d = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.avg(F.length("text") % 11).alias("x"), F.avg(F.length("text") % 13).alias("y"))
    rows = d.repartition(1).select("lang", "source", "x", "y")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(parts))
        known = [(str(a), f"{a}/{b}", "", float(x), float(y)) for a, b, x, y in got.itertuples(index=False)]
        if known:
            m = pd.Series(U.clustered_bootstrap(known, 200, b"claim-1"))
            yield pd.DataFrame({"mean": [m.mean()], "low": [m.quantile(0.025)], "high": [m.quantile(0.975)], "n_clusters": [len(known)]})

    return rows.mapInPandas(run, "mean double, low double, high double, n_clusters bigint")


@query("structure_scores")
def structure_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's Markdown against that of its main content: headings, lists, code and tables."""
    from brookmill.operators import extract as E

    c = E.candidates(spread(pages(spark, sf_dir))).where("strategy IN ('rs-trafilatura', 'markdownify')")
    j = c.groupBy("page_id").agg(F.max(F.when(C("strategy") == "markdownify", C("text"))).alias("a"), F.max(F.when(C("strategy") == "rs-trafilatura", C("text"))).alias("b"))
    return j.select("page_id", _structure("a", "b").alias("s")).select("page_id", "s.*")


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in U.STRUCTURE]))
def _structure(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for a, b in parts:
        yield pd.DataFrame([U.structure_score(x, y) for x, y in zip(a, b, strict=True)], columns=list(U.STRUCTURE)).astype(float)


@query("oracle_units", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
c AS (SELECT doc_id, k FROM l WHERE length(line) > 40 AND (k % 2 = 0 OR k % 3 = 0))
SELECT doc_id, k::BIGINT AS unit FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.doc_id = a.doc_id AND b.k = a.k // 2) AND NOT EXISTS (SELECT 1 FROM c b WHERE b.doc_id = a.doc_id AND b.k = a.k // 4)""")
def oracle_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled lines without those below another labelled one; a line's ancestors are half and a quarter of its number."""
    l = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))  # noqa: E741
    k = (C("p") + 1).cast("bigint")
    rows = l.select(C("doc_id").alias("doc"), k.alias("id"), F.array(F.expr("(p + 1) div 2"), F.expr("(p + 1) div 4")).alias("ancestors"), "line").where("id % 2 = 0 OR id % 3 = 0")
    rows = rows.withColumn("ancestors", F.filter("ancestors", lambda a: a > 0))
    return U.outermost(rows, F.length("line") > 40).select(C("doc").alias("doc_id"), C("id").alias("unit"))


@query("identical_texts", "SELECT sha256(text) AS text_sha256, min(doc_id) AS first_doc, count(*) AS n, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def identical_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of byte-identical texts with the lineages (sources) of their members."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "source", F.sha2("text", 256).alias("text_sha256"))
    return d.groupBy("text_sha256").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources")).where("n > 1")
