"""Queries that score texts against references and roll the scores up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookmill.functions import grams as N
from brookmill.functions import page as G
from brookmill.operators import similarity as S
from brookmill.operators import statistics as Q
from brookmill.plans.pages import TOKENS, VISIBLE, pages
from brookmill.plans.registry import query
from brookmill.sources.tables import table

C = F.col

# Documents against benchmark items of the same number modulo the items' count: gold and prediction stand-ins.
PAIRS = "SELECT d.doc_id AS l, b.item_id AS r, d.text AS lt, b.text AS rt, d.source, d.lang FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(C("item_id").alias("r"), C("text").alias("rt"))
    d = table(spark, sf_dir, "documents").select(C("doc_id").alias("l"), C("text").alias("lt"), "source", "lang")
    n = b.agg(F.count("*").alias("n"))
    return d.withColumn("r", C("l") % n.scalar()).join(b, "r")


def _scored(spark: SparkSession, sf_dir: str, items, prepare=lambda text: text) -> DataFrame:
    p = pairs(spark, sf_dir)
    # One text per key: keyed by its id and a hash, so that no text is a key of the shuffle.
    side = lambda key, text: S.bag(p.select(key, C(text), F.xxhash64(text).alias("h")).dropDuplicates([key, "h"]).select(key, prepare(C(text)).alias("prepared")), [key], items(C("prepared")))
    return S.overlap(p.select("l", "r", "source", "lang"), side("l", "lt"), side("r", "rt"))


def _compared(spark: SparkSession, sf_dir: str, overlap) -> DataFrame:
    """doc_id, hit, nl and nr of every pair as ``_scored`` gives them, from whole texts side by side: no gram is shuffled.

    Only ids are counted over all rows; rows that share one are then put together, their distinct texts as one bag.
    """
    p = pairs(spark, sf_dir).select("l", "lt", "rt")
    shared = p.groupBy("l").count().where("count > 1").select("l")
    alone = lambda rows: rows.select("l", F.array("lt").alias("lt"), F.array("rt").alias("rt"), F.lit(1).cast("bigint").alias("k"))
    if shared.isEmpty():
        rows = alone(p)
    else:
        together = p.join(shared, "l", "left_semi").groupBy("l").agg(F.collect_set("lt").alias("lt"), F.collect_set("rt").alias("rt"), F.count("*").alias("k"))
        rows = alone(p.join(shared, "l", "left_anti")).unionByName(together)
    s = rows.select("l", "k", overlap("lt", "rt").alias("s"))
    # k rows of a key are k pairs, each with the sum over them.
    return s.select(C("l").alias("doc_id"), (C("s.hit") * C("k")).alias("hit"), "s.nl", "s.nr", F.explode(F.sequence(F.lit(1).cast("bigint"), "k"))).drop("col")


def _sql(left: str, right: str, prepare: str = "{}") -> str:
    return f"""WITH p AS ({PAIRS}),
lb AS (SELECT l, item, count(*) AS n FROM (SELECT l, unnest({left}) AS item FROM (SELECT DISTINCT l, {prepare.format('lt')} AS lt FROM p)) GROUP BY ALL),
rb AS (SELECT r, item, count(*) AS m FROM (SELECT r, unnest({right}) AS item FROM (SELECT DISTINCT r, {prepare.format('rt')} AS rt FROM p)) GROUP BY ALL),
h AS (SELECT l, r, sum(least(n, m)) AS hit FROM p JOIN lb USING (l) JOIN rb USING (r, item) GROUP BY ALL),
s AS (SELECT p.l, p.r, p.source, p.lang, coalesce(hit, 0) AS hit, coalesce((SELECT sum(n) FROM lb WHERE lb.l = p.l), 0) AS nl, coalesce((SELECT sum(m) FROM rb WHERE rb.r = p.r), 0) AS nr FROM p LEFT JOIN h USING (l, r))"""


GRAMS = lambda t: f"CASE WHEN len({t}) >= 5 THEN list_transform(range(1, len({t}) - 3), lambda i: array_to_string({t}[i:i + 4], '')) ELSE [] END"
CHARACTERS = "list_filter(string_split({}, ''), lambda c: c <> '')"
SHINGLE_WORDS = r"regexp_extract_all({}, '[\p{{L}}\p{{M}}\p{{N}}_]+')"
SHINGLES = lambda t: f"CASE WHEN len({t}) > 0 THEN list_transform(range(1, greatest(1, len({t}) - 3) + 1), lambda i: array_to_string({t}[i:i + 3], ' ')) ELSE [] END"
F1 = "CASE WHEN nl + nr > 0 THEN 2 * hit::DOUBLE / (nl + nr) ELSE 0 END"
TOKEN_F1_SQL = _sql(TOKENS("lt"), TOKENS("rt"))


@query("token_f1", TOKEN_F1_SQL + f" SELECT l AS doc_id, r AS item_id, hit::DOUBLE / greatest(nl, 1) AS p, hit::DOUBLE / greatest(nr, 1) AS r, {F1} AS f1 FROM s")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir, G.quality_tokens)
    one = F.lit(1)
    return s.select(C("l").alias("doc_id"), C("r").alias("item_id"), (C("hit") / F.greatest("nl", one)).alias("p"), (C("hit") / F.greatest("nr", one)).alias("r"), S.dice(C("hit"), C("nl"), C("nr")).alias("f1"))


@query("gram5_dice", _sql(GRAMS("lt"), GRAMS("rt"), CHARACTERS) + f" SELECT l AS doc_id, hit::BIGINT AS overlap_grams, {F1} AS dice FROM s")
def gram5_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-character multiset Dice of whole texts."""
    s = _compared(spark, sf_dir, N.overlap)
    return s.select("doc_id", C("hit").alias("overlap_grams"), S.dice(C("hit"), C("nl"), C("nr")).alias("dice"))


POSITIONAL = lambda t: f"CASE WHEN len({t}) >= 5 THEN list_transform(range(1, len({t}) - 3), lambda i: ((i - 1) * 64 // (len({t}) - 4)) || ':' || array_to_string({t}[i:i + 4], '')) ELSE [] END"


@query("positional_f1", _sql(POSITIONAL("lt"), POSITIONAL("rt"), CHARACTERS) + f" SELECT l AS doc_id, hit::BIGINT AS overlap_grams, {F1} AS f1 FROM s")
def positional_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-character F1 within 64 position buckets of whole texts."""
    s = _compared(spark, sf_dir, N.placed_overlap)
    return s.select("doc_id", C("hit").alias("overlap_grams"), S.dice(C("hit"), C("nl"), C("nr")).alias("f1"))


SHINGLE_SQL = _sql(SHINGLES("lt"), SHINGLES("rt"), SHINGLE_WORDS)


def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir, S.word_shingles, lambda t: F.regexp_extract_all(t, F.lit(r"([\p{L}\p{M}\p{N}_]+)")))
    return s.select("l", "source", "lang", C("hit").alias("tp"), (C("nl") - C("hit")).alias("fp"), (C("nr") - C("hit")).alias("fn"))


@query("shingle_f1", SHINGLE_SQL + """, t AS (SELECT source, hit AS tp, nl - hit AS fp, nr - hit AS fn FROM s)
SELECT coalesce(source, '(all)') AS source, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tp) / sum(tp + fp) AS p, sum(tp) / sum(tp + fn) AS r, 2 * sum(tp) / sum(2 * tp + fp + fn) AS f1 FROM t GROUP BY ROLLUP(source)""")
def shingle_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus precision, recall and F1 of four-token shingles, overall and by source."""
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    g = shingle_counts(spark, sf_dir).rollup("source").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return g.select(F.coalesce("source", F.lit("(all)")).alias("source"), "tp", "fp", "fn", (C("tp") / (C("tp") + C("fp"))).alias("p"), (C("tp") / (C("tp") + C("fn"))).alias("r"), (2 * C("tp") / (2 * C("tp") + C("fp") + C("fn"))).alias("f1"))


@query("macro_micro", TOKEN_F1_SQL + f""", f AS (SELECT source, {F1} AS f1 FROM s), d AS (SELECT source, avg(f1) AS a, median(f1) AS m FROM f GROUP BY source)
SELECT (SELECT round(avg(f1), 9) FROM f) AS micro_mean, (SELECT round(median(f1), 9) FROM f) AS micro_median, round(avg(a), 9) AS macro_mean, round(median(m), 9) AS macro_median, count(*) AS n_sources FROM d""")
def macro_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _scored(spark, sf_dir, G.quality_tokens).select("source", S.dice(C("hit"), C("nl"), C("nr")).alias("f1"))
    d = f.groupBy("source").agg(F.avg("f1").alias("a"), F.median("f1").alias("m"))
    micro = f.agg(F.round(F.avg("f1"), 9).alias("micro_mean"), F.round(F.median("f1"), 9).alias("micro_median"))
    macro = d.agg(F.round(F.avg("a"), 9).alias("macro_mean"), F.round(F.median("m"), 9).alias("macro_median"), F.count("*").alias("n_sources"))
    return micro.join(F.broadcast(macro))


@query("score_breakdown", TOKEN_F1_SQL + f""", f AS (SELECT source, lang, {F1} AS f1 FROM s)
SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*) AS n, round(avg(f1), 9) AS mean_f1 FROM f GROUP BY GROUPING SETS ((), (lang), (source), (lang, source))""")
def score_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _scored(spark, sf_dir, G.quality_tokens).select("source", "lang", S.dice(C("hit"), C("nl"), C("nr")).alias("f1"))
    g = f.groupingSets([[], [C("lang")], [C("source")], [C("lang"), C("source")]], C("lang"), C("source")).agg(F.count("*").alias("n"), F.round(F.avg("f1"), 9).alias("mean_f1"))
    return g.select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "n", "mean_f1")


# Events stand in for runs of providers: latency, success and costs.
@query("provider_summary", """SELECT event_type AS provider, count(*) AS n, avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END) AS success_rate, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.99) AS p99, min(value) AS low, max(value) AS high, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type""")
def provider_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    q = lambda p: Q.interpolated("value", p)
    return e.groupBy(C("event_type").alias("provider")).agg(F.count("*").alias("n"), F.avg(F.when(C("value") > 20, 1.0).otherwise(0.0)).alias("success_rate"), q(0.5).alias("p50"), q(0.9).alias("p90"), q(0.99).alias("p99"), F.min("value").alias("low"), F.max("value").alias("high"), F.countDistinct("user_id").alias("n_users"))


@query("quantiles", """SELECT event_type, quantile_cont(value, 0.95) AS interpolated, quantile_disc(value, 0.95) AS nearest_rank, list_sort(list(value))[least(count(*), floor(count(*) * 0.95)::BIGINT + 1)] AS floor_index FROM events GROUP BY event_type""")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three kinds of quantile side by side."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy("event_type").agg(Q.interpolated("value", 0.95).alias("interpolated"), Q.nearest_rank("value", 0.95).alias("nearest_rank"), F.sort_array(F.collect_list("value")).alias("v"))
    return g.select("event_type", "interpolated", "nearest_rank", Q.floor_index(C("v"), 0.95).alias("floor_index"))


@query("distribution_summary", "SELECT o_orderstatus, count(o_totalprice) AS n, round(avg(o_totalprice), 6) AS mean, median(o_totalprice) AS median, quantile_cont(o_totalprice, 0.9) AS p90, quantile_cont(o_totalprice, 0.95) AS p95, quantile_cont(o_totalprice, 0.99) AS p99, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY 1")
def distribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.distribution(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice").withColumn("mean", F.round("mean", 6))


@query("bootstrap_ci", """
WITH u AS (SELECT row_number() OVER (ORDER BY item_id) AS unit, (length(text) % 17) - 7.5::DOUBLE AS delta FROM benchmark), n AS (SELECT count(*) AS n FROM u),
dr AS (SELECT b, ('0x' || substr(md5(concat_ws(':', 7, b, i)), 1, 8))::BIGINT % n + 1 AS unit FROM (SELECT unnest(range(1, 201)) AS b), (SELECT n, unnest(range(1, n + 1)) AS i FROM n)),
m AS (SELECT b, sum(delta) / count(*) AS d FROM dr JOIN u USING (unit) GROUP BY b)
SELECT round(avg(d), 9) AS boot_mean, quantile_cont(d, 0.025) AS ci_low, quantile_cont(d, 0.975) AS ci_high, avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END) AS win_fraction FROM m""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    u = b.select(F.row_number().over(Window.orderBy("item_id")).cast("bigint").alias("unit"), ((F.length("text") % 17) - F.lit(7.5)).alias("delta"))
    return Q.paired_bootstrap(u, 200, 7).withColumn("boot_mean", F.round("boot_mean", 9))


@query("paired_comparison", """
WITH a AS (SELECT doc_id, length(text) % 11 AS score FROM documents), b AS (SELECT doc_id, length(text) % 13 AS score FROM documents)
SELECT count(*) AS n, sum(CASE WHEN a.score > b.score THEN 1 ELSE 0 END)::BIGINT AS better, sum(CASE WHEN a.score < b.score THEN 1 ELSE 0 END)::BIGINT AS worse, sum(CASE WHEN a.score = b.score THEN 1 ELSE 0 END)::BIGINT AS equal, avg(a.score - b.score) AS mean_delta FROM a JOIN b USING (doc_id)""")
def paired_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of scores per key: better, worse and equal counts and the mean difference."""
    d = table(spark, sf_dir, "documents")
    a, b = d.select("doc_id", (F.length("text") % 11).alias("x")), d.select("doc_id", (F.length("text") % 13).alias("y"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return a.join(b, "doc_id").agg(F.count("*").alias("n"), n(C("x") > C("y")).alias("better"), n(C("x") < C("y")).alias("worse"), n(C("x") == C("y")).alias("equal"), F.avg(C("x") - C("y")).alias("mean_delta"))


@query("conservative_aggregate", "SELECT d.lang, sum(CASE WHEN l.quality = 1 THEN least(1.0, n_chars / 5000.0) ELSE 0 END) / count(*) AS mean_with_failures, bool_and(l.doc_id IS NOT NULL) AS all_scored, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang")
def conservative_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over a fixed denominator: rows without success count as 0."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumn("known", F.lit(True))
    j = d.join(lab, "doc_id", "left")
    score = F.when(C("quality") == 1, F.least(F.lit(1.0), C("n_chars") / 5000.0)).otherwise(0.0)
    return j.groupBy("lang").agg((F.sum(score) / F.count("*")).alias("mean_with_failures"), F.bool_and(F.coalesce("known", F.lit(False))).alias("all_scored"), F.count("*").alias("n"))


@query("label_cube", "SELECT coalesce(d.lang, '*') AS lang, coalesce(l.toxic::VARCHAR, '*') AS toxic, count(*) AS n, avg(l.quality) AS mean_quality FROM documents d JOIN labels l USING (doc_id) GROUP BY CUBE(d.lang, l.toxic)")
def label_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    g = j.cube("lang", C("toxic").cast("string").alias("toxic")).agg(F.count("*").alias("n"), F.avg("quality").alias("mean_quality"))
    return g.select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("toxic", F.lit("*")).alias("toxic"), "n", "mean_quality")


@query("harmonic_quality", TOKEN_F1_SQL + " SELECT l AS doc_id, CASE WHEN hit = 0 THEN 0 ELSE 2 / (1 / (hit::DOUBLE / nl) + 1 / (hit::DOUBLE / nr)) END AS quality FROM s")
def harmonic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir, G.quality_tokens)
    p, r = C("hit") / F.greatest("nl", F.lit(1)), C("hit") / F.greatest("nr", F.lit(1))
    return s.select(C("l").alias("doc_id"), S.harmonic(p, r).alias("quality"))


ORDERS = "SELECT item_id AS task_id, provider FROM benchmark, (VALUES ('alpha'), ('beta'), ('gamma')) v(provider)"


@query("randomized_orders", f"SELECT task_id, provider, row_number() OVER (PARTITION BY task_id ORDER BY sha256(concat_ws(':', 42, task_id, provider))) AS place FROM ({ORDERS})")
def randomized_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of three providers for each benchmark item."""
    w = Window.partitionBy("task_id").orderBy(F.sha2(F.concat_ws(":", F.lit("42"), C("task_id").cast("string"), "provider"), 256))
    t = table(spark, sf_dir, "benchmark").select(C("item_id").alias("task_id"), F.explode(F.array(*map(F.lit, ("alpha", "beta", "gamma")))).alias("provider"))
    return t.select("task_id", "provider", F.row_number().over(w).cast("bigint").alias("place"))


@query("hash_sample", "SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY sha256('seed|' || doc_id), doc_id LIMIT 100)")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: the 100 rows of the smallest hash."""
    return table(spark, sf_dir, "documents").select("doc_id").orderBy(F.sha2(F.concat(F.lit("seed|"), C("doc_id").cast("string")), 256), "doc_id").limit(100)


@query("source_logsumexp", "SELECT source, m + ln(sum(exp(x - m))) AS lse FROM (SELECT source, n_chars / 1000.0::DOUBLE AS x, max(n_chars / 1000.0::DOUBLE) OVER (PARTITION BY source) AS m FROM documents) GROUP BY source, m")
def source_logsumexp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-sum-exp per source from a maximum and a scaled sum, in two aggregations."""
    d = table(spark, sf_dir, "documents").select("source", (C("n_chars") / 1000.0).alias("x"))
    top = d.groupBy("source").agg(F.max("x").alias("m"))
    return d.join(top, "source").groupBy("source", "m").agg(F.sum(F.exp(C("x") - C("m"))).alias("s")).select("source", (C("m") + F.log("s")).alias("lse"))


@query("candidate_disagreement", f"""
WITH c AS (SELECT page_id, 1 AS k, {VISIBLE} AS t FROM pages UNION ALL SELECT page_id, 2, regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '<[^>]+>', ' ', 'g') FROM pages),
b AS (SELECT page_id, k, x, count(*) AS n FROM (SELECT page_id, k, unnest({TOKENS('t')}) AS x FROM c) GROUP BY ALL), z AS (SELECT page_id, sum(n) AS n FROM b GROUP BY page_id),
h AS (SELECT a.page_id, sum(least(a.n, b2.n)) AS hit FROM b a JOIN b b2 ON a.page_id = b2.page_id AND a.x = b2.x AND a.k = 1 AND b2.k = 2 GROUP BY 1)
SELECT page_id, round(1 - 2 * hit::DOUBLE / n, 4) AS disagreement FROM z JOIN h USING (page_id)""")
def candidate_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 minus the token F1 of a page's two candidates."""
    p = pages(spark, sf_dir)
    article = F.regexp_replace(F.regexp_extract("html", r"(?is)<article[^>]*>(.*?)</article>", 1), r"<[^>]+>", " ")
    key = p.select(C("page_id").alias("l"), C("page_id").alias("r"))
    left = S.bag(p.select(C("page_id").alias("l"), G.visible_text(C("html")).alias("t")), ["l"], G.quality_tokens(C("t")))
    right = S.bag(p.select(C("page_id").alias("r"), article.alias("t")), ["r"], G.quality_tokens(C("t")))
    s = S.overlap(key, left, right).where("hit > 0")
    return s.select(C("l").alias("page_id"), F.round(1 - 2 * C("hit") / (C("nl") + C("nr")), 4).alias("disagreement"))
