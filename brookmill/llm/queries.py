"""Queries over the operators of this subpackage, and their SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.llm import chat, mixing, order_minhash, packing, paragraph_dedup, sharding, toxicity, url_filter
from brookmill.llm._common import Scratch
from brookmill.llm.embedding_dedup import near_duplicates as near_duplicate_vectors
from brookmill.llm.exact_dedup import copy_groups


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str, tokenizer_file: str | None = None) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file or vocabulary("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op2_url_char_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.score_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


OP2_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(regexp_extract(rest, '(?s)^[^/?#]*[^?#]*'), length(regexp_extract(rest, '^[^/?#]*')) + 1) AS path,
         substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS after FROM u),
rules(suffix, prefix, says) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit AS (
  SELECT page_id, arg_max({'rule': suffix || prefix, 'says': says}, length(suffix || prefix)) AS r
  FROM (SELECT DISTINCT * FROM h) JOIN rules ON (host = suffix OR ends_with(host, '.' || suffix)) AND starts_with(path, prefix) GROUP BY page_id),
t AS (
  SELECT row_number() OVER () AS id, h.page_id, host, path, r.rule AS rule, r.says AS says, host || after AS s,
         ('0x' || substr(md5('url-fold|' || host || after), 1, 8))::BIGINT % 5 = 0 AS held FROM h LEFT JOIN fit USING (page_id)),
g AS (SELECT id, CASE WHEN NOT held THEN says END AS label, substr(repeat(chr(2), 4) || s, i, 5) AS gram FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM t)),
distinct_grams AS (SELECT gram, count(*) FILTER (label = 'allow') AS n1, count(*) FILTER (label = 'block') AS n0 FROM g GROUP BY gram),
ks AS (SELECT unnest(range(1, 6)) AS k),
c AS (SELECT right(gram, k) AS s, sum(n1) AS c1, sum(n0) AS c0 FROM distinct_grams, ks WHERE n1 + n0 > 0 GROUP BY 1),
x AS (SELECT left(s, length(s) - 1) AS s, sum(c1) AS total1, sum(c0) AS total0, count(*) FILTER (c1 > 0) AS kinds1, count(*) FILTER (c0 > 0) AS kinds0 FROM c GROUP BY 1),
o AS (
  SELECT gram, k, coalesce(c1, 0) AS c1, coalesce(c0, 0) AS c0, coalesce(total1, 0) AS total1, coalesce(total0, 0) AS total0, coalesce(kinds1, 0) AS kinds1, coalesce(kinds0, 0) AS kinds0
  FROM (SELECT gram, k, right(gram, k) AS own, left(right(gram, k), k - 1) AS ctx FROM distinct_grams, ks) LEFT JOIN c ON c.s = own LEFT JOIN x ON x.s = ctx),
l AS (
  SELECT gram,
    list_reduce(list_prepend({'a': 0::DOUBLE, 'b': 1::DOUBLE, 'p': 1.0::DOUBLE / 256}, list({'a': (CASE WHEN total1 > 0 THEN c1 / (total1 + kinds1) ELSE 0 END)::DOUBLE, 'b': (CASE WHEN total1 > 0 THEN kinds1 / (total1 + kinds1) ELSE 1 END)::DOUBLE, 'p': 0::DOUBLE} ORDER BY k)),
      lambda q, z: {'a': 0::DOUBLE, 'b': 1::DOUBLE, 'p': z.a + z.b * q.p}).p AS p1,
    list_reduce(list_prepend({'a': 0::DOUBLE, 'b': 1::DOUBLE, 'p': 1.0::DOUBLE / 256}, list({'a': (CASE WHEN total0 > 0 THEN c0 / (total0 + kinds0) ELSE 0 END)::DOUBLE, 'b': (CASE WHEN total0 > 0 THEN kinds0 / (total0 + kinds0) ELSE 1 END)::DOUBLE, 'p': 0::DOUBLE} ORDER BY k)),
      lambda q, z: {'a': 0::DOUBLE, 'b': 1::DOUBLE, 'p': z.a + z.b * q.p}).p AS p0
  FROM o GROUP BY gram),
sc AS (SELECT t.*, coalesce(m, 0) AS score FROM t LEFT JOIN (SELECT id, round(sum(round(ln(p1) - ln(p0), 9)) / count(*), 9) AS m FROM g JOIN l USING (gram) GROUP BY id) USING (id)),
hist AS (SELECT greatest(-400, least(400, floor(score * 100))) AS step, count(*) FILTER (says = 'allow') AS good, count(*) FILTER (says = 'block') AS bad FROM sc WHERE says IS NOT NULL AND held GROUP BY 1),
cuts AS (
  SELECT k AS step, round((SELECT coalesce(sum(good), 0) FROM hist WHERE hist.step >= k)::DOUBLE / greatest(1, (SELECT sum(good) FROM hist))
    + (SELECT coalesce(sum(bad), 0) FROM hist WHERE hist.step < k)::DOUBLE / greatest(1, (SELECT sum(bad) FROM hist)), 9) AS gain
  FROM range(-400, 401) x(k) WHERE (SELECT count(*) FROM hist) > 0),
cut AS (SELECT coalesce((SELECT step / 100.0::DOUBLE FROM cuts ORDER BY gain DESC, abs(step), step LIMIT 1), 0) AS cut)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score FROM sc, cut
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scores = toxicity.score_documents(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scores.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(_table(spark, sf_dir, "documents"))
    drawn = lambda c, field: F.get(F.filter("draws", lambda d: d["copy"] == c), F.lit(0))[field].cast("bigint").alias(f"{field}{c}")
    fields = [drawn(c, field) for c in range(mixing.MOST) for field in ("block", "shard", "at")]
    return mix.select("doc_id", "size", "source_size", "target", "taken", *fields)


def _tree_sql(shards: int) -> str:
    """Common table expressions of the splitting tree, one pair a level: the draw's ranks, then the halves."""
    ctes = [f"d0 AS (SELECT src, unnest(range(0, blocks)) AS ticket, 0 AS lo, {shards} AS hi FROM g)"]
    for k in range((shards - 1).bit_length()):
        rank = f"row_number() OVER (PARTITION BY lo, hi ORDER BY ('0x' || substr(md5(concat_ws('|', 'mix-tree{k}', src, ticket::VARCHAR)), 1, 8))::BIGINT, src, ticket)"
        ctes.append(f"r{k} AS (SELECT *, {rank} AS rank, count(*) OVER (PARTITION BY lo, hi) AS k, lo + (hi - lo) // 2 AS mid FROM d{k})")
        left = "rank * (hi - lo) <= k * (mid - lo)"
        ctes.append(f"d{k + 1} AS (SELECT src, ticket, CASE WHEN hi - lo <= 1 OR {left} THEN lo ELSE mid END AS lo, CASE WHEN hi - lo <= 1 OR NOT {left} THEN hi ELSE mid END AS hi FROM r{k})")
    return ",\n".join(ctes) + f",\nleaf AS (SELECT src, lo AS shard, count(*) AS n FROM d{(shards - 1).bit_length()} GROUP BY ALL)"


def _copy_sql(c: int) -> str:
    start = f"({c} * source_size + ahead)"
    return f"CASE WHEN size > 0 AND 2 * {start} + size <= 2 * words THEN {start} * blocks // words END AS block{c}"


OP4_SQL = rf"""
WITH n AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src, md5(coalesce(text, '')) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(concat_ws('|', 'mix', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 8))::BIGINT AS pos FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM n GROUP BY src),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY src) - 1) % 3 + 1] AS w FROM s),
o AS (
  SELECT *, (2 * source_size)::DOUBLE / w AS r, coalesce(sum(2 * source_size) OVER before, 0)::BIGINT AS "full",
         (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::BIGINT AS w_left, (sum(source_size) OVER ())::BIGINT AS everything
  FROM w WINDOW before AS (ORDER BY (2 * source_size)::DOUBLE / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (everything * 3 / 2 - "full") / w_left AS level FROM o),
t AS (
  SELECT src, source_size, least(source_size * 2.0::DOUBLE, coalesce((SELECT level FROM l WHERE level * w <= 2 * source_size ORDER BY r, src LIMIT 1) * w, source_size * 2.0::DOUBLE)) AS target FROM l),
g AS (SELECT *, round(target)::BIGINT AS words, CASE WHEN sum(target) OVER () > 0 THEN greatest(1, round(target * {mixing.SHARDS * mixing.BLOCKS_PER_SHARD} / sum(target) OVER ())::INT) ELSE 1 END AS blocks FROM t),
{_tree_sql(mixing.SHARDS)},
quota AS (SELECT src, shard, coalesce(sum(n) OVER (PARTITION BY src ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "first", n FROM leaf),
c AS (SELECT *, sum(size) OVER (PARTITION BY src ORDER BY pos, doc_id, size, digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS ahead FROM n JOIN g USING (src)),
b AS (SELECT *, row_number() OVER () AS id, {_copy_sql(0)}, {_copy_sql(1)} FROM c),
p AS (
  SELECT b.*, q0.shard AS shard0, q1.shard AS shard1 FROM b
  LEFT JOIN quota q0 ON q0.src = b.src AND block0 >= q0."first" AND block0 < q0."first" + q0.n
  LEFT JOIN quota q1 ON q1.src = b.src AND block1 >= q1."first" AND block1 < q1."first" + q1.n),
a AS (SELECT *, concat_ws('|', 'mix-local', coalesce(doc_id::VARCHAR, ''), digest) AS local FROM p)
SELECT doc_id, size, source_size, target, ((CASE WHEN shard0 IS NULL THEN 0 ELSE size END) + (CASE WHEN shard1 IS NULL THEN 0 ELSE size END))::BIGINT AS taken,
       block0::BIGINT AS block0, shard0::BIGINT AS shard0, CASE WHEN shard0 IS NOT NULL THEN ('0x' || substr(md5(local || '|0'), 1, 8))::BIGINT END AS at0,
       block1::BIGINT AS block1, shard1::BIGINT AS shard1, CASE WHEN shard1 IS NOT NULL THEN ('0x' || substr(md5(local || '|1'), 1, 8))::BIGINT END AS at1
FROM a
"""


def op5_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = Scratch(sharding.row_sizes(_table(spark, sf_dir, "documents")), "shard-sizes").df
    cut = sharding.stratified_shards(sized, shards=40)
    return cut.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("__bm_shard").alias("shard"), F.col("__bm_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_event_sourced_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marker = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(marker).alias("text"))
    return chat.read_back(chat.format_log(chat.streamed_log(turns.unionByName(more))))


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, length('<|turn|>' || replace(regexp_replace(replace(role, '␛', '␛e'), '([<\[])(\||/?s>|/?INST\]|</?SYS>>)', '\1␛.\2', 'g'), chr(10), '␛n') || chr(10)
    || regexp_replace(replace(text, '␛', '␛e'), '([<\[])(\||/?s>|/?INST\]|</?SYS>>)', '\1␛.\2', 'g') || '<|end|>' || chr(10)) AS n FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = copy_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", F.col("group_size").cast("long"), "kept", "text_sha256")


OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST)
"""


def op8_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op9_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated_spans(_table(spark, sf_dir, "documents"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
u AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v WHERE ok),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(deg.n, 0) AS n_links, least(vec_id, coalesce(comp.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(comp.b, vec_id)) AS kept
FROM v LEFT JOIN deg ON deg.a = vec_id LEFT JOIN comp ON comp.a = vec_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_sum_of_squares_packing": op1_sum_of_squares_packing, "op2_url_char_lm": op2_url_char_lm, "op3_toxicity": op3_toxicity, "op4_source_mixing": op4_source_mixing, "op5_stratified_shards": op5_stratified_shards, "op6_event_sourced_chat": op6_event_sourced_chat, "op7_exact_dedup": op7_exact_dedup, "op8_spherical_caps": op8_spherical_caps, "op9_paragraph_minhash": op9_paragraph_minhash, "op10_order_minhash": op10_order_minhash}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_char_lm": OP2_SQL, "op4_source_mixing": OP4_SQL, "op6_event_sourced_chat": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op8_spherical_caps": OP8_SQL}
