"""Sharding by proportional stratified interleaving (DataFrame functions only).

Rows are shuffled by a seeded hash within their source and ranked; the row of rank r of a source with n rows stands at
the fraction (r - 1/2)/n. All rows in the order of these fractions are cut into shards with row counts at most one
apart, so every shard holds each source in the proportion of the whole.

Both rankings are exact prefix sums over cells of about a thousand rows: a source with a third of all rows is
ranked by as many tasks as its rows need.

Defined cases: null sources form a source of their own, which comes last among equal fractions; null texts hold no
bytes; repeated rows are placed as separate rows, and equal texts are not kept together (a group of a third of all rows would
break the law ``rows``); with fewer rows than shards the last shards stay empty; an empty
table gives an empty result; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookmill.llm._common import hash32, prefix_sums, source_key

ROW_OVERHEAD = 16


def stratified_shards(rows: DataFrame, shards: int = 40, seed: str = "shard", key: str = "doc_id", source: str = "source") -> DataFrame:
    """``rows`` with __bm_shard (int), __bm_slot (long, gapless from 0 within the shard); the rest passes through.

    ``rows`` is read several times; give a written table. Columns whose names begin with __bm_ are reserved.
    """
    others = [F.col(c) for c in rows.columns if c != key and dict(rows.dtypes)[c] in ("bigint", "int", "string", "double")]
    ties = [F.col(key), *others]
    # Rows of one key, or of none, are spread by their other columns.
    keyed = rows.withColumns({"__bm_src": source_key(F.col(source)), "__bm_pos": hash32(*ties, seed=seed)})
    one = F.lit(1).cast("long")
    ranked = prefix_sums(keyed, ["__bm_src"], "__bm_pos", ties, one, "__bm_rank", "__bm_n", "__bm_rows").drop("__bm_rows")
    at = ranked.withColumn("__bm_at", (F.col("__bm_rank") + F.lit(0.5)) / F.col("__bm_n")).drop("__bm_n", "__bm_pos")
    at = at.withColumns({"__bm_pos": F.floor(F.col("__bm_at") * F.lit(float(2**32))).cast("long"), "__bm_all": F.lit(0)})
    order = [F.col("__bm_at"), F.col("__bm_src"), F.col("__bm_rank")]
    placed = prefix_sums(at, ["__bm_all"], "__bm_pos", order, one, "__bm_i", "__bm_n", "__bm_rows")
    # Row i of n goes to shard floor(i * shards / n), whose first row is ceil(shard * n / shards).
    placed = placed.withColumn("__bm_shard", F.expr(f"__bm_i * {shards} div __bm_n"))
    first = F.expr(f"(__bm_shard * __bm_n + {shards - 1}) div {shards}")
    placed = placed.withColumn("__bm_slot", (F.col("__bm_i") - first).cast("long"))
    return placed.select(*rows.columns, F.col("__bm_shard").cast("int").alias("__bm_shard"), "__bm_slot")


def row_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (UTF-8 bytes of the text plus a fixed overhead) and text_crc32 of every document."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "source", (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
