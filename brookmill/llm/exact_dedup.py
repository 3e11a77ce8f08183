"""Exact deduplication with a heavy-hitter split (native: DataFrame functions only).

A Misra-Gries summary finds every digest with more than a set share of the rows. The winners of those digests are
verified by an exact count and broadcast, and rows of those digests are settled where they are read; all other digests
are shuffled, none of which can be large.

Defined cases: a null text counts as empty; empty texts are equal to each other; rows repeated in every column are
copies like any other, and one of them stays; a null doc_id loses a tie against any other; an empty table gives an
empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookmill.llm._common import WS_CLASS, Scratch

#: Share of the rows from which a digest may be settled by broadcast; at most 1/HEAVY_SHARE digests are.
HEAVY_SHARE = 0.002


def text_digest(text: Column) -> Column:
    """SHA-256 (lower-case hex) of the text without white space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), f"{WS_CLASS}+", ""), 256)


def copy_groups(docs: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """One row per document: doc_id, n_chars (code points of the text), text_sha256, keep_id, group_size, kept.

    ``docs`` needs doc_id and text. Of equal texts the longest original stays, then the smallest doc_id.
    """
    narrow = docs.select(
        F.col("doc_id"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        text_digest(F.col("text")).alias("text_sha256"),
        F.monotonically_increasing_id().alias("rid"),
    )
    narrow = Scratch(narrow, "exact-digests").df
    # Ascending order puts the winner first; rid only tells repeated rows apart.
    order = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("id"), F.col("rid").alias("rid"))
    suspects = narrow.freqItems(["text_sha256"], heavy_share).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    heavy = (
        narrow.join(F.broadcast(suspects), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    )
    heavy = Scratch(heavy, "exact-heavy").df
    settled = narrow.join(F.broadcast(heavy), "text_sha256")
    w = Window.partitionBy("text_sha256")
    rest = narrow.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    rest = rest.withColumn("best", F.min(order).over(w)).withColumn("group_size", F.count(F.lit(1)).over(w))
    cols = ["doc_id", "n_chars", "text_sha256", F.col("best.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept")]
    return settled.select(*cols).unionByName(rest.select(*cols))


def exact_dedup(docs: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """The documents that stay, with all their columns.

    The rows that stay are found by (doc_id, length, digest); where several rows agree in these they are repeats of
    one another, and one of them is taken.
    """
    kept = copy_groups(docs, heavy_share).where("kept").select(
        F.col("doc_id").alias("__bm_id"), F.col("n_chars").alias("__bm_n"), F.col("text_sha256").alias("__bm_sha")
    )
    repeats = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("__bm_id"))
    repeats = Scratch(repeats, "exact-repeats").df
    same = F.col("doc_id").eqNullSafe(F.col("__bm_id")) & (F.length(F.coalesce("text", F.lit(""))) == F.col("__bm_n")) & (text_digest(F.col("text")) == F.col("__bm_sha"))
    out = docs.join(Scratch(kept, "exact-kept").df, same, "left_semi")
    if repeats.isEmpty():
        return out
    twice = F.col("doc_id").eqNullSafe(F.col("__bm_id"))
    once = out.join(repeats, twice, "left_anti")
    many = out.join(repeats, twice, "left_semi").groupBy(F.col("doc_id").alias("__bm_id"), F.length(F.coalesce("text", F.lit(""))).alias("__bm_n"), text_digest(F.col("text")).alias("__bm_sha"))
    return once.unionByName(many.agg(F.any_value(F.struct(*[F.col(c) for c in docs.columns])).alias("__bm_row")).select("__bm_row.*"))
