"""Mixing sources to target weights (native: DataFrame functions only).

Targets are words per source. Each source's documents stand in a seeded permutation that is repeated as often as its
target asks for, and the stream is cut into blocks of about equal words: the source's exact block quota. A splitting
tree deals these quotas out: each node halves its shards, and the halves' quotas are one multivariate hypergeometric
draw, made by ranking the node's block tickets by a seeded hash and cutting the ranking at the half. At the leaves
each shard has its quota of every source, and the shards' quotas follow each other along the source's permutation, so
their blocks are disjoint. Inside a shard the order is another seeded hash.

Documents are taken whole: a document is taken where the target reaches its middle, so a source yields its target to
within half a document. The places in the permutation are exact prefix sums over cells of bounded size, spread by doc_id and
text, so a hot source is no hot task. The number of block tickets is fixed by shards and blocks per shard (plus one per
source at most), not by the data. Sources are named, not hosts: their targets are computed in one task.

Defined cases: null sources are a source of their own, ordered last; documents without words are never drawn; null
texts have no words; repeated rows count as separate documents; an empty table gives an empty result; a table without
words gives targets of 0; other columns are not looked at, and pass through the mix unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookmill.llm._common import NON_WS_RUN, Scratch, hash32, prefix_sums, small_or_plain, source_key

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # the mix holds 150 % of all words
MOST = 2  # times its own words, the most that a source gives
SHARDS = 16
BLOCKS_PER_SHARD = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NON_WS_RUN)), F.lit(0)).cast("long")


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def targets(sizes: DataFrame) -> DataFrame:
    """Sources (src, source_size) with their targets: the total shared by weight, none above MOST times its source,
    and what is above reshared by weight among the rest.

    With r = MOST * size / weight, the sources with the smallest r are full; the share of the rest is found where the
    first source stays below its bound. One row per source.
    """
    sized = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy("src")
    weight = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    s = sized.withColumn("w", weight.cast("long"))
    every = Window.partitionBy()
    before = Window.orderBy(F.expr(f"CAST({MOST} * source_size AS DOUBLE) / w"), "src").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "full": F.coalesce(F.sum(F.col("source_size") * MOST).over(before), F.lit(0)),
        "w_left": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)),
        "all": F.sum("source_size").over(every),
    })
    # The level at which this source and all after it share what those before it leave; it holds from the first source below it.
    s = s.withColumn("level", (F.col("all") * SHARE[0] / SHARE[1] - F.col("full")) / F.col("w_left"))
    s = s.withColumn("fits", F.col("level") * F.col("w") <= F.col("source_size") * MOST)
    s = s.withColumn("share", F.min(F.when(F.col("fits"), F.struct(F.expr(f"CAST({MOST} * source_size AS DOUBLE) / w").alias("r"), F.col("src"), F.col("level")))).over(every)["level"])
    target = F.least(F.col("source_size") * float(MOST), F.coalesce(F.col("share") * F.col("w"), F.col("source_size") * float(MOST)))
    return s.select("src", "source_size", target.alias("target"))


def split_tree(quotas: DataFrame, shards: int, seed: str) -> DataFrame:
    """Deals the blocks of (src, blocks) out to shards: rows (src, shard, first, n), disjoint ranges of block numbers.

    Each level is one draw per node: the node's tickets are ranked by hash and cut in proportion to its two halves.
    """
    t = quotas.select("src", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("ticket"))
    t = t.withColumns({"lo": F.lit(0), "hi": F.lit(shards)})
    for level in range(max(0, math.ceil(math.log2(shards)))):
        node = Window.partitionBy("lo", "hi")
        rank = F.row_number().over(node.orderBy(hash32(F.col("src"), F.col("ticket"), seed=f"{seed}-tree{level}"), "src", "ticket"))
        mid = F.expr("lo + (hi - lo) div 2")
        t = t.withColumns({"rank": rank, "k": F.count(F.lit(1)).over(node), "mid": mid})
        left = F.col("rank") * (F.col("hi") - F.col("lo")) <= F.col("k") * (F.col("mid") - F.col("lo"))
        single = F.col("hi") - F.col("lo") <= 1
        t = t.select("src", "ticket", F.when(single | left, F.col("lo")).otherwise(F.col("mid")).alias("lo"), F.when(single | ~left, F.col("hi")).otherwise(F.col("mid")).alias("hi"))
    leaf = t.groupBy("src", F.col("lo").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    first = F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return leaf.withColumn("first", first)


def mix(docs: DataFrame, shards: int = SHARDS, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, digest (of the text), size, source_size, target, taken, draws.

    ``draws`` lists the takes of the document as (copy, block, shard, at): the copy's number, its block in the source's
    stream, the output shard that the tree dealt this block to, and the hash by which the shard is ordered.
    """
    narrow = docs.select("doc_id", "source", source_key(F.col("source")).alias("src"), word_count(F.col("text")).alias("size"), text_digest(F.col("text")).alias("digest"))
    narrow = Scratch(narrow.withColumn("pos", hash32(F.col("doc_id"), F.col("digest"), seed=seed)), "mix-sizes").df
    goal = targets(narrow)
    total = F.sum("target").over(Window.partitionBy())
    blocks = F.greatest(F.lit(1), F.round(F.col("target") * (shards * BLOCKS_PER_SHARD) / total).cast("int"))
    goal = goal.withColumns({"blocks": F.when(total > 0, blocks).otherwise(F.lit(1)), "words": F.round("target").cast("long")})
    goal = Scratch(goal, "mix-goal").df
    quota = split_tree(goal.select("src", "blocks"), shards, seed).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("first", "shard"))).alias("quota"))
    goal = small_or_plain(Scratch(goal.join(quota, "src"), "mix-quota"))
    placed = prefix_sums(narrow, ["src"], "pos", [F.col("doc_id"), F.col("size"), F.col("digest")], F.col("size"), "before", "src_words", "src_rows")
    d = placed.join(goal, "src")
    start = lambda c: c * F.col("source_size") + F.col("before")
    copies = F.filter(F.sequence(F.lit(0), F.lit(MOST - 1)), lambda c: (F.col("size") > 0) & (2 * start(c) + F.col("size") <= 2 * F.col("words")))
    blocked = F.transform(copies, lambda c: F.struct(c.alias("copy"), F.call_function("div", start(c) * F.col("blocks"), F.col("words")).alias("block")))
    draw = lambda x: F.struct(
        x["copy"].alias("copy"),
        x["block"].alias("block"),
        F.array_max(F.filter(F.col("quota"), lambda q: q["first"] <= x["block"]))["shard"].alias("shard"),
        hash32(F.col("doc_id"), F.col("digest"), x["copy"], seed=f"{seed}-local").alias("at"),
    )
    d = d.withColumn("draws", F.transform(blocked, draw))
    return d.select("doc_id", "source", "digest", "size", "source_size", "target", (F.size("draws") * F.col("size")).cast("long").alias("taken"), "draws")


def mixed_documents(docs: DataFrame, shards: int = SHARDS, seed: str = "mix") -> DataFrame:
    """The mix itself with the columns of ``docs``: each document as often as it is drawn, dealt to the shards and
    shuffled inside them.

    Rows that repeat a doc_id with its source and text are one row here, drawn as often as all of them together.
    """
    names = {"doc_id": "__bm_id", "source": "__bm_src", "digest": "__bm_digest"}
    drawn = mix(docs, shards, seed).select(*[F.col(a).alias(b) for a, b in names.items()], F.explode("draws").alias("__bm_d"))
    drawn = Scratch(drawn, "mix-draws").df
    own = docs.withColumn("__bm_key", text_digest(F.col("text")))
    again = docs.groupBy("doc_id", "source", text_digest(F.col("text")).alias("digest")).agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    again = Scratch(again.select(*[F.col(a).alias(b) for a, b in names.items()]), "mix-again")
    same = F.col("doc_id").eqNullSafe(F.col("__bm_id")) & F.col("source").eqNullSafe(F.col("__bm_src")) & (F.col("__bm_key") == F.col("__bm_digest"))
    if not again.df.isEmpty():
        twice = small_or_plain(again)
        many = own.join(twice, same, "left_semi").groupBy(F.col("doc_id").alias("__bm_id"), F.col("source").alias("__bm_src"), F.col("__bm_key").alias("__bm_digest"))
        many = many.agg(F.any_value(F.struct(*[F.col(c) for c in own.columns])).alias("__bm_row")).select("__bm_row.*")
        own = own.join(twice, same, "left_anti").unionByName(many)
    dealt = own.join(drawn, same)
    # A shard is written by up to 64 tasks, each with one range of its order.
    dealt = dealt.withColumns({"__bm_shard": F.col("__bm_d.shard"), "__bm_at": F.col("__bm_d.at")})
    part = F.shiftright("__bm_at", 26)
    return dealt.repartition(F.col("__bm_shard"), part).sortWithinPartitions("__bm_shard", "__bm_at").select(*docs.columns)
