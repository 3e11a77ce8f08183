"""Crawl frontier in batch: admission, fair order over hosts, budgets, breadth-first crawls, yield curves.

The per-host state machine for live crawls is in brookmill.streaming.frontier.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def admit(candidates: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New URLs, and known ones that a duplicate improves.

    candidates: canonical, host, depth, priority, ready_at, ord; known: canonical, depth, priority, ready_at, state.
    The first admission of a URL wins; a duplicate lowers depth and ready_at and raises priority of a URL that waits.
    """
    first = candidates.groupBy("canonical").agg(F.min(F.struct("ord", "host", "depth", "priority", "ready_at")).alias("a"), (F.count(F.lit(1)) - 1).alias("n_duplicates"), F.min("depth").alias("depth"), F.max("priority").alias("priority"), F.min("ready_at").alias("ready_at"))
    new = first.join(known.select("canonical"), "canonical", "left_anti").select("canonical", "a.host", "depth", "priority", "ready_at", "a.ord", "n_duplicates")
    better = first.select("canonical", F.col("depth").alias("d"), F.col("priority").alias("p"), F.col("ready_at").alias("r")).join(known.where("state IN ('queued', 'retry_wait')"), "canonical")
    better = better.select("canonical", F.least("depth", "d").alias("depth"), F.greatest("priority", "p").alias("priority"), F.least("ready_at", "r").alias("ready_at"))
    return new, better


def fair_order(entries: DataFrame) -> DataFrame:
    """Order of leases with no host delay: hosts take turns; a host's turn goes to its entry of highest priority, then
    earliest order; the turn among hosts is by the priority of their first entries, then host. Adds turn and place."""
    own = Window.partitionBy("host").orderBy(F.desc("priority"), "ord")
    e = entries.withColumns({"turn": F.row_number().over(own), "head": F.first("priority").over(own)})
    return e.withColumn("place", F.row_number().over(Window.partitionBy("turn").orderBy(F.desc("head"), "host"))).drop("head")


def within_budgets(ordered: DataFrame, total: int, per_host: int) -> DataFrame:
    """Adds reason: null, global_fetch_budget or host_fetch_budget, for entries with turn and place."""
    turns = ordered.where(F.col("turn") <= per_host).groupBy("turn").agg(F.count(F.lit(1)).alias("n"))
    before = turns.select("turn", F.coalesce(F.sum("n").over(Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    j = ordered.join(before, "turn", "left")
    over = F.when(F.col("turn") > per_host, "host_fetch_budget").when(F.col("before") + F.col("place") > total, "global_fetch_budget")
    return j.withColumn("reason", over).drop("before")


def next_wake(entries: DataFrame, hosts: DataFrame, now: float) -> DataFrame:
    """Earliest time after ``now`` at which a host can be claimed (host, wake_at)."""
    ready = entries.groupBy("host").agg(F.min("ready_at").alias("ready_at"))
    at = F.greatest("ready_at", F.coalesce("next_allowed_at", F.lit(0.0)))
    return ready.join(hosts, "host", "left").select("host", F.greatest(at, F.lit(now)).alias("wake_at"))


def crawl_depths(seeds: DataFrame, links: DataFrame, max_depth: int) -> DataFrame:
    """Breadth-first depths (id, depth) over links (src, dst), level by level: each level is one join and one anti join."""
    level = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    reached = [level]
    for d in range(1, max_depth + 1):
        seen = reduce(DataFrame.unionByName, reached).select("id")
        nxt = level.join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        level = nxt.withColumn("depth", F.lit(d))
        reached.append(level)
    return reduce(DataFrame.unionByName, reached)


def priority(policy: str, depth: Column, overlap: Column | None = None, ident: Column | None = None, seed: int = 0, constant: int = 0) -> Column:
    """Priority of a link under a policy: constant, breadth_first, random (63 bits of a SHA-256) or anchor_overlap."""
    if policy == "constant":
        return F.lit(constant).cast("bigint")
    if policy == "breadth_first":
        return (-depth).cast("bigint")
    if policy == "random":
        digest = F.sha2(F.concat(F.lit(str(seed)), F.decode(F.unhex(F.lit("00")), "UTF-8"), ident), 256)
        low = F.conv(F.concat(F.conv(F.conv(F.substring(digest, 1, 1), 16, 10).cast("int") % 8, 10, 16), F.substring(digest, 2, 15)), 16, 10)
        return low.cast("bigint")
    if policy == "anchor_overlap":
        return (overlap * 1000 - depth).cast("bigint")
    raise ValueError(f"unknown policy {policy!r}")


def yield_curve(trace: DataFrame, total_targets: int) -> DataFrame:
    """Rows of a trace (ord, target, payload_bytes) with running hits and bytes spent on pages that are no targets."""
    w = Window.orderBy("ord")
    one = F.when(F.col("target"), 1).otherwise(0)
    return trace.select("ord", F.sum(one).over(w).alias("hits"), F.sum(F.when(F.col("target"), 0).otherwise(F.col("payload_bytes"))).over(w).alias("wasted_bytes"), (F.sum(one).over(w) / total_targets).alias("share"))


def token_bucket(arrivals: DataFrame, burst: float = 5.0, rate: float = 2.0) -> DataFrame:
    """Grants of a token bucket per host over arrivals (host, at): a recurrence folded over each host's sorted arrivals.

    Waiting is unbounded; each arrival takes one token and starts when it is there.
    """
    start = F.struct(F.lit(burst).alias("tokens"), F.lit(0.0).alias("clock"), F.array().cast("array<struct<at:double,start:double>>").alias("out"))

    def step(s: Column, at: Column) -> Column:
        clock = F.greatest(s["clock"], at)
        have = F.least(F.lit(burst), s["tokens"] + (clock - s["clock"]) * rate)
        begin = F.when(have >= 1, clock).otherwise(clock + (1 - have) / rate)
        left = F.when(have >= 1, have - 1).otherwise(0.0)
        return F.struct(left.alias("tokens"), begin.alias("clock"), F.concat(s["out"], F.array(F.struct(at.alias("at"), begin.alias("start")))).alias("out"))

    per_host = arrivals.groupBy("host").agg(F.sort_array(F.collect_list(F.col("at").cast("double"))).alias("ats"))
    return per_host.select("host", F.explode(F.aggregate("ats", start, step)["out"]).alias("g")).select("host", "g.at", "g.start")
