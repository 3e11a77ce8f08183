"""Evaluation studies: example scores, structure scores, clustered bootstrap, paired providers, gates over runs, oracle units."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from difflib import SequenceMatcher
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookmill.functions.scoring import multiset_f1

STRUCTURE = ("heading_f1", "list_f1", "code_f1", "table_similarity", "structure_score")


def harmonic(*scores: Column) -> Column:
    """Harmonic mean; 0 as soon as one of them is 0."""
    some_zero = reduce(lambda a, b: a | b, [s == 0 for s in scores])
    return F.when(some_zero, 0.0).otherwise(len(scores) / sum((1 / F.nullif(s, F.lit(0.0)) for s in scores), F.lit(0.0)))


def example_score(whole: Column, positional: Column, ordered: Column, window: Column, leaks: Column) -> Column:
    """struct(quality, leakage, lie_index, margin, rejection, utility) from four F1s against the truth and an array of F1s against lies."""
    quality = harmonic(window, whole, positional, ordered)
    leak = F.array_max(leaks)
    return F.struct(quality.alias("quality"), leak.alias("leakage"), (F.array_position(leaks, leak) - 1).alias("lie_index"), (quality - leak).alias("margin"), (1 - leak).alias("rejection"), (quality * (1 - leak)).alias("utility"))


def markdown_structure(text: str | None) -> dict[str, list]:
    """Headings (with their level), list items, fenced code and pipe tables (rows of cells) of a Markdown text."""
    out: dict[str, list] = {"headings": [], "items": [], "code": [], "tables": []}
    fence: list[str] | None = None
    open_table = False
    for line in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = line.rstrip()
        if line.lstrip().startswith("```"):
            if fence is not None:
                out["code"].append("\n".join(fence))
            fence, open_table = ([] if fence is None else None), False
        elif fence is not None:
            fence.append(line)
        elif m := re.match(r"\s*(#{1,6})\s+(.+?)\s*#*\s*$", line):
            out["headings"].append(f"{len(m[1])}:{m[2]}")
            open_table = False
        elif m := re.match(r"\s*(?:[-+*]|\d+[.)])\s+(.+)$", line):
            out["items"].append(m[1])
            open_table = False
        else:
            cells = [c.strip() for c in line.strip().strip("|").split("|")] if "|" in line else []
            if cells and all(re.fullmatch(r":?-{3,}:?", c.replace(" ", "")) for c in cells):
                continue
            if len(cells) >= 2:
                if not open_table:
                    out["tables"].append([])
                out["tables"][-1].append(cells)
            open_table = len(cells) >= 2
    if fence is not None:
        out["code"].append("\n".join(fence))
    return out


def table_tokens(tables: list) -> list[str]:
    return [t for table in tables for t in ("TABLE", *(x for row in table for x in ("ROW", *(f"CELL:{' '.join(c.casefold().split())}" for c in row))))][:20_000]


def structure_score(candidate: str | None, reference: str | None) -> dict:
    """Agreement of two Markdown texts in each kind of structure that the reference has, and the mean of these."""
    seen, want = markdown_structure(candidate), markdown_structure(reference)
    f1 = lambda k: multiset_f1(seen[k], want[k]) if want[k] else None
    tables = SequenceMatcher(None, table_tokens(seen["tables"]), table_tokens(want["tables"]), autojunk=False).ratio() if want["tables"] else None
    parts = {"heading_f1": f1("headings"), "list_f1": f1("items"), "code_f1": f1("code"), "table_similarity": tables}
    known = [v for v in parts.values() if v is not None]
    return parts | {"structure_score": sum(known) / len(known) if known else None}


def clustered_bootstrap(rows: list[tuple[str, str, str, float, float]], samples: int, seed: bytes) -> list[float]:
    """Differences of the two arms for each replicate, from rows (language, cluster, unit, left, right).

    A replicate's value is the mean over languages of the mean over as many drawn clusters as the language has of the
    cluster's mean difference. Draws come from SHAKE-256 over the seed, the replicate and the draw's number, and are
    rejected where they would favour some clusters, so that they depend on the design alone: swapped arms give
    the same values with the other sign.
    """
    by: dict[str, dict[str, list[float]]] = {}
    for language, cluster, _, left, right in sorted(rows):
        by.setdefault(language, {}).setdefault(cluster, []).append(left - right)
    means = [[sum(x) / len(x) for _, x in sorted(c.items())] for _, c in sorted(by.items())]

    def draw(replicate: int, number: int, n: int) -> int:
        for attempt in range(1 << 16):
            x = int.from_bytes(hashlib.shake_256(seed + replicate.to_bytes(8, "big") + number.to_bytes(8, "big") + attempt.to_bytes(2, "big")).digest(8), "big")
            if x < (1 << 64) // n * n:
                return x % n
        raise RuntimeError("no draw was accepted")

    out = []
    for b in range(samples):
        number, total = 0, 0.0
        for m in means:
            chosen = 0.0
            for _ in m:
                chosen += m[draw(b, number, len(m))]
                number += 1
            total += chosen / len(m)
        out.append(total / len(means))
    return out


def metric_aggregate(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Per metric of ``names`` (null: the page failed) the mean over successes, their number, failures, bounds and deviation; and the
    overall mean of the metrics' means, where a metric without a success counts as 0."""
    stats = [x for n in names for x in (F.coalesce(F.avg(n), F.lit(0.0)).alias(n), F.count(n).alias(f"{n}_successful"), (F.count(F.lit(1)) - F.count(n)).alias(f"{n}_failed"), F.min(n).alias(f"{n}_min"), F.max(n).alias(f"{n}_max"), F.coalesce(F.stddev_samp(n), F.lit(0.0)).alias(f"{n}_std"))]
    out = rows.groupBy(*keys).agg(*stats)
    return out.withColumn("overall", sum((F.col(n) for n in names), F.lit(0.0)) / len(names))


def aggregate_delta(baseline: DataFrame, candidate: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Differences of two outputs of metric_aggregate, and whether the candidate may be promoted: no metric below, no page lost."""
    c = candidate.select(*keys, *[F.col(x).alias(f"__{x}") for x in candidate.columns if x not in keys])
    cols = ["overall", *names, *[f"{n}_{k}" for n in names for k in ("successful", "failed")]]
    j = baseline.join(c, keys).select(*keys, *[(F.col(f"__{x}") - F.col(x)).alias(f"{x}_delta") for x in cols])
    sound = reduce(lambda a, b: a & b, [(F.col(f"{n}_delta") >= 0) & (F.col(f"{n}_failed_delta") <= 0) for n in names])
    return j.withColumn("promoted", sound)


def provider_pairs(events: DataFrame, metrics: list[str]) -> DataFrame:
    """All pairs of providers by metric, from rows (task, cluster, provider, attempt, *metrics): tasks both have in their first
    attempt, the mean difference over clusters of the clusters' means, and how many tasks favour either."""
    first = events.withColumn("__n", F.row_number().over(Window.partitionBy("task", "provider").orderBy("attempt"))).where("__n = 1")
    long = first.select("task", "cluster", "provider", F.explode(F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*[F.col(m).cast("double") for m in metrics]))).alias("metric", "value")).where("value IS NOT NULL")
    a, b = long.withColumnsRenamed({"provider": "left", "value": "x"}), long.drop("cluster").withColumnsRenamed({"provider": "right", "value": "y"})
    pairs = a.join(b, ["task", "metric"]).where("left < right").withColumn("d", F.col("x") - F.col("y"))
    by = pairs.groupBy("left", "right", "metric", "cluster").agg(F.avg("d").alias("m"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("up"), F.sum(F.when(F.col("d") < 0, 1).otherwise(0)).alias("down"))
    return by.groupBy("left", "right", "metric").agg(F.avg("m").alias("mean_delta"), F.sum("n").alias("n_tasks"), F.count(F.lit(1)).alias("n_clusters"), F.sum("up").alias("n_left_better"), F.sum("down").alias("n_right_better"))


def run_gate(runs: DataFrame) -> DataFrame:
    """One row per experiment from runs (experiment, window, mode, corpus, protocol, verified): the reasons against comparing
    its runs: several corpora or protocols, windows without one cold and one warm run, runs that were not verified."""
    per = runs.groupBy("experiment", "window").agg(F.count_if(F.col("mode") == "cold").alias("cold"), F.count_if(F.col("mode") == "warm").alias("warm"))
    odd = per.groupBy("experiment").agg(F.count_if((F.col("cold") != 1) | (F.col("warm") != 1)).alias("odd"), F.count(F.lit(1)).alias("n_windows"))
    all_ = runs.groupBy("experiment").agg(F.min("corpus").alias("c0"), F.max("corpus").alias("c1"), F.min("protocol").alias("p0"), F.max("protocol").alias("p1"), F.bool_and("verified").alias("verified"))
    why = F.array_compact(F.array(
        F.when(F.col("c0") != F.col("c1"), "corpora_differ"), F.when(F.col("p0") != F.col("p1"), "protocols_differ"), F.when(F.col("n_windows") < 2, "too_few_windows"),
        F.when(F.col("odd") > 0, "window_not_paired"), F.when(~F.col("verified"), "artifacts_unverified"),
    ))
    return all_.join(odd, "experiment").select("experiment", "n_windows", (F.size(why) == 0).alias("passed"), F.array_join(why, ",").alias("reasons"))


def outermost(rows: DataFrame, chosen: Column) -> DataFrame:
    """Rows (doc, id, ancestors) that are chosen and have no chosen ancestor."""
    c = rows.where(chosen)
    above = c.select("doc", F.col("id").alias("a"))
    under = c.select("doc", "id", F.explode("ancestors").alias("a")).join(above, ["doc", "a"], "left_semi").select("doc", "id").distinct()
    return c.join(under, ["doc", "id"], "left_anti")


def alignment(candidate: list[str], source: list[str], most: int = 128) -> list[tuple[int, int]]:
    """Places (candidate, source) of a longest run of matches in both orders; tokens that the source has more than ``most`` times match nothing."""
    from bisect import bisect_left

    count, where = Counter(source), {}
    for j, t in enumerate(source):
        if count[t] <= most:
            where.setdefault(t, []).append(j)
    ends: list[int] = []
    kept: list[tuple[int, int, int]] = []
    at: list[int] = []
    for i, t in enumerate(candidate):
        for j in reversed(where.get(t, ())):
            k = bisect_left(ends, j)
            kept.append((i, j, at[k - 1] if k else -1))
            if k == len(ends):
                ends.append(j)
                at.append(len(kept) - 1)
            else:
                ends[k], at[k] = j, len(kept) - 1
    out, n = [], at[-1] if at else -1
    while n >= 0:
        i, j, n = kept[n]
        out.append((i, j))
    return out[::-1]
