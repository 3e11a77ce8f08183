"""Quantiles of three kinds, distribution summaries and a paired bootstrap that any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interpolated(col: str, p: float) -> Column:
    """Linear interpolation between the order statistics around (n - 1) * p."""
    return F.percentile(F.col(col).cast("double"), F.lit(p))


def nearest_rank(col: str, p: float) -> Column:
    """The order statistic of rank ceil(p * n)."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {col})")


def floor_index(values: Column, p: float) -> Column:
    """Of a sorted array the element at min(n - 1, floor(n * p))."""
    return F.element_at(values, F.least(F.size(values), F.floor(F.size(values) * F.lit(p)).cast("int") + 1))


def distribution(rows: DataFrame, keys: list[str], col: str) -> DataFrame:
    """count, mean, median, p90, p95, p99, min and max of a column per key."""
    return rows.groupBy(*keys).agg(
        F.count(col).alias("n"), F.avg(col).alias("mean"), interpolated(col, 0.5).alias("median"), interpolated(col, 0.9).alias("p90"),
        interpolated(col, 0.95).alias("p95"), interpolated(col, 0.99).alias("p99"), F.min(col).alias("min"), F.max(col).alias("max"),
    )


def hash_draw(n: Column, *parts: Column) -> Column:
    """A number in 1..n from an MD5 of the parts: the draw of a bootstrap that every engine repeats."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % n + 1).cast("bigint")


def paired_bootstrap(pairs: DataFrame, samples: int, seed: int) -> DataFrame:
    """One row: mean delta, its bootstrap mean, 95 % interval and share of positive draws, over rows (unit, delta) with
    unit numbered from 1. Replicates are dealt to tasks; each joins its draws to the deltas."""
    spark = pairs.sparkSession
    n = pairs.agg(F.count(F.lit(1)).alias("n"))
    draws = spark.range(1, samples + 1).withColumnRenamed("id", "b").join(F.broadcast(n)).select("b", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    draws = draws.select("b", hash_draw(F.col("n"), F.lit(seed), F.col("b"), F.col("i")).alias("unit"))
    means = draws.join(pairs, "unit").groupBy("b").agg((F.sum("delta") / F.count(F.lit(1))).alias("d"))
    return means.agg(F.avg("d").alias("boot_mean"), interpolated("d", 0.025).alias("ci_low"), interpolated("d", 0.975).alias("ci_high"), F.avg(F.when(F.col("d") > 0, 1.0).otherwise(0.0)).alias("win_fraction"))
