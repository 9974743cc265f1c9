"""Ranks of large groups without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tie_rank(x: Column, keys: Sequence[str | Column]) -> Column:
    """Tie-averaged rank inside small groups (one date's symbols, one symbol's dates)."""
    w = Window.partitionBy(*keys).orderBy(x)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, x))
    return F.rank().over(w) + (ties - 1) / 2


def average_rank(df: DataFrame, x: str, out: str, keys: Sequence[str], buckets: int = 64) -> DataFrame:
    """Tie-averaged rank inside groups of any size; rows with null x are dropped.

    Equal values are counted first, so ties shuffle as one row per task. The distinct values of
    a group are cut into ranges at approximate quantiles, each range is ranked on its own, and the
    counts of the ranges before it are added. The cuts only balance the work; ranks are exact.
    """
    keys = list(keys)
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_n"))
    marks = [i / buckets for i in range(1, buckets)]
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(x, marks, 10000).alias("_cuts"))
    placed = counts.join(cuts, keys).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(x)))).drop("_cuts")
    per_range = placed.groupBy(*keys, "_b").agg(F.sum("_n").alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per_range = per_range.withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m")
    inside = Window.partitionBy(*keys, "_b").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    ranks = placed.join(per_range, keys + ["_b"]).withColumn(out, below + (F.col("_n") + 1) / 2)
    return df.join(ranks.select(*keys, x, out), keys + [x])
