"""Exact quantiles of groups of any size by distributed selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.sources.store import through_table

#: Distinct values that one task may sort to find a rank among them.
RANGE_VALUES = 1 << 20
#: Ranges that a larger one is cut into.
CUTS = 512


def value_counts(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column | str]) -> DataFrame:
    """(keys, _name, _x, _n): how often each value comes in each group, written once.

    Equal values combine on the map side and distinct ones are spread over all tasks, whatever group they are in. Nulls don't count.
    """
    cells = [F.struct(F.lit(name).alias("_name"), F.col(v).cast("double").alias("_x") if isinstance(v, str) else v.cast("double").alias("_x")) for name, v in values.items()]
    rows = df.select(*keys, F.explode(F.array(*cells)).alias("_cell")).select(*keys, "_cell.*").where("_x is not null")
    # -0.0 and 0.0 are one value to groupBy
    return through_table(rows.groupBy(*keys, "_name", "_x").agg(F.count(F.lit(1)).alias("_n")), "value-counts")


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the keys of the left side stay."""
    mine = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(mine[f"_r_{k}"])
    return left.join(mine, on, how).drop(*[f"_r_{k}" for k in keys])


def _ranks(shares: Sequence[float]) -> list[Column]:
    """The ranks (from 0) next to each share of ``_all`` values."""
    at = [F.lit(float(q)) * (F.col("_all") - 1) for q in shares]
    return [f(a).cast("long") for a in at for f in (F.floor, F.ceil)]


def _narrowed(ranges: DataFrame, sizes: DataFrame, group: list[str], shares: Sequence[float], most: int) -> tuple[DataFrame, DataFrame]:
    """Cut ranges of more than ``most`` values and keep the parts that hold a wanted rank.

    ``ranges``: group, _range, _x, _n; ``sizes``: one row per range with _all (values of the group), _below (values before
    the range), _m (distinct values in it).
    """
    each = [*group, "_range"]
    wide = sizes.where(F.col("_m") > most)
    narrow = same_keys(ranges, sizes.where(F.col("_m") <= most).select(*each), each)
    inside = same_keys(ranges, wide.select(*each, "_all", F.col("_below").alias("_before")), each)
    marks = [i / CUTS for i in range(1, CUTS)]
    # the cuts only decide how evenly the values fall; every count is exact
    cuts = inside.groupBy(*each).agg(F.percentile_approx("_x", F.lit(marks), 20 * CUTS).alias("_cuts"))
    parts = same_keys(inside, through_table(cuts, "cuts"), each).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col("_x")))).drop("_cuts")
    counted = parts.groupBy(*each, "_part", "_all", "_before").agg(F.sum("_n").alias("_sum"), F.count(F.lit(1)).alias("_m"))
    counted = through_table(counted, "range-counts")
    earlier = Window.partitionBy(*each).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most CUTS rows
    counted = counted.withColumn("_below", F.col("_before") + F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    held = [(r >= F.col("_below")) & (r < F.col("_below") + F.col("_sum")) for r in _ranks(shares)]
    wanted = through_table(counted.where(F.array_contains(F.array(*held), True)), "wanted")
    name = (F.col("_range") * CUTS + F.col("_part")).alias("_range")
    kept = same_keys(parts.drop("_all", "_before"), wanted.select(*each, "_part"), [*each, "_part"])
    small = (F.col("_range") * CUTS).alias("_range")
    rows = narrow.select(*group, small, "_x", "_n").unionByName(kept.select(*group, name, "_x", "_n"))
    new = sizes.where(F.col("_m") <= most).select(*group, small, "_all", "_below", "_m").unionByName(wanted.select(*group, name, "_all", "_below", "_m"))
    return through_table(rows, "ranges"), through_table(new, "sizes")


def select_quantiles(counts: DataFrame, keys: Sequence[str], shares: Sequence[float], range_values: int = RANGE_VALUES) -> DataFrame:
    """keys, _name and _q (array, one value per share, linear between neighbours) from ``value_counts``.

    The wanted ranks follow from the group's size. As long as a range of values is too large to be sorted in one task it is cut, the parts
    are counted, and only parts that hold a wanted rank go on, some 1 in CUTS of the values for each rank; what is
    left is sorted and counted up. No group is ever held in one buffer, and every size takes the same way.
    """
    group = [*keys, "_name"]
    each = [*group, "_range"]
    ranges = counts.withColumn("_range", F.lit(0).cast("long"))
    # no group has more values than the table has rows
    if counts.count() > range_values and counts.groupBy(*group).count().agg(F.max("count")).first()[0] > range_values:
        sizes = counts.groupBy(*group).agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_m"))
        zero = F.lit(0).cast("long")
        sizes = through_table(sizes.select(*group, zero.alias("_range"), "_all", zero.alias("_below"), "_m"), "sizes")
        while (sizes.agg(F.max("_m")).first()[0] or 0) > range_values:
            ranges, sizes = _narrowed(ranges, sizes, group, shares, range_values)
        rows = same_keys(ranges, sizes.select(*each, "_all", "_below"), each)
    else:
        rows = ranges.withColumns({"_all": F.sum("_n").over(Window.partitionBy(*each)), "_below": F.lit(0).cast("long")})
    so_far = Window.partitionBy(*each).orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_end", F.col("_below") + F.sum("_n").over(so_far))
    here = [F.max(F.when((r >= F.col("_end") - F.col("_n")) & (r < F.col("_end")), F.col("_x"))).alias(f"_v{i}") for i, r in enumerate(_ranks(shares))]
    found = rows.groupBy(*group).agg(F.max("_all").alias("_all"), *here)
    part = [F.lit(float(q)) * (F.col("_all") - 1) - F.floor(F.lit(float(q)) * (F.col("_all") - 1)) for q in shares]
    values = [F.col(f"_v{2 * i}") + (F.col(f"_v{2 * i + 1}") - F.col(f"_v{2 * i}")) * p for i, p in enumerate(part)]
    # between two infinite neighbours the difference has no value
    values = [F.when(F.col(f"_v{2 * i}") == F.col(f"_v{2 * i + 1}"), F.col(f"_v{2 * i}")).otherwise(v) for i, v in enumerate(values)]
    return found.select(*group, F.array(*values).alias("_q"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column | str], shares: Sequence[float], range_values: int = RANGE_VALUES) -> DataFrame:
    """keys and, for every name in ``values``, an array with the quantile of each share; null where a group has no value.

    Groups without any value have no row. Null keys are a group. ``keys`` may be empty: then there is one row, or none.
    """
    found = select_quantiles(value_counts(df, keys, values), keys, shares, range_values)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name) for name in values])
