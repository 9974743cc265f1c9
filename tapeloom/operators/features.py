"""Factor and feature operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.kernels import BARS, Panel, div, lag, roll
from tapeloom.functions.quantiles import exact_quantiles, same_keys
from tapeloom.functions.ranks import average_rank, tie_rank
from tapeloom.sources.store import through_table


def normalize(df: DataFrame, cols: Sequence[str], method: str = "zscore", keys: Sequence[str] = ("date",)) -> DataFrame:
    """z-score or min-max inside each group."""
    w = Window.partitionBy(*keys)
    if method == "zscore":
        new = {c: div(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w)) for c in cols}
    elif method == "minmax":
        new = {c: div(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w)) for c in cols}
    else:
        raise ValueError(f"unknown method: {method}")
    return df.withColumns(new)


def winsorize(df: DataFrame, x: str, lower: float = 0.025, upper: float = 0.975, keys: Sequence[str] = ("date",)) -> DataFrame:
    df = same_keys(df, exact_quantiles(df, keys, {"_q": x}, (lower, upper)), keys, "left")
    clipped = F.least(F.greatest(F.col(x), F.col("_q")[0]), F.col("_q")[1])
    return df.withColumn(x, F.when(F.col(x).isNotNull(), clipped)).drop("_q")


def neutralize(df: DataFrame, factor: str, industry: str = "industry", cap: str | None = None, keys: Sequence[str] = ("date",), out: str = "neutral") -> DataFrame:
    """Residual of the factor on industry dummies and, if given, the market cap.

    With dummies the regression is the one on values centred inside the industry, so only the cap
    needs a slope and that is a ratio of two sums.
    """
    here = F.col(factor).isNotNull()
    cell = Window.partitionBy(*keys, industry)
    df = df.withColumn("_y", F.col(factor) - F.avg(factor).over(cell))
    if cap is None:
        return df.withColumnRenamed("_y", out)
    df = df.withColumn("_x", F.when(here, F.col(cap) - F.avg(F.when(here, F.col(cap))).over(cell)))
    day = Window.partitionBy(*keys)
    slope = F.coalesce(div(F.sum(F.col("_x") * F.col("_y")).over(day), F.sum(F.col("_x") * F.col("_x")).over(day)), F.lit(0.0))
    return df.withColumn(out, F.col("_y") - slope * F.col("_x")).drop("_x", "_y")


def information_coefficient(df: DataFrame, factor: str, target: str, method: str = "spearman", keys: Sequence[str] = ("date",), large: bool = False, out: str = "ic") -> DataFrame:
    """Correlation of factor and target per group over the rows that have both.

    ``large`` is for groups that are no calendar or cross-section but a whole table: ranks are
    then built in ranges instead of one sort per group.
    """
    if method not in ("spearman", "pearson"):
        raise ValueError(f"unknown method: {method}")
    df = df.where(F.col(factor).isNotNull() & F.col(target).isNotNull())
    a, b = factor, target
    if method == "spearman":
        a, b = "_ra", "_rb"
        if large:
            # a rank reads its input more than once
            df = average_rank(through_table(df.select(*keys, factor, target), "ic"), factor, a, keys)
            df = average_rank(through_table(df, "ic"), target, b, keys)
        else:
            df = df.withColumns({a: tie_rank(F.col(factor), keys), b: tie_rank(F.col(target), keys)})
    # one constant side has no correlation
    corr = F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.corr(a, b))
    return df.groupBy(*keys).agg(corr.alias(out))


def lagged_features(df: DataFrame, cols: Sequence[str], lags: Sequence[int], panel: Panel = BARS) -> DataFrame:
    return df.withColumns({f"{c}_lag{k}": lag(c, k, panel) for k in lags for c in cols})


_ROLLING = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min}


def rolling_features(df: DataFrame, cols: Sequence[str], windows: Sequence[int], funcs: Sequence[str] = ("mean", "std", "max", "min"), panel: Panel = BARS) -> DataFrame:
    """One column per column, window and function; unknown function names are skipped."""
    return df.withColumns(
        {f"{c}_rolling{n}_{f}": roll(_ROLLING[f], c, n, panel=panel) for n in windows for f in funcs if f in _ROLLING for c in cols}
    )


def select_features(df: DataFrame, features: Sequence[str], target: str, threshold: float = 0.05) -> DataFrame:
    """Features whose rank correlation with the target is beyond the threshold, over all rows."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    long = df.select(F.col(target).alias("_t"), F.explode(pairs).alias("_p")).select("_p.feature", "_p.value", "_t")
    ic = information_coefficient(long, "value", "_t", keys=("feature",), large=True)
    return ic.where(F.abs("ic") > threshold)


def factor_score(df: DataFrame, families: Mapping[str, Sequence[str]], weights: Mapping[str, float], keys: Sequence[str] = ("date",), out: str = "score") -> DataFrame:
    """Weighted mean z-score: each family counts by its weight, its factors equally."""
    names = [f for fs in families.values() for f in fs]
    keep = df.columns
    df = normalize(df.withColumns({f"_{n}": F.col(n) for n in names}), [f"_{n}" for n in names], keys=keys)
    total = F.lit(0.0)
    for family, fs in families.items():
        for f in fs:
            total = total + F.coalesce(F.col(f"_{f}"), F.lit(0.0)) * (weights[family] / len(fs))
    return df.withColumn(out, total).select(*keep, out)


