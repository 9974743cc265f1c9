"""Resampling, returns, alignment, gap filling and splits."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.kernels import BARS, Panel, col, div, lag, row_no

# fixed values: how a bar column is carried to a coarser period
BAR_AGGS = {"open": "first", "high": "max", "low": "min", "close": "last", "volume": "sum"}


def period_end(date: Column | str, freq: str) -> Column:
    """Last calendar day of the period of a date: D, W (to Sunday), M, Q or Y."""
    d = col(date)
    if freq == "D":
        return d
    if freq == "W":
        return F.next_day(F.date_sub(d, 1), "SUN")
    if freq == "M":
        return F.last_day(d)
    if freq == "Q":
        return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))
    if freq == "Y":
        return F.last_day(F.add_months(F.trunc(d, "year"), 11))
    raise ValueError(f"unknown frequency: {freq}")


_STEP = {"D": "interval 1 day", "W": "interval 7 days", "M": "interval 1 month", "Q": "interval 3 months", "Y": "interval 1 year"}


def resample(df: DataFrame, freq: str = "W", aggs: Mapping[str, str] | None = None, panel: Panel = BARS, fill_empty: bool = True) -> DataFrame:
    """Bars of a coarser period, labelled with its last day.

    Periods without a bar between the first and last of a series appear with nulls (sums with 0).
    """
    o = panel.order
    fns = {
        "first": lambda c: F.min_by(c, o), "last": lambda c: F.max_by(c, o), "max": F.max, "min": F.min,
        "sum": F.sum, "mean": F.avg, "count": F.count,
    }
    aggs = dict(BAR_AGGS if aggs is None else aggs)
    keys = list(panel.keys)
    out = df.withColumn("period", period_end(o, freq)).groupBy(*keys, "period").agg(*[fns[f](c).alias(c) for c, f in aggs.items()])
    if not fill_empty:
        return out
    # month ends have no fixed step, so steps run over first days and are turned into ends
    base = {"M": "month", "Q": "quarter", "Y": "year"}.get(freq)
    start = F.trunc("period", base) if base else F.col("period")
    ends = out.groupBy(*keys).agg(F.min(start).alias("_a"), F.max(start).alias("_b"))
    step = F.expr(_STEP[freq])
    calendar = ends.select(*keys, F.explode(F.sequence("_a", "_b", step)).alias("_s")).select(*keys, period_end("_s", freq).alias("period"))
    full = calendar.join(out, keys + ["period"], "left")
    return full.fillna(0, [c for c, f in aggs.items() if f in ("sum", "count")])


def simple_returns(df: DataFrame, x: str = "close", method: str = "simple", out: str = "ret", panel: Panel = BARS) -> DataFrame:
    ratio = div(x, lag(x, panel=panel))
    if method == "simple":
        return df.withColumn(out, ratio - 1)
    if method == "log":
        return df.withColumn(out, F.when(ratio > 0, F.ln(ratio)))
    raise ValueError(f"unknown method: {method}")


def align(dfs: Sequence[DataFrame], keys: Sequence[str], join: str = "inner") -> list[DataFrame]:
    """Every table on the keys that all share (inner) or that any has (outer)."""
    ids = [d.select(*keys).distinct() for d in dfs]
    index = reduce(lambda a, b: a.intersect(b), ids) if join == "inner" else reduce(lambda a, b: a.union(b), ids).distinct()
    return [index.join(d, list(keys), "left") for d in dfs]


def fill_missing(df: DataFrame, cols: Sequence[str], method: str = "ffill", limit: int | None = None, panel: Panel = BARS) -> DataFrame:
    """Fill gaps of each series: ffill, bfill, interpolate (by position), mean or median.

    ``limit`` is the most rows filled in one gap. Interpolation goes forward: a leading gap stays,
    a trailing one repeats the last value.
    """
    keep = df.columns
    if method in ("mean", "median"):
        fn = F.avg if method == "mean" else (lambda c: F.percentile(c, F.lit(0.5)))
        return df.withColumns({c: F.coalesce(F.col(c), fn(F.col(c)).over(panel.whole)) for c in cols})
    if method not in ("ffill", "bfill", "interpolate"):
        raise ValueError(f"unknown method: {method}")
    df = df.withColumn("_rn", row_no(panel))
    new = {}
    for c in cols:
        at = F.when(F.col(c).isNotNull(), F.col("_rn"))
        last, last_at = F.last(c, ignorenulls=True).over(panel.so_far), F.last(at, ignorenulls=True).over(panel.so_far)
        nxt, nxt_at = F.last(c, ignorenulls=True).over(panel.from_end), F.last(at, ignorenulls=True).over(panel.from_end)
        since, until = F.col("_rn") - last_at, nxt_at - F.col("_rn")
        if method == "ffill":
            value, gap = last, since
        elif method == "bfill":
            value, gap = nxt, until
        else:
            inside = last + (nxt - last) * (F.col("_rn") - last_at) / (nxt_at - last_at)
            value, gap = F.when(nxt.isNull() | (nxt_at == last_at), last).otherwise(inside), since
        filled = value if limit is None else F.when(gap <= limit, value)
        new[c] = F.coalesce(F.col(c), filled)
    return df.withColumns(new).select(*keep)


def split(df: DataFrame, train: float = 0.7, valid: float = 0.15, panel: Panel = BARS, out: str = "split") -> DataFrame:
    """Label each row by its position in the series: the first part train, then valid, then test."""
    n, rn = F.count(F.lit(1)).over(panel.whole), row_no(panel)
    first, second = F.floor(n * F.lit(train)), F.floor(n * F.lit(train + valid))
    return df.withColumn(out, F.when(rn <= first, "train").when(rn <= second, "valid").otherwise("test"))


def last_rows(df: DataFrame, k: int, panel: Panel = BARS) -> DataFrame:
    """The last k rows of every series."""
    return df.withColumn("_back", F.row_number().over(panel.desc)).where(F.col("_back") <= k).drop("_back")


# which days a frequency takes, by its letters; weeks end on Sunday, quarters and years with the calendar's
FREQUENCIES: dict[str, Callable[[Column], Column]] = {
    "D": lambda d: F.lit(True),
    "B": lambda d: F.weekday(d) < 5,
    "W": lambda d: F.weekday(d) == 6,
    "MS": lambda d: F.dayofmonth(d) == 1,
    "ME": lambda d: F.last_day(d) == d,
    "QS": lambda d: (F.dayofmonth(d) == 1) & (F.month(d) % 3 == 1),
    "QE": lambda d: (F.last_day(d) == d) & (F.month(d) % 3 == 0),
    "YS": lambda d: F.dayofyear(d) == 1,
    "YE": lambda d: (F.month(d) == 12) & (F.dayofmonth(d) == 31),
}
FREQUENCIES |= {"M": FREQUENCIES["ME"], "Q": FREQUENCIES["QE"], "Y": FREQUENCIES["YE"], "A": FREQUENCIES["YE"]}


def calendar_days(df: DataFrame, start: Column | str, end: Column | str, out: str = "date", business: bool = False, freq: str = "D") -> DataFrame:
    """One row per date of a frequency from start to end of each input row; ``business`` is the frequency B, Monday to Friday.

    D days, B business days, W Sundays, MS and ME (or M) first and last days of months, QS, QE (Q) of quarters, YS, YE (Y, A) of
    years. A number in front takes every n-th of them from the first on.
    """
    found = re.fullmatch(r"(\d*)([A-Z]+)", "B" if business else freq.strip().upper())
    step, name = found.groups() if found else ("", "")
    if name not in FREQUENCIES or step and int(step) == 0:
        raise ValueError(f"unknown frequency: {freq}")
    days = F.sequence(F.to_date(col(start)), F.to_date(col(end)), F.expr("interval 1 day"))
    days = F.filter(days, FREQUENCIES[name])
    if step:
        days = F.filter(days, lambda d, i: i % int(step) == 0)
    return df.withColumn(out, F.explode(days))
