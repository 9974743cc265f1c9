"""Window building blocks that every operator shares.

A bar table has one row per series and date, so the rows of one series are bounded by the
calendar (some 250 a year). Everything that could be large for one symbol - trades, ticks - is
aggregated to bars before a window sees it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Panel:
    """Which columns name a series and which column orders it."""

    keys: tuple[str, ...] = ("symbol",)
    order: str = "date"

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.order)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    @property
    def desc(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(F.col(self.order).desc())

    @property
    def so_far(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    @property
    def before(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, -1)

    @property
    def from_end(self) -> WindowSpec:
        """This row and all later ones, newest first: a running frame, unlike one open to the end."""
        return self.desc.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    @property
    def after(self) -> WindowSpec:
        return self.desc.rowsBetween(Window.unboundedPreceding, -1)

    def trailing(self, n: int) -> WindowSpec:
        return self.w.rowsBetween(-(n - 1), Window.currentRow)

    def by(self, *more: str) -> Panel:
        """The same order inside finer keys, e.g. one series per experiment and symbol."""
        return Panel(tuple(more) + self.keys, self.order)


BARS = Panel()


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a: Column | str, b: Column | str) -> Column:
    """a / b with null where b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def flag(c: Column) -> Column:
    """A condition that is False, not null, where an input is missing."""
    return F.coalesce(c, F.lit(False))


def roll(
    fn: Callable[[Column], Column], x: Column | str, n: int, min_periods: int | None = None, panel: Panel = BARS
) -> Column:
    """fn over the last n rows, null until min_periods (default n) values are present."""
    x = col(x)
    frame = panel.trailing(n)
    need = n if min_periods is None else min_periods
    return F.when(F.count(x).over(frame) >= need, fn(x).over(frame))


def rolling_quantile(
    df: DataFrame, out: str, x: str, n: int, q: float, min_periods: int | Column | None = None, panel: Panel = BARS
) -> DataFrame:
    """Linear quantile of the last n values; sorting n numbers is cheaper than a percentile aggregate per row."""
    keep = [c for c in df.columns if c != out]
    df = df.withColumn("_win", F.sort_array(F.collect_list(x).over(panel.trailing(n))))
    df = df.withColumns({"_cnt": F.size("_win"), "_at": (F.size("_win") - 1) * F.lit(float(q))})
    df = df.withColumns({"_lo": F.get("_win", F.floor("_at").cast("int")), "_hi": F.get("_win", F.ceil("_at").cast("int"))})
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at"))
    need = F.lit(n) if min_periods is None else min_periods if isinstance(min_periods, Column) else F.lit(min_periods)
    return df.withColumn("_qv", F.when((F.col("_cnt") >= need) & (F.col("_cnt") > 0), value)).select(*keep, F.col("_qv").alias(out))


def lag(x: Column | str, n: int = 1, panel: Panel = BARS) -> Column:
    return F.lag(col(x), n).over(panel.w)


def row_no(panel: Panel = BARS) -> Column:
    return F.row_number().over(panel.w)


def ffill(x: Column | str, panel: Panel = BARS) -> Column:
    return F.last(col(x), ignorenulls=True).over(panel.so_far)


def crosses_up(a: Column, b: Column, prev_a: Column, prev_b: Column) -> Column:
    return flag((a > b) & (prev_a <= prev_b))


def crosses_down(a: Column, b: Column, prev_a: Column, prev_b: Column) -> Column:
    return flag((a < b) & (prev_a >= prev_b))


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the last in the given order (drop_duplicates keep=last)."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


# exp(-41) is below the rounding error of a double next to 1
_REACH = 41.0


def ewm(df: DataFrame, specs: Mapping[str, tuple[str, float]], panel: Panel = BARS) -> DataFrame:
    """Exponentially weighted means ``{out: (column, alpha)}`` without a Python loop.

    y[t] = (1-alpha) y[t-1] + alpha x[t], started at the first value. The recursion is cut into
    blocks of the length after which an old value has no more weight than a rounding error: inside
    a block it is a weighted running sum, and only the end of the block before can still
    contribute. Leading nulls are skipped; a column with gaps goes to ``ewm_gaps``.
    """
    cols = list(df.columns)
    means = {str(i): (out, x, alpha) for i, (out, (x, alpha)) in enumerate(specs.items()) if alpha < 1.0}
    df = df.withColumns({out: F.col(x) for out, (x, alpha) in specs.items() if alpha >= 1.0})
    rate = {i: -math.log1p(-alpha) for i, (_, _, alpha) in means.items()}
    size = {i: max(int(_REACH / r), 1) for i, r in rate.items()}
    # all means take each step together, so that they share its sort
    df = df.withColumns({f"_age{i}": F.when(F.col(x).isNotNull(), F.count(F.col(x)).over(panel.so_far) - 1) for i, (_, x, _) in means.items()})
    df = df.withColumns({f"_blk{i}": F.floor(F.col(f"_age{i}") / size[i]) for i in means} | {f"_pos{i}": F.col(f"_age{i}") % size[i] for i in means})
    local = {}
    for i, (_, x, alpha) in means.items():
        weight = F.when(F.col(f"_age{i}") == 0, 1.0).otherwise(alpha)
        grow, decay = F.exp(F.col(f"_pos{i}") * rate[i]), F.exp(-F.col(f"_pos{i}") * rate[i])
        local[f"_local{i}"] = F.sum(weight * F.col(x) * grow).over(_block(panel, f"_blk{i}")) * decay
    df = df.withColumns(local)
    df = df.withColumns({f"_carry{i}": F.last(F.when(F.col(f"_pos{i}") == size[i] - 1, F.col(f"_local{i}")), ignorenulls=True).over(panel.before) for i in means})
    out_of = {}
    for i, (out, _, _) in means.items():
        decay = F.exp(-F.col(f"_pos{i}") * rate[i])
        out_of[out] = F.col(f"_local{i}") + F.coalesce(F.col(f"_carry{i}") * decay * math.exp(-rate[i]), F.lit(0.0))
    return df.withColumns(out_of).select(*cols, *[out for out in specs if out not in cols])


def _block(panel: Panel, blk: str) -> WindowSpec:
    """The rows of a block of a series so far."""
    return Window.partitionBy(*panel.keys, blk).orderBy(panel.order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def ewm_gaps(df: DataFrame, specs: Mapping[str, tuple[str, float]], panel: Panel = BARS) -> DataFrame:
    """``ewm`` for columns with missing values inside.

    A missing row repeats the last mean, and the old weight fades by (1-alpha) for each missing
    row: after g rows without a value y = (q^g y + alpha x) / (q^g + alpha) with q = 1-alpha.
    The factors differ by row, so blocks are cut by their running log instead of a row count.
    """
    cols = list(df.columns)
    means = {str(i): (out, x, alpha) for i, (out, (x, alpha)) in enumerate(specs.items())}
    here = {i: F.col(x).isNotNull() for i, (_, x, _) in means.items()}
    each = lambda make: {k: v for i in means for k, v in make(i).items()}
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    # all means take each step together, so that they share its sort
    df = df.withColumn("_rn", F.row_number().over(panel.w))
    df = df.withColumns(each(lambda i: {f"_seen{i}": last(F.when(here[i], F.col("_rn")), panel.before)}))

    def fades(i):
        alpha = means[i][2]
        old = F.pow(F.lit(1.0 - alpha), (F.col("_rn") - F.col(f"_seen{i}")).cast("double"))
        first = F.col(f"_seen{i}").isNull()
        return {f"_fade{i}": F.when(here[i] & first, 0.0).when(here[i], F.least(-F.log(old / (old + alpha)), F.lit(700.0))),
                f"_gain{i}": F.when(here[i] & first, 1.0).when(here[i], alpha / (old + alpha))}

    df = df.withColumns(each(fades))
    df = df.withColumns(each(lambda i: {f"_path{i}": F.sum(f"_fade{i}").over(panel.so_far)}))
    df = df.withColumns(each(lambda i: {f"_blk{i}": F.when(here[i], F.floor(F.col(f"_path{i}") / _REACH))}))

    def local(i):
        inside = F.col(f"_path{i}") - F.col(f"_blk{i}") * _REACH
        return {f"_local{i}": F.sum(F.col(f"_gain{i}") * F.col(means[i][1]) * F.exp(inside)).over(_block(panel, f"_blk{i}")) * F.exp(-inside)}

    df = df.withColumns(each(local))
    # what stood before: at the first row of a block that is the end of the block before
    df = df.withColumns(each(lambda i: {
        f"_pblk{i}": last(F.col(f"_blk{i}"), panel.before), f"_prev{i}": last(F.when(here[i], F.col(f"_local{i}")), panel.before),
        f"_ppath{i}": last(F.when(here[i], F.col(f"_path{i}")), panel.before)}))

    def carries(i):
        begins = here[i] & F.coalesce(F.col(f"_pblk{i}") < F.col(f"_blk{i}"), F.lit(True))
        return {f"_carry{i}": F.when(begins, F.coalesce(F.col(f"_prev{i}"), F.lit(0.0))), f"_cpath{i}": F.when(begins, F.coalesce(F.col(f"_ppath{i}"), F.col(f"_path{i}")))}

    df = df.withColumns(each(carries))
    df = df.withColumns(each(lambda i: {f"_carry{i}": last(F.col(f"_carry{i}"), panel.so_far), f"_cpath{i}": last(F.col(f"_cpath{i}"), panel.so_far)}))
    df = df.withColumns(each(lambda i: {f"_y{i}": F.when(here[i], F.col(f"_local{i}") + F.col(f"_carry{i}") * F.exp(F.col(f"_cpath{i}") - F.col(f"_path{i}")))}))
    df = df.withColumns({out: ffill(f"_y{i}", panel) for i, (out, _, _) in means.items()})
    return df.select(*cols, *[out for out in specs if out not in cols])


def span(n: float) -> float:
    """The alpha of an n-span mean."""
    return 2.0 / (n + 1.0)


def latch(event: Column, panel: Panel = BARS) -> Column:
    """The last non-null event so far, 0 before the first: machines whose events set a fixed state."""
    return F.coalesce(F.last(event, ignorenulls=True).over(panel.so_far), F.lit(0))


def reset_latch(
    df: DataFrame,
    out: str,
    long_in: Column,
    short_in: Column,
    long_out: Column,
    short_out: Column,
    valid: Column | None = None,
    panel: Panel = BARS,
) -> DataFrame:
    """Position of a machine with entries from any state and exits that close one side only.

    An entry sets +1 or -1; an exit matters while its own side is open. So the state is the side
    of the last entry, unless a matching exit came after that entry. Rows that are not valid emit
    0 and leave the state alone.
    """
    ok = F.lit(True) if valid is None else flag(valid)
    cols = [c for c in df.columns if c != out]
    df = df.withColumn("_in", F.when(ok & flag(long_in), 1).when(ok & flag(short_in), -1))
    df = df.withColumns(
        {
            "_exit_l": ok & flag(long_out),
            "_exit_s": ok & flag(short_out),
            "_ok": ok,
            "_rn": F.row_number().over(panel.w),
            "_side": F.last("_in", ignorenulls=True).over(panel.so_far),
        }
    )
    closes = F.col("_in").isNull() & (
        (F.col("_exit_l") & (F.col("_side") == 1)) | (F.col("_exit_s") & (F.col("_side") == -1))
    )
    df = df.withColumns(
        {
            "_opened": F.last(F.when(F.col("_in").isNotNull(), F.col("_rn")), ignorenulls=True).over(panel.so_far),
            "_closed": F.last(F.when(closes, F.col("_rn")), ignorenulls=True).over(panel.so_far),
        }
    )
    held = F.when(F.col("_closed") > F.col("_opened"), 0).otherwise(F.coalesce(F.col("_side"), F.lit(0)))
    return df.withColumn("_state", F.when(F.col("_ok"), held).otherwise(0)).select(*cols, F.col("_state").alias(out))


#: Position states -1, 0 and 1 in two bits each: what a row makes of each state it may find.
SAME_STATE = 0 | 1 << 2 | 2 << 4


def state_map(of_short: Column, of_flat: Column, of_long: Column) -> Column:
    """A row's transition as one number: the state (-1, 0, 1) that follows each of the three."""
    code = lambda c: c.cast("int") + 1
    return code(of_short) + code(of_flat) * 4 + code(of_long) * 16


def _after(later: str, earlier: str) -> str:
    """One transition behind another, state by state."""
    image = lambda s: f"(shiftright({later}, 2 * (shiftright({earlier}, {2 * s}) & 3)) & 3)"
    return f"({image(0)} + {image(1)} * 4 + {image(2)} * 16)"


def state_scan(df: DataFrame, out: str, step: Column, start: int = 0, rows: int = 1 << 16, panel: Panel = BARS) -> DataFrame:
    """The state after each row of a machine whose next state depends on its last one, without a loop over rows.

    ``step`` is the row's ``state_map``; null leaves the state. Transitions compose, and composing is associative: each pass
    joins what the last 1, 4, 16, ... rows do together from four parts that lie one behind the other. So the number of passes grows
    with the logarithm of the longest series; a series of more than ``rows`` rows is an error.
    """
    keep = [c for c in df.columns if c != out]
    number = F.row_number().over(panel.w)
    known = F.when(number <= rows, F.coalesce(step, F.lit(SAME_STATE))).otherwise(F.raise_error(F.lit(f"a series has more than {rows} rows")).cast("int"))
    df = df.withColumn("_f", known)
    reach = 1
    while reach < rows:
        parts = {f"_f{i}": F.coalesce(F.lag("_f", i * reach).over(panel.w), F.lit(SAME_STATE)) for i in (1, 2, 3)}
        df = df.withColumns(parts).withColumns({"_f1": F.expr(_after("_f", "_f1")), "_f3": F.expr(_after("_f2", "_f3"))})
        df = df.withColumn("_f", F.expr(_after("_f1", "_f3"))).drop("_f1", "_f2", "_f3")
        reach *= 4
    return df.withColumn("_state", F.expr(f"(shiftright(_f, {2 * (start + 1)}) & 3) - 1")).select(*keep, F.col("_state").alias(out))


def fold(
    df: DataFrame,
    inputs: Sequence[str],
    outputs: Mapping[str, str],
    fn: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]],
    panel: Panel = BARS,
) -> DataFrame:
    """Run a sequential rule over each series in order and add its columns (Arrow batches).

    Only for rules whose next step needs their own last result. ``fn`` gets the input columns of
    one series as arrays (null is NaN) and gives the output columns; NaN becomes null. One group
    is one bar series of one scenario, so its size is the length of the calendar.
    """
    types = T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in outputs.items()))
    schema = T.StructType(list(df.schema.fields) + list(types.fields))
    order = panel.order

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        result = fn({c: table.column(c).to_numpy() for c in inputs})
        for name in outputs:
            table = table.append_column(name, pa.array(result[name], from_pandas=True))
        return table

    return df.groupBy(*panel.keys).applyInArrow(run, schema)


def greedy_gap(items: Column, gap: int, kind: str, field: str | None = None) -> Column:
    """From the items of one series, those whose position is ``gap`` or more after the last kept one.

    Items are positions, or structs (of SQL type ``kind``) that start with the position ``field``.
    """
    at = (lambda x: x[field]) if field else (lambda x: x)
    far = lambda kept, x: (F.size(kept) == 0) | (at(x) - at(F.try_element_at(kept, F.lit(-1))) >= gap)
    return F.aggregate(
        F.array_sort(items),
        F.array().cast(f"array<{kind}>"),
        lambda kept, x: F.when(far(kept, x), F.concat(kept, F.array(x))).otherwise(kept),
    )
