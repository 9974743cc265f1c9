"""Portfolio tables: sizing, values, rebalance trades and calendars, risk figures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.kernels import div, greedy_gap, lag, Panel
from tapeloom.sources.store import through_table


def target_shares(weight: Column, price: Column, capital: float = 1_000_000.0, max_pct: float = 0.05, min_pct: float = 0.01) -> Column:
    """Shares for a weight, its value clipped to a share of the capital."""
    value = F.least(F.greatest(weight * capital, F.lit(capital * min_pct)), F.lit(capital * max_pct))
    return F.floor(div(value, price)).cast("long")


def size_positions(weights: DataFrame, prices: DataFrame, capital: float = 1_000_000.0, max_pct: float = 0.05, min_pct: float = 0.01) -> DataFrame:
    """Target shares of the weights that have a price, without empty ones."""
    df = weights.join(prices, "symbol").withColumn("shares", target_shares(F.col("weight"), F.col("price"), capital, max_pct, min_pct))
    return df.where("shares > 0")


def position_values(positions: DataFrame, prices: DataFrame) -> DataFrame:
    return positions.join(prices, "symbol").withColumn("value", F.col("shares") * F.col("price"))


def total_value(positions: DataFrame, prices: DataFrame, capital: float, keys: tuple[str, ...] = ("portfolio",)) -> DataFrame:
    """Capital plus the worth of the positions that have a price."""
    held = position_values(positions, prices).groupBy(*keys).agg(F.sum("value").alias("_v"))
    out = positions.select(*keys).distinct().join(held, list(keys), "left")
    return out.select(*keys, (F.coalesce("_v", F.lit(0.0)) + capital).alias("total_value"))


def rebalance_trades(current: DataFrame, target: DataFrame, prices: DataFrame, keys: tuple[str, ...] = ("portfolio", "symbol")) -> DataFrame:
    """Buys and sells that turn current into target shares, over the union of their symbols."""
    both = current.withColumnRenamed("shares", "_now").join(target.withColumnRenamed("shares", "_then"), list(keys), "full_outer")
    diff = F.coalesce("_then", F.lit(0)) - F.coalesce("_now", F.lit(0))
    both = both.withColumn("_diff", diff).where("_diff <> 0").join(prices, "symbol", "left")
    price = F.coalesce("price", F.lit(0.0))
    return both.select(
        *keys,
        F.when(F.col("_diff") > 0, "buy").otherwise("sell").alias("action"),
        F.abs("_diff").alias("shares"),
        price.alias("price"),
        (F.abs("_diff") * price).alias("value"),
    )


def apply_threshold(current: DataFrame, target: DataFrame, threshold: float = 0.05, keys: tuple[str, ...] = ("portfolio", "symbol")) -> DataFrame:
    """Target weights, but the current one where the change is below the threshold."""
    df = target.withColumnRenamed("weight", "_t").join(current.withColumnRenamed("weight", "_c"), list(keys), "left")
    now = F.coalesce("_c", F.lit(0.0))
    return df.select(*keys, F.when(F.abs(F.col("_t") - now) >= threshold, F.col("_t")).otherwise(now).alias("weight"))


def rebalance_days(dates: DataFrame, freq: str = "monthly", keys: tuple[str, ...] = ("calendar",)) -> DataFrame:
    """The dates on which a portfolio is rebalanced; the first date always is.

    Daily and monthly look at the date before. Weekly (7 days on) and quarterly depend on the last
    chosen date, a fold over one calendar of distinct dates. The quarterly rule counts
    4 per year plus whole thirds of the month difference since the last rebalance.
    """
    d = dates.select(*keys, "date").distinct()
    if freq in ("daily", "monthly"):
        before = lag("date", panel=Panel(keys, "date"))
        change = F.month("date") != F.month(before) if freq == "monthly" else F.datediff("date", before) >= 1
        return d.withColumn("_go", F.coalesce(change, F.lit(True))).where("_go").drop("_go")
    days = d.groupBy(*keys).agg(F.collect_list(F.unix_date("date")).alias("_days"))
    if freq == "weekly":
        kept = greedy_gap(F.col("_days"), 7, "int")
    elif freq == "quarterly":

        def quarters(x, last):
            a, b = F.date_from_unix_date(x), F.date_from_unix_date(last)
            return (F.year(a) - F.year(b)) * 4 + F.floor((F.month(a) - F.month(b)) / 3)

        kept = F.aggregate(
            F.array_sort("_days"),
            F.array().cast("array<int>"),
            lambda acc, x: F.when((F.size(acc) == 0) | (quarters(x, F.element_at(acc, -1)) >= 1), F.concat(acc, F.array(x))).otherwise(acc),
        )
    else:
        raise ValueError(f"unknown frequency: {freq}")
    return days.select(*keys, F.explode(kept).alias("_d")).select(*keys, F.date_from_unix_date("_d").alias("date"))


def execute_rebalance(days: DataFrame, current: DataFrame, target: DataFrame, prices: DataFrame) -> DataFrame:
    """The rebalance trades of every chosen date (all inputs carry the date)."""
    on = days.select("date")
    return rebalance_trades(
        current.join(on, "date", "left_semi"), target.join(on, "date", "left_semi"), prices, ("date", "symbol")
    )


# ---- risk -------------------------------------------------------------------------------------


def mean_returns(returns: DataFrame, r: str = "r") -> DataFrame:
    return returns.groupBy("symbol").agg(F.avg(r).alias("mean_return"))


#: Symbols that one side of a tile of the covariance matrix may hold.
TILE = 512


def symbol_blocks(symbols: DataFrame, tile: int = TILE) -> int:
    """Into how many blocks symbols have to be hashed so that none holds more than ``tile`` of them."""
    blocks = max(1, -(-symbols.count() * 4 // (3 * tile)))
    while (symbols.groupBy(F.pmod(F.xxhash64("symbol"), F.lit(blocks))).count().agg(F.max("count")).first()[0] or 0) > tile:
        blocks += -(-blocks // 4)
    return blocks


def covariance(returns: DataFrame, r: str = "r", tile: int = TILE) -> DataFrame:
    """Sample covariance of every pair of symbols (a <= b) over the dates they share.

    The matrix is the result, but its rows must not be built date by date. Symbols are hashed into blocks, as many
    as keep every block at ``tile`` symbols or less; for each pair of blocks and each year one matrix product gives the
    sums of all pairs at once, and only these sums are shuffled. So a task holds two blocks of a year's days,
    whatever the number of symbols; a row is sent once for each block.
    """
    x = returns.select("symbol", "date", r).where(F.col(r).isNotNull())
    mean = through_table(x.groupBy("symbol").agg(F.avg(r).alias("_mu")), "means")
    blocks = symbol_blocks(mean.select("symbol"), tile)
    # centred values keep the sums of products small next to their differences
    x = x.join(mean, "symbol").select(
        "symbol", F.unix_date("date").alias("_day"), F.year("date").alias("_year"), (F.col(r) - F.col("_mu")).alias("_x"),
        F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int").alias("_blk"),
    )
    tiled = x.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiled = tiled.select("symbol", "_day", "_year", "_x", "_blk", F.least("_blk", "_o").alias("i"), F.greatest("_blk", "_o").alias("j"))

    def products(table: pa.Table) -> pa.Table:
        names, code = np.unique(np.array(table.column("symbol").to_pylist(), dtype=object), return_inverse=True)
        days, day = np.unique(table.column("_day").to_numpy(), return_inverse=True)
        values = np.zeros((len(days), len(names)))
        there = np.zeros_like(values)
        values[day, code] = table.column("_x").to_numpy()
        there[day, code] = 1.0
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block = np.zeros(len(names), dtype=int)
        block[code] = table.column("_blk").to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        xl, ml, xr, mr = values[:, left], there[:, left], values[:, right], there[:, right]
        n, sx, sy, sxy = ml.T @ mr, xl.T @ mr, ml.T @ xr, xl.T @ xr
        a, b = np.meshgrid(names[left], names[right], indexing="ij")
        swap = a > b
        keep = ~swap if i == j else np.ones(a.shape, dtype=bool)
        lo, hi = np.where(swap, b, a), np.where(swap, a, b)
        s_lo, s_hi = np.where(swap, sy, sx), np.where(swap, sx, sy)
        text = {"a": lo, "b": hi}
        sums = {"n": n, "sa": s_lo, "sb": s_hi, "sab": sxy}
        return pa.table(
            {k: pa.array(v[keep].ravel(), pa.string()) for k, v in text.items()}
            | {k: pa.array(v[keep].ravel(), pa.float64()) for k, v in sums.items()}
        )

    schema = "a string, b string, n double, sa double, sb double, sab double"
    sums = tiled.groupBy("i", "j", "_year").applyInArrow(products, schema).groupBy("a", "b").agg(
        *[F.sum(c).alias(c) for c in ("n", "sa", "sb", "sab")]
    )
    return sums.select("a", "b", div(F.col("sab") - div(F.col("sa") * F.col("sb"), "n"), F.col("n") - 1).alias("cov"))


def _marginal(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """Sum over b of cov(a, b) w(b), per portfolio and a."""
    # both orders of a pair from one row, so that the matrix is made once
    full = cov.select(F.explode(F.expr("if(a = b, array(struct(a, b)), array(struct(a, b), struct(b as a, a as b)))")).alias("_p"), "cov").select("_p.*", "cov")
    w = weights.select("portfolio", F.col("symbol").alias("b"), "weight")
    part = full.join(w, "b").groupBy("portfolio", "a").agg(F.sum(F.col("cov") * F.col("weight")).alias("_m"))
    return weights.join(part.withColumnRenamed("a", "symbol"), ["portfolio", "symbol"])


def mean_variance_objective(weights: DataFrame, mean: DataFrame, cov: DataFrame, risk_aversion: float = 1.0) -> DataFrame:
    """-w.mu + lambda w'Cw of every weight vector (one portfolio per vector)."""
    df = _marginal(weights, cov).join(mean, "symbol")
    return df.groupBy("portfolio").agg(
        F.sum(F.col("weight") * F.col("mean_return")).alias("expected_return"),
        F.sum(F.col("weight") * F.col("_m")).alias("variance"),
    ).withColumn("objective", -F.col("expected_return") + risk_aversion * F.col("variance"))


def risk_contributions(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """Each symbol's share of the portfolio risk, and the squared distance to an equal share."""


    part = _marginal(weights, cov).withColumn("_c", F.col("weight") * F.col("_m"))
    w = Window.partitionBy("portfolio")
    share = div("_c", F.sum("_c").over(w))
    return part.select("portfolio", "symbol", share.alias("risk_share"), F.count(F.lit(1)).over(w).alias("_n")).withColumn(
        "squared_gap", F.pow(F.col("risk_share") - 1 / F.col("_n"), 2)
    ).drop("_n")
