"""Performance of value and return series, one row per scenario (or one in all)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.kernels import Panel, div, lag
from tapeloom.functions.quantiles import same_keys, select_quantiles, value_counts
from tapeloom.functions.scalars import format_number

YEAR = 252


def _ratio(top: Column, bottom: Column, when_zero: float = 0.0) -> Column:
    """top / bottom; the given value where the bottom is zero."""
    return F.when(bottom == 0, when_zero).otherwise(div(top, bottom))


def sharpe(r: Column, risk_free: float = 0.03, periods: int = YEAR) -> Column:
    excess = r - risk_free / periods
    return _ratio(F.avg(excess), F.stddev_samp(excess)) * math.sqrt(periods)


def sortino(r: Column, risk_free: float = 0.03, periods: int = YEAR) -> Column:
    down = F.when(r < 0, r)
    return F.when(F.count(down) == 0, 0.0).otherwise(
        _ratio(F.avg(r - risk_free / periods), F.stddev_samp(down)) * math.sqrt(periods)
    )


def treynor(r: Column, beta: float, risk_free: float = 0.03, periods: int = YEAR) -> Column:
    return F.lit(0.0) if beta == 0 else (F.avg(r) * periods - risk_free) / beta


def beta(r: Column, b: Column, consistent: bool = False) -> Column:
    """Sample covariance over population variance, as usual here; ``consistent`` uses one divisor."""
    if consistent:
        return F.regr_slope(r, b)
    both = F.when(r.isNotNull(), b)
    return _ratio(F.covar_samp(r, b), F.var_pop(both))


def alpha(r: Column, b: Column, risk_free: float = 0.03, periods: int = YEAR) -> Column:
    both_r, both_b = F.when(b.isNotNull(), r), F.when(r.isNotNull(), b)
    rf = risk_free / periods
    value = (F.avg(both_r) - rf - beta(r, b) * (F.avg(both_b) - rf)) * periods
    return F.when(F.var_pop(both_b) == 0, 0.0).otherwise(value)


def information_ratio(r: Column, b: Column, periods: int = YEAR) -> Column:
    return _ratio(F.avg(r - b) * periods, tracking_error(r, b, periods))


def tracking_error(r: Column, b: Column, periods: int = YEAR) -> Column:
    return F.stddev_samp(r - b) * math.sqrt(periods)


def returns(df: DataFrame, value: str = "portfolio_value", out: str = "returns", keys: tuple[str, ...] = ("scenario",), order: str = "date") -> DataFrame:
    return df.withColumn(out, div(value, lag(value, panel=Panel(keys, order))) - 1)


def cumulative_return(df: DataFrame, r: str = "returns", out: str = "cumulative_return", keys: tuple[str, ...] = ("scenario",), order: str = "date") -> DataFrame:
    """The running product of 1 + r, less 1; rows with no return have none."""
    w, grows = Panel(keys, order).so_far, F.col(r) + 1
    # factors of 0 or less have no logarithm: one 0 ends the product at 0, each negative one turns its sign
    size = F.exp(F.coalesce(F.sum(F.when(F.col(r) > -1, F.log1p(r)).when(grows < 0, F.log(-grows))).over(w), F.lit(0.0)))
    sign = 1 - 2 * (F.sum((grows < 0).cast("int")).over(w) % 2)
    grown = F.when(F.max((grows == 0).cast("int")).over(w) == 1, 0.0).otherwise(sign * size) - 1
    return df.withColumn(out, F.when(F.col(r).isNotNull(), grown))


def drawdown(df: DataFrame, value: str = "portfolio_value", out: str = "drawdown", keys: tuple[str, ...] = ("scenario",), order: str = "date") -> DataFrame:
    top = F.max(value).over(Panel(keys, order).so_far)
    return df.withColumn(out, div(F.col(value) - top, top))


def max_drawdown(df: DataFrame, value: str = "portfolio_value", keys: tuple[str, ...] = ("scenario",), order: str = "date") -> DataFrame:
    return drawdown(df, value, "_dd", keys, order).groupBy(*keys).agg(F.min("_dd").alias("max_drawdown"))


def calmar(df: DataFrame, r: str = "returns", keys: tuple[str, ...] = ("scenario",), order: str = "date", periods: int = YEAR) -> DataFrame:
    """Mean yearly return over the deepest fall of the compounded returns."""
    df = cumulative_return(df.where(F.col(r).isNotNull()), r, "_c", keys, order).withColumn("_g", F.col("_c") + 1)
    df = drawdown(df, "_g", "_dd", keys, order)
    return df.groupBy(*keys).agg(_ratio(F.avg(r) * periods, F.abs(F.min("_dd"))).alias("calmar_ratio"))


def value_at_risk(df: DataFrame, r: str = "returns", keys: tuple[str, ...] = ("scenario",), confidence: float = 0.95) -> DataFrame:
    """Historical VaR, and CVaR as the mean of the returns at or below it.

    Both come from the counts of the values, where VaR is selected exactly and its tail is a plain aggregate. Scenarios
    without a return have no row.
    """
    counts = value_counts(df, keys, {"r": r})
    var = select_quantiles(counts, keys, [1 - confidence]).select(*keys, F.col("_q")[0].alias("var"))
    tail = F.col("_x") <= F.col("var")
    of_tail = lambda v: F.sum(F.when(tail, v))
    return same_keys(counts, var, keys).groupBy(*keys).agg(F.first("var").alias("var"), (of_tail(F.col("_x") * F.col("_n")) / of_tail(F.col("_n"))).alias("cvar"))


def summary(df: DataFrame, value: str = "portfolio_value", keys: tuple[str, ...] = ("scenario",), order: str = "date", benchmark: str | None = None, risk_free: float = 0.03, extra: tuple[Column, ...] = ()) -> DataFrame:
    """Total and yearly return, volatility, Sharpe of the yearly return, Calmar, day wins and losses.

    ``extra`` aggregates are computed in the same pass.
    """
    df = drawdown(returns(df, value, "_r", keys, order), value, "_dd", keys, order)
    r = F.col("_r")
    aggs = [
        (div(F.max_by(value, order), F.min_by(value, order)) - 1).alias("total_return"),
        F.count(F.lit(1)).alias("_n"),
        (F.stddev_samp(r) * math.sqrt(YEAR)).alias("annual_volatility"),
        F.min("_dd").alias("max_drawdown"),
        div(F.count_if(r > 0), F.count(r)).alias("win_rate"),
        F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(r < 0, r)), F.lit(0.0)).alias("avg_loss"),
    ]
    if benchmark is not None:
        df = returns(df, benchmark, "_b", keys, order)
        aggs += [tracking_error(r, F.col("_b")).alias("tracking_error"), information_ratio(r, F.col("_b")).alias("information_ratio")]
    out = df.groupBy(*keys).agg(*aggs, *extra)
    c = F.col
    out = out.withColumn("annual_return", F.when(c("total_return") >= -1, F.pow(1 + c("total_return"), F.lit(float(YEAR)) / c("_n")) - 1))
    return out.withColumns(
        {
            "sharpe_ratio": F.when(c("annual_volatility") > 0, div(c("annual_return") - risk_free, "annual_volatility")).otherwise(0.0),
            "calmar_ratio": _ratio(c("annual_return"), F.abs("max_drawdown")),
            "profit_loss_ratio": F.abs(_ratio(c("avg_win"), c("avg_loss"))),
        }
    ).drop("_n")


# fixed values: report labels in report order
REPORT = [
    ("总收益率", "total_return", "pct"), ("年化收益率", "annual_return", "pct"), ("年化波动率", "annual_volatility", "pct"),
    ("夏普比率", "sharpe_ratio", "num"), ("最大回撤", "max_drawdown", "pct"), ("卡尔玛比率", "calmar_ratio", "num"),
    ("胜率", "win_rate", "pct"), ("平均盈利", "avg_win", "num"), ("平均亏损", "avg_loss", "num"),
    ("盈亏比", "profit_loss_ratio", "num"), ("跟踪误差", "tracking_error", "pct"), ("信息比率", "information_ratio", "num"),
]


def report(stats: DataFrame, keys: tuple[str, ...] = ("scenario",)) -> DataFrame:
    """The summary as label and text rows, in report order."""
    rows = []
    for i, (label, name, kind) in enumerate(r for r in REPORT if r[1] in stats.columns):
        text = format_number(name, 2, True) if kind == "pct" else format_number(name, 4)
        rows.append(F.struct(F.lit(i + 1).alias("line"), F.lit(label).alias("metric"), text.alias("value")))
    return stats.select(*keys, F.explode(F.array(*rows)).alias("_x")).select(*keys, "_x.*")


def dashboard_metrics(df: DataFrame, keys: tuple[str, ...] = ("scenario",), risk_free: float = 0.03) -> DataFrame:
    """Calendar-year variant: needs portfolio_value, returns and cumulative_returns per date."""
    df = drawdown(df.withColumn("_c", F.col("cumulative_returns")), "_c", "_dd", keys)
    r, c = F.col("returns"), F.col
    out = df.groupBy(*keys).agg(
        F.min_by("portfolio_value", "date").alias("initial_value"),
        F.max_by("portfolio_value", "date").alias("final_value"),
        F.datediff(F.max("date"), F.min("date")).alias("days"),
        F.min("_dd").alias("max_drawdown"),
        (_ratio(F.avg(r - risk_free / YEAR), F.stddev_samp(r)) * math.sqrt(YEAR)).alias("sharpe_ratio"),
        div(F.count_if(r > 0), F.count(r)).alias("win_rate"),
        F.abs(_ratio(F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)), F.coalesce(F.avg(F.when(r < 0, r)), F.lit(0.0)))).alias("profit_loss_ratio"),
    )
    total = div(c("final_value") - c("initial_value"), "initial_value")
    out = out.withColumns({"total_return": total, "years": c("days") / F.lit(365.25)})
    return out.withColumn("annual_return", F.when(c("years") > 0, F.pow(1 + c("total_return"), 1 / c("years")) - 1).otherwise(0.0))


def sleeve_metrics(trades: DataFrame, equity: DataFrame, pnl: str = "pnl", value: str = "equity", keys: tuple[str, ...] = ("scenario",), order: str = "date") -> DataFrame:
    """Win rate and expectancy of trades with the population Sharpe and drawdown of the equity."""
    t = trades.groupBy(*keys).agg(
        div(F.count_if(F.col(pnl) > 0), F.count(pnl)).alias("win_rate"), F.avg(pnl).alias("expectancy"), F.count(pnl).alias("total_trades")
    )
    e = drawdown(returns(equity, value, "_r", keys, order), value, "_dd", keys, order)
    e = e.groupBy(*keys).agg(
        (F.avg("_r") / (F.stddev_pop("_r") + 1e-9) * math.sqrt(YEAR)).alias("sharpe"), F.min("_dd").alias("max_drawdown")
    )
    both = t.unionByName(e, allowMissingColumns=True)
    return both.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns if c not in keys])
