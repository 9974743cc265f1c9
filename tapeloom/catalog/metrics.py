"""Performance queries (inventory rows M01-M13): each symbol's close is a value series, the market its daily mean."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog.base import PART, SOFAR, W, query, with_bars
from tapeloom.catalog.indicators import KEY, r4, s4
from tapeloom.catalog.trades import LOG, NAV, PLAIN, RULES, nav_of, plain, scenario
from tapeloom.operators import metrics as m
from tapeloom.operators import trades as tr

SYM = ("symbol",)
RET = (f"ret AS (SELECT *, close / lag(close) {W} - 1 AS r FROM bars)",)
MARKET = (*RET, "mk AS (SELECT date, avg(r) AS b FROM ret GROUP BY 1)", "pair AS (SELECT ret.*, mk.b FROM ret JOIN mk USING (date) WHERE r IS NOT NULL)")
DD = (f"top AS (SELECT *, max(close) {SOFAR} AS mx FROM ret)", "dd AS (SELECT *, (close - mx) / mx AS d FROM top)")
DAY_RF = "0.03::DOUBLE / 252"


def ret(t):
    return m.returns(t.bars, "close", "r", SYM)


def pair(t):
    """Returns next to the mean return of all symbols on the same date."""
    df = ret(t).where("r IS NOT NULL")
    return df.join(df.groupBy("date").agg(F.avg("r").alias("b")), "date")


def per_symbol(df, **aggs):
    return df.groupBy("symbol").agg(*[a.alias(n) for n, a in aggs.items()])


@query("m01_sharpe", with_bars(f"SELECT symbol, round(avg(r - {DAY_RF}) / nullif(stddev_samp(r - {DAY_RF}), 0) * sqrt(252), 6) AS sharpe_ratio FROM ret GROUP BY 1", *RET))
def _(t):
    return per_symbol(ret(t), sharpe_ratio=F.round(m.sharpe(F.col("r")), 6))


@query("m02_sortino", with_bars(
    f"SELECT symbol, round(avg(r - {DAY_RF}) / stddev_samp(r) FILTER (r < 0) * sqrt(252), 6) AS sortino_ratio FROM ret GROUP BY 1", *RET))
def _(t):
    return per_symbol(ret(t), sortino_ratio=F.round(m.sortino(F.col("r")), 6))


@query("m03_drawdown", store=True, sql=with_bars("SELECT symbol, date, round(d, 6) AS drawdown, round(min(d) OVER (PARTITION BY symbol), 6) AS max_drawdown FROM dd", *RET, *DD))
def _(t):
    df = m.drawdown(t.bars, "close", keys=SYM)
    return df.join(m.max_drawdown(t.bars, "close", SYM), "symbol").select(*KEY, *r4("drawdown", "max_drawdown", digits=6))


@query("m04_calmar", with_bars(
    f"""SELECT symbol, round(avg(r) * 252 / abs(min((g - gm) / gm)), 6) AS calmar_ratio FROM
  (SELECT *, max(g) {SOFAR} AS gm FROM (SELECT *, product(1 + r) {SOFAR} AS g FROM ret WHERE r IS NOT NULL)) GROUP BY 1""", *RET))
def _(t):
    return m.calmar(ret(t), "r", SYM).select("symbol", *r4("calmar_ratio", digits=6))


@query("m05_information_ratio", store=True, sql=with_bars(
    "SELECT symbol, round(avg(r - b) * 252 / (stddev_samp(r - b) * sqrt(252)), 6) AS information_ratio, round(stddev_samp(r - b) * sqrt(252), 6) AS tracking_error FROM pair GROUP BY 1", *MARKET))
def _(t):
    r, b = F.col("r"), F.col("b")
    return per_symbol(pair(t), information_ratio=F.round(m.information_ratio(r, b), 6), tracking_error=F.round(m.tracking_error(r, b), 6))


@query("m06_treynor", with_bars("SELECT symbol, round((avg(r) * 252 - 0.03) / 1.2, 6) AS treynor_ratio FROM ret GROUP BY 1", *RET))
def _(t):
    return per_symbol(ret(t), treynor_ratio=F.round(m.treynor(F.col("r"), 1.2), 6))


@query("m07_alpha_beta", store=True, sql=with_bars(
    f"""SELECT symbol, round(be, 6) AS beta, round((ar - {DAY_RF} - be * (ab - {DAY_RF})) * 252, 6) AS alpha, round(sl, 6) AS slope FROM
  (SELECT symbol, covar_samp(r, b) / var_pop(b) AS be, avg(r) AS ar, avg(b) AS ab, regr_slope(r, b) AS sl FROM pair GROUP BY 1)""", *MARKET))
def _(t):
    r, b = F.col("r"), F.col("b")
    return per_symbol(pair(t), beta=F.round(m.beta(r, b), 6), alpha=F.round(m.alpha(r, b), 6), slope=F.round(m.beta(r, b, True), 6))


@query("m08_value_at_risk", store=True, sql=with_bars(
    "SELECT symbol, round(v, 6) AS var, round(avg(r) FILTER (r <= v), 6) AS cvar FROM ret JOIN (SELECT symbol, quantile_cont(r, 0.05) AS v FROM ret GROUP BY 1) USING (symbol) GROUP BY symbol, v", *RET))
def _(t):
    return m.value_at_risk(ret(t), "r", SYM).select("symbol", *r4("var", "cvar", digits=6))


@query("m09_returns", with_bars(
    f"SELECT symbol, date, round(r, 6) AS returns, CASE WHEN r IS NOT NULL THEN round(close / first_value(close) OVER ({PART}) - 1, 6) END AS cumulative_return FROM ret", *RET))
def _(t):
    df = m.cumulative_return(m.returns(t.bars, "close", keys=SYM), keys=SYM)
    return df.select(*KEY, *r4("returns", "cumulative_return", digits=6))


SUMMARY = f"""summ AS (SELECT *, (pow(1 + total_return, 252.0 / n) - 1) AS annual_return FROM (
  SELECT symbol, arg_max(close, date) / arg_min(close, date) - 1 AS total_return, count(*) AS n, stddev_samp(r) * sqrt(252) AS annual_volatility, min(d) AS max_drawdown,
    count(*) FILTER (r > 0) / count(r) AS win_rate, avg(r) FILTER (r > 0) AS avg_win, avg(r) FILTER (r < 0) AS avg_loss,
    stddev_samp(r - b) * sqrt(252) AS tracking_error, avg(r - b) * 252 / (stddev_samp(r - b) * sqrt(252)) AS information_ratio
  FROM (SELECT dd.*, bm.market / lag(bm.market) OVER (PARTITION BY symbol ORDER BY date) - 1 AS b FROM dd JOIN (SELECT date, avg(close) AS market FROM bars GROUP BY 1) bm USING (date)) GROUP BY 1)),
sum2 AS (SELECT *, (annual_return - 0.03) / annual_volatility AS sharpe_ratio, annual_return / abs(max_drawdown) AS calmar_ratio, abs(avg_win / avg_loss) AS profit_loss_ratio FROM summ)"""
SUM_COLS = ["total_return", "annual_return", "annual_volatility", "sharpe_ratio", "max_drawdown", "calmar_ratio", "win_rate",
            "avg_win", "avg_loss", "profit_loss_ratio", "tracking_error", "information_ratio"]


def with_market(t):
    """Bars next to the mean close of all symbols on the date."""
    return t.bars.join(t.bars.groupBy("date").agg(F.avg("close").alias("market")), "date")


@query("m10_summary", store=True, sql=with_bars(f"SELECT symbol, {s4(*SUM_COLS)} FROM sum2", *RET, *DD, SUMMARY))
def _(t):
    return m.summary(with_market(t), "close", SYM, benchmark="market").select("symbol", *r4(*SUM_COLS))


def report_sql():
    parts = []
    for i, (label, name, kind) in enumerate(m.REPORT):
        text = f"printf('%.2f%%', {name} * 100)" if kind == "pct" else f"printf('%.4f', {name})"
        parts.append(f"SELECT symbol, {i + 1} AS line, '{label}' AS metric, {text} AS value FROM sum2")
    return " UNION ALL ".join(parts)


@query("m11_report", store=True, sql=with_bars(report_sql(), *RET, *DD, SUMMARY))
def _(t):
    return m.report(m.summary(with_market(t), "close", SYM, benchmark="market"), SYM)


@query("m12_dashboard_metrics", with_bars(
    f"""SELECT scenario, round(iv, 0) AS initial_value, round(fv, 0) AS final_value, days, round(days / 365.25, 4) AS years, round((fv - iv) / iv, 4) AS total_return,
  round(pow(1 + (fv - iv) / iv, 365.25 / days) - 1, 4) AS annual_return, round(mdd, 4) AS max_drawdown, round(sh, 4) AS sharpe_ratio, round(wr, 4) AS win_rate, round(plr, 4) AS profit_loss_ratio FROM (
  SELECT scenario, arg_min(portfolio_value, date) AS iv, arg_max(portfolio_value, date) AS fv, date_diff('day', min(date), max(date)) AS days, min((cr - cm) / cm) AS mdd,
   avg(r - {DAY_RF}) / stddev_samp(r) * sqrt(252) AS sh, count(*) FILTER (r > 0) / count(r) AS wr, abs(avg(r) FILTER (r > 0) / avg(r) FILTER (r < 0)) AS plr FROM (
   SELECT *, max(cr) OVER (ORDER BY date) AS cm FROM (SELECT *, portfolio_value / lag(portfolio_value) OVER (ORDER BY date) - 1 AS r,
     CASE WHEN lag(portfolio_value) OVER (ORDER BY date) IS NOT NULL THEN portfolio_value / first_value(portfolio_value) OVER (ORDER BY date) END AS cr FROM nav)) GROUP BY 1)""", *PLAIN, NAV))
def _(t):
    df = m.dashboard_metrics(tr.nav_returns(nav_of(t)), ("scenario",))
    return df.select("scenario", *r4("initial_value", "final_value", digits=0), "days",
                     *r4("years", "total_return", "annual_return", "max_drawdown", "sharpe_ratio", "win_rate", "profit_loss_ratio"))


@query("m13_sleeve_metrics", store=True, sql=with_bars(
    """SELECT scenario, round(win_rate, 4) AS win_rate, round(expectancy, 2) AS expectancy, total_trades, round(sharpe, 4) AS sharpe, round(mdd, 4) AS max_drawdown FROM
  (SELECT scenario, count(*) FILTER (profit > 0) / count(profit) AS win_rate, avg(profit) AS expectancy, count(profit) AS total_trades FROM log GROUP BY 1)
  JOIN (SELECT scenario, avg(r) / (stddev_pop(r) + 1e-9) * sqrt(252) AS sharpe, min((portfolio_value - mx) / mx) AS mdd FROM
   (SELECT *, portfolio_value / lag(portfolio_value) OVER (ORDER BY date) - 1 AS r, max(portfolio_value) OVER (ORDER BY date) AS mx FROM nav) GROUP BY 1) USING (scenario)""", *PLAIN, LOG, NAV))
def _(t):
    led = scenario(plain(t))
    out = m.sleeve_metrics(tr.trade_log(led, RULES, ("scenario",)), tr.nav(led), "profit", "portfolio_value")
    return out.select("scenario", *r4("win_rate"), *r4("expectancy", digits=2), "total_trades", *r4("sharpe", "max_drawdown"))


@query("b24_period_summary", store=True, sql=with_bars(
    f"""SELECT period, round(arg_max(v, date), 0) AS final_portfolio_value, round(arg_max(v, date) / arg_min(v, date) - 1, 4) AS total_return, round(min((v - mx) / mx), 4) AS max_drawdown,
  round(stddev_samp(r) * sqrt(252), 4) AS annual_volatility, any_value(b.buys) AS buy_trade_count, any_value(b.sells) AS sell_trade_count, round(any_value(b.wr), 4) AS win_rate, round(any_value(b.pp), 4) AS avg_profit_pct FROM (
  SELECT *, v / lag(v) OVER (PARTITION BY period ORDER BY date) - 1 AS r, max(v) OVER (PARTITION BY period ORDER BY date) AS mx FROM
    (SELECT CASE WHEN year(date) < 1999 THEN 'train' ELSE 'valid' END AS period, date, portfolio_value AS v FROM nav)) n
  LEFT JOIN (SELECT CASE WHEN year(date) < 1999 THEN 'train' ELSE 'valid' END AS period, count(*) FILTER (action = 'buy' AND status = 'filled') AS buys, count(*) FILTER (action = 'sell') AS sells,
     count(*) FILTER (profit > 0) / count(*) FILTER (action = 'sell') AS wr, avg(profit_pct) AS pp FROM log GROUP BY 1) b USING (period) GROUP BY 1""", *PLAIN, LOG, NAV))
def _(t):
    led = scenario(plain(t))
    period = F.when(F.year("date") < 1999, "train").otherwise("valid")
    out = tr.period_summary(tr.nav(led).withColumn("period", period), tr.trade_log(led, RULES, ("scenario",)).withColumn("period", period), 1_000_000.0, ("scenario", "period"))
    return out.select("period", *r4("final_portfolio_value", digits=0), *r4("total_return", "max_drawdown", "annual_volatility"),
                      "buy_trade_count", "sell_trade_count", *r4("win_rate", "avg_profit_pct"))
