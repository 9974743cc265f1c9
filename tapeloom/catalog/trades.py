"""Trade, stop, ledger and value queries (inventory rows B01-B25)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog.base import SOFAR, W, query, with_bars
from tapeloom.catalog.indicators import KEY, atr_ctes, r4, s4
from tapeloom.catalog.signals import T01, L
from tapeloom.functions.kernels import BARS
from tapeloom.operators import signals as sig
from tapeloom.operators import trades as tr

# The given prices jump far more than a share does in a day, so the limits are wide here.
RULES = tr.Rules(trade_amount=1_000_000.0, lot_size=10, limit_pct=1.5)
COST = "greatest({v} * 0.0003, 5.0)"

# bars with gaps in the data, by rule: no open on the 13th, no volume on thin days, no amount on the 7th
ROUGH_SQL = """rough AS (SELECT symbol, date, CASE WHEN day(date) <> 13 THEN open END AS open, close, high, low,
  CASE WHEN volume <= 5 THEN 0 ELSE volume END AS volume, CASE WHEN day(date) <> 7 THEN amount END AS amount,
  CASE WHEN symbol = 'Brand#7' THEN '*st ' || symbol ELSE symbol END AS name FROM bars)"""


def rough(t):
    day = F.dayofmonth("date")
    return t.bars.withColumns(
        {
            "open": F.when(day != 13, F.col("open")),
            "volume": F.when(F.col("volume") <= 5, 0.0).otherwise(F.col("volume")),
            "amount": F.when(day != 7, F.col("amount")),
            "name": F.when(F.col("symbol") == "Brand#7", F.concat(F.lit("*st "), "symbol")).otherwise(F.col("symbol")),
        }
    )


DIGITS = "regexp_replace(symbol, '[^0-9]', '', 'g')"


def pct_sql(st=False, base="1.5"):
    names = "WHEN contains(upper(name), 'ST') THEN 0.05 " if st else ""
    hits = " ".join(f"WHEN starts_with(symbol, '{p}') OR starts_with({DIGITS}, '{p}') THEN {v}" for p, v in
                    (("300", "0.20"), ("301", "0.20"), ("688", "0.20"), ("4", "0.30"), ("8", "0.30")))
    return f"CAST(CASE {names}{hits} ELSE {base} END AS DOUBLE)"


def flag_ctes(src, name="fl"):
    """Row flags of the order rules over a table with a signal."""
    return (f"{name}_a AS (SELECT *, {L('close')} AS pc, {pct_sql()} AS pct, CAST(floor(1000000.0 / close) AS BIGINT) AS req FROM {src})",
            f"{name}_b AS (SELECT *, greatest(abs(pc) * 1e-4, 1e-6) AS tol FROM {name}_a)",
            f"""{name} AS (SELECT *, coalesce(pc > 0 AND close >= pc * (1 + pct) - tol AND high >= pc * (1 + pct) - tol, FALSE) AS lim_up,
  coalesce(pc > 0 AND close <= pc * (1 - pct) + tol AND low <= pc * (1 - pct) + tol, FALSE) AS lim_down,
  (volume <= 0 OR amount <= 0) AS susp, (req // 10) * 10 AS lots FROM {name}_b)""")


def ledger_ctes(src="t01", loss=None, profit=None, name="led"):
    """The ledger as a fold over one series. loss/profit: SQL over v[1] (row), e (entry), t (top), d (days)."""
    a = "acc[len(acc)]"
    top = f"greatest({a}.t, v[1].h)"
    def sub(s):
        return s.replace("@e", f"{a}.e").replace("@t", top).replace("@d", f"(v[1].i - {a}.k)") if s else "0"
    why = f"CASE WHEN ({sub(loss)}) <> 0 THEN ({sub(loss)}) ELSE ({sub(profit)}) END"
    keep = "'c': v[1].c, 'h': v[1].h, 'b': v[1].b, 's': v[1].s, 'x': v[1].x, 'a': v[1].a, 'i': v[1].i"
    row = "'c': close, 'h': high, 'b': signal = 1 AND NOT susp AND NOT lim_up AND lots > 0, 's': signal = -1, 'x': NOT susp AND NOT lim_down, 'a': atr, 'i': rn"
    zero = "'c': 0::DOUBLE, 'h': 0::DOUBLE, 'b': FALSE, 's': FALSE, 'x': FALSE, 'a': NULL::DOUBLE, 'i': 0::BIGINT"
    state = "'p': 0, 'e': 0::DOUBLE, 't': 0::DOUBLE, 'k': 0::BIGINT, 'ev': 0, 'w': 0"
    return (*flag_ctes(src, f"{name}_f"), *atr_ctes(14, f"{name}_f", f"{name}_a"),
            f"{name}_r AS (SELECT *, row_number() {W} AS rn FROM {name}_a)",
            f"""{name}_l AS (SELECT symbol, list(date ORDER BY date) AS ds, list_reduce(
    list_prepend([{{{zero}, {state}}}], list_transform(list({{{row}}} ORDER BY date), lambda r: [{{
      'c': r.c, 'h': r.h, 'b': r.b, 's': r.s, 'x': r.x, 'a': r.a, 'i': r.i, {state}}}])),
    lambda acc, v: list_append(acc, CASE
      WHEN {a}.p = 0 AND v[1].b THEN {{{keep}, 'p': 1, 'e': v[1].c * (1 + 0.0001::DOUBLE), 't': v[1].c * (1 + 0.0001::DOUBLE), 'k': v[1].i, 'ev': 1, 'w': 0}}
      WHEN {a}.p = 0 THEN {{{keep}, {state}}}
      WHEN v[1].x AND (v[1].s OR ({why}) <> 0) THEN {{{keep}, 'p': 0, 'e': {a}.e, 't': {top}, 'k': {a}.k, 'ev': -1, 'w': {why}}}
      ELSE {{{keep}, 'p': 1, 'e': {a}.e, 't': {top}, 'k': {a}.k, 'ev': 0, 'w': 0}} END))[2:] AS vs FROM {name}_r GROUP BY symbol)""",
            f"{name}_u AS (SELECT symbol, unnest(ds) AS date, unnest(vs) AS q FROM {name}_l)",
            f"{name}_j AS (SELECT s.*, u.q.ev AS trade, u.q.w AS why, u.q.p AS pos, u.q.k AS entry_row, u.q.e AS entry_price FROM {name}_r s JOIN {name}_u u USING (symbol, date))",
            f"""{name}_k AS (SELECT *, CASE trade WHEN 1 THEN close * (1 + 0.0001::DOUBLE) WHEN -1 THEN close * (1 - 0.0001::DOUBLE) END AS px,
  last_value(CASE WHEN trade = 1 THEN lots END IGNORE NULLS) {SOFAR} AS qty FROM {name}_j)""",
            f"""{name}_m AS (SELECT *, qty * px AS val, last_value(CASE WHEN trade = 1 THEN lots * px + {COST.format(v='(lots * px)')} END IGNORE NULLS) {SOFAR} AS pcost,
  coalesce(lag(pos) {W}, 0) AS prev_pos FROM {name}_k)""",
            f"""{name} AS (SELECT *, CASE WHEN pos = 1 THEN qty ELSE 0 END AS held,
  CASE trade WHEN 1 THEN -pcost WHEN -1 THEN val - {COST.format(v='val')} - val * 0.0005::DOUBLE ELSE 0 END AS flow,
  CASE WHEN susp THEN 'suspended' WHEN lim_up THEN 'limit_up' WHEN lots <= 0 THEN 'lot_size' END AS refusal FROM {name}_m)""")


REASON = "CASE why WHEN 1 THEN 'stop_loss' WHEN 2 THEN 'stop_profit' WHEN 3 THEN 'stop_holding' ELSE 'strategy' END"
LOSS_SQL = "CASE WHEN @d >= 15 THEN 3 WHEN @t > @e AND v[1].c <= @t * (1 - 0.5::DOUBLE) THEN 1 ELSE 0 END"
PROFIT_SQL = "CASE WHEN v[1].c >= @e + v[1].a * 2.0::DOUBLE THEN 2 ELSE 0 END"
LOSS = tr.Stop("trailing", 0.5, holding_day=15)
PROFIT = tr.Stop("atr", atr_window=14)
PLAIN = (*T01, *ledger_ctes())
STOPS = (*T01, *ledger_ctes(loss=LOSS_SQL, profit=PROFIT_SQL))


def plain(t):
    return tr.ledger(sig.ma_cross(t.bars), RULES)


def stops(t):
    return tr.ledger(sig.ma_cross(t.bars), RULES, loss=LOSS, profit=PROFIT)


@query("b01_order_intents", with_bars(
    "SELECT symbol, date, CASE WHEN signal = 1 THEN 'buy' ELSE 'sell' END AS action, CASE WHEN signal = 1 THEN req ELSE lag_held END AS shares "
    f"FROM (SELECT *, coalesce(lag(held) {W}, 0) AS lag_held FROM led) WHERE close > 0 AND ((signal = 1 AND lag_held = 0) OR (signal = -1 AND lag_held > 0))", *PLAIN))
def _(t):
    return tr.order_intents(plain(t), RULES).select(*KEY, "action", "shares")


LEDGER_OUT = ("SELECT symbol, date, trade, held, CASE WHEN held > 0 OR trade = -1 THEN rn - entry_row END AS holding_days, round(flow, 2) AS cash_flow, "
              f"CASE WHEN trade <> 0 THEN {REASON} END AS reason FROM led")


def ledger_cols(df):
    return df.select(*KEY, "trade", "held", "holding_days", F.round("cash_flow", 2).alias("cash_flow"), "reason")


@query("b02_ledger", with_bars(LEDGER_OUT, *PLAIN))
def _(t):
    return ledger_cols(plain(t))


@query("b02b_ledger_stops", with_bars(LEDGER_OUT, *STOPS))
def _(t):
    return ledger_cols(stops(t))


@query("b03_holding_days", with_bars(
    "SELECT symbol, date, rn - entry_row AS holding_days, rn - entry_row >= 10 AS cap_reached FROM led WHERE held > 0 OR trade = -1", *PLAIN))
def _(t):
    return plain(t).where("holding_days IS NOT NULL").select(*KEY, "holding_days", (F.col("holding_days") >= 10).alias("cap_reached"))


@query("b04_suspended", with_bars(
    "SELECT symbol, date, open IS NULL OR coalesce(volume <= 0, FALSE) OR coalesce(amount <= 0, FALSE) AS suspended FROM rough", ROUGH_SQL))
def _(t):
    return tr.suspended(rough(t)).select(*KEY, "suspended")


@query("b05_previous_close", with_bars(
    f"SELECT symbol, date, coalesce({L('close')}, close / (1 + pct_change / 100)) AS prev_close FROM (SELECT *, (close / open - 1) * 100 AS pct_change FROM bars)"))
def _(t):
    df = t.bars.withColumn("pct_change", (F.col("close") / F.col("open") - 1) * 100)
    return tr.previous_close(df).select(*KEY, "prev_close")


@query("b06_limit_pct", with_bars(f"SELECT symbol, date, {pct_sql(True, '0.10')} AS limit_pct FROM rough", ROUGH_SQL))
def _(t):
    return tr.limit_pct(rough(t)).select(*KEY, "limit_pct")


@query("b07_limit_moves", with_bars("SELECT symbol, date, lim_up AS limit_up, lim_down AS limit_down FROM fl", *flag_ctes("bars")))
def _(t):
    return tr.limit_moves(t.bars, RULES).select(*KEY, "limit_up", "limit_down")


@query("b08_t1_rule", with_bars(
    f"SELECT symbol, date, coalesce(CAST(date AS DATE) <= last_value(CASE WHEN trade = 1 THEN date END IGNORE NULLS) {SOFAR}, FALSE) AS t1_blocked FROM led", *PLAIN))
def _(t):
    last_buy = F.last(F.when(F.col("trade") == 1, F.col("date")), ignorenulls=True).over(BARS.so_far)
    return plain(t).withColumn("_lb", last_buy).select(*KEY, tr.violates_t1(F.col("date"), F.col("_lb"), RULES).alias("t1_blocked"))


@query("b09_lot_shares", with_bars(
    "SELECT symbol, date, CAST(floor(1000000.0 / close) AS BIGINT) // 10 * 10 AS buy_shares, "
    "CASE WHEN least(volume, 137) = 137 THEN 137 ELSE CAST(floor(volume / 10) AS BIGINT) * 10 END AS sell_shares FROM bars"))
def _(t):
    want = F.floor(RULES.trade_amount / F.col("close"))
    return t.bars.select(*KEY, tr.lot_shares(want, RULES).alias("buy_shares"),
                         tr.sell_shares(F.col("volume").cast("long"), F.lit(137), RULES).alias("sell_shares"))


@query("b10_rejections", with_bars(
    "SELECT symbol, date, refusal AS rejection_reason, req AS requested_shares FROM led WHERE trade = 0 AND prev_pos = 0 AND signal = 1 AND refusal IS NOT NULL", *PLAIN))
def _(t):
    log = tr.trade_log(plain(t), RULES)
    return log.where("status = 'rejected'").select(*KEY, "rejection_reason", "requested_shares")


@query("b11_trade_costs", with_bars(
    f"SELECT symbol, date, px AS exec_price, round({COST.format(v='val')}, 4) AS commission, round(CASE trade WHEN -1 THEN val * 0.0005::DOUBLE ELSE 0 END, 4) AS stamp_duty FROM led WHERE trade <> 0", *PLAIN))
def _(t):
    log = tr.trade_log(plain(t), RULES).where("status = 'filled'")
    return log.select(*KEY, F.col("price").alias("exec_price"), *r4("commission", "stamp_duty"))


@query("b12_affordable_shares", with_bars(
    """SELECT symbol, date, (SELECT coalesce(max(k), 0) FROM unnest(generate_series(0, CAST(floor(volume) AS BIGINT), 10)) g(k)
   WHERE k * px + CASE WHEN k > 0 THEN greatest(k * px * 0.0003, 5.0) ELSE 0 END <= 50000) AS shares FROM (SELECT *, close * (1 + 0.0001::DOUBLE) AS px FROM bars)"""))
def _(t):
    price = F.col("close") * (1 + RULES.slippage)
    return t.bars.select(*KEY, tr.affordable_shares(F.col("volume"), F.lit(50000.0), price, RULES).alias("shares"))


# stops of a position opened on the first bar of each series
ENTRY = f"first_value(close) {SOFAR}"


def entry():
    return F.first("close").over(BARS.so_far)


@query("b13_stop_loss_levels", with_bars(
    f"""SELECT symbol, date, e * 0.94::DOUBLE AS abs_price, (close <= e * 0.94::DOUBLE)::INT AS abs_signal,
  t * 0.94::DOUBLE AS trail_price, (close <= t * 0.94::DOUBLE OR rn > 40)::INT AS trail_signal,
  round(e - atr * 2, 4) AS atr_price, coalesce(close <= e - atr * 2, FALSE)::INT AS atr_signal FROM
  (SELECT *, {ENTRY} AS e, greatest({ENTRY}, max(high) {SOFAR}) AS t, row_number() {W} AS rn FROM atr_t)""", *atr_ctes(14)))
def _(t):
    df = t.bars.withColumn("_e", entry())
    for name, stop in (("abs", tr.Stop()), ("trail", tr.Stop("trailing", holding_day=40)), ("atr", tr.Stop("atr"))):
        df = tr.stop_loss_levels(df, stop, F.col("_e")).withColumnsRenamed({"stop_price": f"{name}_price", "stop_signal": f"{name}_signal"})
    return df.select(*KEY, "abs_price", "abs_signal", "trail_price", "trail_signal", *r4("atr_price"), "atr_signal")


def first_hit_sql(conds):
    """First row of each series where a condition holds, -1 there and 0 elsewhere."""
    marks = ", ".join(f"CASE WHEN {c} AND coalesce(sum(({c})::INT) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN -1 ELSE 0 END AS {n}"
                      for n, c in conds)
    return (f"SELECT symbol, date, {marks} FROM (SELECT *, {ENTRY} AS e, greatest({ENTRY}, max(high) {SOFAR}) AS t, row_number() {W} - 1 AS d FROM atr_t)")


@query("b14_stop_loss_exit", with_bars(first_hit_sql([
    ("absolute", "close <= e * 0.94::DOUBLE"), ("trailing", "(t > e AND close <= t * 0.94::DOUBLE)"),
    ("atr", "coalesce(close <= e - atr * 2, FALSE)"), ("holding_day", "d >= 12")]), *atr_ctes(14)))
def _(t):
    df = t.bars.withColumn("_e", entry())
    for stop in (tr.Stop(), tr.Stop("trailing"), tr.Stop("atr"), tr.Stop("holding_day", holding_day=12)):
        df = tr.first_stop(df, stop, F.col("_e")).withColumnRenamed("exit_signal", stop.kind)
    return df.select(*KEY, "absolute", "trailing", "atr", "holding_day")


@query("b15_take_profit_levels", with_bars(
    f"""SELECT symbol, date, e * 1.06::DOUBLE AS abs_price, (close >= e * 1.06::DOUBLE)::INT AS abs_signal,
  t * 1.06::DOUBLE AS trail_price, (close >= t * 1.06::DOUBLE)::INT AS trail_signal,
  round(e + atr * 2, 4) AS atr_price, coalesce(close >= e + atr * 2, FALSE)::INT AS atr_signal FROM
  (SELECT *, {ENTRY} AS e, least({ENTRY}, min(low) {SOFAR}) AS t FROM atr_t)""", *atr_ctes(14)))
def _(t):
    df = t.bars.withColumn("_e", entry())
    for name, stop in (("abs", tr.Stop()), ("trail", tr.Stop("trailing")), ("atr", tr.Stop("atr"))):
        df = tr.take_profit_levels(df, stop, F.col("_e")).withColumnsRenamed({"profit_price": f"{name}_price", "profit_signal": f"{name}_signal"})
    return df.select(*KEY, "abs_price", "abs_signal", "trail_price", "trail_signal", *r4("atr_price"), "atr_signal")


@query("b16_take_profit_exit", with_bars(first_hit_sql([
    ("absolute", "close >= e * 1.06::DOUBLE"), ("trailing", "(t >= e * 1.06::DOUBLE AND close <= t * 0.94::DOUBLE)"),
    ("atr", "coalesce(close >= e + atr * 2, FALSE)"), ("holding_day", "d >= 12")]), *atr_ctes(14)))
def _(t):
    df = t.bars.withColumn("_e", entry())
    for stop in (tr.Stop(), tr.Stop("trailing"), tr.Stop("atr"), tr.Stop("holding_day", holding_day=12)):
        df = tr.first_stop(df, stop, F.col("_e"), profit=True).withColumnRenamed("exit_signal", stop.kind)
    return df.select(*KEY, "absolute", "trailing", "atr", "holding_day")


@query("b17_exit_reasons", with_bars(f"SELECT symbol, {REASON} AS reason, count(*) AS exits FROM led WHERE trade = -1 GROUP BY ALL", *STOPS))
def _(t):
    return stops(t).where("trade = -1").groupBy("symbol", "reason").agg(F.count(F.lit(1)).alias("exits"))


@query("b18_stop_atr", with_bars("SELECT symbol, date, round(a, 4) AS stop_loss_atr_14, round(b, 4) AS stop_profit_atr_20 FROM atr_b",
                                 *atr_ctes(14, out="a"), *atr_ctes(20, "atr_t", "atr_b", "b")))
def _(t):
    from tapeloom.operators.indicators import atr

    return atr(atr(t.bars, 14, "stop_loss_atr_14"), 20, "stop_profit_atr_20").select(*KEY, *r4("stop_loss_atr_14", "stop_profit_atr_20"))


LOG = f"""log AS (SELECT 'ma_cross' AS scenario, symbol, date, CASE WHEN trade = -1 THEN 'sell' ELSE 'buy' END AS action, CASE WHEN trade = 0 THEN 'rejected' ELSE 'filled' END AS status,
  CASE WHEN trade = 0 THEN refusal END AS rejection_reason, {REASON} AS reason, CASE WHEN trade <> 0 THEN qty ELSE 0 END AS shares,
  CASE WHEN trade = -1 THEN flow END AS revenue, CASE WHEN trade = -1 THEN flow - pcost END AS profit, CASE WHEN trade = -1 THEN (flow - pcost) / pcost * 100 END AS profit_pct,
  CASE WHEN trade = 1 THEN pcost / qty END AS avg_cost FROM led WHERE trade <> 0 OR (prev_pos = 0 AND signal = 1 AND refusal IS NOT NULL))"""
NAV = f"""nav_d AS (SELECT date, sum(flow) AS flow, sum(held * close) AS worth, sum(trade) AS opened FROM led GROUP BY 1),
nav AS (SELECT 'ma_cross' AS scenario, date, 1000000 + sum(flow) OVER (ORDER BY date) AS cash, sum(opened) OVER (ORDER BY date) AS n_positions,
  1000000 + sum(flow) OVER (ORDER BY date) + worth AS portfolio_value FROM nav_d)"""


def scenario(df):
    return df.withColumn("scenario", F.lit("ma_cross"))


def nav_of(t, led=plain):
    return tr.nav(scenario(led(t)))


@query("b19_realised_profit", with_bars(
    f"SELECT symbol, date, action, shares, {s4('revenue', 'profit', 'profit_pct', 'avg_cost', digits=2)} FROM log WHERE status = 'filled'", *PLAIN, LOG))
def _(t):
    log = tr.trade_log(plain(t), RULES).where("status = 'filled'")
    return log.select(*KEY, "action", "shares", *r4("revenue", "profit", "profit_pct", "avg_cost", digits=2))


@query("b20_daily_value", with_bars("SELECT scenario, date, round(cash, 0) AS cash, CAST(n_positions AS BIGINT) AS n_positions, round(portfolio_value, 0) AS portfolio_value FROM nav", *STOPS, NAV))
def _(t):
    return nav_of(t, stops).select("scenario", "date", *r4("cash", digits=0), "n_positions", *r4("portfolio_value", digits=0))


@query("b21_value_returns", with_bars(
    "SELECT scenario, date, round(portfolio_value / lag(portfolio_value) OVER (ORDER BY date) - 1, 6) AS returns, "
    "CASE WHEN lag(portfolio_value) OVER (ORDER BY date) IS NOT NULL THEN round(portfolio_value / first_value(portfolio_value) OVER (ORDER BY date), 6) END AS cumulative_returns FROM nav", *PLAIN, NAV))
def _(t):
    return tr.nav_returns(nav_of(t)).select("scenario", "date", *r4("returns", "cumulative_returns", digits=6))


@query("b22_annual_returns", with_bars(
    "SELECT scenario, year(date) AS year, round((arg_max(portfolio_value, date) / arg_min(portfolio_value, date) - 1) * 100, 4) AS annual_return FROM nav GROUP BY ALL", *PLAIN, NAV))
def _(t):
    return tr.annual_returns(nav_of(t)).select("scenario", "year", *r4("annual_return"))


STATS_SQL = """SELECT scenario, count(*) FILTER (status = 'filled' AND action = 'buy') AS buys, count(*) FILTER (action = 'sell') AS sells,
  count(*) FILTER (profit > 0) AS wins, round(count(*) FILTER (profit > 0) / count(*) FILTER (action = 'sell') * 100, 4) AS win_rate,
  round(avg(profit), 2) AS avg_profit, round(avg(profit_pct), 4) AS avg_profit_pct, count(*) FILTER (status = 'rejected') AS rejected_buys,
  count(*) FILTER (action = 'sell' AND reason = 'stop_holding') AS stop_holding_exits, count(*) FILTER (action = 'sell' AND reason = 'stop_loss') AS stop_loss_exits,
  count(*) FILTER (action = 'sell' AND reason = 'stop_profit') AS stop_profit_exits, count(*) FILTER (action = 'sell' AND reason = 'strategy') AS strategy_exits,
  (SELECT CAST(max(n_positions) AS BIGINT) FROM nav) AS max_positions, (SELECT CAST(arg_max(n_positions, date) AS BIGINT) FROM nav) AS final_positions FROM log GROUP BY 1"""


@query("b23_trade_statistics", store=True, sql=with_bars(STATS_SQL, *STOPS, LOG, NAV))
def _(t):
    led = scenario(stops(t))
    out = tr.trade_statistics(tr.trade_log(led, RULES, ("scenario",)), tr.nav(led))
    return out.withColumns({"win_rate": F.round("win_rate", 4), "avg_profit": F.round("avg_profit", 2), "avg_profit_pct": F.round("avg_profit_pct", 4)})


@query("b25_pooled_expectancy", with_bars(
    """SELECT CAST(sum(n) AS BIGINT) AS trade_sum, round(sum(n * wr), 4) AS win_sum, round(sum(n * wr) / sum(n), 6) AS win_rate, round(sum(n * ex) / sum(n), 2) AS expectancy FROM
  (SELECT symbol, CAST(count(*) AS BIGINT) AS n, count(*) FILTER (profit > 0) / count(*) AS wr, avg(profit) AS ex FROM log WHERE action = 'sell' GROUP BY 1)""", *PLAIN, LOG))
def _(t):
    sells = tr.trade_log(plain(t), RULES).where("action = 'sell'")
    per = sells.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("total_trades"), (F.count_if(F.col("profit") > 0) / F.count(F.lit(1))).alias("win_rate"), F.avg("profit").alias("expectancy"))
    return tr.pooled_expectancy(per).select("trade_sum", *r4("win_sum"), *r4("win_rate", digits=6), *r4("expectancy", digits=2))


