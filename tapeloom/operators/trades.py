"""From signals to trades: exchange constraints, costs, stops, a position ledger and its value.

Every symbol trades its own fixed amount, so series do not wait for each other's cash: the result
equals a shared account whenever that account never runs out.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.kernels import BARS, Panel, div, flag, fold, lag, row_no
from tapeloom.operators import indicators as ind

# fixed values: daily limit by code prefix
LIMIT_BY_PREFIX = {"300": 0.20, "301": 0.20, "688": 0.20, "4": 0.30, "8": 0.30}

TRADE_COLUMNS = [
    "date", "symbol", "action", "status", "rejection_reason", "requested_shares", "shares", "price", "trade_value",
    "commission", "stamp_duty", "cost", "avg_cost", "revenue", "profit", "profit_pct", "reason",
]


@dataclass(frozen=True)
class Rules:
    """Costs and exchange rules of one account."""

    trade_amount: float = 10000.0
    commission_rate: float = 0.0003
    min_commission: float = 5.0
    stamp_duty_rate: float = 0.0005
    slippage: float = 0.0001
    enforce_lot_size: bool = True
    lot_size: int = 100
    enable_t1: bool = True
    block_suspended: bool = True
    block_limit_up: bool = True
    block_limit_down: bool = True
    limit_pct: float = 0.10
    st_limit_pct: float | None = 0.05
    limit_pct_by_prefix: Mapping[str, float] = field(default_factory=lambda: dict(LIMIT_BY_PREFIX))

    def with_(self, **kw) -> Rules:
        return replace(self, **kw)


@dataclass(frozen=True)
class Stop:
    """One stop: absolute, trailing, atr or holding_day, each with an optional day cap.

    A trailing loss follows the highest price down by ``pct``, once that price passed the entry.
    A trailing profit is armed when the high reached entry*(1+pct), then falls back by ``pct``.
    """

    kind: str = "absolute"
    pct: float = 0.06
    holding_day: int | None = None
    atr_window: int = 14
    atr_multiplier: float = 2.0

    def __post_init__(self):
        if self.holding_day is not None and self.holding_day <= 0:
            raise ValueError("holding_day must be a positive integer when provided.")
        if self.kind in ("holding_day", "holding_days") and self.holding_day is None:
            raise ValueError("holding_day must be a positive integer for this kind of stop.")


# ---- row rules ------------------------------------------------------------------------------


def suspended(df: DataFrame, out: str = "suspended") -> DataFrame:
    """A missing price, or no volume or amount where these are given."""
    bad = F.lit(False)
    for c in ("open", "close", "high", "low"):
        bad = bad | (F.col(c).isNull() if c in df.columns else F.lit(True))
    for c in ("volume", "amount"):
        if c in df.columns:
            bad = bad | flag(F.col(c) <= 0)
    return df.withColumn(out, bad)


def previous_close(df: DataFrame, out: str = "prev_close", panel: Panel = BARS) -> DataFrame:
    """The close of the row before, else the close that the percent change implies."""
    prev = lag("close", panel=panel)
    if "pct_change" in df.columns:
        base = 1 + F.col("pct_change") / 100
        prev = F.coalesce(prev, F.when(F.abs(base) > 1e-8, div("close", base)))
    return df.withColumn(out, prev)


def symbol_digits(symbol: Column) -> Column:
    return F.regexp_replace(symbol, "[^0-9]", "")


def limit_pct(df: DataFrame, rules: Rules = Rules(), out: str = "limit_pct") -> DataFrame:
    """The daily limit: special-treatment names first, then the longest matching code prefix."""
    case, symbol = None, F.col("symbol")
    if rules.st_limit_pct is not None and "name" in df.columns:
        case = F.when(flag(F.upper("name").contains("ST")), rules.st_limit_pct)
    for prefix, pct in sorted(rules.limit_pct_by_prefix.items(), key=lambda kv: -len(kv[0])):
        hit = symbol.startswith(prefix) | symbol_digits(symbol).startswith(prefix)
        case = F.when(hit, pct) if case is None else case.when(hit, pct)
    base = F.lit(float(rules.limit_pct))
    return df.withColumn(out, base if case is None else case.otherwise(base))


def limit_moves(df: DataFrame, rules: Rules = Rules(), panel: Panel = BARS) -> DataFrame:
    """Adds limit_up and limit_down: close and extreme at the limit, within a small tolerance."""
    df = limit_pct(previous_close(df, "_pc", panel), rules, "_pct")
    pc, pct = F.col("_pc"), F.col("_pct")
    slack = F.greatest(F.abs(pc) * 1e-4, F.lit(1e-6))
    high, low = F.coalesce("high", "close"), F.coalesce("low", "close")
    top, bottom = pc * (1 + pct) - slack, pc * (1 - pct) + slack
    return df.withColumns(
        {
            "limit_up": flag((pc > 0) & (F.col("close") >= top) & (high >= top)),
            "limit_down": flag((pc > 0) & (F.col("close") <= bottom) & (low <= bottom)),
        }
    ).drop("_pc", "_pct")


def lot_shares(shares: Column, rules: Rules = Rules()) -> Column:
    """Bought shares in whole lots."""
    whole = F.greatest(F.coalesce(shares.cast("long"), F.lit(0)), F.lit(0))
    if not rules.enforce_lot_size:
        return whole
    lot = max(int(rules.lot_size), 1)
    return (F.floor(whole / lot) * lot).cast("long")


def sell_shares(shares: Column, held: Column, rules: Rules = Rules()) -> Column:
    """Sold shares: at most the holding; a full exit may be odd, a part must be whole lots."""
    want = F.least(F.greatest(shares, F.lit(0)), held)
    if not rules.enforce_lot_size:
        return want.cast("long")
    lot = max(int(rules.lot_size), 1)
    return F.when(want == held, want).otherwise(F.floor(want / lot) * lot).cast("long")


def violates_t1(date: Column, last_buy: Column, rules: Rules = Rules()) -> Column:
    return flag(F.to_date(date) <= F.to_date(last_buy)) if rules.enable_t1 else F.lit(False)


def rejection_reason(action: Column, rules: Rules = Rules(), last_buy: Column | None = None, requested: Column | None = None) -> Column:
    """Why an order on this row is refused, in order of precedence; needs the row flags."""
    parts = [F.when(F.col("close").isNull() & F.col("date").isNull(), "missing_trade_row")]
    if rules.block_suspended:
        parts.append(F.when(F.col("suspended"), "suspended"))
    if rules.block_limit_up:
        parts.append(F.when((action == "buy") & F.col("limit_up"), "limit_up"))
    if rules.block_limit_down:
        parts.append(F.when((action == "sell") & F.col("limit_down"), "limit_down"))
    if last_buy is not None:
        parts.append(F.when((action == "sell") & violates_t1(F.col("date"), last_buy, rules), "t1_restriction"))
    if requested is not None:
        parts.append(F.when((action == "buy") & (lot_shares(requested, rules) <= 0), "lot_size"))
    return F.coalesce(*parts)


def execution_price(close: Column, action: Column, rules: Rules = Rules()) -> Column:
    return F.when(action == "buy", close * (1 + rules.slippage)).otherwise(close * (1 - rules.slippage))


def commission(value: Column, rules: Rules = Rules()) -> Column:
    return F.when(value > 0, F.greatest(value * rules.commission_rate, F.lit(float(rules.min_commission)))).otherwise(0.0)


def stamp_duty(value: Column, action: Column, rules: Rules = Rules()) -> Column:
    return F.when((value > 0) & (action == "sell"), value * rules.stamp_duty_rate).otherwise(0.0)


def affordable_shares(requested: Column, cash: Column, price: Column, rules: Rules = Rules()) -> Column:
    """The most whole lots, up to the request, whose value and commission the cash covers."""
    step = max(int(rules.lot_size), 1) if rules.enforce_lot_size else 1
    lots = lambda money, unit: F.floor(F.try_divide(money, unit))
    fit = F.least(
        F.floor(requested / step),
        lots(cash - rules.min_commission, price * step),
        lots(cash, price * step * (1 + rules.commission_rate)),
    )
    return (F.greatest(fit, F.lit(0)) * step).cast("long")


# ---- stops from a given entry -----------------------------------------------------------------


def _from_entry(df: DataFrame, stop: Stop, side: str, entry: Column, panel: Panel) -> DataFrame:
    """Stop price and signal of every row of a series that starts with its entry row."""
    loss = side == "stop"
    if stop.kind == "atr":
        df = ind.atr(df, stop.atr_window, "_atr", panel)
        level = entry - F.col("_atr") * stop.atr_multiplier if loss else entry + F.col("_atr") * stop.atr_multiplier
    elif stop.kind == "trailing":
        best = F.greatest(entry, F.max("high").over(panel.so_far)) if loss else F.least(entry, F.min("low").over(panel.so_far))
        level = best * (1 - stop.pct) if loss else best * (1 + stop.pct)
    elif stop.kind in ("holding_day", "holding_days"):
        level = F.lit(None).cast("double")
    else:
        level = entry * (1 - stop.pct) if loss else entry * (1 + stop.pct)
    df = df.withColumn(f"{side}_price", level)
    hit = F.col("close") <= F.col(f"{side}_price") if loss else F.col("close") >= F.col(f"{side}_price")
    hit = flag(hit)
    if stop.holding_day is not None:
        hit = hit | (row_no(panel) > stop.holding_day)
    return df.withColumn(f"{side}_signal", hit.cast("int")).drop("_atr")


def stop_loss_levels(df: DataFrame, stop: Stop, entry: Column, panel: Panel = BARS) -> DataFrame:
    """Adds stop_price and stop_signal; trailing follows the running high."""
    return _from_entry(df, stop, "stop", entry, panel)


def take_profit_levels(df: DataFrame, stop: Stop, entry: Column, panel: Panel = BARS) -> DataFrame:
    """Adds profit_price and profit_signal; trailing follows the running low."""
    return _from_entry(df, stop, "profit", entry, panel)


def first_stop(df: DataFrame, stop: Stop, entry: Column, profit: bool = False, panel: Panel = BARS) -> DataFrame:
    """Adds exit_signal: -1 on the first row where the stateful check of a held position fires.

    The check differs from the level columns: a trailing loss has no price until the high passes
    the entry, and a trailing profit is armed by the high and fires on the way back.
    """
    df = ind.atr(df, stop.atr_window, "_atr", panel).withColumns(
        {"_hi": F.greatest(entry, F.max("high").over(panel.so_far)), "_days": row_no(panel) - 1}
    )
    hi, close = F.col("_hi"), F.col("close")
    if stop.kind == "atr":
        hit = close >= entry + F.col("_atr") * stop.atr_multiplier if profit else close <= entry - F.col("_atr") * stop.atr_multiplier
    elif stop.kind == "trailing":
        hit = (hi >= entry * (1 + stop.pct)) & (close <= hi * (1 - stop.pct)) if profit else (hi > entry) & (close <= hi * (1 - stop.pct))
    elif stop.kind in ("holding_day", "holding_days"):
        hit = F.lit(False)
    else:
        hit = close >= entry * (1 + stop.pct) if profit else close <= entry * (1 - stop.pct)
    hit = flag(hit)
    if stop.holding_day is not None:
        hit = hit | (F.col("_days") >= stop.holding_day)
    df = df.withColumn("_hit", hit)
    first = F.col("_hit") & (F.coalesce(F.sum(F.col("_hit").cast("int")).over(panel.before), F.lit(0)) == 0)
    return df.withColumn("exit_signal", F.when(first, -1).otherwise(0)).drop("_atr", "_hi", "_days", "_hit")


# ---- ledger -----------------------------------------------------------------------------------


def exchange_flags(df: DataFrame, rules: Rules = Rules(), panel: Panel = BARS) -> DataFrame:
    """Adds what the exchange says about each bar, whatever the signal: requested_shares, buy_refusal, can_sell."""
    df = limit_moves(suspended(df), rules, panel)
    good = flag(F.col("close") > 0)
    df = df.withColumn("requested_shares", F.when(good, F.floor(rules.trade_amount / F.col("close"))).otherwise(0).cast("long"))
    why = rejection_reason(F.lit("buy"), rules, requested=F.col("requested_shares"))
    no_sell = rejection_reason(F.lit("sell"), rules)
    return df.withColumns({"buy_refusal": why, "can_sell": no_sell.isNull() & good})


def order_intents(df: DataFrame, rules: Rules = Rules(), held: str = "held_before", signal: str = "signal") -> DataFrame:
    """Rows that ask for an order: buy when flat on signal 1, sell all when holding on -1."""
    good = flag(F.col("close") > 0)
    action = F.when(flag(F.col(signal) == 1) & (F.col(held) == 0), "buy").when(flag(F.col(signal) == -1) & (F.col(held) > 0), "sell")
    df = df.withColumn("action", F.when(good, action)).where("action IS NOT NULL")
    return df.withColumn("shares", F.when(F.col("action") == "buy", F.floor(rules.trade_amount / F.col("close"))).otherwise(F.col(held)).cast("long"))


def _stop_path(loss: Stop | None, profit: Stop | None, slippage: float):
    """The ledger rule with stops for one series: state is the open entry and the highest price since."""

    def fires(stop, is_profit, entry, top, close, atr, days):
        if stop is None:
            return 0
        if stop.holding_day is not None and days >= stop.holding_day:
            return 3
        if stop.kind in ("holding_day", "holding_days"):
            return 0
        code = 2 if is_profit else 1
        if stop.kind == "trailing":
            armed = top >= entry * (1 + stop.pct) if is_profit else top > entry
            return code if armed and close <= top * (1 - stop.pct) else 0
        if stop.kind == "atr":
            move = atr * stop.atr_multiplier
        else:
            move = entry * stop.pct
        # a missing ATR compares false
        return code if (close >= entry + move if is_profit else close <= entry - move) else 0

    def run(c):
        n = len(c["close"])
        trade, why = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        buy, sell, can = c["_buy"], c["_sell"], c["_can"]
        since, entry, top = -1, 0.0, 0.0
        for i in range(n):
            if since < 0:
                if buy[i]:
                    since, trade[i] = i, 1
                    entry = top = c["close"][i] * (1 + slippage)
                continue
            if c["high"][i] > top:
                top = c["high"][i]
            days = i - since
            code = fires(loss, False, entry, top, c["close"][i], c["_latr"][i], days) or fires(
                profit, True, entry, top, c["close"][i], c["_patr"][i], days
            )
            if (code or sell[i]) and can[i]:
                trade[i], why[i], since = -1, code, -1
        return {"_trade": trade, "_why": why}

    return run


def ledger(
    df: DataFrame, rules: Rules = Rules(), signal: str = "signal", loss: Stop | None = None, profit: Stop | None = None,
    panel: Panel = BARS,
) -> DataFrame:
    """Adds the position after each bar and the trade of the bar, if any.

    Columns: trade (1 bought, -1 sold, 0), reason, held (shares after the bar), held_before,
    entry_row, holding_days, entry_price, exec_price, fill_shares, position_cost (what the open or
    just closed position cost), cash_flow. A buy needs signal 1 and no position, a sell signal -1 or a stop and a position; both
    need a row that the exchange rules let through; the rows may bring these flags along, when the
    ledger covers a part of a series whose flags look further back. Without stops that is a latch on the open
    rows, so no Python runs; a stop depends on the open entry and is folded.
    """
    if "buy_refusal" not in df.columns:
        df = exchange_flags(df, rules, panel)
    good = flag(F.col("close") > 0)
    df = df.withColumns({"want_buy": flag(F.col(signal) == 1) & good, "want_sell": flag(F.col(signal) == -1) & good})
    df = df.withColumns(
        {
            "_buy": F.col("want_buy") & F.col("buy_refusal").isNull(),
            "_sell": F.col("want_sell"),
            "_can": F.col("can_sell"),
        }
    )
    if loss is None and profit is None:
        event = F.when(F.col("_buy"), 1).when(F.col("_sell") & F.col("_can"), 0)
        df = df.withColumn("_state", F.coalesce(F.last(event, ignorenulls=True).over(panel.so_far), F.lit(0)))
        df = df.withColumn("_trade", F.col("_state") - F.coalesce(lag("_state", panel=panel), F.lit(0))).withColumn("_why", F.lit(0))
    else:
        for name, stop in (("_latr", loss), ("_patr", profit)):
            if stop is not None and stop.kind == "atr":
                df = ind.atr(df, stop.atr_window, name, panel)
            else:
                df = df.withColumn(name, F.lit(None).cast("double"))
        inputs = ["close", "high", "_buy", "_sell", "_can", "_latr", "_patr"]
        df = fold(df, inputs, {"_trade": "int", "_why": "int"}, _stop_path(loss, profit, rules.slippage), panel)
    trade, close = F.col("_trade"), F.col("close")
    action = F.when(trade == 1, "buy").otherwise("sell")
    df = df.withColumn("_rn", row_no(panel)).withColumn("exec_price", F.when(trade != 0, execution_price(close, action, rules)))
    bought = trade == 1
    lots = lot_shares(F.col("requested_shares"), rules)
    so_far, before = panel.so_far, panel.before
    value = lots * F.col("exec_price")
    opened = {
        "entry_row": F.last(F.when(bought, F.col("_rn")), ignorenulls=True),
        "entry_price": F.last(F.when(bought, F.col("exec_price")), ignorenulls=True),
        "_lots": F.last(F.when(bought, lots), ignorenulls=True),
        "position_cost": F.last(F.when(bought, value + commission(value, rules)), ignorenulls=True),
        "_open": F.last(F.when(trade != 0, trade), ignorenulls=True),
    }
    df = df.withColumns({k: v.over(so_far) for k, v in opened.items()})
    df = df.withColumns(
        {
            "held": F.when(F.col("_open") == 1, F.col("_lots")).otherwise(0).cast("long"),
            "held_before": F.when(F.last(F.when(trade != 0, trade), ignorenulls=True).over(before) == 1,
                                  F.last(F.when(bought, lots), ignorenulls=True).over(before)).otherwise(0).cast("long"),
        }
    )
    live = (F.col("held") > 0) | (trade == -1)
    gross = F.col("_lots") * F.col("exec_price")
    out = {
        "trade": trade,
        "reason": F.when(trade != 0, F.when(F.col("_why") == 1, "stop_loss").when(F.col("_why") == 2, "stop_profit")
                         .when(F.col("_why") == 3, "stop_holding").otherwise("strategy")),
        "entry_row": F.when(live, F.col("entry_row")),
        "holding_days": F.when(live, F.col("_rn") - F.col("entry_row")),
        "entry_price": F.when(live, F.col("entry_price")),
        "position_cost": F.when(live, F.col("position_cost")),
        "fill_shares": F.when(trade != 0, F.col("_lots")),
        "cash_flow": F.when(trade == 1, -F.col("position_cost"))
        .when(trade == -1, gross - commission(gross, rules) - stamp_duty(gross, F.lit("sell"), rules))
        .otherwise(0.0),
    }
    return df.withColumns(out).drop("_buy", "_sell", "_can", "_state", "_trade", "_why", "_rn", "_lots", "_open", "_latr", "_patr")


def trade_log(led: DataFrame, rules: Rules = Rules(), extra: tuple[str, ...] = ()) -> DataFrame:
    """Trades of a ledger in one fixed schema: filled buys and sells, and refused buys."""
    t, c = F.col("trade"), F.col
    refused = (t == 0) & (c("held_before") == 0) & c("want_buy") & c("buy_refusal").isNotNull()
    rows = led.where((t != 0) | refused)
    value = F.coalesce(c("fill_shares") * c("exec_price"), F.lit(0.0))
    action = F.when(t == -1, "sell").otherwise("buy")
    rows = rows.withColumns({"action": action, "trade_value": value, "status": F.when(t == 0, "rejected").otherwise("filled")})
    fee, duty = commission(c("trade_value"), rules), stamp_duty(c("trade_value"), c("action"), rules)
    rows = rows.withColumns({"commission": fee, "stamp_duty": duty})
    sold = t == -1
    revenue = F.when(sold, c("trade_value") - c("commission") - c("stamp_duty"))
    rows = rows.withColumns(
        {
            "rejection_reason": F.when(t == 0, c("buy_refusal")),
            "requested_shares": F.when(t == 0, c("requested_shares")),
            "shares": F.coalesce(c("fill_shares"), F.lit(0)),
            "price": F.coalesce(c("exec_price"), c("close")),
            "cost": F.when(t == 1, c("position_cost")).when(t == 0, 0.0),
            "avg_cost": F.when(t == 1, div("position_cost", "fill_shares")),
            "revenue": revenue,
            "profit": revenue - F.when(sold, c("position_cost")),
            "reason": F.coalesce(c("reason"), F.lit("strategy")),
        }
    )
    rows = rows.withColumn("profit_pct", div(c("profit"), F.when(sold, c("position_cost"))) * 100)
    return rows.select(*extra, *TRADE_COLUMNS)


def nav(led: DataFrame, initial_capital: float = 1_000_000.0, scenario: tuple[str, ...] = ("scenario",)) -> DataFrame:
    """Daily value: cash plus shares at close; a held symbol with no bar that day counts as 0."""
    day = led.groupBy(*scenario, "date").agg(
        F.sum("cash_flow").alias("_flow"),
        F.sum(F.col("held") * F.col("close")).alias("_worth"),
        F.sum(F.col("trade")).alias("_opened"),
    )
    # one row per scenario and date is left, so this window sees at most the calendar
    w = Panel(scenario, "date").so_far
    return day.withColumns(
        {"cash": initial_capital + F.sum("_flow").over(w), "n_positions": F.sum("_opened").over(w)}
    ).withColumn("portfolio_value", F.col("cash") + F.col("_worth")).drop("_flow", "_worth", "_opened")


def positions(led: DataFrame, scenario: tuple[str, ...] = ("scenario",)) -> DataFrame:
    return led.where("held > 0").select(*scenario, "date", "symbol", F.col("held").alias("shares"))


def nav_returns(values: DataFrame, scenario: tuple[str, ...] = ("scenario",)) -> DataFrame:
    """Adds returns and cumulative_returns, the growth since the first day."""
    p = Panel(scenario, "date")
    first = F.first("portfolio_value").over(p.so_far)
    return values.withColumns(
        {
            "returns": div("portfolio_value", lag("portfolio_value", panel=p)) - 1,
            "cumulative_returns": F.when(lag("portfolio_value", panel=p).isNotNull(), div("portfolio_value", first)),
        }
    )


def annual_returns(values: DataFrame, scenario: tuple[str, ...] = ("scenario",)) -> DataFrame:
    """Last over first value of each year, in percent."""
    return (
        values.where("portfolio_value IS NOT NULL")
        .groupBy(*scenario, F.year("date").alias("year"))
        .agg(((div(F.max_by("portfolio_value", "date"), F.min_by("portfolio_value", "date")) - 1) * 100).alias("annual_return"))
    )


def trade_statistics(trades: DataFrame, values: DataFrame, scenario: tuple[str, ...] = ("scenario",)) -> DataFrame:
    """Counts, win rate, average profit, exits by reason and position counts, one row per scenario."""
    c = F.col
    filled, sold = c("status") == "filled", (c("status") == "filled") & (c("action") == "sell")
    wins, sells = F.count_if(filled & (c("profit") > 0)), F.count_if(sold)
    keys = list(scenario)
    t = trades.groupBy(*keys).agg(
        F.count_if(filled & (c("action") == "buy")).alias("buys"),
        sells.alias("sells"),
        wins.alias("wins"),
        F.coalesce(div(wins, sells) * 100, F.lit(0.0)).alias("win_rate"),
        F.avg(F.when(filled, c("profit"))).alias("avg_profit"),
        F.avg(F.when(filled, c("profit_pct"))).alias("avg_profit_pct"),
        F.count_if((c("status") == "rejected") & (c("action") == "buy")).alias("rejected_buys"),
        *[F.count_if(sold & (c("reason") == r)).alias(f"{r}_exits") for r in ("stop_holding", "stop_loss", "stop_profit", "strategy")],
    )
    v = values.groupBy(*keys).agg(
        F.max("n_positions").alias("max_positions"), F.max_by("n_positions", "date").alias("final_positions")
    )
    # one row per scenario on each side
    both = t.unionByName(v, allowMissingColumns=True)
    return both.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns if c not in keys])


def pooled_expectancy(stats: DataFrame, trades: str = "total_trades", win_rate: str = "win_rate", expectancy: str = "expectancy") -> DataFrame:
    """Totals over many result rows, rates weighted by their trades."""
    n = F.sum(trades)
    return stats.agg(
        n.alias("trade_sum"),
        F.sum(F.col(trades) * F.col(win_rate)).alias("win_sum"),
        div(F.sum(F.col(trades) * F.col(win_rate)), n).alias("win_rate"),
        div(F.sum(F.col(trades) * F.col(expectancy)), n).alias("expectancy"),
    )


def period_summary(values: DataFrame, trades: DataFrame, initial_capital: float, keys: tuple[str, ...] = ("scenario", "period"), count_rejected: bool = False) -> DataFrame:
    """Value and trade figures per scenario and period; without a sell the trade figures are 0.

    Refused buys are not counted as buys; ``count_rejected`` counts them all the same.
    """
    from tapeloom.operators.metrics import summary

    c = F.col
    last = (F.max_by("portfolio_value", "date").alias("final_portfolio_value"), F.max_by("n_positions", "date").alias("final_position_count"))
    stats = summary(values, "portfolio_value", keys, extra=last).drop("win_rate")
    sold = c("action") == "sell"
    bought = (c("action") == "buy") if count_rejected else (c("action") == "buy") & (c("status") == "filled")
    t = trades.groupBy(*keys).agg(
        F.count_if(bought).alias("buy_trade_count"),
        F.count_if(sold).alias("sell_trade_count"),
        div(F.count_if(sold & (c("profit") > 0)), F.count_if(sold)).alias("win_rate"),
        F.avg(F.when(sold, c("profit_pct"))).alias("avg_profit_pct"),
    )
    out = stats.join(t, list(keys), "left").fillna(initial_capital, ["final_portfolio_value"])
    return out.fillna(0, ["win_rate", "buy_trade_count", "sell_trade_count", "avg_profit_pct"])
