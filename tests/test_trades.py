"""Exchange rules, costs, stops, the ledger against a plain day loop."""

import pytest
from pyspark.sql import functions as F

from conftest import values, walk
from tapeloom.operators import events as ev
from tapeloom.operators import signals as sig
from tapeloom.operators import trades as tr

FREE = tr.Rules(commission_rate=0.0, slippage=0.0, min_commission=0.0, stamp_duty_rate=0.0, trade_amount=10_000.0)


def stop_bars(frame, **over):
    cols = {"open": [100.0, 101.0, 102.0, 103.0], "close": [100.0, 101.0, 104.0, 103.0], "high": [101.0, 103.0, 106.0, 104.0],
            "low": [99.0, 100.0, 101.0, 102.0], "volume": [1000.0] * 4}
    return frame(**{**cols, **over})


FALL = {"close": [100.0, 99.0, 96.0, 95.0], "high": [101.0, 102.0, 100.0, 98.0], "low": [99.0, 98.0, 96.0, 95.0]}


def test_atr_stops_from_an_entry(frame):
    stop = tr.Stop("atr", atr_window=2, atr_multiplier=1.0)
    assert values(tr.take_profit_levels(stop_bars(frame), stop, F.lit(100.0)), "profit_signal") == [0, 0, 1, 0]
    assert values(tr.stop_loss_levels(stop_bars(frame, **FALL), stop, F.lit(100.0)), "stop_signal") == [0, 0, 1, 1]


def test_day_cap_applies_to_every_kind(frame):
    stop = tr.Stop("absolute", 0.2, holding_day=2)
    assert values(tr.stop_loss_levels(stop_bars(frame), stop, F.lit(100.0)), "stop_signal") == [0, 0, 1, 1]
    assert values(tr.take_profit_levels(stop_bars(frame), stop, F.lit(100.0)), "profit_signal") == [0, 0, 1, 1]
    with pytest.raises(ValueError):
        tr.Stop("holding_day")


def test_ledger_sells_on_stops(frame):
    stop = tr.Stop("atr", atr_window=2, atr_multiplier=1.0)
    up = tr.ledger(stop_bars(frame, signal=[1, 0, 0, 0]), FREE, profit=stop)
    assert values(up, "trade", "reason") == [[1, 0, -1, 0], ["strategy", None, "stop_profit", None]]
    down = tr.ledger(stop_bars(frame, signal=[1, 0, 0, 0], **FALL), FREE, loss=stop)
    assert values(down, "trade", "reason") == [[1, 0, -1, 0], ["strategy", None, "stop_loss", None]]
    held = tr.ledger(stop_bars(frame, signal=[1, 0, 0, 0]), FREE, loss=tr.Stop("holding_day", holding_day=2))
    assert values(held, "reason")[2] == "stop_holding"


def test_limits_by_board(frame):
    cols = {c: [100.0, 115.0] for c in ("open", "close", "high", "low")}
    for symbol, blocked in (("300001", False), ("600001", True)):
        df = tr.limit_moves(frame(symbol, **cols, volume=[1000.0, 1000.0]))
        assert values(df, "limit_up")[1] is blocked
    named = frame("600001", **cols, name=["*ST x", "plain"])
    assert values(tr.limit_pct(named), "limit_pct") == [0.05, 0.10]


def test_refused_buy_is_logged(frame):
    cols = {c: [10.0, 11.0] for c in ("open", "close", "high", "low")}
    df = frame("600001", **cols, volume=[1000.0, 1000.0], signal=[0, 1])
    row = tr.trade_log(tr.ledger(df, FREE.with_(trade_amount=1100.0)), FREE).first()
    assert (row.status, row.rejection_reason, row.action, row.requested_shares, row.shares) == ("rejected", "limit_up", "buy", 100, 0)


def test_sell_costs(frame):
    rules = tr.Rules(commission_rate=0.0001, slippage=0.0, min_commission=5.0, stamp_duty_rate=0.001, trade_amount=1000.0)
    cols = {c: [10.0, 10.0] for c in ("open", "close", "high", "low")}
    log = tr.trade_log(tr.ledger(frame(**cols, volume=[1000.0, 1000.0], signal=[1, -1]), rules), rules)
    sell = log.where("action = 'sell'").first()
    assert (sell.trade_value, sell.commission, sell.stamp_duty, sell.revenue) == (1000.0, 5.0, 1.0, 994.0)
    assert sell.profit == pytest.approx(994.0 - 1005.0)


def test_lots_and_t1(frame):
    df = frame(n=[250, 99, 0])
    out = df.select(tr.lot_shares(F.col("n")).alias("b"), tr.sell_shares(F.col("n"), F.lit(250)).alias("s"), "symbol", "date")
    assert values(out, "b", "s") == [[200, 0, 0], [250, 0, 0]]
    day = F.to_date(F.lit("2024-01-02"))
    row = df.select(tr.violates_t1(day, day).alias("same"), tr.violates_t1(day, F.date_sub(day, 1)).alias("next"), tr.violates_t1(day, F.lit(None)).alias("none")).first()
    assert tuple(row) == (True, False, False)


def test_affordable_shares_equal_the_stepwise_search(spark):
    rules = tr.Rules()
    rows = [(r, c, p) for r in (0, 100, 900, 5000) for c in (0.0, 5.0, 1004.99, 1005.0, 20_000.0, 333_333.0) for p in (0.5, 10.0, 16.67, 250.0)]
    df = spark.createDataFrame(rows, "r long, c double, p double")
    got = [x[0] for x in df.select(tr.affordable_shares(F.col("r"), F.col("c"), F.col("p"), rules)).collect()]
    want = []
    for r, c, p in rows:
        n = r
        while n > 0 and n * p + max(n * p * rules.commission_rate, rules.min_commission) > c:
            n -= 100
        want.append(n)
    assert got == want


def day_loop(pdf, rules, loss_pct, cap):
    """One symbol: buys and sells by the rules, a trailing loss with a day cap, as a plain loop."""
    pos, out = None, []
    prev = None
    for i, row in enumerate(pdf.itertuples()):
        tol = max(abs(prev) * 1e-4, 1e-6) if prev else 0
        up = prev is not None and row.close >= prev * (1 + rules.limit_pct) - tol and row.high >= prev * (1 + rules.limit_pct) - tol
        down = prev is not None and row.close <= prev * (1 - rules.limit_pct) + tol and row.low <= prev * (1 - rules.limit_pct) + tol
        prev = row.close
        lots = int(rules.trade_amount / row.close) // rules.lot_size * rules.lot_size
        if pos is None:
            if row.signal == 1 and not up and lots > 0:
                px = row.close * (1 + rules.slippage)
                pos = [i, px, px]
                out.append((1, None))
                continue
            out.append((0, None))
            continue
        pos[2] = max(pos[2], row.high)
        days = i - pos[0]
        why = "stop_holding" if days >= cap else "stop_loss" if pos[2] > pos[1] and row.close <= pos[2] * (1 - loss_pct) else None
        if (why or row.signal == -1) and not down:
            out.append((-1, why or "strategy"))
            pos = None
        else:
            out.append((0, None))
    return out


def test_ledger_equals_day_loop(spark):
    rules = tr.Rules(trade_amount=20_000.0, limit_pct=0.04, limit_pct_by_prefix={}, st_limit_pct=None)
    bars = spark.createDataFrame(walk(300, 11))
    df = sig.ma_cross(bars, 3, 8)
    led = tr.ledger(df, rules, loss=tr.Stop("trailing", 0.05, holding_day=12))
    pdf = df.orderBy("symbol", "date").toPandas()
    want = [x for _, g in pdf.groupby("symbol") for x in day_loop(g, rules, 0.05, 12)]
    trade, reason = values(led, "trade", "reason")
    assert trade == [w[0] for w in want]
    assert [r for r, t in zip(reason, trade) if t == -1] == [w[1] for w in want if w[0] == -1]
    assert {"stop_loss", "strategy"} <= set(reason)


def test_value_is_cash_plus_holdings(spark):
    rules = tr.Rules(trade_amount=20_000.0)
    led = tr.ledger(sig.ma_cross(spark.createDataFrame(walk(120, 6)), 3, 8), rules).withColumn("scenario", F.lit("s"))
    nav = {r.date: r for r in tr.nav(led, 100_000.0).collect()}
    cash, rows = 100_000.0, led.orderBy("date").collect()
    for day in sorted(nav):
        today = [r for r in rows if r.date == day]
        cash += sum(r.cash_flow for r in today)
        assert nav[day].cash == pytest.approx(cash)
        assert nav[day].portfolio_value == pytest.approx(cash + sum(r.held * r.close for r in today))
        assert nav[day].n_positions == sum(r.held > 0 for r in today)


def test_forward_edges_count_filled_trades_only(frame):
    cols = {c: [10.0, 11.0, 12.0, 9.0] for c in ("open", "close", "high", "low")}
    bars = frame("A", **cols)
    trades = bars.select("symbol", "date", F.lit("buy").alias("action"), F.lit("s").alias("scenario"),
                         F.when(F.col("close") == 10, "filled").otherwise("rejected").alias("status"))
    row = ev.forward_edges(trades, bars, [1, 3]).first()
    assert row.signal_event_count == 1 and row.signal_mean_edge_1 == pytest.approx(0.1) and row.signal_mean_edge_3 == pytest.approx(-0.1)
    assert row.signal_mean_mfe_3 == pytest.approx(0.2) and row.signal_mean_mae_3 == pytest.approx(-0.1)
    assert ev.forward_edges(trades, bars, [1], count_rejected=True).first().signal_event_count == 4


def test_cumulative_return_through_total_losses(spark):
    from tapeloom.operators import metrics

    rows = [("a", k, r) for k, r in enumerate([0.1, -1.0, 0.5, 0.2])] + [("b", k, r) for k, r in enumerate([0.1, None, -1.5, 0.2])]
    out = metrics.cumulative_return(spark.createDataFrame(rows, "scenario string, date int, returns double")).orderBy("scenario", "date").collect()
    got = [r["cumulative_return"] for r in out]
    want = [0.1, -1.0, -1.0, -1.0, 0.1, None, -1.55, -1.66]
    assert all(a is b is None or abs(a - b) < 1e-12 for a, b in zip(got, want, strict=True))
