"""Streaming and registry queries (inventory rows ST1-ST5, D01-D05); streams are run to their end."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.catalog.base import HOURLY_SQL, PART, SOFAR, W, ema_cte, machine_cte, query, sroll, with_bars
from tapeloom.catalog.events import SOFT, condition_ctes, soft
from tapeloom.catalog.features import FACTOR_CTES
from tapeloom.catalog.indicators import KEY, MACD_CTES, MFI_CTES, OBV, r4, rsrs_ctes
from tapeloom.catalog.monitor import MON, MON_OUT, SNAPSHOT, shown, universe
from tapeloom.catalog.signals import (
    BRK_DOWN, BRK_UP, MA, MID_DOWN, MID_UP, READY, T01, T03, bb_ctes, gate_ctes, latch_cte, macd_latch, run_cte,
)
from tapeloom.functions.kernels import crosses_down, crosses_up, lag, roll
from tapeloom.operators import events as ev
from tapeloom.plans import registry as rg
from tapeloom.session import work_dir
from tapeloom.sources.store import through_table
from tapeloom.streaming import bars_stream as bs

START, CUTS = "0001-01-01", ["1997-06-30", "1999-06-30", None]


def arrivals(df, path):
    """The rows as they arrive: three deliveries in date order, the last one open; yields after each."""
    start = START
    for end in CUTS:
        df.where((F.col("date") > start) & (F.col("date") <= end if end else F.lit(True))).write.mode("append").parquet(path)
        start = end
        yield end


VERSIONS = "versions AS (SELECT symbol, date, close, 1 AS v FROM bars UNION ALL SELECT symbol, date, high, 2 FROM bars WHERE day(date) % 5 = 0)"


def versions(t):
    """Every bar, and a correction of every fifth day that comes with the delivery after it."""
    first = t.bars.select("symbol", "date", "open", "close", "high", "low", "volume", F.lit(1).alias("seq"))
    again = first.where(F.dayofmonth("date") % 5 == 0).withColumns({"close": F.col("high"), "seq": F.lit(2)})
    return first, again


@query("st1_refresh", store=True, sql=with_bars(
    "SELECT symbol, date, CASE WHEN day(date) % 5 = 0 THEN high ELSE close END AS close FROM bars"))
def _(t):
    root = work_dir(t.spark, "refresh")
    first, again = versions(t)
    late = None
    for end in arrivals(first, f"{root}/landed"):
        if late is not None:  # corrections of the delivery before
            again.where((F.col("date") > late[0]) & (F.col("date") <= late[1])).write.mode("append").parquet(f"{root}/landed")
        late = (late[1] if late else START, end)
        if end == CUTS[-1]:
            again.where(F.col("date") > CUTS[-2]).write.mode("append").parquet(f"{root}/landed")
        bs.refresh_bars(bs.read_files(t.spark, f"{root}/landed", first.schema), root, compact_every=2)
    return bs.current_bars(t.spark, root).select("symbol", "date", "close")


@query("st2_monitor_run", store=True, sql=with_bars(MON_OUT, *MON))
def _(t):
    root = work_dir(t.spark, "monitor")
    first, _again = versions(t)
    for _end in arrivals(first, f"{root}/landed"):
        pass
    updates = bs.read_files(t.spark, f"{root}/landed", first.schema)
    return shown(bs.monitor_once(updates, root, universe(t), "bollinger_squeeze", SOFT, SNAPSHOT))


def shuffled_arrivals(rows, path):
    """The rows as they arrive out of order: the latest dates first, then those before, every third row of each symbol last."""
    late = F.pmod(F.xxhash64("symbol", "date"), F.lit(3)) == 0
    for when in (~late & (F.col("date") > CUTS[1]), ~late & (F.col("date") <= CUTS[1]), late):
        rows.where(when).write.mode("append").parquet(path)
        yield when


@query("st3_new_signals", store=True, sql=with_bars(f"SELECT symbol, date, condition AND NOT coalesce(lag(condition) {W}, FALSE) AS is_new_signal FROM sqz", *condition_ctes()))
def _(t):
    root = work_dir(t.spark, "signals")
    rows = through_table(soft(t).select("symbol", "date", "condition"), "conditions")
    for _part in shuffled_arrivals(rows, f"{root}/landed"):
        bs.take_conditions(bs.read_files(t.spark, f"{root}/landed", rows.schema), f"{root}/out")
    return bs.new_signals(t.spark, f"{root}/out")


@query("st4_tick_bars", f"WITH {HOURLY_SQL.replace('(value, event_id)', '(value, ROW(ts, event_id))')} SELECT * FROM hourly")
def _(t):
    root = work_dir(t.spark, "ticks")
    ticks = t["events"]
    for part in (1, 0, 2):  # every window gets ticks in all three deliveries
        ticks.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part).write.mode("append").parquet(f"{root}/landed")
        bs.take_ticks(bs.read_files(t.spark, f"{root}/landed", ticks.schema), f"{root}/out", compact_every=2)
    return bs.tick_bars(t.spark, f"{root}/out").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("st5_held_positions", store=True, sql=with_bars("SELECT symbol, date, signal FROM t01", *T01))
def _(t):
    root = work_dir(t.spark, "positions")
    df = t.bars.withColumns({"_s": roll(F.avg, "close", 5), "_l": roll(F.avg, "close", 20)})
    args = F.col("_s"), F.col("_l"), lag("_s"), lag("_l")
    rows = df.withColumn("event", F.when(crosses_up(*args), 1).when(crosses_down(*args), -1)).select("symbol", "date", "event")
    rows = through_table(rows, "events")
    for _part in shuffled_arrivals(rows, f"{root}/landed"):
        bs.take_events(bs.read_files(t.spark, f"{root}/landed", rows.schema), f"{root}/out")
    return bs.held_positions(t.spark, f"{root}/out")


# ---- registries


@query("d01_factor_registry", with_bars(
    "SELECT symbol, date, round(\"RSI_factor\", 4) AS \"RSI_factor\", momentum_factor, high - low AS range_factor, round(gap, 4) AS gap_factor FROM "
    f"(SELECT *, open / lag(close) {W} - 1 AS gap FROM fac)", *FACTOR_CTES))
def _(t):
    reg = rg.default_factors()
    reg.register_column("custom", "range", "high - low")
    reg.register_pandas("custom", "gap", lambda pdf: pdf["open"] / pdf["close"].shift(1) - 1)
    df = reg.calculate(t.bars, ["technical", "custom"])
    return df.select(*KEY, *r4("RSI_factor"), "momentum_factor", "range_factor", F.round(F.nanvl("gap_factor", F.lit(None).cast("double")), 4).alias("gap_factor"))


@query("d02_strategy_registry", store=True, sql=with_bars(
    "SELECT symbol, date, signal, row_number() OVER (PARTITION BY date ORDER BY mom DESC NULLS LAST, symbol) AS place FROM (SELECT t01.*, close - lag(close, 20) OVER (PARTITION BY symbol ORDER BY date) AS mom FROM t01)", *T01))
def _(t):
    from tapeloom.operators import indicators as ind
    from tapeloom.operators import signals as sig

    reg = rg.StrategyRegistry()
    reg.register_timing("cross", sig.ma_cross)
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc_nulls_last("momentum"), "symbol"))
    reg.register_ranking("momentum", lambda factors: factors["momentum"].withColumn("place", place))
    timing = reg.timing_signals(t.bars, "cross").select(*KEY, "signal")
    ranking = reg.ranking_signals({"momentum": ind.momentum(t.bars, n=20)}, "momentum").select(*KEY, "place")
    return timing.join(ranking, KEY)


@query("d03_condition_registry", with_bars("SELECT symbol, date, event_direction FROM sqz WHERE condition", *condition_ctes()))
def _(t):
    return t.bars.transform(lambda df: ev.condition_frame(df, "bollinger_squeeze", SOFT)).where("condition").select(*KEY, "event_direction")


# the presets ma_cross (filter mean 30, volume gate 1.5), rsi and macd, weighted to a threshold of 0.3
PRESETS = (
    *MA, f"ma30 AS (SELECT *, {sroll('avg', 'close', 30)} AS f FROM ma2)",
    machine_cte("p1", "ma30", "golden AND close > f", "death AND close < f", "death", "golden", "f IS NOT NULL"),
    *gate_ctes("p1", "pg", None, (20, 1.5)),
    "pe AS (SELECT * EXCLUDE (signal), CASE WHEN signal = 0 THEN 0 WHEN signal > 0 AND okv THEN 1 WHEN signal < 0 AND okv THEN -1 END AS ev2 FROM pg)",
    latch_cte("p1f", "pe", "ev2"), *T03, *MACD_CTES, macd_latch("p3", "macd", "macd_signal"),
    "pall AS (SELECT a.symbol, a.date, a.signal * (1.0::DOUBLE / 3) + b.signal * (1.0::DOUBLE / 3) + c.signal * (1.0::DOUBLE / 3) AS total FROM p1f a JOIN t03 b USING (symbol, date) JOIN p3 c USING (symbol, date))")


@query("d04_preset_strategies", with_bars("SELECT symbol, date, CASE WHEN total >= 0.3 THEN 1 WHEN total <= -0.3 THEN -1 ELSE 0 END AS signal FROM pall", *PRESETS))
def _(t):
    return rg.run_strategies(t.bars, ["ma_cross", "rsi", "macd"], threshold=0.3).select(*KEY, "signal")


def filtered_ctes(src, out, trend=None, volume=None):
    """The common filters behind a raw signal: gates, allowed transitions, latch."""
    return (*gate_ctes(src, f"{out}_g0", trend, volume),
            f"{out}_e AS (SELECT * EXCLUDE (signal), CASE WHEN signal = 0 THEN 0 WHEN signal > 0 AND okl AND okv THEN 1 WHEN signal < 0 AND oks AND okv THEN -1 END AS ev3 FROM {out}_g0)",
            latch_cte(out, f"{out}_e", "ev3"))


def renamed_bands(ctes, suffix):
    """Bands under their own names, for a second set of them in one statement."""
    return [c.replace("bb_a", f"bb_a{suffix}").replace("bb_b", f"bb_b{suffix}").replace("bb AS", f"bb{suffix} AS").replace("FROM bb)", f"FROM bb{suffix})") for c in ctes]


VZ20 = f"vz AS (SELECT *, (volume - ({sroll('avg', 'volume', 20)})) / nullif({sroll('stddev_samp', 'volume', 20)}, 0) AS z FROM bars)"
SQ30 = (*renamed_bands(bb_ctes(30), "30"), "s30a AS (SELECT *, (up - lo) / nullif(mid, 0) AS bw FROM bb30)",
        f"s30b AS (SELECT *, {sroll('quantile_cont({}, 0.05)', 'bw', 60, 30)} AS thr FROM s30a)",
        f"s30 AS (SELECT *, coalesce(bw <= thr, FALSE) AS sqz, {READY} AND thr IS NOT NULL AS ready FROM s30b)",
        f"s30w AS (SELECT *, coalesce(last_value(CASE WHEN ready THEN sqz END IGNORE NULLS) OVER ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AND NOT sqz AS first_out FROM s30)")
RSRS_UP = (*rsrs_ctes(20, 12, 90, 30), "rs_ev AS (SELECT *, CASE WHEN rsrs_score >= 1.0 THEN 1 WHEN rsrs_score <= 0 THEN 0 END AS up_ev FROM rsrs_t)",
           latch_cte("rs_raw", "rs_ev", "up_ev"))
ALL_PRESETS = (
    *PRESETS, f"rp AS (SELECT *, lag(rsi) {W} AS p FROM rsi)",
    machine_cte("t04", "rp", "rsi > 30 AND p <= 30", "rsi < 70 AND p >= 70", "rsi < 50 AND p >= 50", "rsi > 50 AND p <= 50", "rsi IS NOT NULL AND p IS NOT NULL"),
    macd_latch("t07", "macd_hist", "0"), *bb_ctes(),
    machine_cte("k1", "bb", BRK_UP, BRK_DOWN, MID_DOWN, MID_UP, READY), *filtered_ctes("k1", "k1f", (60, 3), (20, 1.2)),
    machine_cte("k2", "bb", "pc <= plo AND close > lo", "pc >= pup AND close < up", MID_UP, MID_DOWN, READY),
    *SQ30, machine_cte("k3", "s30w", f"first_out AND {BRK_UP}", f"first_out AND {BRK_DOWN}", MID_DOWN, MID_UP, "ready"), *filtered_ctes("k3", "k3f", (60, 3), (60, 2)),
    *run_cte("bb", "br", 2), machine_cte("k4", "br", "ru", "rl", MID_DOWN, MID_UP, READY), *filtered_ctes("k4", "k4f", (60, 3), (20, 1.2)),
    *RSRS_UP, *filtered_ctes("rs_raw", "k5f", (20, 3), (20, 2.0)),
    VZ20, ema_cte("ve", "vz", "close", "(2.0::DOUBLE/51)", "e"), "k6 AS (SELECT *, CASE WHEN z > 2 AND close < e THEN -1 WHEN z > 2 AND close > e THEN 1 ELSE 0 END AS signal FROM ve)",
    OBV, f"k7 AS (SELECT *, CASE WHEN sl > 0 AND ab THEN 1 WHEN sl < 0 AND NOT ab THEN -1 ELSE 0 END AS signal FROM (SELECT *, obv - lag(obv) {W} AS sl, coalesce(close > ({sroll('avg', 'close', 20)}), FALSE) AS ab FROM obvt))",
    *MFI_CTES, ema_cte("me", "mfit", "close", "(2.0::DOUBLE/51)", "e"),
    f"k8 AS (SELECT *, CASE WHEN p > 80 AND mfi < 80 AND close < e THEN -1 WHEN p < 20 AND mfi > 20 AND close > e THEN 1 ELSE 0 END AS signal FROM (SELECT *, lag(mfi) {W} AS p FROM me))",
    f"""k9 AS (SELECT *, CASE WHEN close >= ph AND volume < lag(vh) {W} THEN -1 WHEN close <= pl AND volume > lag(vl) {W} THEN 1 ELSE 0 END AS signal FROM
  (SELECT *, {sroll('max', 'close', 20)} AS ph, {sroll('min', 'close', 20)} AS pl, {sroll('max', 'volume', 20)} AS vh, {sroll('min', 'volume', 20)} AS vl FROM bars))""")
PRESET_CTE = {"ma_cross": "p1f", "rsi": "t03", "rsi_cross": "t04", "macd": "p3", "macd_histogram": "t07", "bollinger_breakout": "k1f", "bollinger_mean_reversion": "k2",
              "bollinger_squeeze": "k3f", "bollinger_double": "k4f", "rsrs": "k5f", "volume_breakout": "k6", "obv": "k7", "mfi": "k8", "volume_price_divergence": "k9"}


@query("d04b_all_presets", with_bars(" UNION ALL ".join(
    f"SELECT '{n}' AS strategy, symbol, count(*) FILTER (signal = 1) AS long_days, count(*) FILTER (signal = -1) AS short_days FROM {c} GROUP BY symbol" for n, c in PRESET_CTE.items()), *ALL_PRESETS))
def _(t):
    df = t.bars
    for name in rg.TIMING_PRESETS:
        df = rg.timing_strategy(name, f"_{name}")(df)
    long = df.groupBy("symbol").agg(*[f(F.col(f"_{n}") == v).alias(f"{n}_{v}") for n in rg.TIMING_PRESETS for f, v in ((F.count_if, 1), (F.count_if, -1))])
    rows = F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(f"{n}_1").alias("long_days"), F.col(f"{n}_-1").alias("short_days")) for n in rg.TIMING_PRESETS])
    return long.select("symbol", F.explode(rows).alias("r")).select("symbol", "r.*")


def rising_runs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Length of the run of rising closes up to each bar."""
    up = pdf["close"].diff() > 0
    run = up.astype(int).groupby((~up).cumsum()).cumsum()
    return pd.DataFrame({"symbol": pdf["symbol"], "date": pdf["date"], "run": run.astype("int64")})


@query("d05_bar_callback", with_bars(
    f"SELECT symbol, date, CAST(sum(up) OVER (PARTITION BY symbol, g ORDER BY date) AS BIGINT) AS run FROM (SELECT *, sum(1 - up) {SOFAR} AS g FROM (SELECT *, coalesce(close > lag(close) {W}, FALSE)::INT AS up FROM bars))"))
def _(t):
    return rg.bar_callback(t.bars.select("symbol", "date", "close"), rising_runs, "symbol string, date date, run long")


