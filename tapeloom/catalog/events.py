"""Event-study queries (inventory rows E01-E15, J01, J06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog.base import W, query, sroll, with_bars
from tapeloom.catalog.indicators import KEY, r4, rsrs_ctes, s4, supertrend_ctes
from tapeloom.catalog.signals import L, gate_ctes
from tapeloom.catalog.trades import LOG, PLAIN, RULES, plain, scenario
from tapeloom.operators import events as ev
from tapeloom.operators import trades as tr

# a squeeze that the given prices reach often, and a strict one with every filter
SOFT = {"squeeze_quantile": 0.3, "breakout_direction": "both", "use_volume_filter": False, "use_trend_filter": False, "breakout_confirm_bars": 1}
STRICT = {
    "squeeze_quantile": 0.3, "breakout_direction": "both", "breakout_buffer": 0.01, "breakout_max_wait": 15, "breakout_confirm_bars": 1,
    "volume_window": 20, "volume_multiplier": 1.1, "trend_window": 20, "use_supertrend_filter": True, "use_band_expansion_filter": True,
    "use_return_filter": True, "min_breakout_return": 0.02,
}
DOUBLE = {**SOFT, "num_std": 1.2, "squeeze_quantile": 0.5, "breakout_confirm_bars": 2}


def condition_ctes(k=2.0, quantile=0.3, wait=10, confirm=1, buffer=0.0, long_ok="TRUE", short_ok="TRUE", src="bars", name="sqz", extra=()):
    """The wait after a squeeze as a fold: (waiting, bars since, run above, run below, event)."""
    a, v = "acc[len(acc)]", "v[1]"
    up, down = f"CASE WHEN {v}.ab THEN {a}.u + 1 ELSE 0 END", f"CASE WHEN {v}.be THEN {a}.d + 1 ELSE 0 END"
    keep = f"'r': {v}.r, 'q': {v}.q, 'ab': {v}.ab, 'be': {v}.be, 'lo': {v}.lo, 'so': {v}.so"
    zero = "'w': FALSE, 'n': 0, 'u': 0, 'd': 0, 'e': 0, 'bu': FALSE, 'bd': FALSE"
    return (
        f"{name}_a AS (SELECT *, {sroll('avg', 'close', 20)} AS mid, {sroll('stddev_samp', 'close', 20)} AS sd, {L('close')} AS pc FROM {src})",
        f"{name}_b AS (SELECT *, mid + {k}::DOUBLE * sd AS up, mid - {k}::DOUBLE * sd AS dn FROM {name}_a)",
        f"{name}_c AS (SELECT *, (up - dn) / nullif(mid, 0) AS bandwidth FROM {name}_b)",
        f"{name}_d AS (SELECT *, {sroll(f'quantile_cont({{}}, {quantile})', 'bandwidth', 60, 20)} AS condition_threshold, {L('bandwidth')} AS pbw FROM {name}_c)", *extra,
        f"{name}_e AS (SELECT *, coalesce(bandwidth <= condition_threshold, FALSE) AS squeeze_condition, {long_ok} AS lok, {short_ok} AS sok FROM {name}_d{'x' if extra else ''})",
        f"""{name}_l AS (SELECT symbol, list(date ORDER BY date) AS ds, list_reduce(
    list_prepend([{{'r': FALSE, 'q': FALSE, 'ab': FALSE, 'be': FALSE, 'lo': FALSE, 'so': FALSE, {zero}}}], list_transform(list({{
      'r': bandwidth IS NOT NULL AND condition_threshold IS NOT NULL, 'q': squeeze_condition, 'ab': coalesce(close > up * (1 + {buffer}::DOUBLE), FALSE),
      'be': coalesce(close < dn * (1 - {buffer}::DOUBLE), FALSE), 'lo': lok, 'so': sok}} ORDER BY date),
      lambda r: [{{'r': r.r, 'q': r.q, 'ab': r.ab, 'be': r.be, 'lo': r.lo, 'so': r.so, {zero}}}])),
    lambda acc, v: list_append(acc, CASE
      WHEN NOT {v}.r THEN {{{keep}, 'w': {a}.w, 'n': {a}.n, 'u': {a}.u, 'd': {a}.d, 'e': 0, 'bu': FALSE, 'bd': FALSE}}
      WHEN {v}.q THEN {{{keep}, 'w': TRUE, 'n': 0, 'u': 0, 'd': 0, 'e': 0, 'bu': FALSE, 'bd': FALSE}}
      WHEN NOT {a}.w OR {a}.n + 1 > {wait} THEN {{{keep}, {zero}}}
      WHEN {up} >= {confirm} AND {v}.lo THEN {{{keep}, 'w': FALSE, 'n': 0, 'u': 0, 'd': 0, 'e': 1, 'bu': TRUE, 'bd': FALSE}}
      WHEN {down} >= {confirm} AND {v}.so THEN {{{keep}, 'w': FALSE, 'n': 0, 'u': 0, 'd': 0, 'e': -1, 'bu': FALSE, 'bd': TRUE}}
      ELSE {{{keep}, 'w': TRUE, 'n': {a}.n + 1, 'u': {up}, 'd': {down}, 'e': 0, 'bu': {up} >= {confirm}, 'bd': {down} >= {confirm}}} END))[2:] AS vs FROM {name}_e GROUP BY symbol)""",
        f"{name}_u AS (SELECT symbol, unnest(ds) AS date, unnest(vs) AS q FROM {name}_l)",
        f"""{name} AS (SELECT s.*, u.q.bu AS breakout_up, u.q.bd AS breakout_down, u.q.e <> 0 AS condition,
  CASE u.q.e WHEN 1 THEN 'up' WHEN -1 THEN 'down' END AS event_direction, row_number() OVER (PARTITION BY s.symbol ORDER BY s.date) AS rn, count(*) OVER (PARTITION BY s.symbol) AS n
  FROM {name}_e s JOIN {name}_u u USING (symbol, date))""")


OUT = "SELECT symbol, date, round(bandwidth, 4) AS bandwidth, round(condition_threshold, 4) AS condition_threshold, squeeze_condition, breakout_up, breakout_down, event_direction, condition FROM sqz"
COLS = ["squeeze_condition", "breakout_up", "breakout_down", "event_direction", "condition"]


def soft(t):
    return ev.condition_frame(t.bars, "bollinger_squeeze", SOFT)


@query("e01_squeeze_condition", with_bars(OUT, *condition_ctes()))
def _(t):
    return soft(t).select(*KEY, *r4("bandwidth", "condition_threshold"), *COLS)


@query("e01b_squeeze_confirmed", with_bars(OUT, *condition_ctes(k=1.2, quantile=0.5, confirm=2)))
def _(t):
    return ev.condition_frame(t.bars, "bollinger_squeeze", DOUBLE).select(*KEY, *r4("bandwidth", "condition_threshold"), *COLS)


STRICT_CTES = (*supertrend_ctes(), *condition_ctes(
    buffer=0.01, wait=15, src="stt", extra=gate_ctes("sqz_d", "sqz_g", (20, 3)) + (
        f"sqz_dx AS (SELECT *, coalesce(volume >= vma * 1.1::DOUBLE AND volume > {L('volume')}, FALSE) AND coalesce(bandwidth > pbw, FALSE) AS okb FROM sqz_g)",),
    long_ok="okl AND okb AND coalesce(st_direction > 0, FALSE) AND coalesce(close / pc - 1 >= 0.02, FALSE)",
    short_ok="oks AND okb AND coalesce(st_direction < 0, FALSE) AND coalesce(close / pc - 1 <= -0.02, FALSE)"))


@query("e01c_squeeze_all_filters", with_bars(OUT, *STRICT_CTES))
def _(t):
    return ev.condition_frame(t.bars, "bollinger_squeeze", STRICT).select(*KEY, *r4("bandwidth", "condition_threshold"), *COLS)


RSRS_COND = (*rsrs_ctes(20, 12, 90, 30), *gate_ctes("rsrs_t", "rg", (60, 3)), "rs_cond AS (SELECT *, coalesce(rsrs_score >= 0.8, FALSE) AS breakout_up, coalesce(rsrs_score <= -0.8, FALSE) AS breakout_down FROM rg)",
             "rsc AS (SELECT *, (breakout_up AND okl) OR (breakout_down AND oks) AS condition, CASE WHEN breakout_down AND oks THEN 'down' WHEN breakout_up AND okl THEN 'up' END AS event_direction FROM rs_cond)")
RSRS_PARAMS = {"entry_zscore": 0.8, "breakout_direction": "both"}


@query("e02_rsrs_condition", with_bars("SELECT symbol, date, round(rsrs_score, 4) AS rsrs_score, breakout_up, breakout_down, event_direction, condition FROM rsc", *RSRS_COND))
def _(t):
    df = ev.condition_frame(t.bars, "rsrs_breakout", RSRS_PARAMS)
    return df.select(*KEY, *r4("rsrs_score"), "breakout_up", "breakout_down", "event_direction", "condition")


@query("e03_condition_dispatch", store=True, sql=with_bars(
    "SELECT 'bollinger_squeeze' AS name, symbol, count(*) FILTER (condition) AS days FROM sqz GROUP BY ALL UNION ALL SELECT 'rsrs_breakout', symbol, count(*) FILTER (condition) FROM rsc GROUP BY ALL",
    *condition_ctes(), *RSRS_COND))
def _(t):
    out = None
    for name, params in (("bollinger_squeeze", SOFT), ("rsrs_breakout", RSRS_PARAMS)):
        df = ev.condition_frame(t.bars, name, params).groupBy(F.lit(name).alias("name"), "symbol").agg(F.count_if("condition").alias("days"))
        out = df if out is None else out.union(df)
    return out


RUNS = f"runs AS (SELECT * FROM (SELECT *, coalesce(lag(condition) {W}, FALSE) AS was FROM sqz) WHERE condition AND NOT was)"
# keep an event when it lies 20 rows after the last kept one
KEPT = """kept_l AS (SELECT symbol, unnest(list_reduce(list_transform(list(rn ORDER BY rn), lambda x: [x]),
  lambda acc, x: CASE WHEN x[1] - acc[len(acc)] >= 20 THEN list_append(acc, x[1]) ELSE acc END)) AS rn FROM runs GROUP BY symbol),
kept AS (SELECT r.* FROM runs r JOIN kept_l USING (symbol, rn))"""
EV = (*condition_ctes(), RUNS, KEPT)
WIN = "win AS (SELECT e.symbol, e.date AS event_date, b.date AS trade_date, b.rn - e.rn AS relative_day, b.open, b.high, b.low, b.close, b.volume, e.close AS event_close, b.close / e.close - 1 AS close_to_event FROM kept e JOIN sqz b ON b.symbol = e.symbol AND b.rn BETWEEN e.rn - 30 AND e.rn + 30 WHERE e.rn > 30 AND e.rn + 30 <= e.n)"
FULL = "full_ AS (SELECT * FROM kept WHERE rn > 30 AND rn + 30 <= n)"


def kept(t):
    return ev.event_rows(soft(t), min_gap=20)


def windows(t):
    return ev.event_windows(kept(t), t.bars)


@query("e04_event_dates", store=True, sql=with_bars("SELECT 'first_in_run' AS selection, symbol, date FROM runs UNION ALL SELECT 'all_true_days', symbol, date FROM sqz WHERE squeeze_condition", *condition_ctes(), RUNS))
def _(t):
    df = soft(t)
    first = ev.event_rows(df).select(F.lit("first_in_run").alias("selection"), *KEY)
    every = ev.event_rows(df.withColumn("condition", F.col("squeeze_condition")), "all_true_days")
    return first.union(every.select(F.lit("all_true_days").alias("selection"), *KEY))


@query("e05_min_gap", with_bars("SELECT symbol, date, rn FROM kept", *EV))
def _(t):
    return kept(t).select(*KEY, "rn")


@query("e06_event_windows", store=True, sql=with_bars("SELECT symbol, event_date, trade_date, relative_day, close, event_close, round(close_to_event, 6) AS close_to_event FROM win", *EV, WIN))
def _(t):
    return windows(t).select("symbol", "event_date", "trade_date", "relative_day", "close", "event_close", *r4("close_to_event", digits=6))


@query("j06_positional_range", store=True, sql=with_bars(
    "SELECT e.symbol, e.date AS event_date, b.date AS trade_date, b.rn - e.rn AS relative_day, b.close FROM kept e JOIN sqz b ON b.symbol = e.symbol AND b.rn BETWEEN e.rn - 3 AND e.rn + 8", *EV))
def _(t):
    return ev.event_windows(kept(t), t.bars, 3, 8, full=False).select("symbol", "event_date", "trade_date", "relative_day", "close")


META = f"SELECT symbol, date AS event_date, close AS event_close, {s4('bandwidth', 'condition_threshold')}, condition AS breakout_valid, event_direction FROM full_"


def meta(t):
    events = kept(t).where("rn > 30 AND rn + 30 <= rows")
    return ev.event_meta(events).select("symbol", "event_date", "event_close", *r4("bandwidth", "condition_threshold"), "breakout_valid", "event_direction")


@query("e07_event_meta", with_bars(META, *EV, FULL))
def _(t):
    return meta(t)


FORWARD_SQL = """SELECT relative_day AS horizon, count(*) AS sample_count, round(avg(close_to_event), 4) AS mean_return, round(median(close_to_event), 4) AS median_return,
  round(avg((close_to_event > 0)::INT), 4) AS win_rate, round(quantile_cont(close_to_event, 0.25), 4) AS p25, round(quantile_cont(close_to_event, 0.75), 4) AS p75 FROM win WHERE relative_day IN (1, 5, 10, 20, 30) GROUP BY 1"""
FORWARD_COLS = ["mean_return", "median_return", "win_rate", "p25", "p75"]


@query("e08_event_study", store=True, sql=with_bars(
    f"SELECT f.*, (SELECT count(*) FROM full_) AS event_count, (SELECT count(DISTINCT symbol) FROM full_) AS symbol_count, (SELECT count(*) FROM (SELECT DISTINCT symbol FROM bars EXCEPT SELECT symbol FROM kept)) AS skipped FROM ({FORWARD_SQL}) f", *EV, WIN, FULL))
def _(t):
    from tapeloom.plans.studies import event_study

    study = event_study(t.bars, "bollinger_squeeze", [{"experiment_id": 1, "param_label": "soft", **SOFT}])
    counts = study["counts"].groupBy("experiment_id").agg(F.sum("event_count").alias("event_count"), F.count(F.lit(1)).alias("symbol_count"))
    skips = study["skips"].groupBy("experiment_id").agg(F.count(F.lit(1)).alias("skipped"))
    out = study["forward"].join(counts, "experiment_id").join(skips, "experiment_id", "left").fillna(0, ["skipped"])
    return out.select("horizon", "sample_count", *r4(*FORWARD_COLS), "event_count", "symbol_count", "skipped")


DAYS = [-30, -10, -1, 0, 1, 5, 10, 20, 30]


@query("e09_path_matrix", store=True, sql=with_bars("SELECT symbol, event_date, " + ", ".join(f"round(any_value(close_to_event) FILTER (relative_day = {d}), 6) AS \"{d}\"" for d in DAYS) + " FROM win GROUP BY ALL", *EV, WIN))
def _(t):
    wide = ev.path_matrix(windows(t), DAYS)
    return wide.select("symbol", "event_date", *[F.round(str(d), 6).alias(str(d)) for d in DAYS])


@query("e10_forward_summary", store=True, sql=with_bars(FORWARD_SQL, *EV, WIN))
def _(t):
    return ev.forward_summary(windows(t)).select("horizon", "sample_count", *r4(*FORWARD_COLS))


@query("e11_event_counts", with_bars("SELECT symbol, count(*) AS event_count FROM full_ GROUP BY 1", *EV, FULL))
def _(t):
    return ev.event_counts(kept(t).where("rn > 30 AND rn + 30 <= rows"))


@query("e12_event_paths", store=True, sql=with_bars(
    "SELECT relative_day, round(avg(close_to_event), 4) AS mean, round(median(close_to_event), 4) AS median, round(quantile_cont(close_to_event, 0.25), 4) AS p25, round(quantile_cont(close_to_event, 0.75), 4) AS p75 FROM win GROUP BY 1", *EV, WIN))
def _(t):
    return ev.event_paths(windows(t)).select("relative_day", *r4("mean", "median", "p25", "p75"))


CATALOG = """catalog_ AS (SELECT symbol, event_date, min(trade_date) AS window_start, max(trade_date) AS window_end, count(*) AS bar_count, min(relative_day) AS min_relative_day,
  max(relative_day) AS max_relative_day, any_value(event_close) AS event_close FROM win GROUP BY ALL)"""


@query("e13_event_catalog", store=True, sql=with_bars(f"SELECT c.*, m.* EXCLUDE (symbol, event_date, event_close) FROM catalog_ c LEFT JOIN ({META}) m USING (symbol, event_date)", *EV, FULL, WIN, CATALOG))
def _(t):
    return ev.event_catalog(windows(t), meta(t))


@query("j01_event_left_join", store=True, sql=with_bars("SELECT w.symbol, w.event_date, w.relative_day, f.close AS event_close FROM win w LEFT JOIN (SELECT symbol, date AS event_date, close FROM full_) f USING (symbol, event_date)", *EV, FULL, WIN))
def _(t):
    closes = meta(t).select("symbol", "event_date", "event_close")
    return windows(t).drop("event_close").join(closes, ["symbol", "event_date"], "left").select("symbol", "event_date", "relative_day", "event_close")


@query("e14_event_lookup", store=True, sql=with_bars(
    "SELECT symbol, event_date, trade_date, relative_day, close FROM win WHERE relative_day BETWEEN -5 AND 5 AND (symbol, event_date) IN (SELECT symbol, max(event_date) FROM win GROUP BY 1)", *EV, WIN))
def _(t):
    win = windows(t)
    last = win.groupBy("symbol").agg(F.max("event_date").alias("event_date"))
    return win.join(last, ["symbol", "event_date"], "left_semi").where(F.col("relative_day").between(-5, 5)).select("symbol", "event_date", "trade_date", "relative_day", "close")


def edge_sql(src, bars, horizons, keys="scenario"):
    """Directed returns after each trade, from the bars that follow it."""
    far = max(horizons)
    leads = ", ".join(f"lead(close, {h}) {W} AS c{h}" for h in horizons)
    edges = ", ".join(f"sg * (c{h} / close - 1) AS e{h}" for h in horizons)
    agg = ", ".join(f"count(e{h}) AS signal_sample_count_{h}, round(coalesce(avg(e{h}), 0), 4) AS signal_mean_edge_{h}, round(coalesce(median(e{h}), 0), 4) AS signal_median_edge_{h}, "
                    f"round(coalesce(avg(CASE WHEN e{h} > 0 THEN 1.0::DOUBLE WHEN e{h} IS NOT NULL THEN 0 END), 0), 4) AS signal_hit_rate_{h}" for h in horizons)
    return f"""SELECT {keys}, count(*) AS signal_event_count, count(*) FILTER (sg > 0) AS signal_buy_event_count, count(*) FILTER (sg < 0) AS signal_sell_event_count, {agg},
  round(avg(coalesce(greatest(sg * (top / close - 1), sg * (low_ / close - 1)), 0)), 4) AS signal_mean_mfe_{far}, round(avg(coalesce(least(sg * (top / close - 1), sg * (low_ / close - 1)), 0)), 4) AS signal_mean_mae_{far}
  FROM (SELECT *, {edges} FROM (SELECT t.*, b.* EXCLUDE (symbol, date), CASE WHEN t.action = 'buy' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sg FROM {src} t JOIN
    (SELECT symbol, date, close, {leads}, max(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {far} FOLLOWING) AS top,
      min(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {far} FOLLOWING) AS low_ FROM {bars}) b USING (symbol, date))) GROUP BY ALL"""


@query("e15_forward_edges", store=True, sql=with_bars(edge_sql("filled", "bars", (1, 5, 10)), *PLAIN, LOG, "filled AS (SELECT scenario, symbol, date, action FROM log WHERE status = 'filled')"))
def _(t):
    log = tr.trade_log(scenario(plain(t)), RULES, ("scenario",))
    out = ev.forward_edges(log, t.bars, (1, 5, 10))
    exact = {"scenario", "signal_event_count", "signal_buy_event_count", "signal_sell_event_count"} | {f"signal_sample_count_{h}" for h in (1, 5, 10)}
    return out.select(*[c if c in exact else F.round(c, 4).alias(c) for c in out.columns])
