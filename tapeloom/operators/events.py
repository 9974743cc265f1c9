"""Event conditions, event selection, windows around events and their summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.kernels import BARS, Panel, div, flag, greedy_gap, lag, roll, rolling_quantile, row_no
from tapeloom.functions.quantiles import exact_quantiles, same_keys, select_quantiles, value_counts
from tapeloom.operators import indicators as ind
from tapeloom.operators.signals import require_columns
from tapeloom.sources.store import through_table

FORWARD_HORIZONS = (1, 5, 10, 20, 30)

# fixed values: default parameters and grids of the conditions
BASE_PARAMS = {
    "bollinger_squeeze": {
        "window": 20, "num_std": 2, "squeeze_threshold": None, "squeeze_quantile": 0.05, "squeeze_lookback": 60,
        "require_breakout_confirmation": True, "breakout_direction": "up", "breakout_buffer": 0.0, "breakout_max_wait": 10,
        "breakout_confirm_bars": 1, "use_volume_filter": True, "volume_window": 60, "volume_multiplier": 2, "use_trend_filter": True,
        "trend_window": 60, "trend_slope_window": 3, "use_supertrend_filter": False, "supertrend_atr_period": 10,
        "supertrend_multiplier": 3.0, "use_band_expansion_filter": False, "band_expansion_lookback": 1, "use_return_filter": False,
        "min_breakout_return": 0.0,
    },
    "rsrs_breakout": {
        "window": 20, "zscore_window": 90, "min_valid_window": 12, "entry_zscore": 1.0, "breakout_direction": "up",
        "use_r2_weight": True, "use_beta_adjustment": False, "use_volume_filter": False, "volume_window": 20, "volume_multiplier": 2,
        "use_trend_filter": True, "trend_window": 60, "trend_slope_window": 3, "use_return_filter": False, "min_breakout_return": 0.0,
    },
}
PARAM_GRIDS = {"bollinger_squeeze": {"num_std": [2.0, 2.5, 3.0]}, "rsrs_breakout": {}}
META_NUMERIC = ["bandwidth", "condition_threshold", "rsrs_beta", "rsrs_r2", "rsrs_zscore", "rsrs_score"]
META_BOOLEAN = [
    "breakout_valid", "volume_confirmation", "trend_long_confirmation", "trend_short_confirmation", "supertrend_long_confirmation",
    "supertrend_short_confirmation", "band_expansion_confirmation", "return_up_confirmation", "return_down_confirmation",
]
META_TEXT = ["event_direction"]
# parameters that may differ from row to row; all others shape the plan
ROW_PARAMS = {
    "bollinger_squeeze": ["num_std", "squeeze_threshold", "breakout_buffer", "breakout_max_wait", "breakout_confirm_bars", "volume_multiplier", "min_breakout_return"],
    "rsrs_breakout": ["entry_zscore", "volume_multiplier", "min_breakout_return"],
}


def _direction(p: Mapping) -> tuple[bool, bool]:
    d = p["breakout_direction"]
    if d not in {"up", "down", "both"}:
        raise ValueError("breakout_direction must be one of: up, down, both")
    return d in {"up", "both"}, d in {"down", "both"}


def _setting(p: Mapping, name: str, row_params: Sequence[str]) -> Column:
    return F.col(f"p_{name}") if name in row_params else F.lit(float(p[name]))


def _gate_inputs(df: DataFrame, p: Mapping, panel: Panel) -> DataFrame:
    """What the filters read and no row parameter changes."""
    new = {"_ret": ind.pct_change("close", panel=panel)}
    if p.get("use_volume_filter"):
        require_columns(df, ["volume"])
        new |= {"_vma": roll(F.avg, "volume", int(p["volume_window"]), panel=panel), "_pv": lag("volume", panel=panel)}
    if p.get("use_trend_filter"):
        new["_tma"] = roll(F.avg, "close", int(p["trend_window"]), panel=panel)
    df = df.withColumns(new)
    if p.get("use_trend_filter"):
        df = df.withColumn("_ptma", lag("_tma", int(p["trend_slope_window"]), panel))
    return df


def _gates(p: Mapping, row_params: Sequence[str]) -> dict[str, Column]:
    c, yes = F.col, F.lit(True)
    out = dict.fromkeys(["volume_confirmation", "trend_long_confirmation", "trend_short_confirmation", "return_up_confirmation", "return_down_confirmation"], yes)
    if p.get("use_volume_filter"):
        out["volume_confirmation"] = flag((c("volume") >= c("_vma") * _setting(p, "volume_multiplier", row_params)) & (c("volume") > c("_pv")))
    if p.get("use_trend_filter"):
        out["trend_long_confirmation"] = flag((c("close") > c("_tma")) & (c("_tma") > c("_ptma")))
        out["trend_short_confirmation"] = flag((c("close") < c("_tma")) & (c("_tma") < c("_ptma")))
    if p.get("use_return_filter"):
        limit = _setting(p, "min_breakout_return", row_params)
        out["return_up_confirmation"] = flag(c("_ret") >= limit)
        out["return_down_confirmation"] = flag(c("_ret") <= -limit)
    return out


def squeeze_inputs(df: DataFrame, p: Mapping, panel: Panel = BARS) -> DataFrame:
    n = int(p["window"])
    df = _gate_inputs(df, p, panel).withColumns(
        {"middle_band": roll(F.avg, "close", n, panel=panel), "_sd": roll(F.stddev_samp, "close", n, panel=panel)}
    )
    if p.get("squeeze_threshold") is None:
        # bands are num_std deviations wide, so the quantile of one deviation serves every num_std
        df = df.withColumn("_narrow", div("_sd", "middle_band"))
        df = rolling_quantile(df, "_quantile", "_narrow", int(p["squeeze_lookback"]), float(p["squeeze_quantile"]), max(n, 5), panel)
    if p.get("use_supertrend_filter"):
        require_columns(df, ["high", "low", "close"])
        df = ind.supertrend(df, int(p["supertrend_atr_period"]), float(p["supertrend_multiplier"]), panel).drop("supertrend")
    return df


def squeeze_decide(df: DataFrame, p: Mapping, panel: Panel = BARS, row_params: Sequence[str] = ()) -> DataFrame:
    """The squeeze condition: a break of the bands within some bars after a squeeze ended.

    Rows count from the last squeeze row of a series. A break must hold for the confirming bars and
    pass the filters; the first such row ends the wait.
    """
    up_ok, down_ok = _direction(p)
    c = F.col
    num_std = _setting(p, "num_std", row_params)
    df = df.withColumns({"upper_band": c("middle_band") + num_std * c("_sd"), "lower_band": c("middle_band") - num_std * c("_sd")})
    df = df.withColumn("bandwidth", div(c("upper_band") - c("lower_band"), "middle_band"))
    if p.get("squeeze_threshold") is None and "squeeze_threshold" not in row_params:
        limit, narrow = 2 * num_std * c("_quantile"), c("_narrow") <= c("_quantile")
    else:
        limit = _setting(p, "squeeze_threshold", row_params)
        narrow = c("bandwidth") <= limit
    df = df.withColumns({"condition_threshold": limit, "squeeze_condition": flag(narrow)})
    yes = F.lit(True)
    gates = _gates(p, row_params) | {"band_expansion_confirmation": yes, "supertrend_long_confirmation": yes, "supertrend_short_confirmation": yes}
    if p.get("use_band_expansion_filter"):
        gates["band_expansion_confirmation"] = flag(c("bandwidth") > lag("bandwidth", max(int(p["band_expansion_lookback"]), 1), panel))
    if p.get("use_supertrend_filter"):
        gates["supertrend_long_confirmation"] = flag(c("st_direction") > 0)
        gates["supertrend_short_confirmation"] = flag(c("st_direction") < 0)
    df = df.withColumns(gates)
    if not p.get("require_breakout_confirmation", False):
        no = F.lit(False)
        return df.withColumns(
            {"breakout_up": no, "breakout_down": no, "breakout_valid": no, "event_direction": F.lit(None).cast("string"), "condition": c("squeeze_condition")}
        )
    buffer = _setting(p, "breakout_buffer", row_params)
    wait = F.greatest(_setting(p, "breakout_max_wait", row_params), F.lit(1))
    confirm = F.greatest(_setting(p, "breakout_confirm_bars", row_params), F.lit(1))
    ready = c("bandwidth").isNotNull() & c("condition_threshold").isNotNull() & c("upper_band").isNotNull() & c("lower_band").isNotNull()
    df = df.withColumns(
        {"_ready": ready, "_above": flag(c("close") > c("upper_band") * (1 + buffer)), "_below": flag(c("close") < c("lower_band") * (1 - buffer))}
    )
    df = df.withColumn("_seq", F.count(F.when(c("_ready"), 1)).over(panel.so_far))

    def last_seq(cond: Column, spec) -> Column:
        return F.last(F.when(c("_ready") & cond, c("_seq")), ignorenulls=True).over(spec)

    df = df.withColumns(
        {
            "_start": last_seq(c("squeeze_condition"), panel.so_far),
            "_noup": last_seq(~c("_above") | c("squeeze_condition"), panel.so_far),
            "_nodown": last_seq(~c("_below") | c("squeeze_condition"), panel.so_far),
        }
    )
    waited = c("_seq") - c("_start")
    open_ = flag(c("_ready") & ~c("squeeze_condition") & (waited >= 1) & (waited <= wait))
    long_ok = c("volume_confirmation") & c("trend_long_confirmation") & c("supertrend_long_confirmation") & c("band_expansion_confirmation") & c("return_up_confirmation")
    short_ok = c("volume_confirmation") & c("trend_short_confirmation") & c("supertrend_short_confirmation") & c("band_expansion_confirmation") & c("return_down_confirmation")
    df = df.withColumns(
        {
            "_up": open_ & flag(c("_seq") - F.coalesce(c("_noup"), F.lit(0)) >= confirm),
            "_down": open_ & flag(c("_seq") - F.coalesce(c("_nodown"), F.lit(0)) >= confirm),
            "_long": long_ok, "_short": short_ok,
        }
    )
    hit_up, hit_down = c("_up") & c("_long") & F.lit(up_ok), c("_down") & c("_short") & F.lit(down_ok)
    # an earlier hit after the same squeeze ended the wait
    df = df.withColumn("_hit", last_seq(hit_up | hit_down, panel.before))
    free = F.coalesce(c("_hit") <= c("_start"), F.lit(True))
    valid = free & (hit_up | hit_down)
    return df.withColumns(
        {
            "breakout_up": c("_up") & free, "breakout_down": c("_down") & free, "breakout_valid": valid, "condition": valid,
            "event_direction": F.when(valid, F.when(hit_up, "up").otherwise("down")),
        }
    )


def rsrs_inputs(df: DataFrame, p: Mapping, panel: Panel = BARS) -> DataFrame:
    require_columns(df, ["high", "low", "close"])
    n = max(int(p["window"]), 5)
    need = min(max(int(p.get("min_valid_window", n // 2)), 5), n)
    df = ind.rsrs(df, n, max(int(p["zscore_window"]), 20), need, bool(p["use_r2_weight"]), bool(p["use_beta_adjustment"]), panel=panel)
    return _gate_inputs(df, p, panel)


def rsrs_decide(df: DataFrame, p: Mapping, panel: Panel = BARS, row_params: Sequence[str] = ()) -> DataFrame:
    up_ok, down_ok = _direction(p)
    c, entry = F.col, _setting(p, "entry_zscore", row_params)
    df = df.withColumns(_gates(p, row_params)).withColumns(
        {"condition_threshold": entry, "breakout_up": flag(c("rsrs_score") >= entry), "breakout_down": flag(c("rsrs_score") <= -entry)}
    )
    long = c("breakout_up") & c("volume_confirmation") & c("trend_long_confirmation") & c("return_up_confirmation")
    short = c("breakout_down") & c("volume_confirmation") & c("trend_short_confirmation") & c("return_down_confirmation")
    valid = (long & F.lit(up_ok)) | (short & F.lit(down_ok))
    return df.withColumns(
        {"breakout_valid": valid, "condition": valid, "event_direction": F.when(short, "down").when(long, "up")}
    )


CONDITIONS = {"bollinger_squeeze": (squeeze_inputs, squeeze_decide), "rsrs_breakout": (rsrs_inputs, rsrs_decide)}


def condition_frame(df: DataFrame, name: str, params: Mapping | None = None, panel: Panel = BARS) -> DataFrame:
    """The bars with the columns of a named condition; missing parameters take their defaults."""
    if name not in CONDITIONS:
        raise ValueError(f"Unsupported condition: {name}. Available: {', '.join(sorted(CONDITIONS))}")
    inputs, decide = CONDITIONS[name]
    p = {**BASE_PARAMS[name], **(params or {})}
    out = decide(inputs(df, p, panel), p, panel)
    return out.drop(*[c for c in out.columns if c.startswith("_")])


# ---- events -----------------------------------------------------------------------------------


def event_rows(df: DataFrame, selection: str = "first_in_run", min_gap: int = 0, panel: Panel = BARS) -> DataFrame:
    """The event rows of a condition frame, with rn, the row number in the series, and rows, its length.

    A run of true rows is one event, at its first row; ``all_true_days`` takes every true row. With
    a minimum gap, an event too close after the last kept one is left out.
    """
    df = df.where("close IS NOT NULL")
    on = flag(F.col("condition"))
    df = df.withColumns({"rn": row_no(panel), "rows": F.count(F.lit(1)).over(panel.whole), "_on": on})
    if selection != "all_true_days":
        df = df.withColumn("_on", F.col("_on") & ~flag(lag("_on", panel=panel)))
    events = df.where("_on").drop("_on")
    return min_gap_events(events, min_gap, panel) if min_gap > 0 else events


def min_gap_events(events: DataFrame, min_gap: int, panel: Panel = BARS) -> DataFrame:
    """Greedy choice by row number; the events of one series are at most its calendar."""
    keys = list(panel.keys)
    rest = [c for c in events.columns if c not in keys + ["rn"]]
    row = F.struct("rn", *rest)
    kind = events.select(row.alias("r")).schema["r"].dataType.simpleString()
    kept = events.groupBy(*keys).agg(greedy_gap(F.collect_list(row), min_gap, kind, "rn").alias("_k"))
    return kept.select(*keys, F.explode("_k").alias("_e")).select(*keys, "_e.*").select(*events.columns)


def event_windows(events: DataFrame, bars: DataFrame, before: int = 30, after: int = 30, full: bool = True, panel: Panel = BARS, days: Sequence[int] | None = None) -> DataFrame:
    """Bars around each event by row position, with relative_day and the return since the event.

    Every event names the row numbers it wants, so this is an equi-join on (series, row number).
    ``days`` picks single offsets instead of the whole window.
    """
    keys = list(panel.keys)
    extra = [c for c in ("experiment_id",) if c in events.columns]
    offsets = F.sequence(F.lit(-before), F.lit(after)) if days is None else F.array(*[F.lit(d) for d in days])
    if full:
        events = events.where((F.col("rn") - before >= 1) & (F.col("rn") + after <= F.col("rows")))
    wanted = events.where("close > 0").select(
        *extra, *keys, F.col(panel.order).alias("event_date"), F.col("close").alias("event_close"), F.col("rn").alias("_at"), F.explode(offsets).alias("relative_day")
    ).withColumn("rn", F.col("_at") + F.col("relative_day")).drop("_at")
    numbered = bars.where("close IS NOT NULL").withColumn("rn", row_no(panel)).withColumnRenamed(panel.order, "trade_date")
    out = wanted.join(numbered, keys + ["rn"]).drop("rn")
    return out.withColumn("close_to_event", F.col("close") / F.col("event_close") - 1)


def event_meta(events: DataFrame, panel: Panel = BARS) -> DataFrame:
    """One row per event with the condition columns that exist."""
    extra = [c for c in ("experiment_id",) if c in events.columns]
    have = [c for c in META_NUMERIC + META_BOOLEAN + META_TEXT if c in events.columns]
    return events.select(*extra, *panel.keys, F.col(panel.order).alias("event_date"), F.col("close").alias("event_close"), *have)


def path_matrix(windows: DataFrame, days: Sequence[int], keys: Sequence[str] = ("symbol", "event_date")) -> DataFrame:
    """One row per event, one column per relative day; the days are named, so no extra pass looks for them."""
    return windows.groupBy(*keys).pivot("relative_day", list(days)).agg(F.avg("close_to_event"))


def forward_summary(windows: DataFrame, horizons: Sequence[int] = FORWARD_HORIZONS, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, median, win rate and quartiles of the return at each horizon, all from the counts of its values."""
    rows = windows.where(F.col("relative_day").isin(list(horizons))).withColumnRenamed("relative_day", "horizon")
    by = [*keys, "horizon"]
    counts = value_counts(rows, by, {"r": "close_to_event"})
    n, x = F.col("_n"), F.col("_x")
    out = counts.groupBy(*by).agg(
        F.sum(n).alias("sample_count"), (F.sum(x * n) / F.sum(n)).alias("mean_return"), (F.sum(F.when(x > 0, n).otherwise(0)) / F.sum(n)).alias("win_rate"))
    out = same_keys(out, select_quantiles(counts, by, (0.25, 0.5, 0.75)).drop("_name"), by)
    return out.withColumns({"median_return": F.col("_q")[1], "p25": F.col("_q")[0], "p75": F.col("_q")[2]}).drop("_q")


def event_counts(events: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("event_count")).orderBy(F.desc("event_count"), *keys)


def event_paths(windows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, median and quartile path by relative day, from the counts of the values."""
    by = [*keys, "relative_day"]
    counts = value_counts(windows, by, {"r": "close_to_event"})
    out = counts.groupBy(*by).agg((F.sum(F.col("_x") * F.col("_n")) / F.sum("_n")).alias("mean"))
    out = same_keys(out, select_quantiles(counts, by, (0.25, 0.5, 0.75)).drop("_name"), by)
    return out.withColumns({"median": F.col("_q")[1], "p25": F.col("_q")[0], "p75": F.col("_q")[2]}).drop("_q")


REQUIRED_WINDOW_COLUMNS = ["symbol", "event_date", "trade_date", "relative_day", "open", "high", "low", "close", "volume"]


def check_window_columns(windows: DataFrame) -> None:
    missing = sorted(set(REQUIRED_WINDOW_COLUMNS) - set(windows.columns))
    if missing:
        raise ValueError(f"event windows lack columns: {', '.join(missing)}")


def event_catalog(windows: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """One row per event: bounds of its window, bar count, event close, and the metadata."""
    keys = ["symbol", "event_date"]
    close = F.first("event_close", ignorenulls=True) if "event_close" in windows.columns else F.max(F.when(F.col("relative_day") == 0, F.col("close")))
    out = windows.groupBy(*keys).agg(
        F.min("trade_date").alias("window_start"), F.max("trade_date").alias("window_end"), F.count(F.lit(1)).alias("bar_count"),
        F.min("relative_day").alias("min_relative_day"), F.max("relative_day").alias("max_relative_day"), close.alias("event_close"),
    )
    return out if meta is None else out.join(meta.drop("event_close"), keys, "left")


def symbol_events(catalog: DataFrame, symbol: str) -> DataFrame:
    return catalog.where(F.col("symbol") == symbol).orderBy("event_date")


def event_window(windows: DataFrame, symbol: str | Column, event_date, visible_days: int | None = None) -> DataFrame:
    out = windows.where((F.col("symbol") == symbol) & (F.col("event_date") == event_date))
    if visible_days is not None:
        out = out.where(F.col("relative_day").between(-visible_days, visible_days))
    return out.orderBy("trade_date")


# ---- what followed a trade ----------------------------------------------------------------------


def forward_columns(bars: DataFrame, horizons: Sequence[int], panel: Panel = BARS) -> DataFrame:
    """Adds the close at each horizon and the extremes over the longest one."""
    horizons = sorted({int(h) for h in horizons if int(h) > 0})
    if not horizons:
        raise ValueError("signal horizons must contain at least one positive integer")
    ahead = panel.w.rowsBetween(1, horizons[-1])
    new = {f"_c{h}": F.lead("close", h).over(panel.w) for h in horizons}
    return bars.withColumns(new | {"_top": F.max("close").over(ahead), "_low": F.min("close").over(ahead)})


def forward_edges(trades: DataFrame, bars: DataFrame, horizons: Sequence[int], keys: Sequence[str] = ("scenario",), count_rejected: bool = False, panel: Panel = BARS) -> DataFrame:
    """Directed returns after trades: mean, median and hit rate per horizon, best and worst excursion.

    Refused buys are no events unless ``count_rejected`` asks for them.
    """
    ahead = forward_columns(bars, horizons, panel)
    later = [c for c in ahead.columns if c not in bars.columns]
    t = trades.where(F.col("action").isin("buy", "sell"))
    if not count_rejected and "status" in trades.columns:
        t = t.where("status = 'filled'")
    t = t.join(ahead.select(*panel.keys, panel.order, F.col("close").alias("_close"), *later), [*panel.keys, panel.order])
    return edge_summary(t.select(*keys, "action", "_close", *later), horizons, keys)


def edge_summary(trades: DataFrame, horizons: Sequence[int], keys: Sequence[str] = ("scenario",)) -> DataFrame:
    """The figures of ``forward_edges`` of trades (action buy or sell) that carry _close and the ``forward_columns`` of their bar."""
    horizons = sorted({int(h) for h in horizons if int(h) > 0})
    far = horizons[-1]
    t = through_table(trades.where("_close > 0"), "edges")
    sign = F.when(F.col("action") == "buy", 1.0).otherwise(-1.0)
    edge = lambda x: sign * (F.col(x) / F.col("_close") - 1)
    t = t.withColumns({f"_e{h}": F.when(F.col(f"_c{h}") > 0, edge(f"_c{h}")) for h in horizons})
    best = F.coalesce(F.greatest(edge("_top"), edge("_low")), F.lit(0.0))
    worst = F.coalesce(F.least(edge("_top"), edge("_low")), F.lit(0.0))
    aggs = [F.count(F.lit(1)).alias("signal_event_count"), F.count_if(sign > 0).alias("signal_buy_event_count"), F.count_if(sign < 0).alias("signal_sell_event_count")]
    zero = F.lit(0.0)
    for h in horizons:
        e = F.col(f"_e{h}")
        aggs += [
            F.count(e).alias(f"signal_sample_count_{h}"),
            F.coalesce(F.avg(e), zero).alias(f"signal_mean_edge_{h}"),
            F.coalesce(F.avg(F.when(e.isNotNull(), (e > 0).cast("double"))), zero).alias(f"signal_hit_rate_{h}"),
        ]
    aggs += [F.avg(best).alias(f"signal_mean_mfe_{far}"), F.avg(worst).alias(f"signal_mean_mae_{far}")]
    middle = exact_quantiles(t, keys, {f"_m{h}": f"_e{h}" for h in horizons}, [0.5])
    out = same_keys(t.groupBy(*keys).agg(*aggs), middle, keys, "left")
    return out.withColumns({f"signal_median_edge_{h}": F.coalesce(F.col(f"_m{h}")[0], zero) for h in horizons}).drop(*[f"_m{h}" for h in horizons])
