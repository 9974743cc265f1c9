"""Studies over many parameter sets: one plan for all of them."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.kernels import BARS, Panel, crosses_down, crosses_up, div, flag, lag, reset_latch, roll, rolling_quantile
from tapeloom.functions.quantiles import exact_quantiles, same_keys
from tapeloom.operators import events as ev
from tapeloom.operators import indicators as ind
from tapeloom.operators import trades as tr
from tapeloom.operators.signals import min_rows_needed
from tapeloom.plans.grids import attach_grid
from tapeloom.sources.store import through_table

# ---- event studies ------------------------------------------------------------------------------


def scan_conditions(bars: DataFrame, name: str, sets: Sequence[Mapping], panel: Panel = BARS) -> DataFrame:
    """Condition columns of every parameter set, keyed by experiment_id.

    Window lengths and filters shape the plan, so sets that share them form one group: its window
    columns are computed once on the bars, then the bars are repeated per experiment with the
    remaining parameters as columns.
    """
    inputs, decide = ev.CONDITIONS[name]
    row_names = ev.ROW_PARAMS[name]
    groups: dict[str, list[Mapping]] = {}
    for s in sets:
        p = {**ev.BASE_PARAMS[name], **s}
        fixed = {k: v for k, v in p.items() if k not in row_names + ["experiment_id", "param_label"]}
        fixed["_adaptive"] = p.get("squeeze_threshold") is None
        groups.setdefault(json.dumps(fixed, sort_keys=True), []).append(p)
    parts = []
    for members in groups.values():
        p = members[0]
        used = [k for k in row_names if p.get(k) is not None]
        grid = [{"experiment_id": m["experiment_id"], **{f"p_{k}": float(m[k]) for k in used}} for m in members]
        df = decide(attach_grid(inputs(bars, p, panel), grid), p, panel.by("experiment_id"), used)
        parts.append(df.drop(*[c for c in df.columns if c.startswith(("_", "p_"))]))
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def event_study(bars: DataFrame, name: str, sets: Sequence[Mapping], before: int = 30, after: int = 30, min_gap: int = 20, selection: str = "first_in_run", full: bool = True, horizons: Sequence[int] = ev.FORWARD_HORIZONS, panel: Panel = BARS) -> dict[str, DataFrame]:
    """Events, windows, forward summary and skipped symbols of every parameter set."""
    by = panel.by("experiment_id")
    events = ev.event_rows(scan_conditions(bars, name, sets, panel), selection, min_gap, by)
    # symbols without an event are skipped; an event without a full window has no row in the results
    counted = events.where((F.col("rn") - before >= 1) & (F.col("rn") + after <= F.col("rows"))) if full else events
    symbols = attach_grid(bars.select(*panel.keys).distinct(), [{"experiment_id": s["experiment_id"]} for s in sets])
    skips = symbols.join(events, ["experiment_id", *panel.keys], "left_anti").withColumn("reason", F.lit("no_events"))
    slim = bars.select(*panel.keys, panel.order, "open", "high", "low", "close", "volume")
    ahead = ev.event_windows(events, slim, before, after, full, panel, list(horizons))
    return {
        "events": counted,
        "meta": ev.event_meta(counted, panel),
        "windows": ev.event_windows(events, slim, before, after, full, panel),
        "forward": ev.forward_summary(ahead, horizons, ["experiment_id"]),
        "counts": ev.event_counts(counted, ["experiment_id", *panel.keys]),
        "skips": skips,
    }


def experiment_summary(bars: DataFrame, name: str, sets: Sequence[Mapping], rank_by: int = 20, before: int = 30, after: int = 30, min_gap: int = 20, selection: str = "first_in_run", full: bool = True, horizons: Sequence[int] = ev.FORWARD_HORIZONS, panel: Panel = BARS) -> DataFrame:
    """One row per parameter set: counts, the figures of every horizon, the rank metric, parameters as JSON.

    The later closes ride along from the bars, so all figures come from one pass over the events.
    """
    key, symbol = "experiment_id", F.concat_ws("\x1f", *panel.keys)
    labels = [{key: s[key], "param_label": s["param_label"],
               "params_json": json.dumps({k: v for k, v in s.items() if k not in (key, "param_label")}, ensure_ascii=False, sort_keys=True)} for s in sets]
    ahead = bars.withColumns({f"fwd_{h}": div(F.lead("close", h).over(panel.w), "close") - 1 for h in horizons})
    events = ev.event_rows(scan_conditions(ahead, name, sets, panel), selection, min_gap, panel.by(key))
    whole = F.col("close") > 0
    if full:
        whole = whole & (F.col("rn") - before >= 1) & (F.col("rn") + after <= F.col("rows"))
    events = events.select(key, *panel.keys, whole.alias("_whole"), *[F.when(whole, F.col(f"fwd_{h}")).alias(f"fwd_{h}") for h in horizons])
    events = through_table(events, "study-events")
    aggs = [F.count_if("_whole").alias("event_count"), F.count_distinct(F.when(F.col("_whole"), symbol)).alias("symbol_count"), F.count_distinct(symbol).alias("_seen")]
    for h in horizons:
        r = F.col(f"fwd_{h}")
        aggs += [F.avg(r).alias(f"mean_return_{h}d"),
                 F.avg((r > 0).cast("double")).alias(f"win_rate_{h}d"), F.count(r).alias(f"sample_count_{h}d")]
    middle = exact_quantiles(events, [key], {f"fwd_{h}": f"fwd_{h}" for h in horizons}, [0.5])
    middle = middle.select(key, *[F.col(f"fwd_{h}")[0].alias(f"median_return_{h}d") for h in horizons])
    figures = same_keys(events.groupBy(key).agg(*aggs), middle, [key], "left")
    out = attach_grid(bars.agg(F.count_distinct(symbol).alias("_symbols")), labels).join(figures, key, "left")
    counts = ["event_count", "symbol_count", "_seen", *[f"sample_count_{h}d" for h in horizons]]
    out = out.fillna(0, counts).withColumns(
        {
            "skip_symbol_count": F.col("_symbols") - F.col("_seen"),
            "avg_events_per_symbol": F.coalesce(div("event_count", "symbol_count"), F.lit(0.0)),
            "rank_metric": F.col(f"mean_return_{rank_by}d"),
        }
    )
    return out.drop("_symbols", "_seen")


def rank_experiments(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.desc_nulls_last("rank_metric"), F.desc("event_count"), "experiment_id")


def best_experiment(summary: DataFrame, min_events: int = 6) -> DataFrame:
    return rank_experiments(summary.where(F.col("event_count") >= min_events)).limit(1)


# ---- Bollinger parameter study --------------------------------------------------------------------


def _pick(param: str, options: Mapping[object, str | Column]) -> Column:
    """The column that belongs to the row's parameter value."""
    case = None
    for value, name in options.items():
        c = F.col(name) if isinstance(name, str) else name
        case = F.when(F.col(param) == value, c) if case is None else case.when(F.col(param) == value, c)
    return case


# parameters that a position machine's path depends on; what else a candidate has is applied to the path
MACHINE = ["window", "num_std", "use_trend_filter", "trend_window", "use_volume_filter", "volume_window",
           "volume_multiplier", "use_supertrend_filter", "squeeze_quantile", "confirm_bars"]


def machine_grid(candidates: Sequence[Mapping]) -> tuple[list[dict], dict[int, list[dict]]]:
    """The candidates as a tree: distinct machine parameters (with machine_id), and the candidates of each machine.

    A leaf has experiment_id, signal_delay and the rows that the candidate needs.
    """
    machines: dict[str, dict] = {}
    leaves: dict[int, list[dict]] = {}
    for i, c in enumerate(candidates, start=1):
        row = {k: c[k] for k in MACHINE if c.get(k) is not None}
        row = {k: float(v) if k in ("num_std", "volume_multiplier", "squeeze_quantile") else v for k, v in row.items()}
        machine = machines.setdefault(json.dumps(row, sort_keys=True), {"machine_id": len(machines), **row})
        leaves.setdefault(machine["machine_id"], []).append({"experiment_id": c.get("experiment_id", i), "delay": c.get("signal_delay", 0), "need": min_rows_needed(c)})
    return list(machines.values()), leaves


def candidate_signals(bars: DataFrame, candidates: Sequence[Mapping], keep: Sequence[str] = (), panel: Panel = BARS) -> DataFrame:
    """Signals of every candidate of one mode, keyed by experiment_id.

    All rolling columns that any candidate needs are computed once on the bars; after the bars are repeated per
    distinct machine only the position machine runs per (machine, symbol), once for all candidates that
    differ in what comes after it.
    """
    mode = candidates[0]["mode"]
    values = lambda k, d: sorted({c.get(k, d) for c in candidates})
    windows, trends, volumes = values("window", 20), values("trend_window", 60), values("volume_window", 20)
    slope = candidates[0].get("trend_slope_window", 3)
    gated = any(c.get("use_trend_filter") or c.get("use_volume_filter") for c in candidates)
    super_ = any(c.get("use_supertrend_filter") for c in candidates)
    df = ind.supertrend(bars, panel=panel) if super_ else bars
    first = {"_pc": lag("close", panel=panel), "_pv": lag("volume", panel=panel), "_n": F.count(F.lit(1)).over(panel.whole)}
    for w in windows:
        first |= {f"_m{w}": roll(F.avg, "close", w, panel=panel), f"_s{w}": roll(F.stddev_samp, "close", w, panel=panel)}
    if gated:
        first |= {f"_t{w}": roll(F.avg, "close", w, panel=panel) for w in trends}
        first |= {f"_v{w}": roll(F.avg, "volume", w, panel=panel) for w in volumes}
    df = df.withColumns(first)
    second = {f"_p{x}{w}": lag(f"_{x}{w}", panel=panel) for w in windows for x in ("m", "s")}
    if gated:
        second |= {f"_pt{w}": lag(f"_t{w}", slope, panel) for w in trends}
    df = df.withColumns(second)
    qs = values("squeeze_quantile", 0.1) if mode == "squeeze" else []
    for w in windows if qs else []:
        # the quantile of one deviation serves every band width
        df = df.withColumn(f"_b{w}", div(f"_s{w}", f"_m{w}"))
        for i, q in enumerate(qs):
            df = rolling_quantile(df, f"_q{w}_{i}", f"_b{w}", candidates[0]["squeeze_lookback"], q, max(w, 5), panel)
    machines, leaves = machine_grid(candidates)
    df = attach_grid(df, machines)
    by, c = panel.by("machine_id"), F.col
    df = df.withColumns({n: _pick("window", {w: f"_{p}{w}" for w in windows}) for n, p in (("_m", "m"), ("_s", "s"), ("_pm", "pm"), ("_ps", "ps"))})
    k = c("num_std")
    df = df.withColumns({"_up": c("_m") + k * c("_s"), "_lo": c("_m") - k * c("_s"), "_pup": c("_pm") + k * c("_ps"), "_plo": c("_pm") - k * c("_ps")})
    long_ok = short_ok = F.lit(True)
    if gated:
        tma, ptma = _pick("trend_window", {w: f"_t{w}" for w in trends}), _pick("trend_window", {w: f"_pt{w}" for w in trends})
        loud = flag((c("volume") > _pick("volume_window", {w: f"_v{w}" for w in volumes}) * c("volume_multiplier")) & (c("volume") > c("_pv")))
        quiet_ok = ~c("use_volume_filter") | loud
        long_ok = quiet_ok & (~c("use_trend_filter") | flag((c("close") > tma) & (tma > ptma)))
        short_ok = quiet_ok & (~c("use_trend_filter") | flag((c("close") < tma) & (tma < ptma)))
    if super_:
        long_ok = long_ok & (~c("use_supertrend_filter") | flag(c("st_direction") > 0))
        short_ok = short_ok & (~c("use_supertrend_filter") | flag(c("st_direction") < 0))
    df = df.withColumns({"_lok": long_ok, "_sok": short_ok})
    price, prev = c("close"), c("_pc")
    up, down = crosses_up(price, c("_up"), prev, c("_pup")), crosses_down(price, c("_lo"), prev, c("_plo"))
    mid_up, mid_down = crosses_up(price, c("_m"), prev, c("_pm")), crosses_down(price, c("_m"), prev, c("_pm"))
    ready = c("_up").isNotNull() & c("_lo").isNotNull()
    leave_long, leave_short = mid_down, mid_up
    if mode == "mean_reversion":
        enter_long, enter_short = crosses_up(price, c("_lo"), prev, c("_plo")), crosses_down(price, c("_up"), prev, c("_pup"))
        leave_long, leave_short = mid_up, mid_down
    elif mode == "squeeze":
        limit = _pick("squeeze_quantile", {q: _pick("window", {w: f"_q{w}_{i}" for w in windows}) for i, q in enumerate(qs)})
        df = df.withColumns({"_bw": _pick("window", {w: f"_b{w}" for w in windows}), "_thr": limit})
        df = df.withColumns({"_sq": flag(c("_bw") <= c("_thr")), "_ready": ready & c("_thr").isNotNull()})
        df = df.withColumn("_was", flag(F.last(F.when(c("_ready"), c("_sq")), ignorenulls=True).over(by.before)))
        fresh = c("_was") & ~c("_sq")
        enter_long, enter_short, ready = fresh & up & c("_lok"), fresh & down & c("_sok"), c("_ready")
    elif mode == "double":
        df = df.withColumns({"_hi": flag(price > c("_up")), "_below": flag(price < c("_lo")), "_ready": ready})
        df = df.withColumn("_seq", F.count(F.when(c("_ready"), 1)).over(by.so_far))
        since = lambda s: c("_seq") - F.coalesce(F.last(F.when(c("_ready") & ~c(s), c("_seq")), ignorenulls=True).over(by.so_far), F.lit(0))
        df = df.withColumns({"_hr": since("_hi"), "_br": since("_below")})
        enter_long, enter_short, ready = (c("_hr") >= c("confirm_bars")) & c("_lok"), (c("_br") >= c("confirm_bars")) & c("_sok"), c("_ready")
    else:
        enter_long, enter_short = up & c("_lok"), down & c("_sok")
    df = df.select("machine_id", *panel.keys, panel.order, *keep, "_n",
                   flag(enter_long).alias("_il"), flag(enter_short).alias("_is"), flag(leave_long).alias("_ol"), flag(leave_short).alias("_os"), flag(ready).alias("_rd"))
    df = reset_latch(df, "signal", c("_il"), c("_is"), c("_ol"), c("_os"), c("_rd"), by)
    delays = values("signal_delay", 0)
    df = df.withColumns({f"_d{d}": c("signal") if d == 0 else F.coalesce(lag("signal", d, by), F.lit(0)) for d in delays})
    leaf = lambda x: F.struct(F.lit(x["experiment_id"]).alias("experiment_id"), F.lit(x["delay"]).alias("delay"), F.lit(x["need"]).alias("need"))
    of_machine = F.create_map(*[x for m, found in leaves.items() for x in (F.lit(m), F.array(*map(leaf, found)))])
    df = df.withColumn("_leaf", F.explode(F.try_element_at(of_machine, c("machine_id"))))
    signal = F.when(c("_n") >= c("_leaf.need"), _pick("_leaf.delay", {d: f"_d{d}" for d in delays})).otherwise(0)
    return df.select(c("_leaf.experiment_id").alias("experiment_id"), *panel.keys, panel.order, *keep, signal.alias("signal"))


def evaluate_candidates(bars: DataFrame, candidates: Sequence[Mapping], periods: Mapping[str, tuple[str, str]], rules: tr.Rules, horizons: Sequence[int] = (1, 3, 5, 10), initial_capital: float = 1_000_000.0, loss: tr.Stop | None = None, profit: tr.Stop | None = None, panel: Panel = BARS) -> DataFrame:
    """Value, trade and forward figures of every candidate in every period, one row per candidate.

    Signals see the whole history, accounts start flat in each period. The later closes ride along from the bars and the
    ledger is written once, so that values, trades and forward figures read one run of the machines for all periods.
    """
    flagged = tr.exchange_flags(ev.forward_columns(bars, horizons, panel), rules, panel)
    ahead = [*[f"_c{h}" for h in sorted({int(h) for h in horizons if int(h) > 0})], "_top", "_low"]
    sig = candidate_signals(flagged, candidates, ["close", "high", "low", "requested_shares", "buy_refusal", "can_sell", *ahead], panel)
    case = None
    for name, (start, end) in periods.items():
        inside = F.col(panel.order).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        case = F.when(inside, name) if case is None else case.when(inside, name)
    sig = sig.withColumn("period", case).where("period IS NOT NULL")
    keys = ("experiment_id", "period")
    led = tr.ledger(sig, rules, loss=loss, profit=profit, panel=panel.by(*keys))
    # what only trades and refusals need is empty in all other rows, which are nearly all
    asked = F.col("want_buy") | (F.col("trade") != 0)
    sparse = ["want_buy", "buy_refusal", "requested_shares", "held_before", "reason", "exec_price", "fill_shares", "position_cost", "holding_days", "entry_price", *ahead]
    led = led.select(*keys, *panel.keys, panel.order, "trade", "close", "held", "cash_flow", *[F.when(asked, F.col(c)).alias(c) for c in sparse])
    led = through_table(led, "ledger")
    log = tr.trade_log(led, rules, keys)
    value = tr.period_summary(tr.nav(led, initial_capital, keys), log, initial_capital, keys)
    action = F.when(F.col("trade") == 1, "buy").otherwise("sell").alias("action")
    edges = ev.edge_summary(led.where("trade <> 0").select(*keys, action, F.col("close").alias("_close"), *ahead), horizons, keys)
    both = value.join(edges, list(keys), "left")
    figures = [c for c in both.columns if c not in keys]
    both = both.fillna(0, [c for c in figures if c.startswith("signal_")])
    wide = both.groupBy("experiment_id").pivot("period", list(periods)).agg(*[F.first(c).alias(c) for c in figures])
    return wide


def with_parameters(wide: DataFrame, candidates: Sequence[Mapping], columns: Sequence[str]) -> DataFrame:
    """The result rows with the parameters of their candidate."""
    rows = [{"experiment_id": c.get("experiment_id", i), **{k: c.get(k) for k in columns}} for i, c in enumerate(candidates, start=1)]
    used = [k for k in columns if any(r[k] is not None for r in rows)]
    case = {k: F.lit(None) for k in used}
    for k in used:
        values = F.create_map(*[x for r in rows if r[k] is not None for x in (F.lit(r["experiment_id"]), F.lit(r[k]))])
        case[k] = F.try_element_at(values, F.col("experiment_id"))
    return wide.withColumns(case)


def score_candidates(frame: DataFrame, evaluation_mode: str = "combined", horizons: Sequence[int] = (1, 3, 5, 10), primary: int = 5, min_trades: int = 10, min_events: int = 10, max_drawdown: float = 0.2, portfolio_weight: float = 0.5, signal_weight: float = 0.5, group: str = "mode") -> DataFrame:
    """Penalties, scores, pass flags and rank; candidates of one mode are ranked together."""
    horizons = sorted({int(h) for h in horizons if int(h) > 0})
    if primary not in horizons:
        raise ValueError("signal_primary_horizon must be included in signal_horizons")
    c, far = F.col, horizons[-1]
    def mean(pattern: str) -> Column:
        """Mean of the horizons that have a value."""
        xs = [c(pattern.format(h)).cast("double") for h in horizons]
        there = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in xs), F.lit(0))
        return div(sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0)), there)

    df = frame.withColumns(
        {
            "train_valid_sharpe_gap": F.abs(c("train_sharpe_ratio") - c("valid_sharpe_ratio")),
            "train_valid_return_gap": F.abs(c("train_annual_return") - c("valid_annual_return")),
            "valid_signal_edge_mean": mean("valid_signal_mean_edge_{}"),
            "train_signal_edge_mean": mean("train_signal_mean_edge_{}"),
        }
    )
    df = df.withColumns(
        {
            "stability_penalty": c("train_valid_sharpe_gap") + 0.5 * c("train_valid_return_gap"),
            "signal_stability_penalty": F.abs(c("train_signal_edge_mean") - c("valid_signal_edge_mean")),
            "portfolio_validation_pass": (c("valid_sell_trade_count") >= min_trades) & (c("valid_max_drawdown") >= -abs(max_drawdown)),
            "signal_validation_pass": c("valid_signal_event_count") >= min_events,
        }
    )
    df = df.withColumns(
        {
            "portfolio_selection_score": c("valid_sharpe_ratio") + 0.35 * c("valid_calmar_ratio") + 0.10 * c("valid_annual_return") - 0.50 * c("stability_penalty"),
            "signal_selection_score": c(f"valid_signal_mean_edge_{primary}") * 100.0 + mean("valid_signal_hit_rate_{}")
            + 0.50 * c(f"valid_signal_mean_mfe_{far}") * 100.0 + 0.25 * c(f"valid_signal_mean_mae_{far}") * 100.0 - 0.50 * c("signal_stability_penalty") * 100.0,
        }
    )
    passed = {"portfolio": c("portfolio_validation_pass"), "signal": c("signal_validation_pass"),
              "combined": c("portfolio_validation_pass") & c("signal_validation_pass")}
    score = {"portfolio": c("portfolio_selection_score"), "signal": c("signal_selection_score"),
             "combined": portfolio_weight * c("portfolio_selection_score") + signal_weight * c("signal_selection_score")}
    if evaluation_mode not in passed:
        raise ValueError(f"Unsupported evaluation_mode: {evaluation_mode}")
    df = df.withColumns({"validation_pass": passed[evaluation_mode], "selection_score": score[evaluation_mode]})
    order = [F.desc("validation_pass"), F.desc_nulls_last("selection_score")]
    if evaluation_mode != "signal":
        order += [F.desc_nulls_last("valid_sharpe_ratio"), F.desc_nulls_last("valid_annual_return")]
    # as many rows as the grid has candidates
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order, "experiment_id")))


def evaluate_top(bars: DataFrame, candidates: Sequence[Mapping], ranked: DataFrame, top_k: int, period: tuple[str, str], rules: tr.Rules, **kw) -> DataFrame:
    """The best k of a ranking, run again on the test period."""
    # the ranking is a result of its own; the test run has only its first k candidates, so they are named in the plan
    top = through_table(ranked.where(F.col("rank") <= top_k).select("experiment_id", "rank", "selection_score"), "ranking")
    ids = {r["experiment_id"] for r in top.select("experiment_id").collect()}
    chosen = [{**c, "experiment_id": c.get("experiment_id", i)} for i, c in enumerate(candidates, start=1) if c.get("experiment_id", i) in ids]
    return top.join(evaluate_candidates(bars, chosen, {"test": period}, rules, **kw), "experiment_id")


def sharpe_heatmap(ranked: DataFrame, stds: Sequence[float], x: str = "valid_sharpe_ratio") -> DataFrame:
    """Mean validation Sharpe by window and band width."""
    return ranked.groupBy("window").pivot("num_std", list(stds)).agg(F.avg(x)).orderBy("window")
