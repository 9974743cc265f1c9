"""The daily opportunity monitor: latest state per symbol, reports and their views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.kernels import BARS, Panel, div, flag, lag, roll
from tapeloom.functions.scalars import STRENGTH, format_or_dash, normalize_code, normalize_text, parse_bool, run_label, strength_level
from tapeloom.operators import events as ev
from tapeloom.operators import indicators as ind

# fixed values: report columns in order, their kinds, and other names they may have
REPORT_COLUMNS = [
    "run_label", "snapshot_time", "symbol", "industry_name", "trade_date", "is_today", "is_new_signal", "event_direction", "close",
    "daily_return", "volume_ratio", "bandwidth", "condition_threshold", "rsrs_score", "rsrs_zscore", "condition", "breakout_valid",
    "volume_confirmation", "trend_long_confirmation",
]
REPORT_NUMBERS = ["close", "daily_return", "volume_ratio", "bandwidth", "condition_threshold", "rsrs_score", "rsrs_zscore"]
REPORT_FLAGS = ["is_today", "is_new_signal", "condition", "breakout_valid", "volume_confirmation", "trend_long_confirmation"]
REPORT_ALIASES = {
    "symbol": ["symbol", "index_code", "code"],
    "industry_name": ["industry_name", "industry", "name", "板块名称", "行业名称"],
    "trade_date": ["trade_date", "date", "日期"],
    "snapshot_time": ["snapshot_time", "snapshot", "run_time"],
    "run_label": ["run_label"],
    "is_today": ["is_today"],
    "is_new_signal": ["is_new_signal", "new_signal"],
    "event_direction": ["event_direction", "direction"],
}


def monitor_rows(bars: DataFrame, universe: DataFrame, condition: str, params: Mapping, snapshot: str, label: str | None = None, min_rows: int = 120, panel: Panel = BARS) -> DataFrame:
    """The last bar of every symbol of the universe with enough history, and whether its signal is new."""
    o = panel.order
    df = ev.condition_frame(bars.join(universe, list(panel.keys)), condition, params, panel)
    df = df.withColumns(
        {
            "_back": F.row_number().over(panel.desc),
            "_n": F.count(F.lit(1)).over(panel.whole),
            "_was": flag(lag("condition", panel=panel)),
            "daily_return": ind.pct_change(panel=panel),
            "volume_ratio": div("volume", roll(F.avg, "volume", 20, 5, panel)),
        }
    ).where((F.col("_back") == 1) & (F.col("_n") >= min_rows))
    for c in REPORT_NUMBERS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    moment = F.to_timestamp(F.lit(snapshot))
    df = df.withColumns(
        {
            "run_label": F.lit(label) if label else run_label(moment),
            "snapshot_time": F.lit(snapshot),
            "trade_date": F.date_format(o, "yyyy-MM-dd"),
            "is_today": F.to_date(F.col(o)) == F.to_date(moment),
            "is_new_signal": flag(F.col("condition")) & ~F.col("_was"),
            "event_direction": normalize_text("event_direction"),
            **{c: flag(F.col(c)) for c in REPORT_FLAGS if c not in ("is_today", "is_new_signal")},
        }
    )
    return df.select(*REPORT_COLUMNS)


def sort_report(report: DataFrame) -> DataFrame:
    order = ["is_today", "is_new_signal", "condition", "daily_return", "volume_ratio"]
    return report.select(*[c for c in REPORT_COLUMNS if c in report.columns]).orderBy(*[F.desc_nulls_last(c) for c in order], "symbol")


def standardize_report(raw: DataFrame) -> DataFrame:
    """A stored report under standard names and types; rows without symbol or date go."""
    from tapeloom.sources.ingest import pick_column, to_number

    df = raw.withColumnsRenamed({c: c.strip() for c in raw.columns if c != c.strip()})
    for target, names in REPORT_ALIASES.items():
        source = pick_column(df.columns, names)
        if source is not None and source != target:
            df = df.withColumnRenamed(source, target)
    if "symbol" not in df.columns:
        raise ValueError("the report has no symbol or index_code column.")
    have = set(df.columns)
    null = F.lit(None)
    cols = {"symbol": normalize_code("symbol"), "industry_name": normalize_text("industry_name") if "industry_name" in have else F.lit("")}
    for c in ("trade_date", "snapshot_time"):
        cols[c] = F.try_to_timestamp(F.col(c).cast("string")) if c in have else null.cast("timestamp")
    for c in REPORT_NUMBERS:
        cols[c] = to_number(c) if c in have else null.cast("double")
    for c in REPORT_FLAGS:
        cols[c] = parse_bool(c) if c in have else F.lit(False)
    for c in REPORT_COLUMNS:
        if c not in cols:
            cols[c] = F.col(c) if c in have else null.cast("string")
    df = df.select(*[cols[c].alias(c) for c in REPORT_COLUMNS]).where("symbol <> '' AND trade_date IS NOT NULL")
    order = ["is_today", "is_new_signal", "condition", "trade_date", "daily_return", "volume_ratio"]
    return df.orderBy(*[F.desc_nulls_last(c) for c in order], "symbol")


def filter_report(report: DataFrame, today: bool = False, new: bool = False, condition: bool = False, keyword: str = "") -> DataFrame:
    for on, c in ((today, "is_today"), (new, "is_new_signal"), (condition, "condition")):
        if on and c in report.columns:
            report = report.where(F.col(c))
    if keyword:
        report = report.where(F.lower(F.coalesce("industry_name", F.lit(""))).contains(keyword.lower()))
    return report


def price_windows(bars: DataFrame, until: DataFrame, k: int = 20, panel: Panel = BARS) -> DataFrame:
    """The last k bars (20 at least) up to each symbol's date; all bars count where none is that old."""
    k = max(k, 20)
    df = bars.join(until.withColumnRenamed("trade_date", "_until"), list(panel.keys))
    inside = F.coalesce(F.col(panel.order) <= F.col("_until"), F.lit(True))
    df = df.withColumn("_in", inside).withColumn("_any", F.max("_in").over(panel.whole))
    df = df.where(F.col("_in") | ~F.col("_any"))
    return df.withColumn("_back", F.row_number().over(panel.desc)).where(F.col("_back") <= k).drop("_until", "_in", "_any", "_back")


def strength_rows(bars: DataFrame, names: DataFrame, days: int = 30, window: int = 20, panel: Panel = BARS) -> DataFrame:
    """The last rows of MA strength per symbol with the rank of their date among the recent dates (1 is newest)."""
    df = ind.ma_strength(bars, window, panel=panel).where("strength_pct IS NOT NULL").withColumn("_back", F.row_number().over(panel.desc))
    df = df.where(F.col("_back") <= days).select(*panel.keys, panel.order, "strength_pct").join(names, list(panel.keys), "left")
    name = F.coalesce("industry_name", F.lit(""))
    df = df.withColumn("row_label", F.when(name == "", F.col("symbol")).otherwise(F.concat(name, F.lit(" ("), "symbol", F.lit(")"))))
    # distinct dates only: at most ``days`` per symbol
    dates = df.select(panel.order).distinct().withColumn("_all", F.lit(1))
    ranks = dates.withColumn("date_rank", F.row_number().over(Window.partitionBy("_all").orderBy(F.desc(panel.order)))).drop("_all")
    return df.join(ranks, panel.order)


def strength_heatmap(rows: DataFrame, days: int = 30) -> DataFrame:
    """One row per label, one column per recent date, newest first (d1, d2, ...); empty rows are left out."""
    recent = rows.where(F.col("date_rank") <= days)
    wide = recent.groupBy("row_label").pivot("date_rank", list(range(1, days + 1))).agg(F.max("strength_pct"))
    return wide.select("row_label", *[F.col(str(i)).alias(f"d{i}") for i in range(1, days + 1)])


def strength_ranking(rows: DataFrame, days: int = 30) -> DataFrame:
    """The labels of the heat map by strength on the newest date, with the last date each has."""
    out = rows.groupBy("row_label", "symbol", "industry_name").agg(
        F.max("date").alias("latest_available_date"),
        F.max(F.when(F.col("date_rank") == 1, F.col("strength_pct"))).alias("strength_pct"), F.min("date_rank").alias("_best"),
    )
    out = out.where(F.col("_best") <= days).drop("_best")
    return out.orderBy(F.desc_nulls_last("strength_pct"), F.desc("latest_available_date"), "row_label")


def strength_counts(ranking: DataFrame, rows: int | None = None, strong: float = 5.0) -> DataFrame:
    """Number of labels, strong and weak ones, and the share of strong ones in percent, of the top rows."""
    view = ranking if rows is None else ranking.limit(rows)
    view = view.withColumn("level", strength_level("strength_pct", strong))
    n_strong, valid = F.count_if(F.col("level") == STRENGTH["strong"]), F.count("strength_pct")
    return view.agg(
        F.count(F.lit(1)).alias("labels"), n_strong.alias("strong"), F.count_if(F.col("level") == STRENGTH["weak"]).alias("weak"),
        F.coalesce(div(n_strong, valid) * 100, F.lit(0.0)).alias("strong_ratio"),
    )


# ---- overview tables ----------------------------------------------------------------------------

# fixed values: display names
EVENT_NAMES = {
    "event_date": "事件日", "window_start": "窗口开始", "window_end": "窗口结束", "bar_count": "K线数", "event_close": "事件日收盘价",
    "bandwidth": "带宽", "condition_threshold": "阈值", "event_direction": "方向", "breakout_valid": "突破确认", "volume_confirmation": "放量确认",
}
REPORT_NAMES = {
    "trade_date": "交易日", "snapshot_time": "快照时间", "industry_name": "行业", "event_direction": "方向", "close": "收盘价",
    "daily_return": "日涨跌幅", "volume_ratio": "量比", "condition": "条件触发", "is_new_signal": "新信号", "breakout_valid": "突破确认",
    "volume_confirmation": "放量确认", "trend_long_confirmation": "趋势确认", "bandwidth": "带宽", "condition_threshold": "阈值",
    "rsrs_score": "RSRS分数", "rsrs_zscore": "RSRS Z分数",
}
CURRENT, NEW_SIGNAL, CONDITION_MET, WATCHING = "当前", "新信号", "条件满足", "观察"


def _numbered(df: DataFrame, order: Sequence[Column], current: int, mark: str) -> DataFrame:
    w = Window.partitionBy("symbol")
    df = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)), "_of": F.count(F.lit(1)).over(w)})
    return df.withColumn(CURRENT, F.when(F.col("_i") == current + 1, f"{mark} {CURRENT}").otherwise(""))


def event_overview(catalog: DataFrame, current: int = 0) -> DataFrame:
    """A symbol's events for display: position mark, label, dates and numbers as text."""
    df = _numbered(catalog, [F.col("event_date")], current, "◀")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    label = F.format_string("片段 %d/%d | %s | 窗口 %d ~ %d", "_i", "_of", day("event_date"), "min_relative_day", "max_relative_day")
    text = {c: day(c) for c in ("event_date", "window_start", "window_end")}
    for c in ("event_close", "bandwidth", "condition_threshold"):
        if c in df.columns:
            text[c] = format_or_dash(c, 4)
    have = [c for c in EVENT_NAMES if c in df.columns]
    return df.withColumn("label", label).select("symbol", "label", CURRENT, *[text.get(c, F.col(c)).alias(EVENT_NAMES[c]) for c in have])


def opportunity_overview(report: DataFrame, current: int = 0) -> DataFrame:
    """A symbol's report rows for display: label with the signal state, numbers as text."""
    df = _numbered(report, [F.desc("trade_date"), F.desc("snapshot_time")], current, "●")
    state = F.when(F.col("is_new_signal"), NEW_SIGNAL).when(F.col("condition"), CONDITION_MET).otherwise(WATCHING)
    day, moment = F.date_format("trade_date", "yyyy-MM-dd"), F.col("snapshot_time")
    label = F.format_string(
        "机会 %d/%d | %s | %s | %s", "_i", "_of", F.coalesce(day, F.lit("-")), state, F.coalesce(F.date_format(moment, "MM-dd HH:mm"), F.lit("-")))
    text = {"trade_date": day, "snapshot_time": F.date_format(moment, "yyyy-MM-dd HH:mm:ss"), "daily_return": format_or_dash("daily_return", 2, "%")}
    text |= {c: format_or_dash(c, 4) for c in REPORT_NUMBERS if c != "daily_return"}
    have = [c for c in REPORT_NAMES if c in df.columns]
    return df.withColumn("label", label).select("symbol", "label", CURRENT, *[text.get(c, F.col(c)).alias(REPORT_NAMES[c]) for c in have])
