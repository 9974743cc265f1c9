"""Regime and monitor queries (inventory rows R01-R03, N01-N08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog.base import FUNDA_SQL, W, query, sroll, with_bars
from tapeloom.catalog.events import CATALOG, EV, FULL, META, SOFT, WIN, condition_ctes, meta, windows
from tapeloom.catalog.indicators import KEY, r4, s4
from tapeloom.operators import events as ev
from tapeloom.operators import monitor as mo
from tapeloom.operators import regime as rg

TREND = ("tr0 AS (SELECT *, " + ", ".join(f"{sroll('avg', 'close', n)} AS ma{n}" for n in (5, 20, 60, 120)) + f", {sroll('avg', 'volume', 20)} AS vol_ma20, (close / lag(close) {W} - 1) * 100 AS pct_change FROM bars)",
         "tr1 AS (SELECT *, coalesce(ma5 > ma20 AND ma20 > ma60, FALSE) AS uptrend, coalesce(ma5 < ma20 AND ma20 < ma60, FALSE) AS downtrend, coalesce(close > ma20, FALSE) AS price_above_ma20 FROM tr0)")


@query("r01_trend_columns", with_bars(f"SELECT symbol, date, {s4('ma20', 'ma60', 'ma120', 'vol_ma20', 'pct_change')}, uptrend, downtrend, price_above_ma20 FROM tr1", *TREND))
def _(t):
    return rg.trend_columns(t.bars).select(*KEY, *r4("ma20", "ma60", "ma120", "vol_ma20", "pct_change"), "uptrend", "downtrend", "price_above_ma20")


REGIME = (
    *TREND, "rc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back, count(*) OVER (PARTITION BY symbol) AS n FROM tr1) WHERE back <= 60)",
    """rg0 AS (SELECT symbol, arg_max(close, date) AS c, max(close) FILTER (back = 5) AS c5, arg_max(close, date) / arg_min(close, date) - 1 AS price_trend, avg(volume) / arg_min(volume, date) - 1 AS volume_trend,
  avg(price_above_ma20::INT) AS ratio, arg_max(ma5, date) AS m5, arg_max(ma20, date) AS m20, arg_max(ma60, date) AS m60, arg_max(ma120, date) AS m120, least(any_value(n), 60) AS days FROM rc GROUP BY 1)""",
    """rg1 AS (SELECT *, CASE WHEN m5 > m20 AND m20 > m60 AND m60 > m120 THEN 3 WHEN m5 > m20 AND m20 > m60 THEN 2 WHEN m5 > m20 THEN 1
  WHEN m5 < m20 AND m20 < m60 AND m60 < m120 THEN -3 WHEN m5 < m20 AND m20 < m60 THEN -2 WHEN m5 < m20 THEN -1 ELSE 0 END AS ma_status FROM rg0)""",
    """reg AS (SELECT *, CASE WHEN price_trend > 0.05 AND volume_trend > 0.1 AND ma_status > 1 AND ratio > 0.7 THEN 3 WHEN price_trend > 0 AND volume_trend > 0 AND ma_status > 0 AND ratio > 0.5 THEN 2
  WHEN price_trend > -0.05 AND volume_trend > -0.1 AND ma_status >= -1 AND ratio > 0.3 THEN 1 WHEN price_trend < -0.05 AND volume_trend < -0.1 AND ma_status < -1 AND ratio < 0.3 THEN -3
  WHEN price_trend < 0 AND volume_trend < 0 AND ma_status < 0 AND ratio < 0.5 THEN -2 ELSE -1 END AS market_sentiment,
  CASE WHEN ma_status >= 2 AND price_trend > 0.1 THEN '牛市' WHEN ma_status <= -2 AND price_trend < -0.1 THEN '熊市' ELSE '震荡市' END AS bull_bear,
  CASE WHEN c > c5 THEN '上升' WHEN c < c5 THEN '下降' ELSE '震荡' END AS short_term_trend FROM rg1)""")
REGIME_OUT = "symbol, round(price_trend, 4) AS price_trend, round(volume_trend, 4) AS volume_trend, ma_status, round(ratio, 4) AS price_above_ma_ratio, market_sentiment, bull_bear, short_term_trend"


def regime_cols(df, *more):
    return df.select("symbol", *r4("price_trend", "volume_trend"), "ma_status", *r4("price_above_ma_ratio"), "market_sentiment", "bull_bear", "short_term_trend", *more)


@query("r02_market_regime", with_bars(f"SELECT {REGIME_OUT} FROM reg", *REGIME))
def _(t):
    return regime_cols(rg.market_regime(t.bars))


@query("r03_sector_analysis", store=True, sql=with_bars(
    f"""SELECT {REGIME_OUT}, round(c / (SELECT close FROM rc WHERE rc.symbol = reg.symbol AND back = least(reg.days, mk.days)) - mk.c / (SELECT close FROM rc WHERE rc.symbol = 'Brand#1' AND back = least(reg.days, mk.days)), 4) AS relative_performance
  FROM reg, (SELECT c AS c, days FROM reg WHERE symbol = 'Brand#1') mk""".replace("symbol, round", "reg.symbol, round", 1).replace("SELECT c /", "SELECT reg.c /").replace("round(c / (", "round(reg.c / ("), *REGIME))
def _(t):
    return regime_cols(rg.sector_analysis(t.bars, "Brand#1"), *r4("relative_performance"))


# ---- monitor

SNAPSHOT = "2001-09-10 14:30:00"
MON_SQL = f"""mon AS (SELECT '1430_intraday' AS run_label, '{SNAPSHOT}' AS snapshot_time, symbol, industry AS industry_name, strftime(date, '%Y-%m-%d') AS trade_date, date = DATE '2001-09-10' AS is_today,
  condition AND NOT was AS is_new_signal, coalesce(event_direction, '') AS event_direction, close, close / pc - 1 AS daily_return, volume / nullif(vma, 0) AS volume_ratio, bandwidth, condition_threshold,
  NULL::DOUBLE AS rsrs_score, NULL::DOUBLE AS rsrs_zscore, condition, condition AS breakout_valid, TRUE AS volume_confirmation, TRUE AS trend_long_confirmation FROM (
  SELECT sqz.*, funda.industry, coalesce(lag(condition) OVER x, FALSE) AS was, {sroll('avg', 'volume', 20, 5)} AS vma, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back
  FROM sqz JOIN funda USING (symbol) WINDOW x AS (PARTITION BY symbol ORDER BY date)) WHERE back = 1 AND n >= 120)"""
MON = (*condition_ctes(), FUNDA_SQL, MON_SQL)
NUM = ["daily_return", "volume_ratio", "bandwidth", "condition_threshold"]
MON_OUT = f"SELECT * REPLACE ({s4(*NUM)}) FROM mon"


def universe(t):
    return t.fundamentals.select("symbol", F.col("industry").alias("industry_name"))


def report(t):
    return mo.monitor_rows(t.bars, universe(t), "bollinger_squeeze", SOFT, SNAPSHOT)


def shown(df):
    return df.withColumns({c: F.round(c, 4) for c in NUM})


@query("n01_monitor_rows", with_bars(MON_OUT, *MON))
def _(t):
    return shown(report(t))


@query("n02_sorted_report", with_bars(MON_OUT + " ORDER BY is_today DESC, is_new_signal DESC, condition DESC, daily_return DESC NULLS LAST, volume_ratio DESC NULLS LAST, symbol", *MON))
def _(t):
    return mo.sort_report(shown(report(t)))


def stored_report(t):
    """The report as a file keeps it: other names, everything text, some rows broken."""
    df = report(t).withColumnsRenamed({"symbol": "index_code", "industry_name": "板块名称", "trade_date": "date", "snapshot_time": "run_time", "is_new_signal": "new_signal"})
    df = df.withColumns({c: F.col(c).cast("string") for c in df.columns})
    df = df.withColumn("index_code", F.regexp_extract("index_code", "[0-9]+", 0))
    odd = F.col("index_code").cast("int")
    return df.withColumns({"date": F.when(odd % 7 == 0, "no date").otherwise(F.col("date")), "close": F.when(odd % 5 == 0, "n/a").otherwise(F.col("close")),
                           "板块名称": F.when(odd % 6 == 0, " None ").otherwise(F.col("板块名称"))})


STORED = f"""stored AS (SELECT run_label, CAST(snapshot_time AS TIMESTAMP) AS snapshot_time, lpad(c, 6, '0') AS symbol, CASE WHEN c::INT % 6 = 0 THEN '' ELSE industry_name END AS industry_name,
  CAST(trade_date AS TIMESTAMP) AS trade_date, is_today, is_new_signal, event_direction, CASE WHEN c::INT % 5 = 0 THEN NULL ELSE close END AS close, daily_return, volume_ratio, bandwidth, condition_threshold,
  rsrs_score, rsrs_zscore, condition, breakout_valid, volume_confirmation, trend_long_confirmation FROM (SELECT *, regexp_extract(symbol, '[0-9]+') AS c FROM mon) WHERE c::INT % 7 <> 0)"""


@query("n03_standardized_report", with_bars(f"SELECT * REPLACE ({s4(*NUM)}) FROM stored", *MON, STORED))
def _(t):
    return shown(mo.standardize_report(stored_report(t)))


@query("n04_filtered_report", with_bars(f"SELECT symbol, industry_name, condition, {s4('daily_return')} FROM stored WHERE NOT is_today AND contains(lower(industry_name), 'o')", *MON, STORED))
def _(t):
    df = mo.filter_report(mo.standardize_report(stored_report(t)), keyword="O").where("NOT is_today")
    return df.select("symbol", "industry_name", "condition", *r4("daily_return"))


@query("n05_price_windows", with_bars(
    """SELECT symbol, date, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM
  (SELECT *, max(inside::INT) OVER (PARTITION BY symbol) AS any_ FROM (SELECT bars.*, date <= make_date(1990 + cap_, 6, 30) AS inside FROM bars JOIN
     (SELECT p_brand AS symbol, max(p_size) % 13 AS cap_ FROM part GROUP BY 1) USING (symbol))) WHERE inside OR any_ = 0) WHERE back <= 25"""))
def _(t):
    until = t["part"].groupBy(F.col("p_brand").alias("symbol")).agg(F.make_date(F.lit(1990) + F.max("p_size") % 13, F.lit(6), F.lit(30)).alias("trade_date"))
    return mo.price_windows(t.bars, until, 25).select(*KEY, "close")


STRENGTH = (
    FUNDA_SQL, f"st0 AS (SELECT symbol, date, (close / ({sroll('avg', 'close', 20)}) - 1) * 100 AS strength_pct FROM bars)",
    "st1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM st0 WHERE strength_pct IS NOT NULL) WHERE back <= 30)",
    "st2 AS (SELECT symbol, date, strength_pct, industry AS industry_name, industry || ' (' || symbol || ')' AS row_label, dense_rank() OVER (ORDER BY date DESC) AS date_rank FROM st1 JOIN funda USING (symbol))",
    """st3 AS (SELECT row_label, any_value(symbol) AS symbol, any_value(industry_name) AS industry_name, max(date) AS latest_available_date, max(strength_pct) FILTER (date_rank = 1) AS strength_pct
  FROM st2 GROUP BY 1 HAVING min(date_rank) <= 30)""")


def strength(t):
    return mo.strength_rows(t.bars, universe(t))


@query("n06_strength_heatmap", store=True, sql=with_bars("SELECT row_label, " + ", ".join(f"round(max(strength_pct) FILTER (date_rank = {i}), 4) AS d{i}" for i in range(1, 31)) + " FROM st2 WHERE date_rank <= 30 GROUP BY 1", *STRENGTH))
def _(t):
    return mo.strength_heatmap(strength(t)).select("row_label", *r4(*[f"d{i}" for i in range(1, 31)]))


@query("n06b_strength_ranking", store=True, sql=with_bars("SELECT row_label, symbol, industry_name, latest_available_date, round(strength_pct, 4) AS strength_pct FROM st3", *STRENGTH))
def _(t):
    return mo.strength_ranking(strength(t)).withColumn("strength_pct", F.round("strength_pct", 4))


@query("n07_strength_counts", store=True, sql=with_bars(
    """SELECT count(*) AS labels, count(*) FILTER (strength_pct >= 5) AS strong, count(*) FILTER (strength_pct <= -5) AS weak, round(coalesce(count(*) FILTER (strength_pct >= 5) / nullif(count(strength_pct), 0), 0) * 100, 4) AS strong_ratio
  FROM (SELECT * FROM st3 ORDER BY strength_pct DESC NULLS LAST, latest_available_date DESC, row_label LIMIT 20)""", *STRENGTH))
def _(t):
    return mo.strength_counts(mo.strength_ranking(strength(t)), 20).withColumn("strong_ratio", F.round("strong_ratio", 4))


@query("n08_event_overview", store=True, sql=with_bars(
    f"""SELECT symbol, printf('片段 %d/%d | %s | 窗口 %d ~ %d', i, n, strftime(event_date, '%Y-%m-%d'), min_relative_day, max_relative_day) AS label, CASE WHEN i = 2 THEN '◀ 当前' ELSE '' END AS "当前",
  strftime(event_date, '%Y-%m-%d') AS "事件日", strftime(window_start, '%Y-%m-%d') AS "窗口开始", strftime(window_end, '%Y-%m-%d') AS "窗口结束", bar_count AS "K线数",
  printf('%.4f', bandwidth) AS "带宽", printf('%.4f', condition_threshold) AS "阈值", event_direction AS "方向", breakout_valid AS "突破确认" FROM
  (SELECT c.*, m.* EXCLUDE (symbol, event_date, event_close), row_number() OVER (PARTITION BY c.symbol ORDER BY event_date) AS i, count(*) OVER (PARTITION BY c.symbol) AS n FROM catalog_ c LEFT JOIN ({META}) m USING (symbol, event_date))""",
    *EV, FULL, WIN, CATALOG))
def _(t):
    return mo.event_overview(ev.event_catalog(windows(t), meta(t)), 1).drop("事件日收盘价")


@query("n08b_opportunity_overview", with_bars(
    """SELECT symbol, printf('机会 %d/%d | %s | %s | 09-10 14:30', 1, 1, strftime(trade_date, '%Y-%m-%d'), CASE WHEN is_new_signal THEN '新信号' WHEN condition THEN '条件满足' ELSE '观察' END) AS label, '● 当前' AS "当前",
  strftime(trade_date, '%Y-%m-%d') AS "交易日", '2001-09-10 14:30:00' AS "快照时间", industry_name AS "行业", event_direction AS "方向", condition AS "条件触发", is_new_signal AS "新信号", breakout_valid AS "突破确认",
  volume_confirmation AS "放量确认", trend_long_confirmation AS "趋势确认", printf('%.2f%%', daily_return) AS "日涨跌幅", printf('%.4f', bandwidth) AS "带宽", '-' AS "RSRS分数" FROM stored""", *MON, STORED))
def _(t):
    df = mo.opportunity_overview(mo.standardize_report(stored_report(t)))
    return df.drop("收盘价", "量比", "阈值", "RSRS Z分数")
