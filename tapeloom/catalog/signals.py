"""Timing-signal queries (inventory rows T01-T28) and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog.base import PART, SOFAR, W, machine_cte, ema_cte, query, sroll, with_bars
from tapeloom.catalog.indicators import KEY, MACD_CTES, MFI_CTES, OBV, rsi_ctes, rsrs_ctes, supertrend_ctes
from tapeloom.operators import signals as sig

OUT = "SELECT symbol, date, signal FROM "


def pick(df):
    return df.select(*KEY, "signal")


def L(x, n=1):
    return f"lag({x}, {n}) {W}"


def latch_cte(name, src, event, out="signal"):
    return f"{name} AS (SELECT * EXCLUDE (ev), coalesce(last_value(ev IGNORE NULLS) {SOFAR}, 0) AS {out} FROM (SELECT *, {event} AS ev FROM {src}))"


# ---- moving averages

MA = (f"mas AS (SELECT *, {sroll('avg', 'close', 5)} AS s, {sroll('avg', 'close', 20)} AS l FROM bars)",
      f"ma2 AS (SELECT *, coalesce(s > l AND {L('s')} <= {L('l')}, FALSE) AS golden, coalesce(s < l AND {L('s')} >= {L('l')}, FALSE) AS death FROM mas)")
T01 = MA + (latch_cte("t01", "ma2", "CASE WHEN golden THEN 1 WHEN death THEN -1 END"),)


@query("q00_days_in_market", with_bars(
    "SELECT symbol, count(*) FILTER (signal = 1) AS long_days, count(*) FILTER (signal = -1) AS short_days, count(*) FILTER (signal = 0) AS flat_days FROM t01 GROUP BY 1", *T01))
def _(t):
    return sig.days_in_market(sig.ma_cross(t.bars))


@query("t01_ma_cross", with_bars(OUT + "t01", *T01))
def _(t):
    return pick(sig.ma_cross(t.bars))


T02 = MA + (f"ma3 AS (SELECT *, {sroll('avg', 'close', 60)} AS f FROM ma2)",
            machine_cte("t02", "ma3", "golden AND close > f", "death AND close < f", "death", "golden", "f IS NOT NULL"))


@query("t02_ma_cross_filtered", with_bars(OUT + "t02", *T02))
def _(t):
    return pick(sig.ma_cross_filtered(t.bars))


# ---- RSI

RSI = rsi_ctes()
T03 = RSI + (machine_cte("t03", "rsi", "rsi < 30", "rsi > 70", "rsi > 50", "rsi < 50", "rsi IS NOT NULL"),)


@query("t03_rsi_level", with_bars(OUT + "t03", *T03))
def _(t):
    return pick(sig.rsi_level(t.bars))


@query("t04_rsi_cross", with_bars(OUT + "t04", *RSI, f"rp AS (SELECT *, {L('rsi')} AS p FROM rsi)", machine_cte(
    "t04", "rp", "rsi > 30 AND p <= 30", "rsi < 70 AND p >= 70", "rsi < 50 AND p >= 50", "rsi > 50 AND p <= 50",
    "rsi IS NOT NULL AND p IS NOT NULL")))
def _(t):
    return pick(sig.rsi_cross(t.bars))


def _div(fn, x, a, b):
    return f"{fn}({x}) OVER ({PART} ROWS BETWEEN {a} PRECEDING AND {b} PRECEDING)"


@query("t05_rsi_divergence", with_bars(
    OUT + "t05", *RSI,
    "rd AS (SELECT *, row_number() " + W + " AS rn, " + ", ".join(
        f"{_div(fn, x, *ab)} AS {fn}{n}{x}" for fn in ("min", "max") for x in ("close", "rsi") for n, ab in (("n", (5, 0)), ("w", (10, 5)))) + " FROM rsi)",
    machine_cte("t05", "rd", "minnclose < minwclose AND minnrsi > minwrsi", "maxnclose > maxwclose AND maxnrsi < maxwrsi",
                "rsi > 70", "rsi < 30", "rsi IS NOT NULL AND rn > 10 AND minwrsi IS NOT NULL")))
def _(t):
    return pick(sig.rsi_divergence(t.bars))


# ---- MACD


def macd_latch(name, a, b):
    pa, pb = L(a), L(b) if b != "0" else "0"
    return latch_cte(name, "macd_t", f"CASE WHEN {a} > {b} AND {pa} <= {pb} THEN 1 WHEN {a} < {b} AND {pa} >= {pb} THEN -1 END")


@query("t06_macd_cross", with_bars(OUT + "t06", *MACD_CTES, macd_latch("t06", "macd", "macd_signal")))
def _(t):
    return pick(sig.macd_cross(t.bars))


@query("t07_macd_histogram", with_bars(OUT + "t07", *MACD_CTES, macd_latch("t07", "macd_hist", "0")))
def _(t):
    return pick(sig.macd_histogram(t.bars))


@query("t08_macd_zero_axis", with_bars(OUT + "t08", *MACD_CTES, macd_latch("t08", "macd", "0")))
def _(t):
    return pick(sig.macd_zero_axis(t.bars))


@query("t09_macd_combined", with_bars(OUT + "t09", *MACD_CTES, macd_latch("t09", "macd", "macd_signal")))
def _(t):
    return pick(sig.macd_combined(t.bars))


# ---- Bollinger


def bb_ctes(n=20, k=2.0, src="bars", name="bb"):
    """Bands of a mean and its deviation with last row's bands and price; every later rule reads these."""
    return (f"{name}_a AS (SELECT *, {sroll('avg', 'close', n)} AS mid, {sroll('stddev_samp', 'close', n)} AS sd FROM {src})",
            f"{name}_b AS (SELECT *, mid + {k}::DOUBLE * sd AS up, mid - {k}::DOUBLE * sd AS lo FROM {name}_a)",
            f"{name} AS (SELECT *, {L('close')} AS pc, {L('up')} AS pup, {L('mid')} AS pmid, {L('lo')} AS plo FROM {name}_b)")


def gate_ctes(src, name, trend=None, volume=None):
    """Gates by the same rule as the filters: (window, slope) for trend, (window, times) for volume."""
    tw, ts = trend or (60, 3)
    vw, vm = volume or (20, 1.2)
    tl = f"coalesce(close > tma AND tma > {L('tma', ts)}, FALSE)" if trend else "TRUE"
    tsh = f"coalesce(close < tma AND tma < {L('tma', ts)}, FALSE)" if trend else "TRUE"
    vo = f"coalesce(volume > vma * {vm}::DOUBLE AND volume > {L('volume')}, FALSE)" if volume else "TRUE"
    return (f"{name}_g AS (SELECT *, {sroll('avg', 'close', tw)} AS tma, {sroll('avg', 'volume', vw)} AS vma FROM {src})",
            f"{name} AS (SELECT *, {tl} AS okl, {tsh} AS oks, {vo} AS okv FROM {name}_g)")


MID_DOWN, MID_UP = "close < mid AND pc >= pmid", "close > mid AND pc <= pmid"
BRK_UP, BRK_DOWN = "close > up AND pc <= pup", "close < lo AND pc >= plo"
READY = "up IS NOT NULL AND lo IS NOT NULL"
T10 = (*bb_ctes(), *gate_ctes("bb", "bg", (60, 3), (20, 1.2)),
       machine_cte("t10", "bg", f"{BRK_UP} AND okl AND okv", f"{BRK_DOWN} AND oks AND okv", MID_DOWN, MID_UP, READY))
T10_PLAIN = (*bb_ctes(), machine_cte("t10", "bb", BRK_UP, BRK_DOWN, MID_DOWN, MID_UP, READY))


@query("t10_bollinger_breakout", with_bars(OUT + "t10", *T10))
def _(t):
    return pick(sig.bollinger_breakout(t.bars, use_trend_filter=True, use_volume_filter=True))


@query("t10b_bollinger_breakout_plain", with_bars(OUT + "t10", *T10_PLAIN))
def _(t):
    return pick(sig.bollinger_breakout(t.bars))


@query("t11_bollinger_reversion", with_bars(OUT + "t11", *bb_ctes(), machine_cte(
    "t11", "bb", "pc <= plo AND close > lo", "pc >= pup AND close < up", MID_UP, MID_DOWN, READY)))
def _(t):
    return pick(sig.bollinger_reversion(t.bars))


def squeeze_ctes(quantile=0.2, lookback=60, need=20, name="sq"):
    return (*bb_ctes(), "sqa AS (SELECT *, (up - lo) / nullif(mid, 0) AS bw FROM bb)",
            f"sqb AS (SELECT *, {sroll(f'quantile_cont({{}}, {quantile})', 'bw', lookback, need)} AS thr FROM sqa)",
            f"{name} AS (SELECT *, coalesce(bw <= thr, FALSE) AS sqz, {READY} AND thr IS NOT NULL AS ready FROM sqb)")


BEFORE = f"OVER ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
WAS = f"sw AS (SELECT *, coalesce(last_value(CASE WHEN ready THEN sqz END IGNORE NULLS) {BEFORE}, FALSE) AND NOT sqz AS first_out FROM sq)"


@query("t12_bollinger_squeeze", with_bars(OUT + "t12", *squeeze_ctes(), WAS, machine_cte(
    "t12", "sw", f"first_out AND {BRK_UP}", f"first_out AND {BRK_DOWN}", MID_DOWN, MID_UP, "ready")))
def _(t):
    return pick(sig.bollinger_squeeze(t.bars, squeeze_threshold=None, squeeze_quantile=0.2))


@query("t12b_squeeze_supertrend", with_bars(
    OUT + "t12", *supertrend_ctes(), *[c.replace("FROM bars)", "FROM stt)") for c in squeeze_ctes()], WAS, machine_cte(
        "t12", "sw", f"first_out AND {BRK_UP} AND st_direction > 0", f"first_out AND {BRK_DOWN} AND st_direction < 0", MID_DOWN, MID_UP, "ready")))
def _(t):
    return pick(sig.bollinger_squeeze(t.bars, squeeze_threshold=None, squeeze_quantile=0.2, use_supertrend_filter=True))


def run_cte(src, name, confirm):
    """Length of the run of closes outside a band, over valid rows only."""
    return (f"{name}_q AS (SELECT *, sum(CASE WHEN {READY} THEN 1 ELSE 0 END) {SOFAR} AS sq_, "
            f"CASE WHEN {READY} AND NOT coalesce(close > up, FALSE) THEN 1 END AS bu, CASE WHEN {READY} AND NOT coalesce(close < lo, FALSE) THEN 1 END AS bl FROM {src})",
            f"{name} AS (SELECT *, sq_ - coalesce(max(CASE WHEN bu = 1 THEN sq_ END) {SOFAR}, 0) >= {confirm} AS ru, "
            f"sq_ - coalesce(max(CASE WHEN bl = 1 THEN sq_ END) {SOFAR}, 0) >= {confirm} AS rl FROM {name}_q)")


@query("t13_bollinger_double", with_bars(OUT + "t13", *bb_ctes(20, 1.8), *run_cte("bb", "br", 2), machine_cte(
    "t13", "br", "ru", "rl", MID_DOWN, MID_UP, READY)))
def _(t):
    return pick(sig.bollinger_double(t.bars, num_std=1.8))


# ---- RSRS

RSRS = rsrs_ctes(need=12)


def rsrs_machine(name, entry, leave, up=True, down=True):
    """The three-state rule as a fold: hold on a missing score, else by state."""
    e, x, s, z = f"{entry}::DOUBLE", f"{leave}::DOUBLE", "acc[len(acc)].s", "v[1].z"
    u, d = (f"{z} >= {e}" if up else "FALSE"), (f"{z} <= -{e}" if down else "FALSE")
    return f"""{name}_l AS (SELECT symbol, list(date ORDER BY date) AS ds, list_reduce(
    list_prepend([{{'z': NULL::DOUBLE, 's': 0}}], list_transform(list(rsrs_score ORDER BY date), lambda v: [{{'z': v, 's': 0}}])),
    lambda acc, v: list_append(acc, {{'z': {z}, 's': CASE WHEN {z} IS NULL THEN {s}
      WHEN {s} = 0 THEN CASE WHEN {u} THEN 1 WHEN {d} THEN -1 ELSE 0 END
      WHEN {s} = 1 THEN CASE WHEN {z} <= {x} THEN 0 WHEN {d} THEN -1 ELSE 1 END
      ELSE CASE WHEN {z} >= -{x} THEN 0 WHEN {u} THEN 1 ELSE -1 END END}}))[2:] AS vs FROM rsrs_t GROUP BY symbol),
{name} AS (SELECT symbol, unnest(ds) AS date, unnest(vs).s AS signal FROM {name}_l)"""


@query("t14_rsrs_breakout", with_bars(OUT + "t14", *RSRS, rsrs_machine("t14", 0.7, 0.0)))
def _(t):
    return pick(sig.rsrs_breakout(t.bars))


@query("t14b_rsrs_breakout_up", with_bars(OUT + "t14", *RSRS, rsrs_machine("t14", 0.7, 0.0, down=False)))
def _(t):
    return pick(sig.rsrs_breakout(t.bars, breakout_direction="up"))


# ---- volume

VZ = f"vz AS (SELECT *, (volume - ({sroll('avg', 'volume', 20)})) / nullif({sroll('stddev_samp', 'volume', 20)}, 0) AS z FROM bars)"
EMA50 = "(2.0::DOUBLE/51)"


@query("t15_volume_breakout", with_bars(
    "SELECT symbol, date, CASE WHEN z > 2 AND close < e THEN -1 WHEN z > 2 AND close > e THEN 1 ELSE 0 END AS signal FROM ve",
    VZ, ema_cte("ve", "vz", "close", EMA50, "e")))
def _(t):
    return pick(sig.volume_breakout(t.bars))


@query("t16_obv_trend", with_bars(
    f"SELECT symbol, date, CASE WHEN sl > 0 AND ab THEN 1 WHEN sl < 0 AND NOT ab THEN -1 ELSE 0 END AS signal FROM "
    f"(SELECT *, obv - {L('obv')} AS sl, coalesce(close > ({sroll('avg', 'close', 20)}), FALSE) AS ab FROM obvt)", OBV))
def _(t):
    return pick(sig.obv_trend(t.bars))


@query("t17_mfi_cross", with_bars(
    "SELECT symbol, date, CASE WHEN p > 80 AND mfi < 80 AND close < e THEN -1 WHEN p < 20 AND mfi > 20 AND close > e THEN 1 ELSE 0 END AS signal "
    f"FROM (SELECT *, {L('mfi')} AS p FROM me)", *MFI_CTES, ema_cte("me", "mfit", "close", EMA50, "e")))
def _(t):
    return pick(sig.mfi_cross(t.bars))


@query("t18_volume_divergence", with_bars(
    f"SELECT symbol, date, CASE WHEN close >= ph AND volume < {L('vh')} THEN -1 WHEN close <= pl AND volume > {L('vl')} THEN 1 ELSE 0 END AS signal FROM "
    f"(SELECT *, {sroll('max', 'close', 20)} AS ph, {sroll('min', 'close', 20)} AS pl, {sroll('max', 'volume', 20)} AS vh, {sroll('min', 'volume', 20)} AS vl FROM bars)"))
def _(t):
    return pick(sig.volume_divergence(t.bars))


# ---- gates, filters, combination


@query("t19_trend_gates", with_bars("SELECT symbol, date, okl AS allow_long, oks AS allow_short FROM g", *gate_ctes("bars", "g", (60, 3))))
def _(t):
    return sig.trend_gates(t.bars).select(*KEY, "allow_long", "allow_short")


@query("t20_volume_gate", with_bars("SELECT symbol, date, okv AS volume_ok FROM g", *gate_ctes("bars", "g", None, (20, 1.2))))
def _(t):
    return sig.volume_gate(t.bars).select(*KEY, "volume_ok")


T21 = (*T01, *gate_ctes("t01", "g", (60, 3), (20, 1.2)),
       "ge AS (SELECT * EXCLUDE (signal), CASE WHEN signal = 0 THEN 0 WHEN signal > 0 AND okl AND okv THEN 1 WHEN signal < 0 AND oks AND okv THEN -1 END AS ev2 FROM g)",
       latch_cte("t21", "ge", "ev2"))


@query("t21_common_filters", with_bars(OUT + "t21", *T21))
def _(t):
    return pick(sig.common_filters(sig.ma_cross(t.bars), use_trend_filter=True, use_volume_filter=True))


@query("t22_signal_delay", with_bars(f"SELECT symbol, date, coalesce({L('signal', 2)}, 0) AS signal FROM t01", *T01))
def _(t):
    return pick(sig.delay(sig.ma_cross(t.bars), 2))


# three signals side by side: MA cross, RSI level, MACD cross
THREE = (*T01, *T03, *MACD_CTES, macd_latch("t06", "macd", "macd_signal"),
         "three AS (SELECT a.symbol, a.date, a.signal AS s1, b.signal AS s2, c.signal AS s3 FROM t01 a JOIN t03 b USING (symbol, date) JOIN t06 c USING (symbol, date))")


def three(t):
    df = sig.ma_cross(t.bars, out="s1")
    return sig.macd_cross(sig.rsi_level(df, out="s2"), out="s3")


@query("t23_weighted_sum", with_bars(
    "SELECT symbol, date, round((s1 + s2 + s3) / 3.0::DOUBLE, 4) AS equal, round(s1 * 0.5::DOUBLE + s2 * 0.3::DOUBLE + s3 * 0.2::DOUBLE, 4) AS weighted FROM three", *THREE))
def _(t):
    names = ["s1", "s2", "s3"]
    return three(t).select(
        *KEY, F.round(sig.weighted_sum(names), 4).alias("equal"), F.round(sig.weighted_sum(names, [0.5, 0.3, 0.2]), 4).alias("weighted"))


@query("t24_combination_modes", with_bars("""SELECT symbol, date,
  CASE WHEN w >= 0.45 THEN 1 WHEN w <= -0.45 THEN -1 ELSE 0 END AS weighted,
  sign(s1 + s2 + s3)::INT AS voting,
  CASE WHEN s1 = 1 AND s2 = 1 AND s3 = 1 THEN 1 WHEN s1 = -1 AND s2 = -1 AND s3 = -1 THEN -1 ELSE 0 END AS unanimous,
  CASE WHEN w >= 2.5 THEN 1 WHEN w <= -2.5 THEN -1 ELSE 0 END AS unanimous_source
  FROM (SELECT *, s1 * 0.5::DOUBLE + s2 * 0.3::DOUBLE + s3 * 0.2::DOUBLE AS w FROM three)""", *THREE))
def _(t):
    names, w = ["s1", "s2", "s3"], [0.5, 0.3, 0.2]
    df = sig.combine(three(t), names, "weighted", w, 0.45, out="weighted")
    df = sig.combine(sig.combine(df, names, "voting", out="voting"), names, "unanimous", out="unanimous")
    df = sig.combine(df, names, "unanimous", w, source_rule=True, out="unanimous_source")
    return df.select(*KEY, "weighted", "voting", "unanimous", "unanimous_source")


@query("t25_min_history", with_bars("SELECT symbol, date, CASE WHEN count(*) OVER (PARTITION BY symbol) >= 1540 THEN signal END AS signal FROM t01", *T01))
def _(t):
    return pick(sig.min_history(sig.ma_cross(t.bars), 1540))


@query("t27_markers", with_bars(
    "SELECT symbol, date, CASE WHEN signal = 1 THEN 1 ELSE 0 END AS buy_signal, CASE WHEN signal = -1 THEN 1 ELSE 0 END AS sell_signal FROM t01", *T01))
def _(t):
    return sig.markers(sig.ma_cross(t.bars)).select(*KEY, "buy_signal", "sell_signal")


@query("t28_sleeve_signals", with_bars(
    f"""SELECT symbol, date, sqz AS squeeze, coalesce({L('sqz')}, FALSE) AND coalesce(close > up AND mf > ms, FALSE) AND okv AS bb_long,
  coalesce({L('sqz')}, FALSE) AND coalesce(close < lo AND mf < ms, FALSE) AND okv AS bb_short,
  coalesce(rsi < 30 AND close < lo, FALSE) AS rsi_long, coalesce(rsi > 70 AND close > up, FALSE) AS rsi_short,
  CASE WHEN coalesce(abs(mf - ms) / close > 0.02, FALSE) THEN 0.8::DOUBLE ELSE 0.3::DOUBLE END AS bb_weight,
  CASE WHEN coalesce(abs(mf - ms) / close > 0.02, FALSE) THEN 0.2::DOUBLE ELSE 0.7::DOUBLE END AS rsi_weight
  FROM (SELECT *, coalesce(bw < quantile_cont(bw, 0.2) OVER (PARTITION BY symbol), FALSE) AS sqz, coalesce(volume > vma, FALSE) AS okv FROM slv)""",
    *rsi_ctes(smooth=False), *bb_ctes(20, 2.0, "rsi"),
    f"slv AS (SELECT *, (up - lo) / mid AS bw, {sroll('avg', 'close', 50)} AS mf, {sroll('avg', 'close', 200)} AS ms, {sroll('avg', 'volume', 20)} AS vma FROM bb)"))
def _(t):
    df = sig.sleeve_signals(t.bars, volume_filter=True)
    return df.select(*KEY, "squeeze", "bb_long", "bb_short", "rsi_long", "rsi_short", "bb_weight", "rsi_weight")


@query("a04_signal_counts", with_bars(
    "SELECT signal, count(*) AS rows FROM (SELECT CASE WHEN count(*) OVER (PARTITION BY symbol) >= 1540 THEN signal END AS signal FROM t01) GROUP BY 1", *T01))
def _(t):
    return sig.signal_counts(sig.min_history(sig.ma_cross(t.bars), 1540))


