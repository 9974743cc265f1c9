"""Indicator queries (inventory rows I01-I34)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog.base import PART, SOFAR, R, W, ema_cte, query, sroll, with_bars
from tapeloom.functions.kernels import BARS
from tapeloom.operators import indicators as ind

KEY = ["symbol", "date"]


def r4(*cols, digits=4):
    return [F.round(c, digits).alias(c) for c in cols]


def s4(*cols, digits=4):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


TP = "((high + low + close) / 3)"
LAGC = f"lag(close) {W}"
TR = f"greatest(high - low, abs(high - {LAGC}), abs(low - {LAGC}))"


@query("i01_sma", with_bars(f"SELECT symbol, date, round({sroll('avg', 'close', 20)}, 4) AS sma_20 FROM bars"))
def _(t):
    return ind.sma(t.bars, n=20).select(*KEY, *r4("sma_20"))


@query("i02_ema", with_bars(f"SELECT symbol, date, {s4('ema_12', 'ema_60')} FROM e2",
                            ema_cte("e1", "bars", "close", "(2.0::DOUBLE/13)", "ema_12"),
                            ema_cte("e2", "e1", "close", "(2.0::DOUBLE/61)", "ema_60")))
def _(t):
    return ind.ema(ind.ema(t.bars, n=12), n=60).select(*KEY, *r4("ema_12", "ema_60"))


@query("i03_wma", with_bars(
    "SELECT symbol, date, round((" + " + ".join(f"{10 - i} * lag(close, {i}) {W}" for i in range(10)) + ") / 55, 4) AS wma_10 FROM bars"))
def _(t):
    return ind.wma(t.bars, n=10).select(*KEY, *r4("wma_10"))


BANDS = f"bands AS (SELECT *, {sroll('avg', 'close', 20)} AS middle, {sroll('stddev_samp', 'close', 20)} AS sd FROM bars)"


@query("i04_bollinger_bands", with_bars(
    "SELECT symbol, date, round(middle + 2 * sd, 4) AS upper, round(middle, 4) AS middle, round(middle - 2 * sd, 4) AS lower FROM bands", BANDS))
def _(t):
    return ind.bollinger(t.bars).select(*KEY, *r4("upper", "middle", "lower"))


@query("i05_bollinger_bandwidth", with_bars("SELECT symbol, date, round(4 * sd / nullif(middle, 0), 4) AS bandwidth FROM bands", BANDS))
def _(t):
    return ind.bandwidth(t.bars).select(*KEY, *r4("bandwidth"))


def rsi_ctes(n=14, src="bars", name="rsi", smooth=True):
    """RSI by its definition; CTE ``name`` has the source columns and ``rsi``."""
    si = "CASE WHEN {l} = 0 AND {g} > 0 THEN 100.0::DOUBLE ELSE 100 - 100 / (1 + {g} / nullif({l}, 0)) END"
    moves = f"{name}_m AS (SELECT *, greatest(coalesce(close - {LAGC}, 0), 0) AS gain, greatest(coalesce({LAGC} - close, 0), 0) AS loss FROM {src})"
    avgs = f"{name}_a AS (SELECT *, {sroll('avg', 'gain', n)} AS ag, {sroll('avg', 'loss', n)} AS al FROM {name}_m)"
    if not smooth:
        return (moves, avgs, f"{name} AS (SELECT * EXCLUDE (gain, loss, ag, al), {si.format(g='ag', l='al')} AS rsi FROM {name}_a)")
    return (moves, avgs, ema_cte(f"{name}_g", f"{name}_a", "ag", f"(1.0::DOUBLE/{n})", "eg"),
            ema_cte(f"{name}_h", f"{name}_g", "al", f"(1.0::DOUBLE/{n})", "el"),
            f"{name} AS (SELECT * EXCLUDE (gain, loss, ag, al, eg, el), {si.format(g='eg', l='el')} AS rsi FROM {name}_h)")


@query("i06_rsi", with_bars(f"SELECT symbol, date, {s4('rsi')} FROM rsi", *rsi_ctes()))
def _(t):
    return ind.rsi(t.bars).select(*KEY, *r4("rsi"))


MACD_CTES = (
    ema_cte("mf", "bars", "close", "(2.0::DOUBLE/13)", "ef"), ema_cte("ms", "mf", "close", "(2.0::DOUBLE/27)", "es"),
    "ml AS (SELECT *, ef - es AS macd FROM ms)", ema_cte("mg", "ml", "macd", "(2.0::DOUBLE/10)", "macd_signal"),
    "macd_t AS (SELECT *, macd - macd_signal AS macd_hist FROM mg)")


@query("i07_macd", with_bars(f"SELECT symbol, date, {s4('macd', 'macd_signal', 'macd_hist')} FROM macd_t", *MACD_CTES))
def _(t):
    return ind.macd(t.bars).select(*KEY, *r4("macd", "macd_signal", "macd_hist"))


def atr_ctes(n, src="bars", name="atr_t", out="atr"):
    return (f"{name}_r AS (SELECT *, {TR} AS tr FROM {src})",
            f"{name} AS (SELECT * EXCLUDE (tr), {sroll('avg', 'tr', n)} AS {out} FROM {name}_r)")


@query("i08_atr", with_bars(f"SELECT symbol, date, {s4('atr')} FROM atr_t", *atr_ctes(14)))
def _(t):
    return ind.atr(t.bars).select(*KEY, *r4("atr"))


def rsv(n):
    lo, hi = sroll("min", "low", n), sroll("max", "high", n)
    return f"(close - ({lo})) / nullif(({hi}) - ({lo}), 0) * 100"


def gap_ewm_cte(name, src, x, m, out):
    """The smoothing with gaps as a fold over (value, weight) pairs of one series."""
    a = f"(1.0::DOUBLE/{m})"
    return f"""{name}_l AS (
  SELECT symbol, list(date ORDER BY date) AS ds, list_reduce(
    list_transform(list({x} ORDER BY date), lambda v: [{{'y': CAST(v AS DOUBLE), 'w': 1.0::DOUBLE}}]),
    lambda acc, v: list_append(acc, CASE
      WHEN acc[len(acc)].y IS NULL THEN v[1]
      WHEN v[1].y IS NULL THEN {{'y': acc[len(acc)].y, 'w': acc[len(acc)].w * (1 - {a})}}
      ELSE {{'y': (acc[len(acc)].w * (1 - {a}) * acc[len(acc)].y + {a} * v[1].y) / (acc[len(acc)].w * (1 - {a}) + {a}), 'w': 1.0::DOUBLE}} END)) AS vs
  FROM {src} GROUP BY symbol),
{name}_u AS (SELECT symbol, unnest(ds) AS date, unnest(vs).y AS {out} FROM {name}_l),
{name} AS (SELECT s.*, u.{out} FROM {src} s JOIN {name}_u u ON s.symbol = u.symbol AND s.date = u.date)"""


@query("i09_kdj", with_bars("SELECT symbol, date, round(k, 4) AS k, round(d, 4) AS d, round(3 * k - 2 * d, 4) AS j FROM kd",
                            f"rs AS (SELECT *, {rsv(9)} AS rsv FROM bars)",
                            gap_ewm_cte("kk", "rs", "rsv", 3, "k"), gap_ewm_cte("kd", "kk", "k", 3, "d")))
def _(t):
    return ind.kdj(t.bars).select(*KEY, *r4("k", "d", "j"))


@query("i10_stochastic", with_bars(f"SELECT symbol, date, round(stoch_k, 4) AS stoch_k, round({sroll('avg', 'stoch_k', 3)}, 4) AS stoch_d FROM st",
                                   f"st AS (SELECT *, {rsv(14)} AS stoch_k FROM bars)"))
def _(t):
    return ind.stochastic(t.bars).select(*KEY, *r4("stoch_k", "stoch_d"))


@query("i11_cci", with_bars(
    "SELECT symbol, date, CASE WHEN len(l) >= 20 THEN round((tp - list_avg(l)) / nullif(0.015 * list_avg(list_transform(l, lambda v: abs(v - list_avg(l)))), 0), 4) END AS cci FROM tps",
    f"tps AS (SELECT *, {TP} AS tp, list({TP}) {R(20)} AS l FROM bars)"))
def _(t):
    return ind.cci(t.bars).select(*KEY, *r4("cci"))


@query("i12_williams_r", with_bars(
    f"SELECT symbol, date, round((({sroll('max', 'high', 14)}) - close) / nullif(({sroll('max', 'high', 14)}) - ({sroll('min', 'low', 14)}), 0) * -100, 4) AS williams_r FROM bars"))
def _(t):
    return ind.williams_r(t.bars).select(*KEY, *r4("williams_r"))


OBV = f"obvt AS (SELECT *, sum(step) {SOFAR} AS obv FROM (SELECT *, coalesce(sign(close - {LAGC}), 0) * volume AS step FROM bars))"


@query("i13_obv", with_bars("SELECT symbol, date, obv FROM obvt", OBV))
def _(t):
    return ind.obv(t.bars).select(*KEY, "obv")


ADX_CTES = (
    f"d0 AS (SELECT *, high - lag(high) {W} AS up, lag(low) {W} - low AS dn, {TR} AS tr FROM bars)",
    "d1 AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm FROM d0)",
    "d2 AS (SELECT *, CASE WHEN dn > pdm AND dn > 0 THEN dn ELSE 0 END AS mdm FROM d1)",
    f"d3 AS (SELECT *, {sroll('avg', 'pdm', 14)} AS ap, {sroll('avg', 'mdm', 14)} AS am, {sroll('avg', 'tr', 14)} AS atr FROM d2)",
    "d4 AS (SELECT *, 100 * ap / nullif(atr, 0) AS plus_di, 100 * am / nullif(atr, 0) AS minus_di FROM d3)",
    "d5 AS (SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx FROM d4)",
    f"d6 AS (SELECT *, {sroll('avg', 'dx', 14)} AS adx FROM d5)")


@query("i14_adx", with_bars(f"SELECT symbol, date, {s4('adx', 'plus_di', 'minus_di')} FROM d6", *ADX_CTES))
def _(t):
    return ind.adx(t.bars).select(*KEY, *r4("adx", "plus_di", "minus_di"))


MFI_CTES = (
    f"f0 AS (SELECT *, {TP} AS tp, lag({TP}) {W} AS ptp FROM bars)",
    "f1 AS (SELECT *, CASE WHEN tp > ptp THEN tp * volume ELSE 0 END AS fin, CASE WHEN tp < ptp THEN tp * volume ELSE 0 END AS fout FROM f0)",
    f"f2 AS (SELECT *, {sroll('sum', 'fin', 14)} AS sin_, {sroll('sum', 'fout', 14)} AS sout FROM f1)",
    "mfit AS (SELECT *, CASE WHEN sout = 0 AND sin_ > 0 THEN 100.0::DOUBLE ELSE 100 - 100 / (1 + sin_ / nullif(sout, 0)) END AS mfi FROM f2)")


@query("i15_mfi", with_bars(f"SELECT symbol, date, {s4('mfi')} FROM mfit", *MFI_CTES))
def _(t):
    return ind.mfi(t.bars).select(*KEY, *r4("mfi"))


@query("i16_roc", with_bars(f"SELECT symbol, date, round((close - lag(close, 12) {W}) / lag(close, 12) {W} * 100, 4) AS roc FROM bars"))
def _(t):
    return ind.roc(t.bars).select(*KEY, *r4("roc"))


@query("i17_momentum", with_bars(f"SELECT symbol, date, close - lag(close, 10) {W} AS momentum FROM bars"))
def _(t):
    return ind.momentum(t.bars).select(*KEY, "momentum")


@query("i18_vwap", with_bars(f"SELECT symbol, date, round(sum({TP} * volume) {SOFAR} / sum(volume) {SOFAR}, 4) AS vwap FROM bars"))
def _(t):
    return ind.vwap(t.bars).select(*KEY, *r4("vwap"))


@query("i19_donchian", with_bars(
    f"SELECT symbol, date, dc_upper, dc_lower, (dc_upper + dc_lower) / 2 AS dc_middle FROM (SELECT *, {sroll('max', 'high', 20)} AS dc_upper, {sroll('min', 'low', 20)} AS dc_lower FROM bars)"))
def _(t):
    return ind.donchian(t.bars).select(*KEY, "dc_upper", "dc_lower", "dc_middle")


@query("i20_keltner", with_bars(
    "SELECT symbol, date, round(e + 2 * atr, 4) AS kc_upper, round(e, 4) AS kc_middle, round(e - 2 * atr, 4) AS kc_lower FROM ke",
    *atr_ctes(20), ema_cte("ke", "atr_t", "close", "(2.0::DOUBLE/21)", "e")))
def _(t):
    return ind.keltner(t.bars).select(*KEY, *r4("kc_upper", "kc_middle", "kc_lower"))


@query("i21_trix", with_bars(
    f"SELECT symbol, date, round((e3 - lag(e3) {W}) / lag(e3) {W} * 100, 4) AS trix FROM t3",
    ema_cte("t1", "bars", "close", "(2.0::DOUBLE/15)", "e1"), ema_cte("t2", "t1", "e1", "(2.0::DOUBLE/15)", "e2"),
    ema_cte("t3", "t2", "e2", "(2.0::DOUBLE/15)", "e3")))
def _(t):
    return ind.trix(t.bars).select(*KEY, *r4("trix"))


GAPS = "gappy AS (SELECT * REPLACE (CASE WHEN day(date) % 7 <> 0 THEN close END AS close) FROM bars)"


def gappy(t):
    """Bars whose close is missing on some days."""
    return t.bars.withColumn("close", F.when(F.dayofmonth("date") % 7 != 0, F.col("close")))


@query("i02b_ema_gaps", with_bars("SELECT symbol, date, round(e, 4) AS ema_12 FROM eg", GAPS, gap_ewm_cte("eg", "gappy", "close", 6.5, "e")))
def _(t):
    return ind.ema(gappy(t), n=12).select(*KEY, *r4("ema_12"))


@query("i07b_macd_gaps", with_bars(
    f"SELECT symbol, date, {s4('macd', 'macd_signal')} FROM gs", GAPS, gap_ewm_cte("gf", "gappy", "close", 6.5, "ef"), gap_ewm_cte("gl", "gf", "close", 13.5, "es"),
    "gm AS (SELECT *, ef - es AS macd FROM gl)", gap_ewm_cte("gs", "gm", "macd", 5, "macd_signal")))
def _(t):
    return ind.macd(gappy(t)).select(*KEY, *r4("macd", "macd_signal"))


@query("i20b_keltner_gaps", with_bars(
    "SELECT symbol, date, round(e + 2 * atr, 4) AS kc_upper, round(e, 4) AS kc_middle FROM kg", GAPS,
    *atr_ctes(20, "gappy", "atr_g"), gap_ewm_cte("kg", "atr_g", "close", 10.5, "e")))
def _(t):
    return ind.keltner(gappy(t)).select(*KEY, *r4("kc_upper", "kc_middle"))


@query("i21b_trix_gaps", with_bars(
    f"SELECT symbol, date, round((e3 - lag(e3) {W}) / lag(e3) {W} * 100, 4) AS trix FROM x3", GAPS, gap_ewm_cte("x1", "gappy", "close", 7.5, "e1"),
    gap_ewm_cte("x2", "x1", "e1", 7.5, "e2"), gap_ewm_cte("x3", "x2", "e2", 7.5, "e3")))
def _(t):
    return ind.trix(gappy(t)).select(*KEY, *r4("trix"))


@query("i22_dmi", with_bars(f"SELECT symbol, date, {s4('plus_di', 'minus_di', 'dx', 'adx')} FROM d6", *ADX_CTES))
def _(t):
    return ind.adx(t.bars).select(*KEY, *r4("plus_di", "minus_di", "dx", "adx"))


@query("i23_typical_price", with_bars(f"SELECT symbol, date, {TP} AS typical FROM bars"))
def _(t):
    return ind.typical(t.bars).select(*KEY, "typical")


@query("i24_pivot_points", with_bars(
    f"SELECT symbol, date, p AS \"pivot\", 2 * p - low AS r1, 2 * p - high AS s1, p + (high - low) AS r2, p - (high - low) AS s2, "
    f"high + 2 * (p - low) AS r3, low - 2 * (high - p) AS s3 FROM (SELECT *, {TP} AS p FROM bars)"))
def _(t):
    return ind.pivot_points(t.bars).select(*KEY, "pivot", "r1", "s1", "r2", "s2", "r3", "s3")


@query("i25_zscore", with_bars("SELECT symbol, date, round((close - middle) / nullif(sd, 0), 4) AS zscore FROM bands", BANDS))
def _(t):
    return ind.z_score(t.bars).select(*KEY, *r4("zscore"))


def rsrs_ctes(n=18, need=18, z=120, zneed=40, r2=True, beta=False, name="rsrs_t"):
    score = "rsrs_zscore" + (" * rsrs_r2" if r2 else "") + (" * rsrs_beta" if beta else "")
    return (
        f"{name}_w AS (SELECT *, row_number() {W} AS rn_, regr_slope(high, low) {R(n)} AS b, regr_r2(high, low) {R(n)} AS rr, "
        f"regr_count(high, low) {R(n)} AS c, var_pop(low) {R(n)} AS vx, var_pop(high) {R(n)} AS vy FROM bars)",
        f"{name}_b AS (SELECT * EXCLUDE (rn_, b, rr, c, vx, vy), CASE WHEN rn_ >= {n} AND c >= {need} AND vx > 0 THEN b END AS rsrs_beta, "
        f"CASE WHEN rn_ >= {n} AND c >= {need} AND vx > 0 AND vy > 0 THEN rr END AS rsrs_r2 FROM {name}_w)",
        f"{name}_z AS (SELECT *, (rsrs_beta - ({sroll('avg', 'rsrs_beta', z, zneed)})) / nullif({sroll('stddev_samp', 'rsrs_beta', z, zneed)}, 0) AS rsrs_zscore FROM {name}_b)",
        f"{name} AS (SELECT *, {score} AS rsrs_score FROM {name}_z)")


@query("i26_rsrs_beta_r2", with_bars(f"SELECT symbol, date, {s4('rsrs_beta', 'rsrs_r2')} FROM rsrs_t", *rsrs_ctes(need=12)))
def _(t):
    return ind.rsrs_beta(t.bars, 18, 12).select(*KEY, *r4("rsrs_beta", "rsrs_r2"))


@query("i27_rsrs_zscore", with_bars(f"SELECT symbol, date, {s4('rsrs_zscore')} FROM rsrs_t", *rsrs_ctes()))
def _(t):
    return ind.rsrs_z(ind.rsrs_beta(t.bars)).select(*KEY, *r4("rsrs_zscore"))


@query("i28_rsrs_score", with_bars(f"SELECT symbol, date, {s4('rsrs_score')} FROM rsrs_t", *rsrs_ctes(beta=True)))
def _(t):
    return ind.rsrs(t.bars, beta_adjust=True).select(*KEY, *r4("rsrs_score"))


@query("i29_volatility", with_bars(
    f"SELECT symbol, date, round(({sroll('stddev_samp', 'ret', 20)}) * sqrt(252), 4) AS volatility FROM (SELECT *, close / {LAGC} - 1 AS ret FROM bars)"))
def _(t):
    return ind.volatility(t.bars).select(*KEY, *r4("volatility"))


def supertrend_ctes(n=10, k=3, src="bars", name="stt"):
    """The band ratchet as a fold over (line, side) of one series."""
    a = "acc[len(acc)]"
    return (*atr_ctes(n, src, f"{name}_a"),
            f"{name}_b AS (SELECT *, (high + low) / 2 - {k} * atr AS fl, (high + low) / 2 + {k} * atr AS ce, {LAGC} AS pc FROM {name}_a)",
            f"""{name}_l AS (SELECT symbol, list(date ORDER BY date) AS ds, list_reduce(
    list_transform(list({{'c': close, 'f': fl, 't': ce, 'p': pc}} ORDER BY date),
      lambda v: [{{'c': v.c, 'f': v.f, 't': v.t, 'x': CASE WHEN v.c < v.p THEN v.t ELSE v.f END, 's': CASE WHEN v.c < v.p THEN -1 ELSE 1 END}}]),
    lambda acc, v: list_append(acc, CASE
      WHEN v[1].c > {a}.x THEN {{'c': v[1].c, 'f': v[1].f, 't': v[1].t, 'x': CASE WHEN {a}.s > 0 THEN greatest(v[1].f, {a}.x) ELSE v[1].f END, 's': 1}}
      ELSE {{'c': v[1].c, 'f': v[1].f, 't': v[1].t, 'x': CASE WHEN {a}.s < 0 THEN least(v[1].t, {a}.x) ELSE v[1].t END, 's': -1}} END)) AS vs
  FROM {name}_b WHERE atr IS NOT NULL GROUP BY symbol)""",
            f"{name}_u AS (SELECT symbol, unnest(ds) AS date, unnest(vs) AS q FROM {name}_l)",
            f"{name} AS (SELECT s.* EXCLUDE (atr, fl, ce, pc), q.x AS supertrend, CAST(q.s AS DOUBLE) AS st_direction FROM {name}_b s LEFT JOIN {name}_u u ON s.symbol = u.symbol AND s.date = u.date)")


@query("i30_supertrend", with_bars(f"SELECT symbol, date, round(supertrend, 4) AS supertrend, st_direction FROM stt", *supertrend_ctes()))
def _(t):
    return ind.supertrend(t.bars).select(*KEY, *r4("supertrend"), "st_direction")


@query("i31_trend_strength", with_bars(
    f"SELECT symbol, date, round(mf, 4) AS ma_fast, round(ms, 4) AS ma_slow, round(rsi, 4) AS rsi, round(abs(mf - ms) / close, 4) AS trend_strength, "
    f"coalesce(abs(mf - ms) / close > 0.02, FALSE) AS is_trending FROM (SELECT *, {sroll('avg', 'close', 50)} AS mf, {sroll('avg', 'close', 200)} AS ms FROM rsi)",
    *rsi_ctes(smooth=False)))
def _(t):
    return ind.rsi_plain(ind.trend_strength(t.bars)).select(*KEY, *r4("ma_fast", "ma_slow", "rsi", "trend_strength"), "is_trending")


@query("i32_volume_ratio", with_bars(f"SELECT symbol, date, round(volume / ({sroll('avg', 'volume', 20, 5)}), 4) AS volume_ratio FROM bars"))
def _(t):
    return ind.volume_ratio(t.bars).select(*KEY, *r4("volume_ratio"))


@query("i33_ma_strength", with_bars(
    "SELECT symbol, date, round(strength_pct, 4) AS strength_pct FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back "
    f"FROM (SELECT *, (close / ({sroll('avg', 'close', 20)}) - 1) * 100 AS strength_pct FROM bars) WHERE strength_pct IS NOT NULL) WHERE back <= 30"))
def _(t):
    df = ind.ma_strength(t.bars).where("strength_pct IS NOT NULL")
    return df.withColumn("back", F.row_number().over(BARS.desc)).where("back <= 30").select(*KEY, *r4("strength_pct"))


@query("i34_chart_series", with_bars(
    f"SELECT symbol, date, round({sroll('avg', 'close', 7)}, 4) AS short_ma, round({sroll('avg', 'close', 20)}, 4) AS long_ma, obv, "
    f"round({sroll('avg', 'obv', 20)}, 4) AS obv_ma, round({sroll('avg', 'volume', 20)}, 4) AS volume_ma, "
    f"round(close / lag(close, 20) {W} - 1, 4) AS price_change, round(volume / lag(volume, 20) {W} - 1, 4) AS volume_change FROM obvt", OBV))
def _(t):
    return ind.chart_series(t.bars, short=7).select(
        *KEY, *r4("short_ma", "long_ma"), "obv", *r4("obv_ma", "volume_ma", "price_change", "volume_change"))
