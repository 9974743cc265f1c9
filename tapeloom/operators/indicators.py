"""Technical indicators: each takes a bar table and returns it with columns added.

Windows of one panel share one sort, so chains of these stay one exchange and one sort per series.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.kernels import BARS, Panel, div, ewm, ewm_gaps, flag, fold, lag, roll, row_no, span


def sma(df: DataFrame, x: str = "close", n: int = 20, out: str | None = None, panel: Panel = BARS) -> DataFrame:
    return df.withColumn(out or f"sma_{n}", roll(F.avg, x, n, panel=panel))


def ema(df: DataFrame, x: str = "close", n: int = 20, out: str | None = None, panel: Panel = BARS) -> DataFrame:
    return ewm_gaps(df, {out or f"ema_{n}": (x, span(n))}, panel)


def wma(df: DataFrame, x: str = "close", n: int = 10, out: str | None = None, panel: Panel = BARS) -> DataFrame:
    """Weights 1..n, the newest row heaviest."""
    rn = row_no(panel)
    df = df.withColumn("_rn", rn)
    frame = panel.trailing(n)
    # the weight of a row is its number less the number of the row before the frame
    weighted = F.sum(F.col("_rn") * F.col(x)).over(frame) - (F.col("_rn") - n) * F.sum(x).over(frame)
    full = F.count(x).over(frame) >= n
    return df.withColumn(out or f"wma_{n}", F.when(full, weighted / (n * (n + 1) / 2))).drop("_rn")


def bollinger(
    df: DataFrame, x: str = "close", n: int = 20, k: float = 2.0, prefix: str = "", panel: Panel = BARS
) -> DataFrame:
    """Adds upper, middle, lower: the mean and k sample deviations around it."""
    mid, sd = roll(F.avg, x, n, panel=panel), roll(F.stddev_samp, x, n, panel=panel)
    return df.withColumns({f"{prefix}middle": mid, f"{prefix}_sd": sd}).withColumns(
        {
            f"{prefix}upper": F.col(f"{prefix}middle") + k * F.col(f"{prefix}_sd"),
            f"{prefix}lower": F.col(f"{prefix}middle") - k * F.col(f"{prefix}_sd"),
        }
    ).drop(f"{prefix}_sd")


def bandwidth(df: DataFrame, x: str = "close", n: int = 20, k: float = 2.0, panel: Panel = BARS) -> DataFrame:
    df = bollinger(df, x, n, k, panel=panel)
    return df.withColumn("bandwidth", div(F.col("upper") - F.col("lower"), "middle"))


def strength_index(gain: Column, loss: Column) -> Column:
    """100 - 100/(1 + gain/loss): 100 where only the loss is 0, null where both are."""
    return F.when((loss == 0) & (gain > 0), 100.0).otherwise(100 - F.try_divide(F.lit(100.0), 1 + div(gain, loss)))


def _moves(df: DataFrame, x: str, panel: Panel) -> DataFrame:
    """Gain and loss of each row; the first row counts as no move."""
    d = F.col(x) - lag(x, panel=panel)
    return df.withColumn("_d", d).withColumns(
        {"_gain": F.when(flag(F.col("_d") > 0), F.col("_d")).otherwise(0.0),
         "_loss": F.when(flag(F.col("_d") < 0), -F.col("_d")).otherwise(0.0)}
    )


def rsi(df: DataFrame, x: str = "close", n: int = 14, out: str = "rsi", panel: Panel = BARS) -> DataFrame:
    """Rolling means of gains and losses, smoothed again with weight 1/n."""
    keep = [c for c in df.columns if c != out]
    df = _moves(df, x, panel).withColumns(
        {"_ag": roll(F.avg, "_gain", n, panel=panel), "_al": roll(F.avg, "_loss", n, panel=panel)}
    )
    df = ewm(df, {"_eg": ("_ag", 1.0 / n), "_el": ("_al", 1.0 / n)}, panel)
    return df.withColumn(out, strength_index(F.col("_eg"), F.col("_el"))).select(*keep, out)


def rsi_plain(df: DataFrame, x: str = "close", n: int = 14, out: str = "rsi", panel: Panel = BARS) -> DataFrame:
    """RSI from the rolling means alone."""
    keep = [c for c in df.columns if c != out]
    df = _moves(df, x, panel).withColumns(
        {"_ag": roll(F.avg, "_gain", n, panel=panel), "_al": roll(F.avg, "_loss", n, panel=panel)}
    )
    return df.withColumn(out, strength_index(F.col("_ag"), F.col("_al"))).select(*keep, out)


def macd(
    df: DataFrame, x: str = "close", fast: int = 12, slow: int = 26, signal: int = 9, panel: Panel = BARS
) -> DataFrame:
    """Adds macd, macd_signal, macd_hist."""
    df = ewm_gaps(df, {"_fast": (x, span(fast)), "_slow": (x, span(slow))}, panel)
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    df = ewm(df, {"macd_signal": ("macd", span(signal))}, panel)
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def true_range(panel: Panel = BARS) -> Column:
    """The largest of high-low and the distances to the close before; the first row has high-low only."""
    prev = lag("close", panel=panel)
    h, lo = F.col("high"), F.col("low")
    return F.greatest(h - lo, F.abs(h - prev), F.abs(lo - prev))


def atr(df: DataFrame, n: int = 14, out: str = "atr", panel: Panel = BARS) -> DataFrame:
    return df.withColumn("_tr", true_range(panel)).withColumn(out, roll(F.avg, "_tr", n, panel=panel)).drop("_tr")


def _range_position(n: int, panel: Panel) -> Column:
    low, high = roll(F.min, "low", n, panel=panel), roll(F.max, "high", n, panel=panel)
    return div(F.col("close") - low, high - low) * 100


def kdj(df: DataFrame, n: int = 9, m1: int = 3, m2: int = 3, panel: Panel = BARS) -> DataFrame:
    """Adds k, d, j. A flat window has no position in its range, so the smoothing must bridge gaps."""
    df = df.withColumn("_rsv", _range_position(n, panel))
    df = ewm_gaps(df, {"k": ("_rsv", 1.0 / m1)}, panel)
    df = ewm_gaps(df, {"d": ("k", 1.0 / m2)}, panel)
    return df.withColumn("j", 3 * F.col("k") - 2 * F.col("d")).drop("_rsv")


def stochastic(df: DataFrame, n: int = 14, m: int = 3, panel: Panel = BARS) -> DataFrame:
    df = df.withColumn("stoch_k", _range_position(n, panel))
    return df.withColumn("stoch_d", roll(F.avg, "stoch_k", m, panel=panel))


def typical(df: DataFrame, out: str = "typical") -> DataFrame:
    return df.withColumn(out, (F.col("high") + F.col("low") + F.col("close")) / 3)


def cci(df: DataFrame, n: int = 20, panel: Panel = BARS) -> DataFrame:
    """Distance of the typical price to its mean in mean absolute deviations of the window."""
    frame = panel.trailing(n)
    df = typical(df, "_tp").withColumns(
        {"_ma": roll(F.avg, "_tp", n, panel=panel), "_win": F.collect_list("_tp").over(frame)}
    )
    dev = F.aggregate("_win", F.lit(0.0), lambda s, v: s + F.abs(v - F.col("_ma"))) / n
    return df.withColumn("cci", div(F.col("_tp") - F.col("_ma"), 0.015 * dev)).drop("_tp", "_ma", "_win")


def williams_r(df: DataFrame, n: int = 14, panel: Panel = BARS) -> DataFrame:
    low, high = roll(F.min, "low", n, panel=panel), roll(F.max, "high", n, panel=panel)
    return df.withColumn("williams_r", div(high - F.col("close"), high - low) * -100)


def obv(df: DataFrame, panel: Panel = BARS) -> DataFrame:
    step = F.coalesce(F.signum(F.col("close") - lag("close", panel=panel)), F.lit(0.0)) * F.col("volume")
    return df.withColumn("_step", step).withColumn("obv", F.sum("_step").over(panel.so_far)).drop("_step")


def adx(df: DataFrame, n: int = 14, panel: Panel = BARS) -> DataFrame:
    """Adds plus_di, minus_di, dx, adx with simple averages."""
    keep = df.columns
    up, down = F.col("high") - lag("high", panel=panel), lag("low", panel=panel) - F.col("low")
    df = df.withColumns({"_up": up, "_down": down, "_tr": true_range(panel)})
    df = df.withColumns(
        {
            "_pdm": F.when(flag((F.col("_up") > F.col("_down")) & (F.col("_up") > 0)), F.col("_up")).otherwise(0.0),
            # the minus leg is compared with the plus leg after that one is zeroed
            "_mdm": F.when(
                flag((F.col("_down") > F.when(flag((F.col("_up") > F.col("_down")) & (F.col("_up") > 0)), F.col("_up")).otherwise(0.0))
                     & (F.col("_down") > 0)), F.col("_down")).otherwise(0.0),
        }
    )
    df = df.withColumns({f"_a{c}": roll(F.avg, f"_{c}", n, panel=panel) for c in ("pdm", "mdm", "tr")})
    df = df.withColumns({"plus_di": 100 * div("_apdm", "_atr"), "minus_di": 100 * div("_amdm", "_atr")})
    df = df.withColumn("dx", div(100 * F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))
    return df.withColumn("adx", roll(F.avg, "dx", n, panel=panel)).select(*keep, "plus_di", "minus_di", "dx", "adx")


def mfi(df: DataFrame, n: int = 14, panel: Panel = BARS) -> DataFrame:
    """Money flow index; the first row has no direction and counts as no flow."""
    keep = df.columns
    df = typical(df, "_tp").withColumn("_ptp", lag("_tp", panel=panel))
    flow = F.col("_tp") * F.col("volume")
    df = df.withColumns(
        {"_in": F.when(flag(F.col("_tp") > F.col("_ptp")), flow).otherwise(0.0),
         "_out": F.when(flag(F.col("_tp") < F.col("_ptp")), flow).otherwise(0.0)}
    )
    df = df.withColumns({"_sin": roll(F.sum, "_in", n, panel=panel), "_sout": roll(F.sum, "_out", n, panel=panel)})
    return df.withColumn("mfi", strength_index(F.col("_sin"), F.col("_sout"))).select(*keep, "mfi")


def roc(df: DataFrame, x: str = "close", n: int = 12, out: str = "roc", panel: Panel = BARS) -> DataFrame:
    before = lag(x, n, panel)
    return df.withColumn(out, div(F.col(x) - before, before) * 100)


def momentum(df: DataFrame, x: str = "close", n: int = 10, out: str = "momentum", panel: Panel = BARS) -> DataFrame:
    return df.withColumn(out, F.col(x) - lag(x, n, panel))


def vwap(df: DataFrame, panel: Panel = BARS) -> DataFrame:
    df = typical(df, "_tp")
    paid = F.sum(F.col("_tp") * F.col("volume")).over(panel.so_far)
    return df.withColumn("vwap", div(paid, F.sum("volume").over(panel.so_far))).drop("_tp")


def donchian(df: DataFrame, n: int = 20, panel: Panel = BARS) -> DataFrame:
    df = df.withColumns({"dc_upper": roll(F.max, "high", n, panel=panel), "dc_lower": roll(F.min, "low", n, panel=panel)})
    return df.withColumn("dc_middle", (F.col("dc_upper") + F.col("dc_lower")) / 2)


def keltner(df: DataFrame, n: int = 20, k: float = 2.0, panel: Panel = BARS) -> DataFrame:
    df = ewm_gaps(atr(df, n, "_atr", panel), {"kc_middle": ("close", span(n))}, panel)
    return df.withColumns(
        {"kc_upper": F.col("kc_middle") + k * F.col("_atr"), "kc_lower": F.col("kc_middle") - k * F.col("_atr")}
    ).drop("_atr")


def trix(df: DataFrame, x: str = "close", n: int = 14, panel: Panel = BARS) -> DataFrame:
    keep = df.columns
    for i in (1, 2, 3):  # only the column itself can have gaps, a mean repeats its last value there
        df = (ewm_gaps if i == 1 else ewm)(df, {f"_e{i}": (x if i == 1 else f"_e{i - 1}", span(n))}, panel)
    before = lag("_e3", panel=panel)
    return df.withColumn("trix", div(F.col("_e3") - before, before) * 100).select(*keep, "trix")


def pivot_points(df: DataFrame) -> DataFrame:
    h, lo = F.col("high"), F.col("low")
    df = typical(df, "pivot")
    p = F.col("pivot")
    return df.withColumns(
        {
            "r1": 2 * p - lo, "s1": 2 * p - h,
            "r2": p + (h - lo), "s2": p - (h - lo),
            "r3": h + 2 * (p - lo), "s3": lo - 2 * (h - p),
        }
    )


def z_score(df: DataFrame, x: str = "close", n: int = 20, out: str = "zscore", panel: Panel = BARS) -> DataFrame:
    mean, sd = roll(F.avg, x, n, panel=panel), roll(F.stddev_samp, x, n, panel=panel)
    return df.withColumn(out, div(F.col(x) - mean, sd))


def rsrs_beta(df: DataFrame, n: int = 18, min_valid: int | None = None, panel: Panel = BARS) -> DataFrame:
    """Slope and R2 of high on low over the last n rows, from row n on."""
    need = n if min_valid is None else max(2, min(min_valid, n))
    frame = panel.trailing(n)
    h, lo = F.col("high"), F.col("low")
    df = df.withColumns(
        {
            "_n": F.regr_count(h, lo).over(frame),
            "_vx": F.regr_sxx(h, lo).over(frame),
            "_vy": F.regr_syy(h, lo).over(frame),
            "_cxy": F.regr_sxy(h, lo).over(frame),
            "_rn": row_no(panel),
        }
    )
    ok = (F.col("_rn") >= n) & (F.col("_n") >= need) & (F.col("_vx") > 0)
    r2 = F.when(ok & (F.col("_vy") > 0), div(F.col("_cxy") * F.col("_cxy"), F.col("_vx") * F.col("_vy")))
    return df.withColumns({"rsrs_beta": F.when(ok, div("_cxy", "_vx")), "rsrs_r2": r2}).drop(
        "_n", "_vx", "_vy", "_cxy", "_rn"
    )


def rsrs_z(df: DataFrame, n: int = 120, min_periods: int | None = None, panel: Panel = BARS) -> DataFrame:
    need = max(2, min(max(20, n // 3) if min_periods is None else min_periods, n))
    mean = roll(F.avg, "rsrs_beta", n, need, panel)
    sd = roll(F.stddev_samp, "rsrs_beta", n, need, panel)
    return df.withColumn("rsrs_zscore", div(F.col("rsrs_beta") - mean, sd))


def rsrs(
    df: DataFrame, n: int = 18, z_window: int = 120, min_valid: int | None = None, r2_weight: bool = True,
    beta_adjust: bool = False, z_min_periods: int | None = None, panel: Panel = BARS,
) -> DataFrame:
    """Adds rsrs_beta, rsrs_r2, rsrs_zscore, rsrs_score."""
    df = rsrs_z(rsrs_beta(df, n, min_valid, panel), z_window, z_min_periods, panel)
    score = F.col("rsrs_zscore")
    if r2_weight:
        score = score * F.col("rsrs_r2")
    if beta_adjust:
        score = score * F.col("rsrs_beta")
    return df.withColumn("rsrs_score", score)


def pct_change(x: str = "close", n: int = 1, panel: Panel = BARS) -> Column:
    return div(x, lag(x, n, panel)) - 1


def volatility(df: DataFrame, x: str = "close", n: int = 20, annualize: bool = True, panel: Panel = BARS) -> DataFrame:
    sd = df.withColumn("_ret", pct_change(x, panel=panel)).withColumn("volatility", roll(F.stddev_samp, "_ret", n, panel=panel))
    if annualize:
        sd = sd.withColumn("volatility", F.col("volatility") * math.sqrt(252))
    return sd.drop("_ret")


def supertrend(df: DataFrame, n: int = 10, k: float = 3.0, panel: Panel = BARS) -> DataFrame:
    """Adds supertrend and st_direction.

    The trailing band depends on its own last value and on the side it was on, so each series is
    folded once in date order.
    """

    def ratchet(c):
        hi, lo, cl, at = c["high"], c["low"], c["close"], c["_atr"]
        line, side = np.full(len(cl), np.nan), np.full(len(cl), np.nan)
        last = way = None
        for i in np.flatnonzero(~np.isnan(at)):
            mid = (hi[i] + lo[i]) / 2.0
            floor, ceil = mid - k * at[i], mid + k * at[i]
            if last is None:
                now = -1.0 if i and cl[i] < cl[i - 1] else 1.0
                last = ceil if now < 0 else floor
            elif cl[i] > last:
                now = 1.0
                last = max(floor, last) if way > 0 else floor
            else:
                now = -1.0
                last = min(ceil, last) if way < 0 else ceil
            way = now
            line[i], side[i] = last, now
        return {"supertrend": line, "st_direction": side}

    df = atr(df, n, "_atr", panel)
    out = {"supertrend": "double", "st_direction": "double"}
    return fold(df, ["high", "low", "close", "_atr"], out, ratchet, panel).drop("_atr")


def trend_strength(df: DataFrame, fast: int = 50, slow: int = 200, limit: float = 0.02, panel: Panel = BARS) -> DataFrame:
    """Adds ma_fast, ma_slow, trend_strength and is_trending."""
    df = sma(sma(df, n=fast, out="ma_fast", panel=panel), n=slow, out="ma_slow", panel=panel)
    df = df.withColumn("trend_strength", div(F.abs(F.col("ma_fast") - F.col("ma_slow")), "close"))
    return df.withColumn("is_trending", flag(F.col("trend_strength") > limit))


def volume_ratio(df: DataFrame, n: int = 20, min_periods: int = 5, out: str = "volume_ratio", panel: Panel = BARS) -> DataFrame:
    return df.withColumn(out, div("volume", roll(F.avg, "volume", n, min_periods, panel)))


def ma_strength(df: DataFrame, n: int = 20, out: str = "strength_pct", panel: Panel = BARS) -> DataFrame:
    """How far the close is above its mean, in percent."""
    return df.withColumn(out, (div("close", roll(F.avg, "close", n, panel=panel)) - 1) * 100)


def chart_series(df: DataFrame, short: int = 5, long: int = 20, change: int = 20, panel: Panel = BARS) -> DataFrame:
    """The helper lines of the charts: mean pair, volume mean, OBV with its mean, n-row changes."""
    df = sma(sma(df, n=short, out="short_ma", panel=panel), n=long, out="long_ma", panel=panel)
    df = sma(obv(df, panel), "obv", 20, "obv_ma", panel)
    df = sma(df, "volume", 20, "volume_ma", panel)
    return df.withColumns(
        {"price_change": pct_change("close", change, panel), "volume_change": pct_change("volume", change, panel)}
    )
