"""Exact small cases and pandas twins of the indicators."""

import numpy as np
import pandas as pd
import pytest

from conftest import values, walk
from tapeloom.operators import indicators as ind


def near(got, want):
    np.testing.assert_allclose(np.array(got, dtype=float), np.array(want, dtype=float), rtol=1e-10, atol=1e-10)


def test_obv(frame):
    df = frame(close=[10.0, 11.0, 10.0, 12.0], volume=[100.0, 200.0, 300.0, 400.0])
    assert values(ind.obv(df), "obv") == [0.0, 200.0, -100.0, 300.0]


def test_vwap(frame):
    df = frame(high=[11.0, 12.0, 13.0], low=[9.0, 10.0, 11.0], close=[10.0, 11.0, 12.0], volume=[100.0, 200.0, 300.0])
    near(values(ind.vwap(df), "vwap"), [10.0, 10.666666666666666, 11.333333333333334])


def test_mfi(frame):
    df = frame(high=[10.0, 12.0, 11.0, 13.0], low=[8.0, 9.0, 9.0, 10.0], close=[9.0, 11.0, 10.0, 12.0], volume=[100.0, 120.0, 80.0, 150.0])
    near(values(ind.mfi(df, 2), "mfi"), [None, 100.0, 61.53846153846154, 68.62745098039215])


def test_trix(frame):
    near(values(ind.trix(frame(close=[1.0, 2.0, 3.0, 4.0, 5.0]), n=2), "trix"), [None, 29.629629629629626, 45.714285714285715, 41.830065359477125, 33.58934971838196])


def test_adx_and_dmi(frame):
    df = ind.adx(frame(high=[10.0, 12.0, 13.0, 15.0, 16.0], low=[8.0, 9.0, 11.0, 12.0, 14.0], close=[9.0, 11.0, 12.0, 14.0, 15.0]), 2)
    adx, pdi, mdi, dx = values(df, "adx", "plus_di", "minus_di", "dx")
    near(adx, [None, None, 100.0, 100.0, 100.0])
    near(pdi, [None, 40.0, 60.0, 60.0, 60.0])
    near(mdi, [None, 0.0, 0.0, 0.0, 0.0])
    near(dx, [None, 100.0, 100.0, 100.0, 100.0])


def test_rsrs_slope_is_known(frame):
    rng = np.random.default_rng(42)
    low = list(10 + np.cumsum(rng.normal(0, 0.2, 80)))
    df = ind.rsrs_beta(frame(low=low, high=[1.2 * v + 0.5 for v in low]), 18)
    beta, r2 = values(df, "rsrs_beta", "rsrs_r2")
    assert beta[:17] == [None] * 17
    near(beta[17:], [1.2] * 63)
    near(r2[17:], [1.0] * 63)


@pytest.mark.parametrize("step,way", [(0.5, 1.0), (-0.5, -1.0)])
def test_supertrend_follows_the_trend(frame, step, way):
    rng = np.random.default_rng(42)
    close = [100 + step * i + rng.normal(0, 0.1) for i in range(100)]
    df = ind.supertrend(frame(close=close, high=[c + 0.5 for c in close], low=[c - 0.5 for c in close]))
    line, side = values(df, "supertrend", "st_direction")
    assert side[-1] == way and line[:9] == [None] * 9


def test_kdj_bridges_flat_windows(spark):
    pdf = walk(80, 1)
    got = values(ind.kdj(spark.createDataFrame(pdf)), "k", "d", "j")
    want = []
    for _, g in pdf.groupby("symbol"):
        lo, hi = g["low"].rolling(9).min(), g["high"].rolling(9).max()
        rsv = (g["close"] - lo) / (hi - lo) * 100
        kk = rsv.ewm(alpha=1 / 3, adjust=False).mean()
        dd = kk.ewm(alpha=1 / 3, adjust=False).mean()
        want.append(pd.DataFrame({"k": kk, "d": dd, "j": 3 * kk - 2 * dd}))
    want = pd.concat(want)
    for g, c in zip(got, ("k", "d", "j")):
        np.testing.assert_allclose(np.array(g, dtype=float), want[c].to_numpy(), rtol=1e-9, atol=1e-9)


def test_wma_weights_the_newest_most(frame):
    near(values(ind.wma(frame(close=[1.0, 2.0, 3.0, 5.0]), n=3, out="w"), "w"), [None, None, 14 / 6, 23 / 6])


def test_rsi_without_a_loss_is_100(frame):
    assert values(ind.rsi(frame(close=[1.0, 2.0, 3.0, 4.0]), n=2), "rsi") == [None, 100.0, 100.0, 100.0]


def test_means_bridge_missing_closes(frame):
    close = [1.0, 2.0, None, 4.0, 5.0, None, None, 3.0]
    s = pd.Series(close, dtype=float)
    fast, slow = (s.ewm(span=n, adjust=False).mean() for n in (2, 4))
    df = frame(close=close)
    near(values(ind.ema(df, n=3, out="e"), "e"), s.ewm(span=3, adjust=False).mean().tolist())
    near(values(ind.macd(df, fast=2, slow=4, signal=3), "macd_signal"), (fast - slow).ewm(span=3, adjust=False).mean().tolist())
