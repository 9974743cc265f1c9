from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tapeloom.session import build_session  # noqa: E402

DAY0 = dt.date(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    s = build_session("tapeloom-tests", cores="4", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Bars of one or more symbols from columns of equal length."""

    def make(symbol="AAA", **cols):
        n = len(next(iter(cols.values())))
        days = [DAY0 + dt.timedelta(days=i) for i in range(n)]

        def kind(column):
            real = [v for v in column if v is not None]
            return "string" if isinstance(real[0], str) else "double" if isinstance(real[0], float) else "long"

        cols = {c: [v.item() if isinstance(v, np.generic) else v for v in column] for c, column in cols.items()}
        schema = ", ".join(["symbol string", "date date"] + [f"{c} {kind(v)}" for c, v in cols.items()])
        df = spark.createDataFrame(list(zip([symbol] * n, days, *cols.values())), schema)
        return df

    return make


def values(df, *names, order=("symbol", "date")):
    rows = df.orderBy(*order).select(*names).collect()
    out = [[r[i] for r in rows] for i in range(len(names))]
    return out[0] if len(names) == 1 else out


def walk(n, seed, symbols=3):
    """Random bars of several symbols as a pandas frame, one with a flat stretch."""
    rng = np.random.default_rng(seed)
    parts = []
    for k in range(symbols):
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
        if k == 1:
            close[n // 3: n // 3 + 15] = close[n // 3]
        high = close * (1 + rng.uniform(0, 0.02, n))
        low = close * (1 - rng.uniform(0, 0.02, n))
        if k == 1:
            high[n // 3: n // 3 + 15] = low[n // 3: n // 3 + 15] = close[n // 3]
        parts.append(pd.DataFrame({
            "symbol": f"S{k}", "date": [DAY0 + dt.timedelta(days=i) for i in range(n)], "open": close * (1 + rng.normal(0, 0.005, n)),
            "close": close, "high": high, "low": low, "volume": rng.integers(100, 1000, n).astype(float)}))
    out = pd.concat(parts, ignore_index=True)
    out["amount"] = out["close"] * out["volume"]
    return out
