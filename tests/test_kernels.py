"""Window kernels against plain loops and pandas on random series."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import values, walk
from tapeloom.functions import kernels as k
from tapeloom.functions.ranks import average_rank, tie_rank


@pytest.mark.parametrize("span", [2, 12, 60])
def test_ewm_equals_recursion(spark, span):
    pdf = walk(700, span)
    got = values(k.ewm(spark.createDataFrame(pdf), {"e": ("close", k.span(span))}), "e")
    want = pdf.groupby("symbol")["close"].transform(lambda s: s.ewm(span=span, adjust=False).mean())
    np.testing.assert_allclose(got, want.to_numpy(), rtol=1e-11)


def test_ewm_starts_at_first_value_and_alpha_one_copies(frame):
    df = frame(x=[None, None, 4.0, 6.0])
    assert values(k.ewm(df, {"e": ("x", 0.5), "c": ("x", 1.0)}), "e", "c") == [[None, None, 4.0, 5.0], [None, None, 4.0, 6.0]]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.lists(st.one_of(st.none(), st.floats(-100, 100)), min_size=3, max_size=60), alpha=st.sampled_from([0.05, 1 / 3, 0.9]))
def test_ewm_with_gaps_equals_pandas(spark, frame, data, alpha):
    data = [0.5] + data
    got = values(k.ewm_gaps(frame(x=data), {"e": ("x", alpha)}), "e")
    want = pd.Series(data, dtype=float).ewm(alpha=alpha, adjust=False).mean()
    np.testing.assert_allclose(np.array(got, dtype=float), want.to_numpy(), rtol=1e-9, atol=1e-9)


def test_ewm_with_long_gaps(frame):
    x = ([3.0] + [None] * 200 + [7.0, 9.0]) * 3
    got = values(k.ewm_gaps(frame(x=x), {"e": ("x", 1 / 3)}), "e")
    np.testing.assert_allclose(got, pd.Series(x, dtype=float).ewm(alpha=1 / 3, adjust=False).mean().to_numpy(), rtol=1e-9)


def machine(rows):
    state, out = 0, []
    for li, si, lo, so, ok in rows:
        if not ok:
            out.append(0)
            continue
        if li:
            state = 1
        elif si:
            state = -1
        elif (state == 1 and lo) or (state == -1 and so):
            state = 0
        out.append(state)
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(*[st.integers(0, 3)] * 4, st.integers(0, 9)), min_size=2, max_size=80))
def test_reset_latch_equals_loop(frame, rows):
    marks = [[int(v == 0) for v in r[:4]] + [int(r[4] > 0)] for r in rows]
    df = frame(**{n: [r[i] for r in marks] for i, n in enumerate(("li", "si", "lo", "so", "ok"))})
    c = lambda n: F.col(n) == 1
    got = values(k.reset_latch(df, "p", c("li"), c("si"), c("lo"), c("so"), c("ok")), "p")
    assert got == machine([[bool(v) for v in r] for r in marks])


def test_latch_holds_last_event(frame):
    df = frame(e=["0", "1", "x", "-1", "x"]).withColumn("e", F.when(F.col("e") != "x", F.col("e").cast("int")))
    assert values(df.withColumn("p", k.latch(F.col("e"))), "p") == [0, 1, 1, -1, -1]


@pytest.mark.parametrize("q,n,m", [(0.1, 60, 20), (0.3, 20, 5), (0.5, 7, 7)])
def test_rolling_quantile_equals_pandas(spark, q, n, m):
    pdf = walk(150, 3)
    pdf.loc[::11, "close"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    got = np.array(values(k.rolling_quantile(df, "q", "close", n, q, m), "q"), dtype=float)
    want = pdf.groupby("symbol")["close"].transform(lambda s: s.rolling(n, min_periods=m).quantile(q))
    np.testing.assert_allclose(got, want.to_numpy(), rtol=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(positions=st.sets(st.integers(1, 200), min_size=1, max_size=40), gap=st.integers(1, 30))
def test_greedy_gap_equals_loop(spark, positions, gap):
    kept, last = [], None
    for p in sorted(positions):
        if last is None or p - last >= gap:
            kept.append(p)
            last = p
    df = spark.createDataFrame([(list(positions),)], "p array<int>")
    assert df.select(k.greedy_gap(F.col("p"), gap, "int")).first()[0] == kept


def test_ranks_equal_pandas_with_ties_and_hot_value(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": ["a", "b"] * 600, "x": np.where(rng.random(1200) < 0.4, 7.0, rng.integers(0, 300, 1200).astype(float))})
    pdf["id"] = range(len(pdf))
    want = pdf.groupby("g")["x"].rank().to_numpy()
    df = spark.createDataFrame(pdf)
    large = average_rank(df, "x", "r", ["g"], buckets=8).orderBy("id")
    np.testing.assert_allclose([r.r for r in large.collect()], want)
    small = df.withColumn("r", tie_rank(F.col("x"), ["g"])).orderBy("id")
    np.testing.assert_allclose([r.r for r in small.collect()], want)


def test_state_scan_equals_a_loop(spark):
    rng = np.random.default_rng(12)
    rows, want = [], {}
    for name, n in (("a", 300), ("b", 1), ("c", 65), ("d", 17)):
        state, path = 0, []
        for i in range(n):
            step = None if rng.random() < 0.2 else [int(x) for x in rng.integers(-1, 2, 3)]
            if rng.random() < 0.6 and step:
                step = [-1, 0, 1]  # mostly nothing happens, so that far rows matter
            state = state if step is None else step[state + 1]
            path.append(state)
            rows.append((name, i, *(step or [None] * 3)))
        want[name] = path
    df = spark.createDataFrame(rows, "symbol string, date int, s int, f int, l int").repartition(3)
    step = F.when(F.col("s").isNotNull(), k.state_map(F.col("s"), F.col("f"), F.col("l")))
    for limit in (256 * 4, 1 << 16):
        got = k.state_scan(df, "state", step, rows=limit).orderBy("symbol", "date").collect()
        for name in want:
            assert [r["state"] for r in got if r["symbol"] == name] == want[name]
    with pytest.raises(Exception, match="more than 64 rows"):
        k.state_scan(df, "state", step, rows=64).collect()
