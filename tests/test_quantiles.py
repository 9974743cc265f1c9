"""Exact quantiles by selection against numpy, with ranges small enough that they are cut several times."""

from __future__ import annotations

import numpy as np
import pytest

from tapeloom.functions import quantiles

SHARES = (0.0, 0.05, 0.25, 0.5, 0.75, 0.975, 1.0)


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_selection_equals_numpy(spark, monkeypatch, most):
    monkeypatch.setattr(quantiles, "CUTS", 8)
    rng = np.random.default_rng(6)
    groups = {"normal": rng.normal(0, 1, 1500), "ties": rng.integers(0, 3, 900).astype(float), "one": np.array([7.5]), "two": np.array([1.0, 2.0]),
              "equal": np.full(300, -2.0), "wide": np.exp(rng.normal(0, 20, 400)), "signs": np.array([-0.0, 0.0, -1e-300, 1e-300, 1e300, -1e300]), None: rng.uniform(-1, 1, 77)}
    rows = [(g, float(x), float(-2 * x)) for g, v in groups.items() for x in v] + [("ties", None, None), ("nothing", None, None)]
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(4)
    got = {r["g"]: r for r in quantiles.exact_quantiles(df, ["g"], {"a": "a", "b": "b"}, SHARES, max(most, 2)).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        np.testing.assert_allclose(got[g]["a"], np.quantile(v, SHARES), rtol=1e-12, atol=0)
        np.testing.assert_allclose(got[g]["b"], np.quantile(-2 * v, SHARES), rtol=1e-12, atol=0)


def test_no_keys_and_no_rows(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    assert quantiles.exact_quantiles(df, [], {"q": "x"}, [0.1, 0.5], 5).first()["q"] == [10.0, 50.0]
    assert quantiles.exact_quantiles(df.limit(0), ["x"], {"q": "x"}, [0.5]).count() == 0


def test_infinite_neighbours(spark):
    inf = float("inf")
    df = spark.createDataFrame([(x,) for x in (-inf, -inf, 1.0, inf, inf)], "x double")
    assert quantiles.exact_quantiles(df, [], {"q": "x"}, [0.0, 0.2, 0.5, 0.75, 1.0]).first()["q"] == [-inf, -inf, 1.0, inf, inf]
