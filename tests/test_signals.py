"""Timing, filters, combination, and the study form of the Bollinger rules."""

import pytest
from pyspark.sql import functions as F

from conftest import values, walk
from tapeloom.operators import signals as sig
from tapeloom.plans import grids, registry, studies


def test_ma_cross_timing(frame):
    assert values(sig.ma_cross(frame(close=[5.0, 4.0, 3.0, 4.0, 5.0, 4.0, 3.0]), 2, 3), "signal") == [0, 0, 0, 0, 1, 1, -1]


def test_ma_filter_keeps_and_blocks(frame):
    keeps = sig.ma_cross_filtered(frame(close=[5.0, 4.0, 3.0, 4.0, 5.0, 4.0, 3.0]), 2, 3, 4)
    assert values(keeps, "signal") == [0, 0, 0, 0, 1, 1, -1]
    blocks = sig.ma_cross_filtered(frame(close=[10.0, 10.0, 1.0, 2.0, 3.0]), 2, 3, 4)
    assert values(blocks, "signal") == [0, 0, 0, 0, 0]


def test_trend_gate_blocks_entry_but_keeps_position(frame):
    df = frame(close=[10.0, 9.0, 8.0, 9.0, 10.0, 9.8], volume=[100.0] * 6, signal=[0, 0, 0, 1, 1, 1])
    assert values(sig.common_filters(df, use_trend_filter=True, trend_window=2, trend_slope_window=1), "signal") == [0, 0, 0, 0, 1, 1]


@pytest.mark.parametrize("last,way", [(11.0, 1), (9.0, -1)])
def test_volume_breakout(frame, last, way):
    df = frame(close=[10.0, 10.0, 10.0, 10.0, last], volume=[100.0, 100.0, 100.0, 100.0, 1000.0])
    assert values(sig.volume_breakout(df, 3, 1.0, 3), "signal") == [0, 0, 0, 0, way]


def test_obv_counts_missing_mean_as_not_above(frame):
    assert values(sig.obv_trend(frame(close=[10.0, 11.0, 12.0, 13.0], volume=[100.0] * 4), 2), "signal") == [0, 1, 1, 1]
    assert values(sig.obv_trend(frame(close=[13.0, 12.0, 11.0, 10.0], volume=[100.0] * 4), 2), "signal") == [0, -1, -1, -1]


def test_weighted_sums(frame):
    df = frame(a=[1, 0, -1], b=[1, 1, -1]).withColumn("e", sig.weighted_sum(["a", "b"])).withColumn("w", sig.weighted_sum(["a", "b"], [0.7, 0.3]))
    assert values(df, "e", "w") == [[1.0, 0.5, -1.0], [1.0, 0.3, -1.0]]
    with pytest.raises(ValueError):
        sig.weighted_sum([])
    with pytest.raises(ValueError):
        sig.weighted_sum(["a", "b"], [1.0])


def test_unanimous_needs_all_and_source_rule_cannot_fire(frame):
    df = sig.combine(frame(a=[1, 1, -1], b=[1, 0, -1]), ["a", "b"], "unanimous")
    assert values(df, "signal") == [1, 0, -1]
    df = sig.combine(frame(a=[1, 1, -1], b=[1, 0, -1]), ["a", "b"], "unanimous", [0.5, 0.5], source_rule=True)
    assert values(df, "signal") == [0, 0, 0]


def test_rsrs_both_sides_equals_loop(spark):
    pdf = walk(260, 9)
    df = sig.rsrs_breakout(spark.createDataFrame(pdf), 8, 30, 6, entry_zscore=0.4, breakout_direction="both")
    from tapeloom.operators import indicators as ind

    scored = ind.rsrs(spark.createDataFrame(pdf), 8, 30, 6)
    names, scores = values(scored, "symbol", "rsrs_score")
    want, state, last = [], 0, None
    for name, s in zip(names, scores):
        if name != last:
            state, last = 0, name
        if s is not None:
            if state == 0:
                state = 1 if s >= 0.4 else -1 if s <= -0.4 else 0
            elif state == 1:
                state = 0 if s <= 0 else -1 if s <= -0.4 else 1
            else:
                state = 0 if s >= 0 else 1 if s >= 0.4 else -1
        want.append(state)
    assert values(df, "signal") == want and {-1, 0, 1} <= set(want)


OPERATORS = {"breakout": sig.bollinger_breakout, "mean_reversion": sig.bollinger_reversion, "squeeze": sig.bollinger_squeeze, "double": sig.bollinger_double}


@pytest.mark.parametrize("mode", list(OPERATORS))
def test_study_form_equals_single_operators(spark, mode):
    """Every fifth candidate of the full grid, the grid in one plan against the operator on its own."""
    bars = spark.createDataFrame(walk(220, 4, 2)).cache()
    candidates = grids.bollinger_grid(mode)
    for i, c in enumerate(candidates, start=1):
        c["experiment_id"] = i
    chosen = candidates[:: max(len(candidates) // 6, 1)]
    got = studies.candidate_signals(bars, chosen).cache()
    some = 0
    for c in chosen:
        params = {k: v for k, v in c.items() if k in ("window", "num_std", "signal_delay", "squeeze_threshold", "squeeze_quantile", "squeeze_lookback",
                                                      "use_supertrend_filter", "confirm_bars", "use_trend_filter", "trend_window", "trend_slope_window",
                                                      "use_volume_filter", "volume_window", "volume_multiplier")}
        want = values(OPERATORS[mode](bars, **params), "signal")
        assert values(got.where(F.col("experiment_id") == c["experiment_id"]), "signal") == want, c
        some += sum(v != 0 for v in want)
    assert some > 0


def test_grid_sizes():
    assert {m: len(grids.bollinger_grid(m)) for m in OPERATORS} == {"breakout": 162, "mean_reversion": 32, "squeeze": 144, "double": 36}
    with pytest.raises(ValueError):
        grids.bollinger_grid("other")


def test_param_sets_reset_quantiles_for_a_fixed_threshold():
    sets = grids.param_sets({"squeeze_quantile": 0.05, "squeeze_lookback": 60, "squeeze_threshold": None}, {"squeeze_threshold": [None, 0.1], "squeeze_quantile": [0.2]})
    assert [s["squeeze_quantile"] for s in sets] == [0.2, 0.05]
    assert [s["experiment_id"] for s in sets] == [1, 2]
    assert len(grids.param_sets({}, {"a": [1, 2, 3]}, max_experiments=2)) == 2
    assert grids.grid_size({"a": [1, 2, 3], "b": [1, 2]}) == 6


def test_presets_run_and_unknown_names_fail(spark):
    bars = spark.createDataFrame(walk(160, 2, 1))
    for name in ("ma_cross", "bollinger_squeeze", "rsrs", "mfi"):
        assert set(values(registry.timing_strategy(name)(bars), "signal")) <= {-1, 0, 1}
    with pytest.raises(ValueError):
        registry.timing_strategy("no_such")
    with pytest.raises(ValueError):
        registry.StrategyRegistry().timing_signals(bars, "no_such")
    assert len(registry.TIMING_PRESETS) == 14


def test_short_series_get_no_signal(frame):
    df = registry.run_strategies(frame(close=[10.0, 11.0, 12.0], volume=[100.0, 100.0, 100.0]), ["rsi"])
    assert values(df, "signal") == [None, None, None]
