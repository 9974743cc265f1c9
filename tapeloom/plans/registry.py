"""Named factors, strategies and conditions: functions from a DataFrame to a DataFrame."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.kernels import BARS, Panel
from tapeloom.operators import indicators as ind
from tapeloom.operators import signals as sig
from tapeloom.operators.trades import Stop

Transform = Callable[[DataFrame], DataFrame]
FAMILIES = ("technical", "fundamental", "custom")


@dataclass
class FactorRegistry:
    """Factors by family; a factor adds the column it is named after."""

    factors: dict[str, dict[str, Callable]] = field(default_factory=lambda: {f: {} for f in FAMILIES})

    def register(self, family: str, name: str, fn: Callable[[DataFrame, str], DataFrame]) -> None:
        """``fn(df, out)`` adds the column ``out``."""
        if family not in self.factors:
            raise ValueError(f"unknown family: {family}")
        self.factors[family][name] = fn

    def register_column(self, family: str, name: str, expr: Column | str) -> None:
        self.register(family, name, lambda df, out: df.withColumn(out, F.expr(expr) if isinstance(expr, str) else expr))

    def register_pandas(self, family: str, name: str, fn: Callable[[pd.DataFrame], pd.Series], panel: Panel = BARS) -> None:
        """A user function over one series in date order, run per series in Arrow batches."""

        def add(df: DataFrame, out: str) -> DataFrame:
            order, schema = panel.order, f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, `{out}` double"

            def one(pdf: pd.DataFrame) -> pd.DataFrame:
                pdf = pdf.sort_values(order)
                return pdf.assign(**{out: fn(pdf)})

            return df.groupBy(*panel.keys).applyInPandas(one, schema)

        self.register(family, name, add)

    def calculate(self, df: DataFrame, families: Sequence[str] = FAMILIES) -> DataFrame:
        """The bars with one ``<name>_factor`` column per factor; all symbols run in one plan."""
        for family in FAMILIES:
            if family in families:
                for name, fn in self.factors[family].items():
                    df = fn(df, f"{name}_factor")
        return df


# fixed values: the declared factor set and the weights of its families
FACTOR_FAMILIES = {
    "technical": ["MACD_factor", "RSI_factor", "BOLL_factor"],
    "fundamental": ["PE_factor", "PB_factor", "ROE_factor", "ROA_factor"],
    "custom": ["momentum_factor"],
}
FACTOR_WEIGHTS = {"technical": 0.4, "fundamental": 0.4, "custom": 0.2}


def default_factors() -> FactorRegistry:
    reg = FactorRegistry()

    def macd(df, out):
        return ind.macd(df).withColumnRenamed("macd", out).drop("macd_signal", "macd_hist")

    def boll(df, out):
        return ind.bandwidth(df).withColumnRenamed("bandwidth", out).drop("upper", "middle", "lower")

    reg.register("technical", "MACD", macd)
    reg.register("technical", "RSI", lambda df, out: ind.rsi(df, out=out))
    reg.register("technical", "BOLL", boll)
    for name in ("PE", "PB", "ROE", "ROA"):
        reg.register_column("fundamental", name, name.lower())
    reg.register("custom", "momentum", lambda df, out: ind.momentum(df, n=20, out=out))
    return reg


class StrategyRegistry:
    """Timing strategies add a signal column; ranking strategies order symbols from factor tables."""

    def __init__(self) -> None:
        self.timing: dict[str, Transform] = {}
        self.ranking: dict[str, Callable[[Mapping[str, DataFrame]], DataFrame]] = {}

    def register_timing(self, name: str, fn: Transform) -> None:
        self.timing[name] = fn

    def register_ranking(self, name: str, fn: Callable[[Mapping[str, DataFrame]], DataFrame]) -> None:
        self.ranking[name] = fn

    def timing_signals(self, df: DataFrame, name: str) -> DataFrame:
        if name not in self.timing:
            raise ValueError(f"no timing strategy: {name}")
        return self.timing[name](df)

    def ranking_signals(self, factors: Mapping[str, DataFrame], name: str) -> DataFrame:
        if name not in self.ranking:
            raise ValueError(f"no ranking strategy: {name}")
        return self.ranking[name](factors)


# fixed values: strategy presets with their parameters and minimum history
_NO_GATES = {"use_trend_filter": False, "trend_window": 60, "trend_slope_window": 3, "use_volume_filter": False, "volume_window": 20, "volume_multiplier": 1.2}
_BOTH_GATES = {"use_trend_filter": True, "trend_window": 60, "use_volume_filter": True, "volume_window": 20, "volume_multiplier": 1.2}
TIMING_PRESETS = {
    "ma_cross": (sig.ma_cross_filtered, 30, {
        "short_window": 5, "long_window": 20, "ma_filter_window": 30, **_NO_GATES, "use_volume_filter": True, "volume_multiplier": 1.5}),
    "rsi": (sig.rsi_level, 20, {"window": 14, "oversold": 30, "overbought": 70, **_NO_GATES}),
    "rsi_cross": (sig.rsi_cross, 20, {"window": 14, "oversold": 30, "overbought": 70, **_NO_GATES}),
    "macd": (sig.macd_cross, 35, {"fast_period": 12, "slow_period": 26, "signal_period": 9, **_NO_GATES}),
    "macd_histogram": (sig.macd_histogram, 35, {"fast_period": 12, "slow_period": 26, "signal_period": 9, **_NO_GATES}),
    "bollinger_breakout": (sig.bollinger_breakout, 25, {"window": 20, "num_std": 2.0, **_BOTH_GATES}),
    "bollinger_mean_reversion": (sig.bollinger_reversion, 25, {"window": 20, "num_std": 2.0}),
    "bollinger_squeeze": (sig.bollinger_squeeze, 25, {
        "window": 30, "num_std": 2.0, "squeeze_threshold": None, "squeeze_quantile": 0.05, "squeeze_lookback": 60,
        **_BOTH_GATES, "volume_window": 60, "volume_multiplier": 2}),
    "bollinger_double": (sig.bollinger_double, 25, {"window": 20, "num_std": 2.0, "confirm_bars": 2, **_BOTH_GATES}),
    "rsrs": (sig.rsrs_breakout, 140, {
        "window": 20, "zscore_window": 90, "min_valid_window": 12, "entry_zscore": 1.0, "exit_zscore": 0.0, "breakout_direction": "up",
        "use_r2_weight": True, "use_beta_adjustment": False, "signal_delay": 0, "use_trend_filter": True, "trend_window": 20,
        "trend_slope_window": 3, "use_volume_filter": True, "volume_window": 20, "volume_multiplier": 2.0}),
    "volume_breakout": (sig.volume_breakout, 50, {"volume_window": 20, "z_thresh": 2.0, "trend_window": 50}),
    "obv": (sig.obv_trend, 20, {"window": 20}),
    "mfi": (sig.mfi_cross, 50, {"window": 14, "overbought": 80, "oversold": 20, "trend_window": 50}),
    "volume_price_divergence": (sig.volume_divergence, 20, {"window": 20}),
}
STOP_PRESETS = {
    "stop_loss": Stop("atr", pct=0.06, holding_day=30, atr_window=14, atr_multiplier=1),
    "stop_profit": Stop("trailing", pct=0.075, holding_day=30, atr_window=14, atr_multiplier=2),
}


def accepted(fn: Callable, params: Mapping) -> dict:
    """The parameters that the operator names; others serve the filters or nobody."""
    named = {p.name for p in inspect.signature(fn).parameters.values() if p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY)}
    return {k: v for k, v in params.items() if k in named}


def timing_strategy(name: str, out: str = "signal", panel: Panel = BARS) -> Transform:
    """A preset as a transform: the operator, then the common filters where the preset turns them on."""
    if name not in TIMING_PRESETS:
        raise ValueError(f"Strategy not found: {name}. Available: {', '.join(TIMING_PRESETS)}")
    fn, _, params = TIMING_PRESETS[name]

    def run(df: DataFrame) -> DataFrame:
        df = fn(df, out=out, panel=panel, **accepted(fn, params))
        return sig.common_filters(df, out, panel, **params)

    return run


def run_strategies(df: DataFrame, names: Sequence[str], mode: str = "weighted", weights: Sequence[float] | None = None, threshold: float = 0.5, panel: Panel = BARS) -> DataFrame:
    """The combined signal of presets; series shorter than the longest minimum history get none."""
    cols = [f"_s{i}" for i in range(len(names))]
    for c, name in zip(cols, names):
        df = timing_strategy(name, c, panel)(df)
    df = sig.combine(df, cols, mode, weights, threshold).drop(*cols) if len(cols) > 1 else df.withColumnRenamed(cols[0], "signal")
    return sig.min_history(df, max(TIMING_PRESETS[n][1] for n in names), panel=panel)


def default_strategies() -> StrategyRegistry:
    reg = StrategyRegistry()
    for name in TIMING_PRESETS:
        reg.register_timing(name, timing_strategy(name))
    return reg


def bar_callback(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, panel: Panel = BARS) -> DataFrame:
    """A user function over the bars of one series, with a declared output schema."""
    order = panel.order
    return df.groupBy(*panel.keys).applyInPandas(lambda pdf: fn(pdf.sort_values(order).reset_index(drop=True)), schema)
