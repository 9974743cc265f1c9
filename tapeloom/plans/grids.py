"""Parameter grids: built on the driver (they are settings, not data), attached to rows by explode."""

from __future__ import annotations

import itertools
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid_size(grid: Mapping[str, Sequence]) -> int:
    size = 1
    for values in grid.values():
        size *= len(values)
    return size


def param_sets(base: Mapping, grid: Mapping[str, Sequence], max_experiments: int | None = None) -> list[dict]:
    """All combinations over the base, each with experiment_id and param_label.

    A fixed squeeze threshold makes the quantile settings meaningless, so they fall back to the base.
    """
    if not grid:
        return [{"experiment_id": 1, "param_label": "baseline", **base}]
    out = []
    for i, values in enumerate(itertools.product(*grid.values()), start=1):
        if max_experiments is not None and i > max(max_experiments, 1):
            break
        chosen = dict(zip(grid, values))
        params = {**base, **chosen}
        if params.get("squeeze_threshold") is not None:
            params.update({k: base.get(k) for k in ("squeeze_quantile", "squeeze_lookback")})
        out.append({"experiment_id": i, "param_label": " | ".join(f"{k}={v}" for k, v in chosen.items()), **params})
    return out


# fixed values: the axes of the Bollinger study by mode
COMMON_COLUMNS = {"price_col": "close", "high_col": "high", "low_col": "low", "volume_col": "volume"}
GATE_BASE = {"trend_window": 60, "trend_slope_window": 3, "use_volume_filter": False, "volume_window": 20, "volume_multiplier": 1.2}
BOLLINGER_AXES = {
    "breakout": {"window": [14, 20, 26], "num_std": [1.8, 2.0, 2.2], "signal_delay": [0, 1]},
    "mean_reversion": {"window": [14, 20, 26, 34], "num_std": [1.6, 1.8, 2.0, 2.2], "signal_delay": [0, 1]},
    "squeeze": {
        "window": [18, 20, 26], "num_std": [1.8, 2.0, 2.2], "squeeze_quantile": [0.1, 0.2], "signal_delay": [0, 1],
        "use_trend_filter": [False, True], "use_supertrend_filter": [False, True],
    },
    "double": {"window": [14, 20, 26], "num_std": [1.8, 2.0, 2.2], "confirm_bars": [2, 3], "signal_delay": [0, 1]},
}
BREAKOUT_GATES = {
    "trend": [{"use_trend_filter": False, "trend_window": 60}, {"use_trend_filter": True, "trend_window": 40}, {"use_trend_filter": True, "trend_window": 60}],
    "volume": [{"use_volume_filter": False, "volume_multiplier": 1.2}, {"use_volume_filter": True, "volume_multiplier": 1.2}, {"use_volume_filter": True, "volume_multiplier": 1.5}],
}


def bollinger_grid(mode: str) -> list[dict]:
    """The candidates of one mode, without repeats."""
    if mode not in BOLLINGER_AXES:
        raise ValueError(f"Unsupported mode: {mode}")
    axes = BOLLINGER_AXES[mode]
    extra = {
        "breakout": [{**GATE_BASE, **a, **b} for a in BREAKOUT_GATES["trend"] for b in BREAKOUT_GATES["volume"]],
        "mean_reversion": [{}],
        "squeeze": [{**GATE_BASE, "squeeze_threshold": None, "squeeze_lookback": 60}],
        "double": [{**GATE_BASE, "use_trend_filter": True}],
    }[mode]
    rows = [{"mode": mode, **COMMON_COLUMNS, **e, **dict(zip(axes, v))} for v in itertools.product(*axes.values()) for e in extra]
    return list({json.dumps(r, sort_keys=True): r for r in rows}.values())


# fixed values: columns that tell candidates of a mode apart
PARAMETER_COLUMNS = [
    "mode", "window", "num_std", "signal_delay", "use_trend_filter", "trend_window", "trend_slope_window", "use_volume_filter",
    "volume_window", "volume_multiplier", "use_supertrend_filter", "squeeze_threshold", "squeeze_quantile", "squeeze_lookback", "confirm_bars",
]


def parameter_columns(mode: str) -> list[str]:
    return PARAMETER_COLUMNS[:4] if mode == "mean_reversion" else list(PARAMETER_COLUMNS)


def attach_grid(df: DataFrame, rows: Sequence[Mapping]) -> DataFrame:
    """Every input row with every parameter row; the grid travels as a literal, so nothing is joined."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    kinds = {n: type(next((r[n] for r in rows if r.get(n) is not None), "")) for n in names}
    sql_type = {bool: "boolean", int: "int", float: "double", str: "string"}
    if any(isinstance(r.get(n), float) for r in rows for n in names if kinds[n] is int):
        kinds = {n: float if any(isinstance(r.get(n), float) for r in rows) else k for n, k in kinds.items()}
    structs = [F.struct(*[F.lit(r.get(n)).cast(sql_type[kinds[n]]).alias(n) for n in names]) for r in rows]
    return df.withColumn("_g", F.explode(F.array(*structs))).select(*df.columns, "_g.*")
