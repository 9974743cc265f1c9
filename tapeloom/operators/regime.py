"""Market regime of a symbol and its strength next to a market index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.kernels import BARS, Panel, div, flag, roll
from tapeloom.operators import indicators as ind

# fixed values: words of the regime
BULL, BEAR, RANGE = "牛市", "熊市", "震荡市"
RISING, FALLING, FLAT = "上升", "下降", "震荡"
# fixed values: price trend, volume trend, ladder and share limits of each sentiment, first match counts
SENTIMENT = [
    (3, "price_trend > 0.05 AND volume_trend > 0.1 AND ma_status > 1 AND price_above_ma_ratio > 0.7"),
    (2, "price_trend > 0 AND volume_trend > 0 AND ma_status > 0 AND price_above_ma_ratio > 0.5"),
    (1, "price_trend > -0.05 AND volume_trend > -0.1 AND ma_status >= -1 AND price_above_ma_ratio > 0.3"),
    (-3, "price_trend < -0.05 AND volume_trend < -0.1 AND ma_status < -1 AND price_above_ma_ratio < 0.3"),
    (-2, "price_trend < 0 AND volume_trend < 0 AND ma_status < 0 AND price_above_ma_ratio < 0.5"),
]


def trend_columns(df: DataFrame, panel: Panel = BARS) -> DataFrame:
    """Means of 5, 20, 60 and 120 rows, volume mean, percent change and the trend flags."""
    df = df.withColumns({f"ma{n}": roll(F.avg, "close", n, panel=panel) for n in (5, 20, 60, 120)})
    df = df.withColumns({"vol_ma20": roll(F.avg, "volume", 20, panel=panel), "pct_change": ind.pct_change(panel=panel) * 100})
    c = F.col
    return df.withColumns(
        {
            "uptrend": flag((c("ma5") > c("ma20")) & (c("ma20") > c("ma60"))),
            "downtrend": flag((c("ma5") < c("ma20")) & (c("ma20") < c("ma60"))),
            "price_above_ma20": flag(c("close") > c("ma20")),
        }
    )


def market_regime(df: DataFrame, rows: int = 60, panel: Panel = BARS) -> DataFrame:
    """One row per symbol from its last rows: trends, ladder of means, sentiment and the words for them."""
    c, o = F.col, panel.order
    recent = trend_columns(df, panel).withColumn("_back", F.row_number().over(panel.desc)).where(c("_back") <= rows)
    last = {f"_m{n}": F.max_by(f"ma{n}", o) for n in (5, 20, 60, 120)}
    out = recent.groupBy(*panel.keys).agg(
        F.max_by("close", o).alias("_close"),
        F.max(F.when(c("_back") == 5, c("close"))).alias("_close5"),
        (div(F.max_by("close", o), F.min_by("close", o)) - 1).alias("price_trend"),
        (div(F.avg("volume"), F.min_by("volume", o)) - 1).alias("volume_trend"),
        F.avg(c("price_above_ma20").cast("double")).alias("price_above_ma_ratio"),
        *[e.alias(n) for n, e in last.items()],
    )

    def ladder(op):
        a, b, d = op(c("_m5"), c("_m20")), op(c("_m20"), c("_m60")), op(c("_m60"), c("_m120"))
        return flag(a), flag(a & b), flag(a & b & d)

    up, down = ladder(lambda x, y: x > y), ladder(lambda x, y: x < y)
    status = F.when(up[2], 3).when(up[1], 2).when(up[0], 1).when(down[2], -3).when(down[1], -2).when(down[0], -1).otherwise(0)
    out = out.withColumn("ma_status", status)
    mood = F.when(flag(F.expr(SENTIMENT[0][1])), SENTIMENT[0][0])
    for value, rule in SENTIMENT[1:]:
        mood = mood.when(flag(F.expr(rule)), value)
    return out.withColumns(
        {
            "market_sentiment": mood.otherwise(-1),
            "bull_bear": F.when(flag((c("ma_status") >= 2) & (c("price_trend") > 0.1)), BULL)
            .when(flag((c("ma_status") <= -2) & (c("price_trend") < -0.1)), BEAR).otherwise(RANGE),
            "short_term_trend": F.when(flag(c("_close") > c("_close5")), RISING).when(flag(c("_close") < c("_close5")), FALLING).otherwise(FLAT),
        }
    ).drop("_close", "_close5", *last)


def sector_analysis(df: DataFrame, market: str, rows: int = 60, panel: Panel = BARS) -> DataFrame:
    """Regime of every symbol, with its return less that of the market over the days both have."""
    key, c = panel.keys[0], F.col
    recent = df.withColumns(
        {
            "_back": F.row_number().over(panel.desc),
            "_days": F.least(F.count(F.lit(1)).over(panel.whole), F.lit(rows)),
            "_last": F.first("close").over(panel.from_end),
        }
    ).where(c("_back") <= rows).select(key, "_back", "_days", "_last", "close")
    # rows of equal distance from the end meet; the one that both series still have counts. The market has ``rows`` rows at most
    index = recent.where(c(key) == market).select("_back", *[c(x).alias(f"_m{x}") for x in ("_days", "_last", "close")])
    both = recent.join(F.broadcast(index), "_back").where(c("_back") == F.least("_days", "_m_days"))
    relative = div("_last", "close") - div("_m_last", "_mclose")
    both = both.select(key, relative.alias("relative_performance"))
    return market_regime(df, rows, panel).join(both, key, "left").fillna(0.0, ["relative_performance"])
