"""Bars from trade and tick tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_seq() -> Column:
    """The order of trades inside a day as one long: order, line, and a tag of price and quantity.

    Order and line are a key of a trade; the tag orders rows that repeat a key. A number keeps the
    aggregate on the hash path, while a struct as the key of ``min_by`` would make Spark sort all
    trades first. 40 bits hold order keys up to scale factor 180,000.
    """
    order = F.col("l_orderkey")
    fits = order.between(0, 2**40 - 1) & F.col("l_linenumber").between(0, 7)
    order = F.when(fits, order).otherwise(F.raise_error(F.lit("order key beyond 40 bits, or line number beyond 3")).cast("long"))
    tag = (F.round(F.col("l_extendedprice") * 100).cast("long") * 50 + F.col("l_quantity").cast("long")) % 2**20
    return F.shiftleft(order * 8 + F.col("l_linenumber"), 20) + tag


def _basics(price: Column) -> list[Column]:
    """Daily valuation figures from the extremes of the day's lines."""
    return [
        (F.max(price) / (1 + F.min("l_quantity"))).alias("pe"), (F.min(price) / (1 + F.max("l_quantity"))).alias("pb"),
        F.max("l_discount").alias("roe"), F.max("l_tax").alias("roa"),
    ]


def daily_bars(trades: DataFrame, parts: DataFrame, basics: bool = False) -> DataFrame:
    """One bar per brand and ship day: a trade is a line, its price the unit price.

    Open and close are the prices of the first and last trade by ``trade_seq``.
    The aggregate combines on the map side, so a brand with a third of all trades still shuffles
    one row per day and task. With ``basics`` the figures of ``daily_basics`` come from the same pass.
    """
    t = trades.select(
        "l_partkey",
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        "l_quantity",
        "l_extendedprice",
        *(["l_discount", "l_tax"] if basics else []),
        trade_seq().alias("seq"),
    )
    p = parts.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    return (
        t.join(p, "l_partkey")
        .groupBy("symbol", "date")
        .agg(
            F.min_by("price", "seq").alias("open"),
            F.max_by("price", "seq").alias("close"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.sum("l_quantity").alias("volume"),
            F.sum("l_extendedprice").alias("amount"),
            *(_basics(F.col("price")) if basics else []),
        )
    )


def hourly_bars(events: DataFrame) -> DataFrame:
    """One bar per event type and hour; the value of an event is its price."""
    ts = F.col("ts").cast("timestamp")
    return (
        events.select(F.col("event_type").alias("symbol"), F.date_trunc("hour", ts).alias("hour"), "event_id", "value", ts.alias("ts"))
        .groupBy("symbol", "hour")
        .agg(
            F.min_by("value", "event_id").alias("open"),
            F.max_by("value", "event_id").alias("close"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
    )


def fundamentals(parts: DataFrame) -> DataFrame:
    """One row per brand: the industry of its newest part, the highest retail price as its cap.

    Parts are first folded to one row per brand and type, so that only numbers are aggregated over
    the large table and it stays on the hash path.
    """
    by_type = parts.groupBy(F.col("p_brand").alias("symbol"), "p_type").agg(F.max("p_partkey").alias("newest"), F.max("p_retailprice").alias("price"))
    return by_type.groupBy("symbol").agg(F.max_by("p_type", "newest").alias("industry"), F.max("price").alias("cap"))


def daily_basics(trades: DataFrame, parts: DataFrame) -> DataFrame:
    """Daily valuation figures per brand and ship day, from the extremes of the day's lines."""
    p = parts.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ts_code"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        trades.join(p, "l_partkey")
        .groupBy("ts_code", F.to_date("l_shipdate").alias("trade_date"))
        .agg(*_basics(price))
    )
