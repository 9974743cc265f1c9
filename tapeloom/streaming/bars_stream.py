"""Streaming forms of bar building, refresh, signal detection and position holding."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.kernels import keep_last
from tapeloom.streaming.ordered import Fresh, Latch, run_in_order
from tapeloom.streaming.versions import COMPACT_EVERY, Versions, newest


def read_files(spark: SparkSession, path: str, schema, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


# ---- bars from ticks ------------------------------------------------------------------------------


def partial_bars(ticks: DataFrame, width: str = "1 hour") -> DataFrame:
    """What some ticks know of the bars of a tumbling window: first and last tick by time and id, extremes, count.

    Time and id are packed into one decimal, as a struct as the key of ``min_by`` would make Spark sort all ticks first.
    """
    ts = F.col("ts").cast("timestamp")
    place = F.unix_micros(ts).cast("decimal(19,0)") * F.lit(Decimal(2 * 10**19)) + F.col("event_id").cast("decimal(19,0)")
    rows = ticks.select(F.window(ts, width)["start"].alias("hour"), F.col("event_type").alias("symbol"), "value", place.cast("decimal(38,0)").alias("place"))
    return rows.groupBy("symbol", "hour").agg(
        F.min("place").alias("first"), F.min_by("value", "place").alias("open"), F.max("place").alias("last"), F.max_by("value", "place").alias("close"),
        F.max("value").alias("high"), F.min("value").alias("low"), F.count(F.lit(1)).alias("n"))


def merged_bars(parts: DataFrame) -> DataFrame:
    """Partial bars of the same windows as one each; any grouping and order of the parts gives the same bars."""
    return parts.groupBy("symbol", "hour").agg(
        F.min("first").alias("first"), F.min_by("open", "first").alias("open"), F.max("last").alias("last"), F.max_by("close", "last").alias("close"),
        F.max("high").alias("high"), F.min("low").alias("low"), F.sum("n").alias("n"), F.max("batch").alias("batch"))


def _tick_table(spark: SparkSession, root: str) -> Versions:
    return Versions(spark, root, ("symbol", "hour"), merged_bars)


def take_ticks(ticks: DataFrame, root: str, width: str = "1 hour", compact_every: int | None = COMPACT_EVERY) -> None:
    """Take in a stream of ticks. A tick may be as late as it likes: each batch adds what it knows of its bars."""
    table = _tick_table(ticks.sparkSession, root)
    run_batches(ticks, lambda batch, number: table.add(partial_bars(batch, width), number, compact_every), root)


def tick_bars(spark: SparkSession, root: str) -> DataFrame:
    """All bars of the ticks taken in so far, the last window too."""
    parts = _tick_table(spark, root).current()
    return parts.select("symbol", "hour", "open", "close", "high", "low", F.col("n").cast("double").alias("volume"))


# ---- refresh with corrections ---------------------------------------------------------------------


def run_batches(updates: DataFrame, take, root: str, mode: str = "append") -> None:
    """Give every batch that has arrived to ``take(batch, number)``; a batch comes again if it was not finished."""
    q = updates.writeStream.foreachBatch(take).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint")
    q.trigger(availableNow=True).start().awaitTermination()


def _bar_table(spark: SparkSession, root: str, keys=("symbol", "date"), seq: str = "seq") -> Versions:
    return Versions(spark, root, tuple(keys), newest(keys, seq))


def current_bars(spark: SparkSession, root: str, keys=("symbol", "date"), seq: str = "seq") -> DataFrame:
    """The bars of a refreshed table: the newest version of every key."""
    return _bar_table(spark, root, keys, seq).current().drop("batch", seq)


def refresh_bars(updates: DataFrame, root: str, keys=("symbol", "date"), seq: str = "seq", compact_every: int | None = COMPACT_EVERY) -> None:
    """Add bar versions from a stream; a later version of a key replaces the earlier one, however old the bar.

    Each batch writes its own folder and overwrites it when it is repeated, so a lost executor or a
    restart in the middle changes nothing. Every ``compact_every`` batches what was there becomes a snapshot.
    """
    table = _bar_table(updates.sparkSession, root, keys, seq)
    run_batches(updates, lambda batch, number: table.add(keep_last(batch, list(keys), [F.col(seq)]), number, compact_every), root)


def monitor_once(updates: DataFrame, root: str, universe: DataFrame, condition: str, params, snapshot: str) -> DataFrame:
    """One scheduled monitor run: take in what arrived, then report on the bars as they are now."""
    from tapeloom.operators.monitor import monitor_rows, sort_report
    from tapeloom.sources.store import export_report

    refresh_bars(updates, root)
    spark = updates.sparkSession
    report = sort_report(monitor_rows(current_bars(spark, root), universe, condition, params, snapshot))
    label = "1430_intraday" if snapshot[11:13] < "16" else "1900_close"
    stamp = snapshot.translate({ord(c): None for c in "-:"}).replace(" ", "_")
    return spark.read.parquet(export_report(report, f"{root}/reports", "opportunities", label, stamp))


# ---- state per symbol -------------------------------------------------------------------------------


def _corrected(outputs: DataFrame, root: str, compact_every: int | None) -> None:
    table = Versions(outputs.sparkSession, root, ("symbol", "date"), newest(("symbol", "date")))
    run_batches(outputs, lambda batch, number: table.add(batch, number, compact_every), root, "update")


def _latest(spark: SparkSession, root: str) -> DataFrame:
    return Versions(spark, root, ("symbol", "date"), newest(("symbol", "date"))).current()


def take_conditions(conditions: DataFrame, root: str, compact_every: int | None = COMPACT_EVERY) -> None:
    """Take in a stream of (symbol, date, condition), in any order."""
    rows = conditions.withColumn("input", F.when(F.col("condition"), 1).otherwise(0))
    _corrected(run_in_order(rows, Fresh()), root, compact_every)


def new_signals(spark: SparkSession, root: str) -> DataFrame:
    """symbol, date, is_new_signal: whether the bar has a condition that the bar before did not have."""
    return _latest(spark, root).select("symbol", "date", (F.col("output") == 1).alias("is_new_signal"))


def take_events(events: DataFrame, root: str, compact_every: int | None = COMPACT_EVERY) -> None:
    """Take in a stream of (symbol, date, event), in any order; the event is the position it sets, or null."""
    _corrected(run_in_order(events.withColumn("input", F.col("event").cast("int")), Latch()), root, compact_every)


def held_positions(spark: SparkSession, root: str) -> DataFrame:
    """symbol, date, signal: the position after each bar."""
    return _latest(spark, root).select("symbol", "date", F.col("output").alias("signal"))
