"""Tables on shared storage: the bar store, plain save and load, report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.session import work_dir

# fixed values: accepted spellings of the adjust mode; empty means raw
RAW_MODES = ("", "none", "raw", "bfq", "unadjusted")
ADJUST_MODES = ("qfq", "hfq")


def adjust_label(mode: str | None) -> str:
    text = "hfq" if mode is None else str(mode).strip().lower()
    if text in RAW_MODES:
        return "raw"
    if text in ADJUST_MODES:
        return text
    raise ValueError(f"Unsupported adjust_mode: {mode}. Expected one of hfq, qfq, none.")


def save_bars(bars: DataFrame, root: str, source: str, data_type: str = "price", mode: str | None = "hfq") -> None:
    """Append bars under their source, type and adjust mode; a reader of one of them prunes the rest."""
    parts = {"source": source, "data_type": data_type, "adjust_mode": adjust_label(mode)}
    out = bars.withColumns({k: F.lit(v) for k, v in parts.items()})
    out.write.mode("append").partitionBy(*parts).parquet(root)


def load_bars(spark: SparkSession, root: str, source: str, data_type: str = "price", mode: str | None = "hfq") -> DataFrame:
    df = spark.read.parquet(root)
    return df.where((F.col("source") == source) & (F.col("data_type") == data_type) & (F.col("adjust_mode") == adjust_label(mode)))


FORMATS = ("csv", "parquet")


def save(df: DataFrame, path: str, fmt: str = "csv", **options) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt}")
    writer = df.write.mode("overwrite").options(**options)
    (writer.option("header", "true").csv if fmt == "csv" else writer.parquet)(path)


def load(spark: SparkSession, path: str, fmt: str = "csv", schema: str | None = None, **options) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt}")
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.option("header", "true").csv(path) if fmt == "csv" else reader.parquet(path)


def export_report(report: DataFrame, root: str, name: str, label: str, snapshot: str) -> str:
    """Write a report under its run label and snapshot, and again as the latest one."""
    report.write.mode("overwrite").parquet(f"{root}/{name}/run_label={label}/snapshot={snapshot}")
    latest = f"{root}/latest_{name}"
    report.write.mode("overwrite").parquet(latest)
    return latest


def through_table(df: DataFrame, label: str) -> DataFrame:
    """The same rows from a written table: a step that later steps read more than once, or after a loss."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
