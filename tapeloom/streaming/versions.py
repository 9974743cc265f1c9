"""Tables that streams correct: a snapshot, the batches since then, and a manifest that says which snapshot counts.

    deltas/batch=N      what batch N brought; a repeated batch overwrites its own folder
    snapshots/<name>    all of some batch and those before it, one row per key
    manifests           one small file per compaction: (snapshot, upto); the one with the largest ``upto`` counts

A compaction writes its snapshot first and the manifest last. A job that dies in between leaves a folder that nobody reads;
the next compaction writes its own. Readers merge only the keys that later batches touched. ``vacuum`` deletes what no longer counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.kernels import keep_last
from tapeloom.session import delete_folder, folder_names

#: Batches after which a writer compacts.
COMPACT_EVERY = 20


def newest(keys: Sequence[str], *order: str) -> Callable[[DataFrame], DataFrame]:
    """The merge that keeps the row of the latest batch, then the largest ``order``."""
    return lambda rows: keep_last(rows, list(keys), [F.col("batch"), *[F.col(c) for c in order]])


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


@dataclass(frozen=True)
class Versions:
    """``merge`` takes rows of all batches of some keys (with the column ``batch``) and gives one row per key."""

    spark: SparkSession
    root: str
    keys: tuple[str, ...]
    merge: Callable[[DataFrame], DataFrame]

    def add(self, batch: DataFrame, number: int, compact_every: int | None = COMPACT_EVERY) -> None:
        """Write a batch. Compacts what earlier batches left, which the stream has committed, when there is enough of it."""
        if compact_every:
            deltas, _, upto = self._state()
            if deltas is not None and self._batches(deltas.where(F.col("batch") < number), upto) >= compact_every:
                self.compact(before=number)
        batch.write.mode("overwrite").parquet(f"{self.root}/deltas/batch={number}")

    def _state(self) -> tuple[DataFrame | None, str | None, int]:
        done = _read(self.spark, f"{self.root}/manifests")
        last = done.orderBy(F.desc("upto")).first() if done is not None else None
        return _read(self.spark, f"{self.root}/deltas"), last["snapshot"] if last else None, last["upto"] if last else -1

    @staticmethod
    def _batches(deltas: DataFrame, upto: int) -> int:
        return deltas.where(F.col("batch") > upto).select("batch").distinct().count()

    def current(self, before: int | None = None) -> DataFrame | None:
        """One row per key as all batches (those before one of them) leave it; None before the first batch."""
        deltas, snapshot, upto = self._state()
        if deltas is None:
            return None
        fresh = deltas.where(F.col("batch") > upto)
        if before is not None:
            fresh = fresh.where(F.col("batch") < before)
        if snapshot is None:
            return self.merge(fresh)
        base = self.spark.read.parquet(f"{self.root}/snapshots/{snapshot}")
        touched = fresh.select(*self.keys).distinct()
        again = base.join(touched, list(self.keys), "left_semi").unionByName(fresh.withColumn("batch", F.col("batch").cast("long")))
        return base.join(touched, list(self.keys), "left_anti").unionByName(self.merge(again))

    def write_snapshot(self, before: int | None = None) -> tuple[str, int] | None:
        """A snapshot that doesn't count yet, and the last batch in it; None where no batch is new."""
        deltas, _, upto = self._state()
        if deltas is None:
            return None
        fresh = deltas.where(F.col("batch") > upto)
        if before is not None:
            fresh = fresh.where(F.col("batch") < before)
        last = fresh.agg(F.max("batch")).first()[0]
        if last is None:
            return None
        name = f"upto-{last}-{uuid.uuid4().hex}"
        self.current(before).withColumn("batch", F.lit(last).cast("long")).write.parquet(f"{self.root}/snapshots/{name}")
        return name, last

    def commit(self, snapshot: str, upto: int) -> None:
        done = self.spark.createDataFrame([(snapshot, int(upto))], "snapshot string, upto long")
        done.coalesce(1).write.mode("append").parquet(f"{self.root}/manifests")

    def compact(self, before: int | None = None) -> None:
        written = self.write_snapshot(before)
        if written:
            self.commit(*written)

    def vacuum(self) -> None:
        """Delete batches that the snapshot that counts has in it, and all other snapshots.

        For a time when nobody reads an older state; the writer may go on meanwhile, as it only adds later batches.
        """
        _, snapshot, upto = self._state()
        for name in folder_names(self.spark, f"{self.root}/deltas"):
            number = name.removeprefix("batch=")
            # the last batch stays: its folder tells the columns, and the stream may send it again
            if number.isdigit() and int(number) < upto:
                delete_folder(self.spark, f"{self.root}/deltas/{name}")
        for name in folder_names(self.spark, f"{self.root}/snapshots"):
            if snapshot is not None and name != snapshot:
                delete_folder(self.spark, f"{self.root}/snapshots/{name}")
