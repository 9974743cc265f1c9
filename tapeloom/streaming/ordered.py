"""State machines over bars that may come in any order: a late bar corrects what followed it.

Each symbol keeps its bars in the state, one packed chunk a year: day, input, version and last output of each bar. A bar that
comes late is put in its place, and the machine runs again from there until its state is what it was before; only rows whose output
is new or different are sent on. So a stream in date order sends each bar once, a late one sends itself and the bars
that it changes, and the latest output of every bar is that of a batch run, whatever the order and the batches were. No
row is too late; the state grows by 14 bytes a bar, and a batch reads and writes the years that it touches.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Input of a bar without an event.
NOTHING = -128
EPOCH = dt.date(1970, 1, 1).toordinal()
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_KEY = "spark.sql.streaming.stateStore.providerClass"


@dataclass(frozen=True)
class Fresh:
    """1 where the input is 1 and that of the bar before isn't; the state is the last input."""

    start: int = 0

    def run(self, inputs: np.ndarray, state: int) -> np.ndarray:
        return ((inputs == 1) & (np.concatenate([[state], inputs[:-1]]) != 1)).astype(np.int8)

    def state(self, last_input: int, last_output: int) -> int:
        return 1 if last_input == 1 else 0


@dataclass(frozen=True)
class Latch:
    """The last event so far; the state is the position."""

    start: int = 0

    def run(self, inputs: np.ndarray, state: int) -> np.ndarray:
        at = np.where(inputs != NOTHING, np.arange(len(inputs)), -1)
        last = np.maximum.accumulate(at)
        return np.where(last >= 0, inputs[np.maximum(last, 0)], state).astype(np.int8)

    def state(self, last_input: int, last_output: int) -> int:
        return int(last_output)


class Chunk:
    """The bars of one year of one symbol, in order."""

    kinds = (np.int32, np.int8, np.int64, np.int8)

    def __init__(self, packed=None):
        packed = packed or (b"",) * 4
        self.days, self.inputs, self.versions, self.outputs = (np.frombuffer(p, k) for p, k in zip(packed, self.kinds, strict=True))

    def packed(self) -> tuple[bytes, ...]:
        return tuple(x.astype(k).tobytes() for x, k in zip((self.days, self.inputs, self.versions, self.outputs), self.kinds, strict=True))

    def merged(self, days: np.ndarray, inputs: np.ndarray, versions: np.ndarray) -> Chunk:
        """With new bars: the larger version of a day counts, of equal versions the one that came later."""
        every = np.concatenate([self.days, days])
        came = np.concatenate([np.zeros(len(self.days), int), np.ones(len(days), int)])
        value = np.concatenate([self.inputs, inputs])
        version = np.concatenate([self.versions, versions])
        order = np.lexsort((value, came, version, every))
        last = order[np.append(every[order][1:] != every[order][:-1], True)]
        out = Chunk()
        out.days, out.inputs, out.versions = every[last], value[last].astype(np.int8), version[last]
        return out


class InOrder(StatefulProcessor):
    """Runs a machine over the bars of one symbol; see the module."""

    def __init__(self, machine):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.years = handle.getMapState("years", "year int", "days binary, inputs binary, versions binary, outputs binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        days, years = new["day"].to_numpy(np.int32), new["year"].to_numpy(np.int32)
        inputs, versions = new["input"].to_numpy(np.int8), new["version"].to_numpy(np.int64)
        held = sorted(int(y[0]) for y in self.years.keys())
        todo = sorted(set(held) | set(years.tolist()))
        first, last = int(years.min()), int(years.max())
        before = [y for y in held if y < first]
        state = self.machine.start
        if before:
            chunk = Chunk(self.years.getValue((before[-1],)))
            state = self.machine.state(chunk.inputs[-1], chunk.outputs[-1])
        out = []
        for year in (y for y in todo if y >= first):
            old = Chunk(self.years.getValue((year,)) if year in held else None)
            here = years == year
            chunk = old.merged(days[here], inputs[here], versions[here])
            chunk.outputs = self.machine.run(chunk.inputs, state)
            spot = np.searchsorted(old.days, chunk.days)
            known = np.isin(chunk.days, old.days)
            changed = ~known
            changed[known] = old.outputs[spot[known]] != chunk.outputs[known]
            if changed.any():
                dates = [dt.date.fromordinal(EPOCH + int(d)) for d in chunk.days[changed]]
                out.append(pd.DataFrame({"symbol": key[0], "date": dates, "output": chunk.outputs[changed].astype("int32")}))
            self.years.updateValue((year,), chunk.packed())
            was = self.machine.state(old.inputs[-1], old.outputs[-1]) if len(old.days) else None
            state = self.machine.state(chunk.inputs[-1], chunk.outputs[-1])
            if year >= last and was == state:
                break
        if out:
            yield pd.concat(out, ignore_index=True)

    def close(self) -> None:
        pass


def run_in_order(rows: DataFrame, machine) -> DataFrame:
    """symbol, date, output of a stream of (symbol, date, input int, null: nothing, and optionally version long).

    A bar that is sent again takes the place of the one before unless its version is smaller. Rows without a date have no place and
    are left out. Sets the session's state store to RocksDB, which this kind of state needs.
    """
    rows.sparkSession.conf.set(STORE_KEY, STORE)
    version = F.coalesce(F.col("version").cast("long"), F.lit(0).cast("long")) if "version" in rows.columns else F.lit(0).cast("long")
    light = rows.where("date is not null").select(
        "symbol", F.unix_date("date").alias("day"), F.year("date").alias("year"), F.coalesce(F.col("input"), F.lit(NOTHING)).alias("input"), version.alias("version"))
    return light.groupBy("symbol").transformWithStateInPandas(
        InOrder(machine), outputStructType="symbol string, date date, output int", outputMode="update", timeMode="none")
