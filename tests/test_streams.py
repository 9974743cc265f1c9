"""Streams that get their rows in any order against the batch result, and the tables that they correct."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import values
from tapeloom.session import work_dir
from tapeloom.streaming import bars_stream as bs
from tapeloom.streaming.versions import Versions, newest

DAY = dt.date(2023, 12, 28)


def deliver(spark, root, rows, schema, take, **options):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{root}/in")
    take(bs.read_files(spark, f"{root}/in", schema), f"{root}/out", **options)


def positions(marks):
    out, now = [], 0
    for m in marks:
        now = now if m is None else m
        out.append(now)
    return out


def fresh(on):
    return [bool(c) and not (i and on[i - 1]) for i, c in enumerate(on)]


def test_day_one_and_five_before_day_three(spark):
    root = work_dir(spark, "t-order")
    day = lambda d: DAY + dt.timedelta(days=d)
    schema = "symbol string, date date, event int, condition boolean"
    marks, on = {1: 1, 3: -1, 5: None}, {1: True, 3: False, 5: True}
    for part in ((1, 5), (3,)):
        for take, name in ((bs.take_events, "pos"), (bs.take_conditions, "new")):
            deliver(spark, f"{root}/{name}", [("A", day(d), marks[d], on[d]) for d in part], schema, take)
    assert values(bs.held_positions(spark, f"{root}/pos/out"), "signal") == [1, -1, -1]
    assert values(bs.new_signals(spark, f"{root}/new/out"), "is_new_signal") == [True, False, True]


def test_any_order_gives_the_batch_result(spark):
    rng = random.Random(4)
    root = work_dir(spark, "t-any")
    schema = "symbol string, date date, event int, condition boolean"
    bars = {s: [(DAY + dt.timedelta(days=i * 5), rng.choice([None, None, None, 1, -1, 0]), rng.choice([True, False, None])) for i in range(n)] for s, n in (("A", 170), ("B", 40), ("C", 1))}
    rows = [(s, *b) for s, bs_ in bars.items() for b in bs_]
    rng.shuffle(rows)
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        # what came before comes again, so that repeated rows change nothing
        part = rows[a:b] + rows[max(0, a - 3):a] + [("A", None, 1, True)]
        deliver(spark, f"{root}/pos", part, schema, bs.take_events, compact_every=2)
        deliver(spark, f"{root}/new", part, schema, bs.take_conditions, compact_every=2)
    want_pos = [p for s in "ABC" for p in positions([b[1] for b in bars[s]])]
    want_new = [p for s in "ABC" for p in fresh([b[2] for b in bars[s]])]
    assert values(bs.held_positions(spark, f"{root}/pos/out"), "signal") == want_pos
    assert values(bs.new_signals(spark, f"{root}/new/out"), "is_new_signal") == want_new


def test_a_bar_that_is_sent_again_takes_its_place(spark):
    root = work_dir(spark, "t-again")
    schema = "symbol string, date date, event int, version long"
    day = lambda d: DAY + dt.timedelta(days=d)
    deliver(spark, root, [("A", day(0), 1, 1), ("A", day(1), None, 1), ("A", day(2), None, 1)], schema, bs.take_events)
    deliver(spark, root, [("A", day(1), -1, 2)], schema, bs.take_events)
    deliver(spark, root, [("A", day(1), 1, 1), ("A", day(2), 0, 0)], schema, bs.take_events)  # older versions change nothing
    assert values(bs.held_positions(spark, f"{root}/out"), "signal") == [1, -1, -1]


def test_in_date_order_each_bar_is_sent_once(spark):
    root = work_dir(spark, "t-once")
    schema = "symbol string, date date, event int"
    for a in range(0, 30, 10):
        deliver(spark, root, [("A", DAY + dt.timedelta(days=i), 1 if i == 4 else None) for i in range(a, a + 10)], schema, bs.take_events)
    assert spark.read.parquet(f"{root}/out/deltas").count() == 30


def test_late_ticks_and_the_last_window(spark):
    rng = random.Random(7)
    root = work_dir(spark, "t-ticks")
    schema = "event_id long, ts timestamp, event_type string, value double"
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    ticks = [(i, start + dt.timedelta(minutes=rng.randrange(600)), rng.choice("xy"), float(rng.randrange(1000))) for i in range(400)]
    bars = {}
    for t in sorted(ticks, key=lambda t: (t[1], t[0])):  # equal times go by id
        bars.setdefault((t[2], t[1].replace(minute=0)), []).append(t[3])
    rng.shuffle(ticks)
    for a in range(0, 400, 80):
        deliver(spark, root, ticks[a:a + 80], schema, bs.take_ticks, compact_every=2)
    got = {(r["symbol"], r["hour"].astimezone(dt.timezone.utc)): tuple(r[2:]) for r in bs.tick_bars(spark, f"{root}/out").withColumn("hour", F.col("hour")).collect()}
    assert len(got) == len(bars)
    assert sorted(got.values()) == sorted((v[0], v[-1], max(v), min(v), float(len(v))) for v in bars.values())


def test_an_old_correction_replaces_its_bar(spark, frame):
    root = work_dir(spark, "old")
    bars = frame(close=[float(i) for i in range(500)]).withColumn("seq", F.lit(1))
    bars.write.parquet(f"{root}/landed")
    bs.refresh_bars(bs.read_files(spark, f"{root}/landed", bars.schema), root)
    bars.where("close = 50").withColumns({"close": F.lit(-1.0), "seq": F.lit(2)}).write.mode("append").parquet(f"{root}/landed")
    bs.refresh_bars(bs.read_files(spark, f"{root}/landed", bars.schema), root)
    got = values(bs.current_bars(spark, root), "close")
    assert got == [-1.0 if i == 50 else float(i) for i in range(500)]


@pytest.fixture
def table(spark):
    return Versions(spark, work_dir(spark, "t-versions"), ("k",), newest(("k",), "seq"))


def rows_of(table):
    return sorted((r["k"], r["v"]) for r in table.current().collect())


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "k long, v string, seq long")


def test_a_compaction_that_dies_changes_nothing(spark, table):
    assert table.current() is None
    table.add(batch(spark, (1, "a", 1), (2, "b", 1)), 0)
    table.add(batch(spark, (2, "c", 2)), 1)
    want = rows_of(table)
    table.write_snapshot()  # dies before the manifest
    assert rows_of(table) == want == [(1, "a"), (2, "c")] and table._state()[1] is None
    table.compact()
    assert rows_of(table) == want and table._state()[2] == 1
    table.add(batch(spark, (1, "d", 1), (3, "e", 1)), 2)
    table.write_snapshot()  # and again, behind a good one
    assert table._state()[2] == 1 and rows_of(table) == [(1, "d"), (2, "c"), (3, "e")]
    table.compact()
    table.compact()  # nothing new
    assert table._state()[2] == 2 and rows_of(table) == [(1, "d"), (2, "c"), (3, "e")]


def test_a_repeated_batch_overwrites_its_own_rows(spark, table):
    table.add(batch(spark, (1, "a", 1)), 0)
    table.add(batch(spark, (1, "half", 1)), 1)
    table.add(batch(spark, (1, "b", 1), (2, "c", 1)), 1)
    assert rows_of(table) == [(1, "b"), (2, "c")]
    for n in range(2, 9):  # compacts the batches before the current one, which may come again
        table.add(batch(spark, (n % 3, f"v{n}", 1)), n, compact_every=2)
        table.add(batch(spark, (n % 3, f"w{n}", 1)), n, compact_every=2)
    assert rows_of(table) == [(0, "w6"), (1, "w7"), (2, "w8")] and table._state()[2] >= 5


def test_vacuum_keeps_what_counts(spark, table):
    from tapeloom.session import folder_names

    table.vacuum()  # nothing there
    for n in range(4):
        table.add(batch(spark, (n % 2, f"v{n}", 1)), n)
        if n in (1, 2):
            table.compact()
    table.write_snapshot()  # never committed
    want = rows_of(table)
    assert len(folder_names(spark, f"{table.root}/snapshots")) == 3
    table.vacuum()
    assert folder_names(spark, f"{table.root}/deltas") == ["batch=2", "batch=3"] and len(folder_names(spark, f"{table.root}/snapshots")) == 1
    assert rows_of(table) == want == [(0, "v2"), (1, "v3")]
    table.add(batch(spark, (5, "w", 1)), 4)
    table.compact()
    assert rows_of(table) == [*want, (5, "w")]


def test_reads_rank_only_what_later_batches_touched(spark, table):
    table.add(spark.range(1000).selectExpr("id AS k", "'x' AS v", "1L AS seq"), 0)
    table.compact()
    table.add(batch(spark, (5, "y", 1)), 1)
    plan = table.current()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 1 and "LeftAnti" in plan
    assert table.current().where("v = 'y'").count() == 1 and table.current().count() == 1000
