"""How five filters interact: what each removes, alone and behind the others, in every order of application.

Failure conditions of a text (null: empty; words: runs of bytes other than 0x20 and 0x09-0x0D, case-sensitive):

A   fewer than 200 words
B   100 * distinct words < 50 * words
C   100 * characters A-Z > 3 * code points
D   any character of ``#$%&*|``
E   identical to the text of any smaller doc_id of the whole table, removed or not

The counts behind A to D come from one pass of a table-driven transducer over the UTF-8 bytes: a byte's class and the state
before it (between words or inside one) name the next state and what the byte adds to the counts. The state after a byte
depends on its class alone, so that a whole batch runs through the tables at once. The pass marks the spans of words,
which go into an open-addressing hash table of (text, word); a slot's owner is compared byte by byte, eight at a time,
before a word counts as seen, so that no collision of hashes hides a word.

From there on only flags travel: rows that repeat text and doc_id are counted together, the smallest doc_id of each text (by
SHA-256) is met by (text, doc_id), labels by doc_id after rows of one doc_id were counted together, and a part has at most
32 sets of failed filters, from which all orders follow. No key, however hot, brings more than one row a task and set to a join.

Odd rows: a null text is an empty one; a null doc_id never fails E and has no labels; a null lang is the part ''. Rows of one
doc_id count each, and of equal rows none is a duplicate of the other (their doc_id isn't smaller). Of several labels of a
doc_id any 1 counts. An empty table has no parts and gives no rows. A text of any length is one unit of work for a task,
with some ten times its bytes of memory. Only the named columns are read, so that further columns may have any name.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.base import mapped, stored
from tapeloom.llm.words import joined, mix

FILTERS = "ABCDE"
LEAST_WORDS = 200
SYMBOLS = b"#$%&*|"

# ---- the transducer: classes of bytes, states, and what a byte adds in a state
SPACE, PLAIN, CAPITAL, SYMBOL, INNER = range(5)
BETWEEN, INSIDE = 0, 1
START, END, IS_CAPITAL, IS_SYMBOL, IS_POINT = 1, 2, 4, 8, 16


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of a byte, next state by state and class, output bits by state and class)."""
    kind = np.full(256, PLAIN, np.uint8)
    kind[[0x20, *range(0x09, 0x0E)]] = SPACE
    kind[0x41:0x5B] = CAPITAL
    kind[list(SYMBOLS)] = SYMBOL
    kind[0x80:0xC0] = INNER  # bytes of a code point after its first
    following = np.full((2, 5), INSIDE, np.uint8)
    following[:, SPACE] = BETWEEN
    out = np.zeros((2, 5), np.uint8)
    out[:, [SPACE, PLAIN, CAPITAL, SYMBOL]] |= IS_POINT
    out[:, CAPITAL] |= IS_CAPITAL
    out[:, SYMBOL] |= IS_SYMBOL
    out[BETWEEN, PLAIN:] |= START
    out[INSIDE, SPACE] |= END
    return kind, following, out


KIND, FOLLOWING, OUTPUT = _tables()
#: Words of more bytes are kept in a set of byte strings.
LONG_WORD = 64
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def run_transducer(data: np.ndarray) -> np.ndarray:
    """Output bits of every byte; the state before the first is BETWEEN."""
    kind = KIND[data]
    # the next state is the same from either state, so that each byte's is known without those before it
    state = np.empty(len(data), np.uint8)
    state[:1], state[1:] = BETWEEN, FOLLOWING[BETWEEN][kind[:-1]]
    return OUTPUT.ravel()[state * np.uint8(5) + kind]


def distinct_words(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Distinct words of each text, by a hash table whose hits are verified on the bytes."""
    counts = np.zeros(texts, np.int64)
    long = lens > LONG_WORD
    if long.any():
        seen = {(int(t), data[s:s + n].tobytes()) for t, s, n in zip(owner[long], starts[long], lens[long], strict=True)}
        counts += np.bincount([t for t, _ in seen], minlength=texts)
        starts, lens, owner = starts[~long], lens[~long], owner[~long]
    if not len(starts):
        return counts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data),), "<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on

    def piece(words: np.ndarray, j: int) -> np.ndarray:
        return eight[starts[words] + 8 * j] & _MASK[np.minimum(lens[words] - 8 * j, 8)]

    every = np.arange(len(starts))
    head = piece(every, 0)
    key = mix(head + mix(owner.astype(np.uint64) * np.uint64(128) + lens.astype(np.uint64)))
    pieces = -(-int(lens.max()) // 8)
    for j in range(1, pieces):
        more = np.flatnonzero(lens > 8 * j)
        key[more] = mix(key[more] + piece(more, j))
    size = 1 << int(2 * len(starts)).bit_length()
    slot = (key & np.uint64(size - 1)).astype(np.int64)
    table, left = np.full(size, -1, np.int64), every
    while len(left):
        at = slot[left]
        free = table[at] < 0
        table[at[free]] = left[free]  # of several words for one free slot the last gets it
        holder = table[at]
        same = (owner[holder] == owner[left]) & (lens[holder] == lens[left]) & (head[holder] == head[left])
        for j in range(1, pieces):
            check = np.flatnonzero(same & (lens[left] > 8 * j))
            if not len(check):
                break
            same[check] = piece(holder[check], j) == piece(left[check], j)
        counts += np.bincount(owner[left[holder == left]], minlength=texts)
        left = left[~same]
        slot[left] = (slot[left] + 1) & (size - 1)
    return counts


def text_counts(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """words, distinct words, capitals, symbols and code points of each text."""
    data, begins = joined(texts, lower=False)  # a space ends each text and every word with it
    out = run_transducer(data)
    starts = np.flatnonzero(out & START)
    lens = np.flatnonzero(out & END) - starts
    owner = np.searchsorted(begins, starts, side="right") - 1
    total = lambda bit: np.add.reduceat((out & bit) != 0, begins, dtype=np.int64)
    return {"words": np.bincount(owner, minlength=len(texts)), "distinct": distinct_words(data, starts, lens, owner, len(texts)),
            "capitals": total(IS_CAPITAL), "symbols": total(IS_SYMBOL), "points": total(IS_POINT) - 1}


def failed_filters(texts: list[bytes | None]) -> np.ndarray:
    """Bits of the filters A to D that each text fails."""
    c = text_counts(texts)
    failed = [c["words"] < LEAST_WORDS, 100 * c["distinct"] < 50 * c["words"], 100 * c["capitals"] > 3 * c["points"], c["symbols"] > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(failed))


def document_flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, failed (bits of A to D), digest (of the text) of every row."""

    def kernel(batch):
        failed = failed_filters(batch.column(3).cast(pa.binary()).to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(failed, pa.int32())], ["doc_id", "part", "digest", "failed"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    return mapped(rows, kernel, f"doc_id {dict(docs.dtypes)['doc_id']}, part string, digest binary, failed int")


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (bits of all five filters), n, good, toxic: documents of each part by the set of filters that they fail."""
    flags = document_flags(docs).groupBy("digest", "doc_id", "part", "failed").agg(F.count("*").alias("n"))
    flags = stored(flags, "flags")
    least = flags.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("first"))
    met = flags.join(least, ["digest", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    by_id = met.groupBy("doc_id", "part", (F.col("failed") + F.when(copy, 16).otherwise(0)).alias("failed")).agg(F.sum("n").alias("n"))
    marks = labels.where("quality = 1 or toxic = 1").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    of = lambda mark: F.sum(F.when(F.col(mark), F.col("n")).otherwise(0)).alias(mark)
    return by_id.join(marks, "doc_id", "left").groupBy("part", "failed").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def _bits(letters: Column) -> Column:
    return sum((F.when(F.contains(letters, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for every part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A document falls to the first of its failed filters; of all 120 orders each of k failed filters comes first in 120 / k.
    """
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = failure_counts(docs, labels).select("*", F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    rows = rows.withColumns({"before": _bits(F.expr("left(filter_order, step - 1)")), "own": _bits(F.expr("substring(filter_order, step, 1)"))})
    fails, earlier = F.col("failed").bitwiseAND(F.col("own")) != 0, F.col("failed").bitwiseAND(F.col("before")) != 0
    total = lambda when, n=F.col("n"): F.sum(F.when(when, n).otherwise(0)).cast("long")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"),
        total(F.col("failed") == F.col("own")).alias("unique_fails"), total(fails & ~earlier, F.col("good")).alias("good_lost"),
        total(fails & ~earlier, F.col("toxic")).alias("toxic_lost"),
        total(fails, F.expr("n * (120 div greatest(bit_count(failed), 1))")).alias("shapley"))


SQL_TWIN = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE) AS copy FROM d),
f AS (SELECT doc_id, part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
             regexp_matches(t, '[#$%&*|]'), copy] AS fails FROM w),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 3, 4, 5]) AS i),
p AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS seq FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT filter_order, seq, unnest([1, 2, 3, 4, 5]) AS step FROM p),
r AS (SELECT part, filter_order, step, seq[step] AS filter, n, good, toxic, fails[seq[step]] AS own,
             len(list_filter(seq[1:step - 1], lambda i: fails[i])) > 0 AS earlier, len(list_filter(fails, lambda b: b)) AS k FROM c, s),
g AS (SELECT part, filter_order, step, any_value(filter) AS filter,
             coalesce(sum(n) FILTER (NOT own AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (own AND NOT earlier), 0) AS removed,
             coalesce(sum(n) FILTER (own AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (own AND k = 1), 0) AS unique_fails,
             coalesce(sum(good) FILTER (own AND NOT earlier), 0) AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT earlier), 0) AS toxic_lost
      FROM r GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM g
"""
