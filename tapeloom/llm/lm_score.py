"""Cross-entropy difference of two matched bigram models.

Target and background are counted over all documents with one shared vocabulary, the words of the corpus themselves, so that
the models grow with it. Both have the same order and smoothing, and the counts of both are scaled to the same mass, so
that a difference of losses does not come from the size of the corpora.

    p(w | v) = (c(v, w) + A p(w)) / (c(v) + A),  p(w) = (c(w) + B / V) / (N + B)

No task and no broadcast holds a model. Documents are dealt to chunks of some 8 MB of text by a hash of their id, their texts
compressed. A chunk sends each of its distinct words and word pairs once, as a hash with its counts: sorted, cut into as
many ranges of hashes as the corpus needs, one row of packed numbers for each range. The chunks' rows of one range meet,
learn the sums, and a reply goes back to every chunk, which then scores its documents. A reply leaves out the grams of
that chunk alone, whose counts the chunk knows. Chunks and ranges grow in number with the corpus, not in size.

The score is the mean over the words of log p_target - log p_background, the background's loss less the target's.
Documents without words (or null) have 0 words and a score of 0. Rows are judged one by one, repeated rows alike; a row
without an id is never a target. Without any target text its loss is that of the smoothing alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.base import CHUNK_BYTES, mapped, stored
from tapeloom.llm.words import SPACE, joined, pair_hashes, separators, word_hashes

#: Bytes of text whose documents are counted and scored together; chunks whose grams meet in one range.
DEALT_BYTES, CHUNKS_A_RANGE = 1 << 23, 2
#: Weights of the shorter history (A, B above).
BACK_OFF, FLOOR = 8.0, 1000.0
#: Stands for the start of a text.
START = np.uint64(1)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers of 64 bits, byte by byte from the highest, compressed: sorted or small ones take little."""
    return pa.Codec("zstd", 1).compress(numbers.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes(), asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 8 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(">u8").ravel().astype(np.uint64)


def squeezed(docs: DataFrame) -> DataFrame:
    """doc_id, the compressed text and its bytes, which are null for a null text."""

    def kernel(batch):
        codec = pa.Codec("zstd", 1)
        texts = batch.column(1).cast(pa.binary())
        small = [None if t is None else codec.compress(t, asbytes=True) for t in texts.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(small, pa.binary()), pc.binary_length(texts).cast(pa.int64())], ["doc_id", "small", "size"])

    return mapped(docs.select("doc_id", "text"), kernel, f"doc_id {dict(docs.dtypes)['doc_id']}, small binary, size long")


def text_grams(small: list[bytes | None], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every word of all texts: its text, its hash, whether it opens the text, and the hash of it and the word before."""
    part = np.cumsum(sizes) // CHUNK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    out = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.uint64))]
    codec = pa.Codec("zstd")
    for a, b in zip(cuts[:-1], cuts[1:]):
        data, begins = joined([codec.decompress(t, int(n), asbytes=True) if n else b"" for t, n in zip(small[a:b], sizes[a:b])])
        words, owner = word_hashes(data, begins, separators(SPACE))
        if len(words):
            opens = np.concatenate([[True], owner[1:] != owner[:-1]])
            before = np.where(opens, START, np.concatenate([words[:1], words[:-1]]))
            out.append((owner + a, words, opens, pair_hashes(before, words)))
    return tuple(np.concatenate(x) for x in zip(*out))


class Chunk:
    """The documents of one chunk, its distinct grams in order, and their counts under target and background."""

    def __init__(self, table: pa.Table):
        is_doc = table["is_doc"]
        named = table.filter(pc.invert(is_doc))["doc_id"]
        docs = table.filter(is_doc)
        self.doc_id = docs["doc_id"]
        target = pc.fill_null(pc.is_in(self.doc_id, value_set=named.combine_chunks()), False).to_numpy()
        target = target & pc.is_valid(self.doc_id).to_numpy()
        self.owner, word, opens, pair = text_grams(docs["small"].to_pylist(), pc.fill_null(docs["size"], 0).to_numpy())
        n, starts = len(word), np.flatnonzero(opens)
        self.grams, place = np.unique(np.concatenate([word, pair, np.full(len(starts), START)]), return_inverse=True)
        del word, pair
        self.word, self.pair = place[:n], place[n:2 * n]
        self.before = np.concatenate([place[:1], place[:max(n - 1, 0)]])[:n]
        self.before[starts] = place[2 * n:]
        self.is_word = np.zeros(len(self.grams), bool)
        self.is_word[self.word] = True
        aimed = target[self.owner]
        aimed = np.concatenate([aimed, aimed, aimed[starts]])
        self.counts = np.stack([np.bincount(place[aimed], minlength=len(self.grams)), np.bincount(place, minlength=len(self.grams))])

    def ranges(self, n_ranges: int) -> np.ndarray:
        """Where each range of hashes begins among the grams, and their number."""
        ends = np.array([((r << 64) + n_ranges - 1) // n_ranges for r in range(1, n_ranges)], np.uint64)
        return np.concatenate([[0], np.searchsorted(self.grams, ends), [len(self.grams)]])


def dealt(docs: DataFrame, targets: DataFrame, n_chunks: int) -> DataFrame:
    """Documents and the ids of the targets, side by side in the chunks of their ids; rows without an id by their text."""
    kind = dict(docs.dtypes)["doc_id"]
    named = targets.select(F.col("doc_id").cast(kind).alias("doc_id")).where("doc_id is not null").distinct()
    none = [F.lit(None).cast(t) for t in ("binary", "long")]
    both = squeezed(docs).withColumn("is_doc", F.lit(True)).union(named.select("doc_id", *none, F.lit(False)))
    by = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("small"))
    return both.withColumn("chunk", F.pmod(by, F.lit(n_chunks)))


def gram_counts(rows: DataFrame, n_ranges: int) -> DataFrame:
    """The distinct grams of every chunk with the chunk's counts, one row for each range of hashes that it has grams of."""

    def count(table: pa.Table) -> pa.Table:
        c, chunk = Chunk(table), table["chunk"][0].as_py()
        at = c.ranges(n_ranges)
        out = []
        for r in np.flatnonzero(np.diff(at)).tolist():
            cut = slice(at[r], at[r + 1])
            out.append((chunk, r, int(at[r + 1] - at[r]), *[packed(x[cut]) for x in (c.grams, c.is_word, *c.counts)]))
        return pa.Table.from_arrays([pa.array([x[i] for x in out], pa.int64() if i < 3 else pa.binary()) for i in range(7)],
                                    ["chunk", "span", "n", "grams", "is_word", "target", "background"])

    return rows.groupBy("chunk").applyInArrow(count, "chunk long, span long, n long, grams binary, is_word binary, target binary, background binary")


def corpus_counts(counts: DataFrame) -> DataFrame:
    """The reply to every row of counts: which of its grams other chunks have too, and these grams' sums.

    One more row for each range, without a chunk, has the range's distinct words (``n``) and the sums of their counts.
    """

    def add(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_pylist()
        grams, is_word, target, background = (np.concatenate([unpacked(d, n) for d, n in zip(table[c].to_pylist(), sizes)]) for c in ("grams", "is_word", "target", "background"))
        kinds, place, seen = np.unique(grams, return_inverse=True, return_counts=True)
        sums = [np.bincount(place, x.astype(float), len(kinds)).astype(np.int64) for x in (target, background)]
        shared = seen[place] > 1
        out, start = [], 0
        for chunk, n in zip(table["chunk"].to_pylist(), sizes):
            mine = shared[start:start + n]
            at = place[start:start + n][mine]
            out.append((chunk, n, len(at), packed(mine), packed(sums[0][at]), packed(sums[1][at]), 0, 0))
            start += n
        words = np.zeros(len(kinds), bool)
        words[place[is_word > 0]] = True
        out.append((None, int(words.sum()), 0, None, None, None, int(sums[0][words].sum()), int(sums[1][words].sum())))
        names = ["chunk", "n", "n_shared", "shared", "target", "background", "target_words", "background_words"]
        cols = [pa.array([x[i] for x in out], pa.binary() if i in (3, 4, 5) else pa.int64()) for i in range(8)]
        return pa.Table.from_arrays([*cols, pa.repeat(table["span"][0], len(out))], [*names, "span"])

    return counts.groupBy("span").applyInArrow(
        add, "chunk long, n long, n_shared long, shared binary, target binary, background binary, target_words long, background_words long, span long")


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, dealt_bytes: int = DEALT_BYTES) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss, score of every row of ``docs``; ``targets`` (doc_id) names the target texts."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    n_chunks = size // dealt_bytes + 1
    n_ranges = n_chunks // CHUNKS_A_RANGE + 1
    rows = dealt(docs, targets, n_chunks)
    replies = stored(corpus_counts(gram_counts(rows, n_ranges)), "counts")
    total = replies.where("chunk is null").agg(F.sum("target_words"), F.sum("background_words"), F.sum("n")).first()
    sums = np.array([total[0] or 0, total[1] or 0], float)
    mass = min((s for s in sums if s > 0), default=1.0)
    scale, kinds = mass / np.maximum(sums, 1), max(total[2] or 0, 1)

    def score(table: pa.Table, sent: pa.Table) -> pa.Table:
        c = Chunk(table)
        at = c.ranges(n_ranges)
        for r, n, k, shared, *found in zip(*(sent[x].to_pylist() for x in ("span", "n", "n_shared", "shared", "target", "background"))):
            places = at[r] + np.flatnonzero(unpacked(shared, n))
            for row, data in zip(c.counts, found):
                row[places] = unpacked(data, k)
        n = np.bincount(c.owner, minlength=len(c.doc_id))
        loss = np.zeros((2, len(c.doc_id)))
        for k in range(2):
            seen = c.counts[k] * scale[k]
            single = (seen[c.word] + FLOOR / kinds) / (sums[k] * scale[k] + FLOOR)
            p = (seen[c.pair] + BACK_OFF * single) / (seen[c.before] + BACK_OFF)
            loss[k] = np.bincount(c.owner, -np.log(p), len(c.doc_id)) / np.maximum(n, 1)
        return pa.table({"doc_id": c.doc_id, "n_words": n, "target_loss": loss[0], "background_loss": loss[1], "score": loss[1] - loss[0]})

    kind = dict(docs.dtypes)["doc_id"]
    back = replies.where("chunk is not null").select("chunk", "span", "n", "n_shared", "shared", "target", "background")
    return rows.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(score, f"doc_id {kind}, n_words long, target_loss double, background_loss double, score double")
