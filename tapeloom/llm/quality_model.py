"""Supervised subword embeddings: a text classifier learned by stochastic gradient descent.

A text's features are its words and its character n-grams within words, hashed into a table of ``buckets`` learned vectors;
a text is the mean of the vectors of its features, and a softmax over two classes gives the score. Learning reads a
bounded sample of the labelled rows: ``per_class`` ids of each label at most, those with the smallest hash, and one text of each: of an
id with several the one that hashes lowest. It
is done in numpy by one task, on hashed features alone, by rows in a fixed random order with a falling rate. As the output
is linear in the vectors, scoring needs one number per bucket, so that each task reads a text once and adds up.

Labels: rows without a doc_id or label are ignored; a doc_id with both labels counts as 1. Rows held out (crc32 of the id as
text mod 5 is 0) are never learned from. Null texts are empty; an empty text scores by the bias alone. If one label
has no rows to learn from, every score is the share of label 1 (0.5 without any). Repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.base import mapped
from tapeloom.llm.words import SPACE, joined, mix, separators, word_hashes

BITS, WIDTH, NGRAMS = 16, 8, (3, 4)
#: Labelled rows of each class to learn from, passes over them (more where they come to fewer steps than these), and the rate they begin with.
PER_CLASS, PASSES, STEPS, RATE = 3000, 6, 18_000, 2.0
THRESHOLD = 0.3
_POINTS = np.uint64(0x9E3779B97F4A7C15)


def features(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the text) of all words and of the n-grams of characters that have no space between other characters."""
    texts = [t or "" for t in texts]
    data, begins = joined([t.encode() for t in texts], lower=False)
    sep = separators(SPACE)
    words, owner = word_hashes(data, begins, sep)
    cut = np.uint64(64 - bits)
    buckets, owners = [(words >> cut).astype(np.int32)], [owner]
    points = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le"), "<u4")
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    space = np.zeros(len(points), bool)
    low = points < 33
    space[low] = sep[points[low]]
    flat = np.where(space, np.uint32(32), points).astype(np.uint64)
    for n in NGRAMS:
        if len(flat) < n:
            continue
        h = np.zeros(len(flat) - n + 1, np.uint64)
        for j in range(n):
            h = h * _POINTS + flat[j:len(flat) - n + 1 + j]
        inner = np.zeros(len(h), bool)
        for j in range(1, n - 1):
            inner |= space[j:j + len(h)]
        inner |= space[:len(h)] & space[n - 1:]
        at = np.flatnonzero(~inner)
        buckets.append((mix(h[at] + np.uint64(n)) >> cut).astype(np.int32))
        owners.append(np.searchsorted(begins, at, side="right") - 1)
    return np.concatenate(buckets), np.concatenate(owners)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, width: int = WIDTH, passes: int = PASSES, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, float]:
    """Learn from (buckets, counts, label); returns the log odds per bucket and the bias."""
    labels = [r[2] for r in rows]
    if len(set(labels)) < 2:
        share = float(np.clip(np.mean(labels), 0.01, 0.99)) if labels else 0.5
        return np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / width, 1 / width, (1 << bits, width))
    out, bias = np.zeros((2, width)), np.zeros(2)
    # both labels weigh the same
    weight = {y: len(labels) / (2 * labels.count(y)) for y in (0, 1)}
    passes = max(passes, -(-STEPS // len(rows)))
    steps, step = passes * len(rows), 0
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            buckets, counts, y = rows[i]
            speed = rate * (1 - step / steps) * weight[y]
            step += 1
            if not len(buckets):
                continue
            share = counts / counts.sum()
            hidden = share @ vectors[buckets]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            vectors[buckets] -= speed * share[:, None] * (p @ out)
            out -= 0.1 * speed * p[:, None] * hidden
            bias -= 0.02 * speed * p
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Fit on a bounded sample: at most ``per_class`` labelled documents of each class, without the held-out ones."""
    named = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # the sample is as large at any size; documents that earlier stages dropped are no longer there, so that fewer may be found
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [named.where(F.col("quality") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    sample = sample.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))

    def kernel(batch):
        bucket, owner = features(batch.column(1).to_pylist())
        order = np.lexsort((bucket, owner))
        bucket, owner = bucket[order], owner[order]
        new = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])])) if len(bucket) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate([new, [len(bucket)]])).astype(np.int32)
        cuts = np.searchsorted(owner[new], np.arange(batch.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(cuts), pa.array(bucket[new])), pa.ListArray.from_arrays(pa.array(cuts), pa.array(count))],
                                         ["doc_id", "quality", "buckets", "counts"])

    rows = mapped(sample.select("doc_id", "text", F.col("quality").cast("int").alias("quality")), kernel, "doc_id long, quality int, buckets array<int>, counts array<int>")

    def fit(batches):
        examples = []
        for batch in batches:
            buckets, counts = batch.column(2), batch.column(3)
            for doc_id, y, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), range(batch.num_rows), strict=True):
                examples.append((doc_id, np.array(buckets[i].values), np.array(counts[i].values, np.float32), y))
        examples.sort(key=lambda r: r[0])  # so that the rows' order doesn't count
        odds, bias = train([r[1:] for r in examples])
        yield pa.RecordBatch.from_arrays([pa.array([odds.tolist()], pa.list_(pa.float32())), pa.array([bias])], ["odds", "bias"])

    # one task learns from the bounded sample; the driver gets one number per bucket
    model = rows.repartition(1).mapInArrow(fit, "odds array<float>, bias double").first()
    return (np.array(model["odds"], np.float32), model["bias"]) if model else train([])


def score_texts(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(row, score): ``docs`` (row, text) with the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS numbers

    def kernel(batch):
        odds, bias = shared.value
        bucket, owner = features(batch.column(1).to_pylist())
        n = np.maximum(np.bincount(owner, minlength=batch.num_rows), 1)
        z = np.bincount(owner, odds[bucket], batch.num_rows) / n + bias
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-z)))], ["row", "score"])

    return mapped(docs, kernel, f"row {docs.schema['row'].dataType.simpleString()}, score double")


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text)."""
    model = learn(docs, labels)
    scored = score_texts(docs.select(F.col("doc_id").alias("row"), "text"), model)
    return scored.select(F.col("row").alias("doc_id"), held_out(F.col("row")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least the threshold."""
    model = learn(docs, labels)
    scored = score_texts(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    return scored.where(F.col("score") >= threshold).select("row.*")
