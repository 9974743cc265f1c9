"""Consistent weighted sampling of documents, in DataFrame functions only.

A text is a multiset of words; a word's weight w is its count. For each of SAMPLES draws, a hash of word and draw gives r and
c from Gamma(2, 1) and b from Uniform(0, 1); with t = floor(ln w / r + b), a = c exp(-r (t - b) - r) is the same
for all texts where the word's weight falls into the same step. The smallest a of a text is its sample, and the chance
that two texts have the same sample is their generalised Jaccard similarity, sum of minima over sum of maxima. ln a stands for
the pair (word, t): it is a function of the two.

Texts of a block of neighbouring ids lie in one partition from the start, so that words are counted and samples taken
without another exchange. Words are [^\\x20\\x09-\\x0D]+. Null texts are empty; texts without words have the fingerprint of
nothing, alike only to itself. Equal texts have equal fingerprints. Rows that repeat a doc_id stand in order of their text's
hash; null ids come first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.base import stored

SAMPLES = 40
#: Documents to a block, on average.
BLOCK = 256
INTERVALS = 64
#: Rows that one task may order by itself.
ALONE = 65_536


def following(keys: DataFrame) -> DataFrame:
    """(key, next_key) of distinct keys (long): the next larger one, null after the last.

    Keys are cut into cells of equal width and ordered within them; the last key of a cell is followed by the first of the
    next cell that has any, which the same step finds among the far fewer first keys.
    """
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if n <= ALONE:
        return keys.select("key", F.lead("key").over(Window.partitionBy(F.lit(0)).orderBy("key")).alias("next_key"))
    width = max(1, (high - low + 1) * 4096 // n)
    cells = keys.withColumn("cell", F.floor((F.col("key") - F.lit(low)) / F.lit(width)))
    within = cells.withColumn("next_key", F.lead("key").over(Window.partitionBy("cell").orderBy("key")))
    firsts = stored(cells.groupBy("cell").agg(F.min("key").alias("key")), "firsts")
    after = following(firsts.select("key")).join(firsts, "key").select("cell", F.col("next_key").alias("after"))
    return within.join(after, "cell").select("key", F.coalesce("next_key", "after").alias("next_key"))


def _samples(word, weight, n: int) -> list:
    """ln a for each of n draws of one weighted word."""
    out, low = [], float(1 << 32)
    log_w = F.log(weight)
    for i in range(n):
        first, second = F.xxhash64(word, F.lit(2 * i)), F.xxhash64(word, F.lit(2 * i + 1))
        unit = lambda bits: (bits + 0.5) / low
        high32, low32 = lambda h: F.shiftrightunsigned(h, 32).cast("double"), lambda h: h.bitwiseAND(0xFFFFFFFF).cast("double")
        r = -F.log(unit(high32(first)) * unit(low32(first)))
        c = -F.log(unit(high32(second)) * unit(low32(second)))
        b = unit(F.xxhash64(first, second).bitwiseAND(0xFFFFFFFF).cast("double"))
        out.append(F.log(c) - r * (F.floor(log_w / r + b) - b) - r)
    return out


def fingerprint_of(lows: list):
    """Eight hex digits for each sample."""
    return F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(x).bitwiseAND(0xFFFFFFFF))), 8, "0") for x in lows])


def likeness(a, b):
    """Share of equal samples of two fingerprints."""
    same = sum((F.substring(a, 8 * i + 1, 8) == F.substring(b, 8 * i + 1, 8)).cast("int") for i in range(SAMPLES))
    return same / float(SAMPLES)


def _block_of(docs: DataFrame):
    """Number of a block of neighbouring ids: cells of equal width within INTERVALS of about equal counts.

    Any cut gives the same results, so that estimated bounds will do; no block can hold more than an interval.
    """
    n = docs.count()
    bounds = sorted({int(x) for x in docs.approxQuantile("doc_id", [i / INTERVALS for i in range(INTERVALS + 1)], 0.001)}) or [0]
    cells = max(1, n // (INTERVALS * BLOCK))
    widths = [max(1, -(-(b - a) // cells)) for a, b in zip(bounds, [*bounds[1:], bounds[-1] + 1], strict=True)]
    low, width = F.array(*map(F.lit, bounds)).cast("array<long>"), F.array(*map(F.lit, widths)).cast("array<long>")
    # a sum of comparisons, not a lambda: Spark sees that both readers of the blocks want the same exchange, and makes one
    at = sum(((F.col("doc_id") >= b).cast("int") for b in bounds[1:]), F.lit(0))
    cell = F.greatest(F.lit(0), F.floor((F.col("doc_id") - F.get(low, at)) / F.get(width, at)))
    return F.coalesce(at.cast("long") * (1 << 32) + cell, F.lit(-1))


def _blocks(docs: DataFrame) -> DataFrame:
    """Rows by blocks of neighbouring ids, with a copy of the next block's first row as the last of each (``own`` is False)."""
    block = _block_of(docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("block", block).withColumn("tie", F.xxhash64("text"))
    # one row for each block: the first of its documents
    heads = rows.groupBy("block").agg(F.min(F.struct("doc_id", "tie")).alias("head"))
    heads = stored(heads, "heads")
    nexts = stored(following(heads.select(F.col("block").alias("key"))), "nexts")
    first = heads.agg(F.min("block")).first()[0]
    before = nexts.select(F.coalesce("next_key", F.lit(first)).alias("block"), F.col("key").alias("before"), F.col("next_key").isNull().alias("wraps"))
    lead = stored(heads.join(before, "block").select(F.col("block").alias("of"), "before", "wraps", "head"), "lead")
    edge = rows.join(lead, (F.col("block") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("tie") == F.col("head.tie")))
    edge = edge.dropDuplicates(["of"]).select("doc_id", "text", F.col("before").alias("block"), "tie", F.lit(False).alias("own"))
    # one text per block; read from a table, both readers of the blocks have the same plan and share its exchange
    return rows.withColumn("own", F.lit(True)).unionByName(stored(edge, "edge"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document."""
    order = Window.partitionBy("block").orderBy(F.desc("own"), F.col("doc_id").asc_nulls_first(), "tie")
    rows = _blocks(docs).repartition("block")
    after = F.lead("text").over(order)
    rows = rows.withColumn("next_text", after).withColumn("seq", F.row_number().over(order))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - F.col("half")).cast("int"))
    rows = rows.withColumn("edited", F.concat(kept, F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), F.col("half"))))
    facts = rows.where("own").select("block", "seq", "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("t"))))
    texts = rows.select("block", "seq", "own", both.alias("x")).where("own or x.v = 0").select("block", "seq", "x.v", "x.t")
    words = texts.select("block", "seq", "v", F.explode(F.split("t", "[\\x20\\x09-\\x0D]+")).alias("word"))
    counted = words.groupBy("block", "seq", "v", F.when(F.col("word") != "", F.xxhash64("word")).alias("word")).agg(F.count("*").alias("weight"))
    lows = [F.min(F.when(F.col("word").isNotNull(), s)).alias(f"s{i}") for i, s in enumerate(_samples(F.col("word"), F.col("weight").cast("double"), SAMPLES))]
    prints = counted.groupBy("block", "seq", "v").agg(*lows)
    prints = prints.select("block", "seq", "v", fingerprint_of([F.col(f"s{i}") for i in range(SAMPLES)]).alias("fingerprint"))
    line = Window.partitionBy("block").orderBy("seq", "v")
    prints = prints.withColumn("edited_fingerprint", F.lead("fingerprint", 1).over(line)).withColumn("next_fingerprint", F.lead("fingerprint", 2).over(line)).where("v = 0")
    return facts.join(prints, ["block", "seq"]).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"))
