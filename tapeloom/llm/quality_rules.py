"""Quality rules and robust multivariate outliers, in DataFrame functions only.

The base rules count words, symbols, repeated lines and repeated five-word windows. The method goes on from these
counts: each document becomes a vector of transformed statistics (word length, symbols, repeated lines, repeated words, distinct
words, each per word and pulled to a typical value in short texts), and for every language and source a minimum covariance
determinant estimate gives centre and scatter: from the coordinatewise medians, concentration steps fit mean and
covariance to the half of the documents that lies nearest by the last estimate, three quarters at the end. A document
whose squared Mahalanobis distance is above the cut-off is rejected: the chi-squared quantile of OUTLIERS, times the factor by which
the covariance of the nearest three quarters of normal rows falls short of that of all.

All statistics are whole numbers (a fixed grid), medians and quantiles come from counts on that grid, and sums are exact, so
that results don't depend on the order of rows. A group of fewer than LEAST documents is judged with the others of
its language that are in such groups; null languages and sources are groups of their own. Scatter has a floor, the noise of one text, so
that statistics which are the same in nearly all documents don't reject a single symbol or line. Null or wordless texts fail the base rules. Repeated rows get the
same verdict and count as often as they come.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.base import let, stored

#: Grid steps to one unit of a statistic.
GRID = 256
#: Documents that a group needs for its own estimate.
LEAST = 200
#: Concentration steps: the share of documents that each fits.
SHARES = (0.5, 0.5, 0.5, 0.75)
STATISTICS = ("word_length", "symbols", "lines", "repeats", "distinct")
#: Least standard deviation of each statistic: the mean of about 100 words; one symbol or repeated line, some repeated words in a text; distinct words of about 100.
FLOORS = (0.04, 0.12, 0.10, 0.12, 0.04)
#: Share of normal rows that the cut-off rejects.
OUTLIERS = 0.001


def _chi2(x: float, d: int) -> float:
    """Distribution function of chi-squared with an odd number of degrees of freedom."""
    term, total = math.sqrt(2 * x / math.pi) * math.exp(-x / 2), 0.0
    for k in range(1, d, 2):
        total += term
        term *= x / (k + 2)
    return math.erf(math.sqrt(x / 2)) - total


def _chi2_quantile(share: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2(middle, d) < share else (low, middle)
    return low


def cutoff_of(share: float, fitted: float, d: int) -> float:
    """Squared distance that a share of normal rows exceeds, by the covariance of the ``fitted`` share nearest to the centre."""
    return _chi2_quantile(1 - share, d) * fitted / _chi2(_chi2_quantile(fitted, d), d + 2)


CUTOFF = cutoff_of(OUTLIERS, SHARES[-1], len(STATISTICS))
SPACES = r"[\x20\x09-\x0D]+"


def _repeat_words(words: Column) -> Column:
    """Words within five-word windows that come twice or more, each once.

    Windows are sorted by hash with their places; places whose window has an equal neighbour are sorted again, and the words
    that they cover are added up from left to right.
    """
    places = F.sequence(F.lit(0), F.size(words) - 5)
    windows = F.transform(places, lambda i: F.struct(F.xxhash64(F.slice(words, i + 1, 5)).alias("h"), i.alias("i")))

    def covered(sorted_windows):
        n = F.size(sorted_windows)
        at = lambda k: F.get(sorted_windows, k)["h"]
        twice = F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.coalesce(at(k) == at(k + 1), F.lit(False)) | F.coalesce(at(k) == at(k - 1), F.lit(False)))
        starts = F.array_sort(F.transform(twice, lambda k: F.get(sorted_windows, k)["i"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(starts, zero, lambda a, p: F.struct((p + 5).alias("end"), (a["n"] + 5 - F.greatest(F.lit(0), a["end"] - p)).alias("n")), lambda a: a["n"])

    return F.when(F.size(words) < 6, 0).otherwise(let(F.array_sort(windows), covered)).cast("long")


def text_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_distinct of a text (null: empty)."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        ))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def statistics() -> list[Column]:
    """Transformed statistics on the grid; a few words more of a typical text keep short texts from the edges."""
    n = F.col("n_words") + 20
    values = [
        F.log((F.col("word_chars") + 110) / n),
        F.asinh(10 * F.col("n_symbols") / n),
        F.asinh(20 * F.col("n_dup_lines") / n),
        F.asinh(5 * F.col("n_repeat_words") / n),
        F.log((F.col("n_distinct") + 20) / F.sqrt(n * 20)),
    ]
    return [F.round(v * GRID).cast("long").alias(name) for v, name in zip(values, STATISTICS, strict=True)]


def _quantile(counts: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """The smallest value below which a share of the rows lies, from (keys, value, n)."""
    w = Window.partitionBy(*keys)
    run = F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("run", run).withColumn("all", F.sum("n").over(w)).where(F.col("run") >= share * F.col("all")).groupBy(*keys).agg(F.min(value).alias(name))


def _inverse(s: list[list[Column]]) -> tuple[list[str], list[tuple[str, Column]]]:
    """Steps (name, expression) of the Cholesky factor of a matrix of columns, to be added one by one."""
    d, steps = len(s), []
    low = [[None] * d for _ in range(d)]
    for j in range(d):
        for i in range(j, d):
            rest = s[i][j]
            for k in range(j):
                rest = rest - low[i][k] * low[j][k]
            name = f"l{i}{j}"
            steps.append((name, F.sqrt(rest) if i == j else rest / low[j][j]))
            low[i][j] = F.col(name)
    return [f"l{i}{j}" for i in range(d) for j in range(i + 1)], steps


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution, in let form so that each coordinate is computed once."""
    solved: list[Column] = []
    d = len(STATISTICS)

    def step(i: int) -> Column:
        if i == d:
            return sum((y * y for y in solved[1:]), solved[0] * solved[0])
        rest = F.col(STATISTICS[i]) / float(GRID) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * solved[k]

        def go(y):
            solved.append(y)
            return step(i + 1)

        return let(rest / F.col(f"l{i}{i}"), go)

    return step(0)


def _moments(rows: DataFrame) -> DataFrame:
    """Mean and Cholesky factor of the covariance for each group, from exact sums."""
    d = len(STATISTICS)
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(STATISTICS)]
    sums += [F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"p{i}{j}") for i in range(d) for j in range(i + 1)]
    out = rows.groupBy("group").agg(F.count("*").alias("n"), *sums)
    for i in range(d):
        out = out.withColumn(f"m{i}", F.col(f"s{i}") / F.col("n") / float(GRID))
    floor = lambda i, j: F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0)
    matrix = [[F.col(f"p{i}{j}") / F.col("n") / float(GRID * GRID) - F.col(f"m{i}") * F.col(f"m{j}") + floor(i, j) for j in range(i + 1)] for i in range(d)]
    names, steps = _inverse(matrix)
    for name, value in steps:
        out = out.withColumn(name, value)
    return out.select("group", *[f"m{i}" for i in range(d)], *names)


def _start(rows: DataFrame) -> DataFrame:
    """Medians, with the spread of a median absolute deviation on the diagonal."""
    d = len(STATISTICS)
    long = lambda values: F.explode(F.array(*[F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(values)])).alias("x")
    count = lambda df: df.groupBy("group", "x.i", "x.v").agg(F.count("*").alias("n"))
    middle = _quantile(count(rows.select("group", long([F.col(c) for c in STATISTICS]))), ["group", "i"], "v", 0.5, "v")
    centre = stored(middle.groupBy("group").agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"c{i}") for i in range(d)]), "centre")
    away = rows.join(centre, "group").select("group", long([F.abs(F.col(c) - F.col(f"c{i}")) for i, c in enumerate(STATISTICS)]))
    spread = _quantile(count(away), ["group", "i"], "v", 0.5, "v")
    spread = spread.groupBy("group").agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"d{i}") for i in range(d)])
    cols = [(F.col(f"c{i}") / float(GRID)).alias(f"m{i}") for i in range(d)]
    cols += [(F.sqrt(F.pow(1.4826 * F.col(f"d{i}") / GRID, 2) + FLOORS[i] ** 2) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(d) for j in range(i + 1)]
    return centre.join(spread, "group").select("group", *cols)


def _nearest(rows: DataFrame, share: float) -> DataFrame:
    """The share of each group's rows with the smallest distance, ties included, by a fine grid of the logarithm."""
    level = F.round(F.log(F.col("distance") + 1e-6) * 64).cast("long")
    rows = rows.withColumn("level", level)
    cut = _quantile(rows.groupBy("group", "level").agg(F.count("*").alias("n")), ["group"], "level", share, "cut")
    cut = stored(cut, "cut")  # one row per group: its size is known before the join with the rows
    return rows.join(cut, "group").where("level <= cut")


def robust_estimates(rows: DataFrame) -> DataFrame:
    """Minimum covariance determinant centre and factor of each group of (group, statistics)."""
    estimate = stored(_start(rows), "estimate")
    for share in SHARES:
        near = _nearest(rows.join(estimate, "group").withColumn("distance", _distance()).select("group", *STATISTICS, "distance"), share)
        estimate = stored(_moments(near), "estimate")
    return estimate


def rule_verdicts(docs: DataFrame, cutoff: float = CUTOFF, carry: bool = False) -> DataFrame:
    """Counts, base_failed, distance and kept of every row of ``docs`` (doc_id, text, lang, source); with ``carry`` also its struct ``row``."""
    counted = docs.select("doc_id", "lang", "source", text_counts(F.col("text")).alias("c"), *([_row_key().alias("key")] if carry else []))
    counted = counted.select("doc_id", "lang", "source", "c.*", *(["key"] if carry else [])).withColumn("base_failed", base_failed())
    rows = counted.select("*", *statistics())
    rows = stored(rows, "statistics")
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("size"))
    small = F.col("size") < LEAST
    groups = sizes.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), F.xxhash64("lang", F.when(~small, F.col("source")), F.when(small, 1).otherwise(0)).alias("group"))
    groups = stored(groups, "groups")
    rows = rows.join(groups, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))).drop("of_lang", "of_source")
    # documents that the base rules reject don't shape the estimates
    estimates = robust_estimates(rows.where("not base_failed").select("group", *STATISTICS))
    judged = rows.join(estimates, "group", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    judged = judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept", *(["key"] if carry else []))


def _row_key() -> Column:
    """A hash of all that a verdict depends on; the hash of Spark passes over nulls, so that they are said apart."""
    columns = ["doc_id", "text", "lang", "source"]
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def keep_by_rules(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep."""
    rejected = rule_verdicts(docs, cutoff, carry=True).where("not kept").select("key").distinct()
    rejected = stored(rejected, "rejected").withColumnRenamed("key", "_rejected_key")
    rows = docs.select(F.struct(*docs.columns).alias("row"), _row_key().alias("key"))
    return rows.join(rejected, F.col("key") == F.col("_rejected_key"), "left_anti").select("row.*")
