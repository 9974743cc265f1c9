"""Mixing sources to target weights by Poisson replication.

A source with target share w and n of all N characters has the mean repetition rate w N / n (times ``epochs``). Every
document is repeated k times, k being the Poisson quantile at a uniform number that a hash of its id and the seed gives:
the same for every run, whatever the partitions. The copies are shuffled globally by the hash of id, copy and seed.
Rates above ``RATE_STEP`` are sums of draws with smaller rates, as exp(-rate) would vanish.

Without given weights, a source's share is its share of characters to the power ``power``, normed: rare sources gain, no
source vanishes. Sources without a given weight have none and go. Null sources are one source; null texts have no
characters; sources without characters keep their rate of ``epochs``. Rows that repeat a doc_id draw the same number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.base import stored

RATE_STEP = 32.0


def _uniform(*parts):
    """A number in (0, 1) from the first 12 hex digits of an md5."""
    digits = F.substring(F.md5(F.concat_ws("/", *parts)), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.7, epochs: float = 1.0) -> DataFrame:
    """(source, rate, draws, cdf): one row per source; cdf lists the distribution of one of the draws."""
    sizes = docs.groupBy("source").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("double").alias("n"))
    if weights is None:
        sizes = sizes.withColumn("w", F.pow("n", F.lit(power)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        sizes = sizes.join(F.broadcast(given), "source", "left").fillna(0.0, ["w"])
    all_n, all_w = sizes.agg(F.sum("n"), F.sum("w")).first()
    rate = F.when(F.col("n") > 0, epochs * F.col("w") / F.lit(all_w) * F.lit(all_n) / F.col("n")).otherwise(F.lit(epochs))
    rates = sizes.select("source", rate.alias("rate"))
    rates = rates.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / RATE_STEP)).cast("int")).withColumn("step", F.col("rate") / F.col("draws"))
    # terms of the distribution of a rate of 32 at most end before 128
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(128)), F.struct(F.exp(-F.col("step")).alias("p"), F.array(F.exp(-F.col("step"))).alias("cdf")),
        lambda a, k: F.struct((a["p"] * F.col("step") / k).alias("p"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * F.col("step") / k)).alias("cdf")))
    return rates.withColumn("cdf", terms["cdf"]).drop("step")


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.7, epochs: float = 1.0, seed: int = 0) -> DataFrame:
    """(row, copy): the rows of ``docs`` (doc_id, text, source and any others) as structs, each as often as drawn, in a global random order."""
    # one row per source: written, so that its size is known to the planner
    rates = stored(repetition_rates(docs, weights, power, epochs), "rates").withColumnRenamed("source", "of")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), "source")
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    total = F.aggregate(
        F.sequence(F.lit(1), F.col("draws")), F.lit(0),
        lambda acc, j: acc + F.size(F.filter("cdf", lambda c: c < _uniform(name, j.cast("string"), F.lit(str(seed))))))
    drawn = rows.join(rates, F.col("source").eqNullSafe(F.col("of"))).withColumn("times", F.when(F.col("rate") > 0, total).otherwise(0))
    copies = drawn.where("times > 0").select("row", "id", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    return copies.orderBy(F.xxhash64("id", "copy", F.lit(seed)), "id", "copy").select("row", "copy")


SQL_TWIN = """
WITH sizes AS (SELECT source, CAST(coalesce(sum(length(text)), 0) AS DOUBLE) AS n FROM documents GROUP BY source),
sums AS (SELECT sum(n) AS all_n, sum(pow(n, 0.7)) AS all_w FROM sizes),
rates AS (SELECT source, CASE WHEN n > 0 THEN pow(n, 0.7) / all_w * all_n / n ELSE 1.0 END AS rate FROM sizes, sums),
steps AS (SELECT *, rate / draws AS step FROM (SELECT *, CAST(greatest(1, ceil(rate / 32.0)) AS INT) AS draws FROM rates)),
terms AS (SELECT source, draws, k, sum(exp(k * ln(step) - step - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
          FROM steps, range(0, 129) AS r(k)),
cdfs AS (SELECT source, any_value(draws) AS draws, list(cdf ORDER BY k) AS cdf FROM terms GROUP BY source),
draws AS (SELECT d.doc_id, d.text, d.lang, d.source, CAST(list_sum(list_transform(range(1, c.draws + 1), lambda j: len(list_filter(c.cdf, lambda x: x <
              (CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || '/' || j || '/0'), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)))) AS BIGINT) AS times
          FROM documents d JOIN cdfs c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, lang, source, md5(coalesce(text, '')) AS text_md5, CAST(unnest(range(1, times + 1)) AS INT) AS copy FROM draws WHERE times > 0
"""
