"""Connected components of a link table, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.base import stored


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest node next to them: the larger neighbours of every node, or its smaller ones and itself."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if large:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        hung = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        low = down.groupBy("u").agg(F.min("v").alias("low"))
        hung = down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v")))
    return hung.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``links`` (u, v: long) reaches. Nodes without links don't appear.

    Alternating stars; each round is written, and the rounds end when a round changes nothing.
    """
    now = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(sums) == mark:
            break
        mark = tuple(sums)
        now = stored(_stars(_stars(now, True), False), "links", now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
