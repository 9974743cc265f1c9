"""Centroid clustering of vectors in whole numbers, with the equal-average equal-variance search for the nearest centroid.

For vectors x, c of d components with component sums S and deviations V = sqrt(sum (x_i - mean)^2)

    |x - c|^2 >= (S_x - S_c)^2 / d + (V_x - V_c)^2

Centroids lie sorted by component mean. The search of a vector starts at its own mean and goes outward, always to the nearer of
the next centroids on both sides: once the first term alone exceeds the best distance, all that follow are out (equal
average); a centroid whose two terms exceed it is passed over (equal variance); the rest are compared component by component in
64-bit integers. Both bounds are tested with a margin wider than any rounding, and only a greater bound rejects, so that ties go to the
smaller number as in a full search. The vectors of a batch take their steps together.

A round is one pass: tasks send their exact sums, at most one row of each centroid and task, and only the k sums come to the driver.
Assignments are never moved; vectors are turned into integers once and read from the written table by each round.

Odd rows: vectors that are null, of another length or hold null or non-finite components are left out. A null vec_id takes part
but starts a centroid only if other rows don't suffice; rows that share a vec_id start in the order of their components. With fewer
than k vectors there are as many centroids; an empty table gives no rows. Equal centroids: the smaller number gets the vectors, the
other stays as it is. A component of more than 2^26 in absolute value (a quarter of a million in the floating vector) is an error, as
distances would leave the range of a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.base import stored

#: Whole numbers to one unit of a component.
SCALE = 256
#: Largest component, so that 64 squares of differences and the sums of any table stay within a long.
LARGEST = 1 << 26
#: Vectors that take their steps together.
BATCH = 4096


def whole_vectors(vectors: DataFrame, size: int = 64) -> DataFrame:
    """vec_id and q (array of longs) of the vectors with exactly ``size`` finite components."""
    fits = (F.size("embedding") == size) & F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is above infinity
    number = lambda x: F.floor(x.cast("double") * SCALE)
    rows = vectors.select("vec_id", "embedding").where(F.coalesce(fits, F.lit(False)))
    far = F.exists("embedding", lambda x: F.abs(x.cast("double")) * SCALE > LARGEST)
    checked = F.when(far, F.raise_error(F.lit(f"a vector has a component beyond {LARGEST // SCALE}"))).otherwise(F.transform("embedding", number))
    return rows.select("vec_id", checked.cast("array<long>").alias("q"))


def first_centroids(whole: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``seed:vec_id``."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = whole.select("q", key.alias("key")).orderBy(F.asc_nulls_last("key"), "q").limit(k).collect()
    return np.array([r["q"] for r in rows], np.int64)


class Search:
    """Nearest centroids of many vectors; ``compared`` counts the distances that were computed."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        sums = centroids.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.sums = sums[self.order]
        self.sorted = centroids[self.order]
        self.deviation = self._deviation(self.sorted)
        self.compared = 0

    @staticmethod
    def _deviation(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.sqrt(((x - x.mean(axis=1, keepdims=True)) ** 2).sum(axis=1))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row; ties go to the smaller number."""
        rows, d, k = len(x), x.shape[1], len(self.order)
        sums, deviation = x.sum(axis=1), self._deviation(x)
        up = np.searchsorted(self.sums, sums)
        down = up - 1
        best, number = np.full(rows, np.iinfo(np.int64).max), np.full(rows, k)
        left = np.arange(rows)
        for _ in range(k):
            if not len(left):
                break
            above = np.where(up[left] < k, np.abs(self.sums[np.minimum(up[left], k - 1)] - sums[left]), np.iinfo(np.int64).max)
            below = np.where(down[left] >= 0, np.abs(self.sums[np.maximum(down[left], 0)] - sums[left]), np.iinfo(np.int64).max)
            go_up = above <= below
            at = np.where(go_up, up[left], down[left])
            apart = np.minimum(above, below)
            # equal average: nobody further out can be nearer
            reach = np.floor(np.sqrt(best[left].astype(np.float64) * d) * (1 + 1e-9)).astype(np.float64) + 1
            inside = apart <= reach
            left, at, apart, go_up = left[inside], at[inside], apart[inside], go_up[inside]
            up[left[go_up]] += 1
            down[left[~go_up]] -= 1
            # equal variance
            own, theirs = deviation[left], self.deviation[at]
            bound = apart.astype(np.float64) ** 2 / d + (own - theirs) ** 2
            margin = 1e-9 * (own + theirs + 1) ** 2 + 1e-9 * bound
            near = bound - margin <= best[left]
            rest, at = left[near], at[near]
            self.compared += len(rest)
            apart = x[rest] - self.sorted[at]
            distance = np.einsum("ij,ij->i", apart, apart)
            index = self.order[at]
            better = (distance < best[rest]) | ((distance == best[rest]) & (index < number[rest]))
            best[rest[better]], number[rest[better]] = distance[better], index[better]
        return number.astype(np.int32), best


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("q"))
    return column.flatten().to_numpy().reshape(batch.num_rows, -1)


def _cluster_sums(whole: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, n, exact sum of each component) of the vectors nearest to each centroid."""
    k, d = centroids.shape

    def run(batches):
        search = Search(centroids)
        n, total = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                x = _matrix(batch.slice(start, BATCH))
                number, _ = search.nearest(x)
                n += np.bincount(number, minlength=k)
                np.add.at(total, number, x)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(n[held]), *[pa.array(total[held, j]) for j in range(d)]],
                                         ["cluster", "n", *[f"s{j}" for j in range(d)]])

    names = [f"s{j}" for j in range(d)]
    part = whole.select("q").mapInArrow(run, "cluster int, n long, " + ", ".join(f"{c} long" for c in names))
    return part.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).collect()


def fit_centroids(whole: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> np.ndarray:
    """The centroids after ``rounds`` of assignment and exact, floored means; those without vectors stay."""
    centroids = first_centroids(whole, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = centroids.copy()
        for cluster, n, *sums in _cluster_sums(whole, centroids):
            centroids[cluster] = np.array(sums, np.int64) // n  # of numpy: rounds down
    return centroids


def assign(whole: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared) of every vector."""

    def run(batches):
        search = Search(centroids)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                number, distance = search.nearest(_matrix(part))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return whole.select("vec_id", "q").mapInArrow(run, f"vec_id {dict(whole.dtypes)['vec_id']}, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, size: int = 64, k: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept row of ``vectors`` (vec_id, embedding)."""
    whole = stored(whole_vectors(vectors, size), "whole")
    centroids = fit_centroids(whole, k, rounds, seed)
    schema = f"vec_id {dict(whole.dtypes)['vec_id']}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    spark = vectors.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], schema)
    found = stored(assign(whole, centroids), "found")
    # one row of each centroid: k rows at most
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    rows = [(c, s, sum(sums.values()), digest(centroids[c])) for c, s in sums.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql_twin(size: int = 64, k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    """The same by a full search, round by round."""
    square = f"list_sum(list_transform(range(1, {size + 1}), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))"
    ctes = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), q) - 1 AS cluster, q FROM v ORDER BY 1 LIMIT {k})",
    ]
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT any_value(vec_id) AS vec_id, any_value(q) AS q, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM "
                    f"(SELECT v.rid, v.vec_id, v.q, c.cluster, {square} AS d FROM (SELECT row_number() OVER () AS rid, * FROM v) v, c{r} c) GROUP BY rid)")
        if r < rounds:
            mean = f"list_transform(range(1, {size + 1}), lambda i: (s[i] - ((s[i] % n) + n) % n) // n)"
            ctes += [
                f"m{r} AS (SELECT cluster, count(*) AS n, [{', '.join(f'sum(q[{i}])::BIGINT' for i in range(1, size + 1))}] AS s FROM a{r} GROUP BY cluster)",
                f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, CASE WHEN n IS NULL THEN c.q ELSE {mean} END AS q FROM c{r} c LEFT JOIN m{r} USING (cluster))",
            ]
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, a.cluster::INTEGER AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c USING (cluster)"""


SQL_TWIN = sql_twin()
