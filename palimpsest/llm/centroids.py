"""Exact integer k-means whose search rejects centroids by their mean and deviation.

Centroids are sorted by the mean of their components.  A vector's search starts at the centroid whose
mean is nearest to its own and goes outward on both sides; the next centroid is always the nearer of
the two ends.  With d components, means m and deviations v (root of the summed squares round the mean),

    |x - c|^2 >= d (m_x - m_c)^2                        the search ends: all further ones are worse
    |x - c|^2 >= d (m_x - m_c)^2 + (v_x - v_c)^2        this centroid is passed over

Only the others have their distance computed, in 64-bit integers, so ties and sums are exact; the bounds
are rounded down by far more than their error.  Each round reads the staged integer vectors once, adds
up by centroid within tasks, and moves ``k`` x ``d`` sums to the driver; nothing else leaves the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.vectors import clean, matrix, pieces, width
from palimpsest.llm.words import Shared
from palimpsest.scratch import stage

CENTROIDS, ROUNDS, SCALE, DIMENSION = 40, 5, 256, 64
LIMIT = 1 << 27  # with at most 256 components a squared distance stays below 2^64
SAFE = 1 - 1e-9  # of a bound, against rounding


class Means:
    """The centroids sorted by the sum of their components, with deviations."""

    def __init__(self, centroids: np.ndarray):
        totals = centroids.sum(axis=1)
        self.numbers = np.argsort(totals, kind="stable")
        self.vectors, self.totals = centroids[self.numbers], totals[self.numbers]
        self.deviations = deviation(self.vectors, self.totals)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of each row's centroid, its squared distance, and how many distances were computed."""
        n, d = x.shape
        k = len(self.totals)
        totals = x.sum(axis=1)
        own = deviation(x, totals)
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        right = np.searchsorted(self.totals, totals)  # next centroid to the right; left is the one before
        left = right - 1
        live, computed = np.arange(n), 0
        while len(live):
            a, b, total = left[live], right[live], totals[live]
            far = np.iinfo(np.int64).max
            down = np.where(a >= 0, np.abs(total - self.totals[np.maximum(a, 0)]), far)
            up = np.where(b < k, np.abs(self.totals[np.minimum(b, k - 1)] - total), far)
            step, go_up = np.minimum(down, up), up < down
            bound = step.astype(np.float64) ** 2 / d * SAFE
            on = (step < far) & (bound <= best[live])
            live, at = live[on], np.where(go_up, b, a)[on]
            bound, go_up = bound[on], go_up[on]
            right[live[go_up]] += 1
            left[live[~go_up]] -= 1
            near = bound + (own[live] - self.deviations[at]) ** 2 * SAFE - 1e-3 <= best[live]
            rows, at = live[near], at[near]
            computed += len(rows)
            apart = x[rows] - self.vectors[at]
            distance = np.einsum("ij,ij->i", apart, apart)
            names = self.numbers[at]
            closer = (distance < best[rows]) | ((distance == best[rows]) & (names < number[rows]))
            best[rows[closer]], number[rows[closer]] = distance[closer], names[closer]
        return number, best, computed


def deviation(x: np.ndarray, totals: np.ndarray) -> np.ndarray:
    apart = x - (totals / x.shape[1])[:, None]
    return np.sqrt(np.einsum("ij,ij->i", apart, apart))


def integers(found: Iterator[pa.RecordBatch], kind: str, scale: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(found):
        whole = np.clip(np.floor(np.clip(matrix(batch.column("body"), kind), -1e30, 1e30) * scale), -LIMIT, LIMIT)
        bodies = pa.array([x.tobytes() for x in whole.astype("<i4")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), bodies], names=["vec_id", "body"])


def whole(batch: pa.RecordBatch) -> np.ndarray:
    return matrix(batch.column("body"), "<i4").astype(np.int64)


def sums(found: Iterator[pa.RecordBatch], means: Shared) -> Iterator[pa.RecordBatch]:
    """By centroid the number of vectors (place -1) and the sums of their components."""
    held: Means = means.value
    k, d = held.vectors.shape
    total = np.zeros((k, d + 1), np.int64)
    for batch in pieces(found):
        x = whole(batch)
        if len(x):
            number, _, _ = held.nearest(x)
            np.add.at(total[:, 1:], number, x)
            total[:, 0] += np.bincount(number, minlength=k)
    cluster, place = np.nonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(cluster.astype(np.int32)), pa.array((place - 1).astype(np.int32)), pa.array(total[cluster, place])],
        names=["cluster", "place", "total"])


def assigned(found: Iterator[pa.RecordBatch], means: Shared) -> Iterator[pa.RecordBatch]:
    for batch in pieces(found):
        if batch.num_rows:
            number, distance, _ = means.value.nearest(whole(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)],
                names=["vec_id", "cluster", "distance"])


def moved(centroids: np.ndarray, found: list) -> np.ndarray:
    """Floor of the mean of each centroid's vectors; one without vectors stays."""
    new = [[int(x) for x in row] for row in centroids]
    counts = {r["cluster"]: int(r["total"]) for r in found if r["place"] < 0}
    for cluster in counts:
        new[cluster] = [0] * centroids.shape[1]
    for r in found:
        if r["place"] >= 0:
            new[r["cluster"]][r["place"]] = int(r["total"]) // counts[r["cluster"]]
    return np.array(new, np.int64)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dimension: int = DIMENSION,
            salt: str = "2:", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector taken.

    Taken are vectors of exactly ``dimension`` components (at most 256), none null or non-finite.  A
    component x becomes ``floor(scale * x)``; beyond 2^27 either way it counts as 2^27, so that distances
    fit in a long.  The first centroids are the ``k`` vectors with the smallest SHA-256 of ``salt`` and
    vec_id (all, if there are fewer; ties: the smaller vector; rows without a vec_id last).  Equal distances
    go to the smaller number.  Repeated rows count and are returned as often as they occur.  Sums that do
    not fit in a long are null.  An empty table gives no row; other columns are ignored.
    """
    spark, kind = vectors.sparkSession, "<f4" if width(vectors, vector) == 4 else "<f8"
    taken = clean(vectors, vec_id, vector).filter(F.col("dim") == dimension)
    rows = stage(taken.mapInArrow(lambda found: integers(found, kind, scale), "vec_id bigint, body binary"), "centroid-rows")
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    first = rows.orderBy(order, "body").limit(k).collect()
    centroids = np.frombuffer(b"".join(bytes(r["body"]) for r in first), "<i4").reshape(-1, dimension).astype(np.int64)
    if not len(first):
        centroids = np.zeros((1, dimension), np.int64)
    for _ in range(rounds):
        means = Shared(spark, Means(centroids))
        added = rows.select("body").mapInArrow(lambda found, m=means: sums(found, m), "cluster int, place int, total bigint")
        added = added.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        centroids = moved(centroids, added.collect())
    means = Shared(spark, Means(centroids))
    out = stage(rows.mapInArrow(lambda found: assigned(found, means), "vec_id bigint, cluster int, distance bigint"),
                "centroid-assigned")
    inertia = {r["cluster"]: int(r["total"]) for r in
               out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    long = lambda x: x if x < 1 << 63 else None
    hashes = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    facts = spark.createDataFrame(
        [(c, long(total), long(sum(inertia.values())), hashes[c]) for c, total in inertia.items()],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select(  # k rows at most
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12(vectors: DataFrame) -> DataFrame:
    return cluster(vectors)


def op12_sql(rounds: int = ROUNDS) -> str:
    apart = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS HUGEINT)))"
    parts = [f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding,
    lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {DIMENSION}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSION}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x FROM v
    ORDER BY sha256('2:' || vec_id), x LIMIT {CENTROIDS})"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, any_value(v.x) AS x, min(struct_pack(d := {apart}, c := c.c)) AS near
    FROM v, c{i} c GROUP BY vec_id)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT near.c AS c, unnest(x) AS y, generate_subscripts(x, 1) AS p FROM a{i}),
m{i} AS (SELECT c, p, CAST((sum(y) - (sum(y) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS y FROM s{i} GROUP BY c, p),
n{i} AS (SELECT c, list(y ORDER BY p) AS x FROM m{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN n{i} USING (c))""")
    last = f"a{rounds}"
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(near.c AS INTEGER) AS cluster, CAST(near.d AS BIGINT) AS distance,
    CAST(sum(near.d) OVER (PARTITION BY near.c) AS BIGINT) AS cluster_inertia,
    CAST(sum(near.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM {last} JOIN c{rounds} c ON c.c = near.c"""


OP12_SQL = op12_sql()
