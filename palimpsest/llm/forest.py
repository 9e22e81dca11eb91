"""Nearest neighbours by cosine from a forest of random-projection trees.

Every node of a tree cuts its part of the space at the median of a random projection; the nodes of one
level of a tree share the direction, so a tree is its few directions and one threshold a node.  Thresholds
are fitted on a sample of ``SAMPLE`` vectors at most, each tree in its own task; all vectors are indexed.

A query searches all trees through one priority queue of nodes.  The priority of a node is the largest
amount by which the query lies on the wrong side of a cut above it; the near child of a node has its
parent's priority, so going down level by level with the ``leaves`` best nodes of all trees is the same
as taking nodes from the queue one by one, and does it for all queries of a batch at once.

How many leaves a query opens is not fixed: ``PROBES`` vectors are compared with all others, which shows
how deep in their queues their true neighbours lie, and the depth at which ``target`` of these are found
is used for all queries.  Data of low dimension thus open few leaves, data without structure many.

Vectors of the leaves opened are compared exactly.  Leaf and queries meet in tasks of at most ``ROOM`` rows
by ``ROOM`` queries: a larger leaf or more queries are dealt over several such tasks, so nothing is left out.
Equal vectors are one entry that carries its smallest ids, as many as a result can show.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.vectors import clean, matrix, pieces, width
from palimpsest.llm.words import Shared
from palimpsest.operators.copies import top_rows
from palimpsest.scratch import stage

TREES, LEAF, DEEPEST = 8, 1024, 17
SAMPLE = 1 << 20  # of vectors; a tree's task gets one float a level of each
PROBES = 256
ROOM = 4096
NEIGHBOURS, TARGET = 5, 0.97


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, safe for components of any size."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Forest:
    """Trees over vectors of one length: ``directions`` (trees, levels, d), ``cuts`` (trees, 2^levels - 1)."""

    def __init__(self, directions: np.ndarray, cuts: np.ndarray | None = None):
        self.directions = directions
        self.trees, self.levels = directions.shape[:2]
        self.cuts = cuts if cuts is not None else np.zeros((self.trees, (1 << self.levels) - 1))

    @classmethod
    def drawn(cls, d: int, held: int, trees: int, leaf: int, seed: int) -> Forest:
        levels = min(DEEPEST, max(0, math.ceil(math.log2(max(1, held / leaf)))))
        directions = np.random.default_rng([seed, d]).normal(size=(trees, levels, d))
        return cls(directions / np.linalg.norm(directions, axis=2, keepdims=True))

    def heights(self, x: np.ndarray) -> np.ndarray:
        """Projections of unit rows: (rows, trees, levels)."""
        flat = self.directions.reshape(self.trees * self.levels, self.directions.shape[2])
        return (x @ flat.T).reshape(len(x), self.trees, self.levels)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        heights = self.heights(x)
        node = np.zeros((len(x), self.trees), np.int64)
        tree = np.arange(self.trees)[None]
        for level in range(self.levels):
            cut = self.cuts[tree, (1 << level) - 1 + node]
            node = 2 * node + (heights[:, :, level] > cut)
        return node

    def queue(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``most`` leaves in each row's queue as (tree, leaf), the best first."""
        heights, n = self.heights(x), len(x)
        tree = np.repeat(np.arange(self.trees)[None], n, axis=0)
        node = np.zeros((n, self.trees), np.int64)
        wrong = np.zeros((n, self.trees))
        for level in range(self.levels):
            over = np.take_along_axis(heights[:, :, level], tree, axis=1) - self.cuts[tree, (1 << level) - 1 + node]
            tree = np.repeat(tree, 2, axis=1)
            wrong = np.stack([np.maximum(wrong, over), np.maximum(wrong, -over)], axis=2).reshape(n, -1)
            node = np.stack([2 * node, 2 * node + 1], axis=2).reshape(n, -1)
            if wrong.shape[1] > most:
                best = np.argpartition(wrong, most - 1, axis=1)[:, :most]
                tree, node, wrong = (np.take_along_axis(a, best, axis=1) for a in (tree, node, wrong))
        order = np.lexsort((node, tree, wrong), axis=1)[:, :most]
        return np.take_along_axis(tree, order, axis=1), np.take_along_axis(node, order, axis=1)


def fitted(heights: np.ndarray) -> np.ndarray:
    """Cuts of one tree at the medians of its nodes, from the projections (rows, levels) of the sample."""
    node, cuts = np.zeros(len(heights), np.int64), []
    for level in range(heights.shape[1]):
        z = heights[:, level]
        order = np.lexsort((z, node))
        first = np.searchsorted(node[order], np.arange((1 << level) + 1))
        held = np.diff(first)
        middle = np.minimum(first[:-1] + np.maximum(held - 1, 0) // 2, len(z) - 1)
        cut = np.where(held > 0, z[order][middle], 0.0) if len(z) else np.zeros(1 << level)
        cuts.append(cut)
        node = 2 * node + (z > cut[node])
    return np.concatenate([*cuts, np.zeros(0)])


def by_length(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    dims = batch.column("dim").to_numpy()
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        yield d, at, matrix(batch.column("body").take(pa.array(at)), kind)


def distinct_vectors(vectors: DataFrame, vec_id: str, vector: str, k: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (vec_id, key) and ``entries`` (key, dim, body, ids): each vector once, with its smallest ids."""
    sound = clean(vectors, vec_id, vector, zeros=False).filter("vec_id IS NOT NULL")
    # of rows that share an id the one with the smallest bytes counts
    rows = stage(sound.groupBy("vec_id").agg(F.min(F.struct("body", "dim")).alias("v")).select(
        "vec_id", F.unhex(F.sha2(F.col("v.body"), 256)).alias("key"), "v.dim", "v.body"), "forest-rows")
    least = top_rows(rows.select("key", "vec_id"), ["key"], [F.col("vec_id")], k + 1)
    ids = least.groupBy("key").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # k + 1 at most
    entries = rows.join(ids.select(F.element_at("ids", 1).alias("vec_id"), "ids"), "vec_id")
    return rows.select("vec_id", "key"), stage(entries.select("key", "dim", "body", "ids"), "forest-entries")


def grow(entries: DataFrame, kind: str, trees: int, leaf: int, seed: int) -> dict[int, Forest]:
    """A forest for each length of vectors."""
    held = {r["dim"]: r["count"] for r in entries.groupBy("dim").count().collect()}
    forests = {d: Forest.drawn(d, n, trees, leaf, seed) for d, n in held.items()}
    shared = Shared(entries.sparkSession, forests)
    # the share is by hash of the vector; a table within the bound is taken whole
    share = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("double") / 2**32
    limit = F.create_map(*[F.lit(x) for d, n in held.items() for x in (d, min(1.0, SAMPLE / n))]) if held else None
    if limit is None:
        return forests
    sample = entries.filter(share < F.try_element_at(limit, "dim"))

    def heights(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(found):
            for d, _, x in by_length(batch, kind):
                own = shared.value[d]
                if own.levels:
                    h = own.heights(unit(x)).astype("<f4")
                    n = len(x)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n * own.trees, d, np.int32)), pa.array(np.tile(np.arange(own.trees, dtype=np.int32), n)),
                         pa.array([row.tobytes() for row in h.reshape(n * own.trees, -1)], pa.binary())],
                        names=["dim", "tree", "heights"])

    def cuts(table: pa.Table) -> pa.Table:
        z = np.frombuffer(b"".join(table.column("heights").to_pylist()), "<f4").reshape(table.num_rows, -1)
        z = z[np.lexsort(z.T[::-1])]  # the order of rows must not matter
        return pa.table({"dim": table.column("dim")[:1], "tree": table.column("tree")[:1],
                         "cuts": pa.array([fitted(z.astype(float)).astype("<f8").tobytes()], pa.binary())})

    low = sample.select("dim", "body").mapInArrow(heights, "dim int, tree int, heights binary")
    for r in low.groupBy("dim", "tree").applyInArrow(cuts, "dim int, tree int, cuts binary").collect():
        forests[r["dim"]].cuts[r["tree"]] = np.frombuffer(bytes(r["cuts"]), "<f8")
    return forests


def nearest_of(queries: np.ndarray, rows: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the ``k`` nearest rows of each query, and of ties with the last.

    A matrix product finds who can be among them; scores are then computed pair by pair, so that they
    do not depend on who else is in the task.
    """
    near = unit(queries) @ unit(rows).T
    if near.shape[1] > k:
        bound = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
        q, r = np.nonzero(near >= bound - 1e-9)
    else:
        q, r = np.nonzero(np.ones(near.shape, bool))
    score = np.zeros(len(q))
    for at in range(0, len(q), ROOM):
        a, b = queries[q[at : at + ROOM]], rows[r[at : at + ROOM]]
        score[at : at + ROOM] = cosine(a, b)
    order = np.lexsort((least[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], r[rank < k], score[rank < k]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows.  Only where squares would leave the range of doubles are vectors scaled first."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        dot, one, two = (a * b).sum(axis=1), (a * a).sum(axis=1), (b * b).sum(axis=1)
        out = dot / (np.sqrt(one) * np.sqrt(two))
        wild = ~((one > 1e-290) & (one < 1e290) & (two > 1e-290) & (two < 1e290))
        if wild.any():
            u, v = unit(a[wild]), unit(b[wild])
            out[wild] = (u * v).sum(axis=1)
    return out


def probe(entries: DataFrame, forests: dict[int, Forest], kind: str, k: int, target: float) -> dict[int, int]:
    """For each length the number of leaves in whose union ``target`` of the true neighbours lie."""
    spark, least = entries.sparkSession, {}
    asked = entries.orderBy("key").limit(PROBES).select("dim", "body").collect()
    asked = {d: matrix(pa.array([bytes(r["body"]) for r in asked if r["dim"] == d], pa.binary()), kind)
             for d in {r["dim"] for r in asked}}
    shared = Shared(spark, (asked, forests))

    def best(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, _ = shared.value
        held: dict[int, tuple] = {}
        for batch in pieces(found):
            for d, _, x in by_length(batch, kind):
                if d in mine:
                    old = held.get(d, (np.zeros((0, d)), None))
                    both = np.concatenate([old[0], x])
                    q, r, score = nearest_of(mine[d], both, np.zeros(len(both)), k + 1)  # one is itself
                    rows, r = np.unique(r, return_inverse=True)
                    held[d] = (both[rows], (q, r, score))
        for d, (rows, (q, r, score)) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(q), d, np.int32)), pa.array(q.astype(np.int32)), pa.array(score),
                 pa.array([rows[i].tobytes() for i in r], pa.binary())], names=["dim", "query", "score", "body"])

    found = entries.select("dim", "body").mapInArrow(best, "dim int, query int, score double, body binary")
    found = top_rows(found, ["dim", "query"], [F.desc("score"), F.col("body")], k + 1)

    def depth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, trees = shared.value
        for batch in pieces(batches, 64):
            for d, at, x in by_length(batch, "<f8"):
                forest = trees[d]
                asking = mine[d][batch.column("query").to_numpy()[at]]
                total = forest.trees << forest.levels
                leaves = forest.leaves(unit(x))
                asked_before = None
                for i in range(len(at)):
                    if np.array_equal(asking[i], x[i]):
                        continue  # itself
                    if asked_before is None or not np.array_equal(asking[i], asked_before):
                        asked_before = asking[i]
                        tree, node = forest.queue(unit(asking[i : i + 1]), total)
                    place = np.flatnonzero(leaves[i][tree[0]] == node[0])[0]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d], pa.int32()), pa.array([int(place) + 1], pa.int64())], names=["dim", "place"])

    for r in found.select("dim", "query", "body").mapInArrow(depth, "dim int, place bigint").groupBy("dim").agg(
            F.sort_array(F.collect_list("place")).alias("places")).collect():  # PROBES x k at most
        least[r["dim"]] = r["places"][min(len(r["places"]) - 1, math.ceil(target * len(r["places"])) - 1)]
    return {d: least.get(d, f.trees << f.levels) for d, f in forests.items()}


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, every: int = 50, trees: int = TREES, leaf: int = LEAF,
            target: float = TARGET, seed: int = 11, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each vec_id divisible by ``every`` its ``k`` nearest others.

    ``score`` is the cosine in double precision; ties go to the smaller vec_id.  Null vectors, vectors of
    zeros or without components, and those with null or non-finite components take no part, nor do rows
    without a vec_id.  Only vectors of one length are compared with each other.  Of rows that share a vec_id
    one counts (smallest bytes).  A query with fewer than ``k`` others gets all; with none, or in an empty table,
    it has no row.  Other columns are ignored.
    """
    spark, kind = vectors.sparkSession, "<f4" if width(vectors, vector) == 4 else "<f8"
    rows, entries = distinct_vectors(vectors, vec_id, vector, k)
    forests = grow(entries, kind, trees, leaf, seed)
    depths = probe(entries, forests, kind, k, target)
    shared = Shared(spark, (forests, depths))

    def settled(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every vector in its leaf of each tree."""
        for batch in pieces(found):
            for d, at, x in by_length(batch, kind):
                own = shared.value[0][d]
                yield placed(batch, at, np.repeat(np.arange(own.trees)[None], len(at), axis=0), own.leaves(unit(x)))

    def searching(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every query in the first leaves of its queue."""
        for batch in pieces(found, 256):
            for d, at, x in by_length(batch, kind):
                own, most = shared.value[0][d], shared.value[1][d]
                yield placed(batch, at, *own.queue(unit(x), most))

    def placed(batch: pa.RecordBatch, at: np.ndarray, tree: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        each = pa.array(np.repeat(at, tree.shape[1]))
        return pa.RecordBatch.from_arrays(
            [batch.column(name).take(each) for name in ("key", "dim", "body", "ids")]
            + [pa.array(tree.ravel().astype(np.int32)), pa.array(node.ravel().astype(np.int64))],
            names=["key", "dim", "body", "ids", "tree", "node"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many rows of a task each leaf gets, without the rows."""
        total: Counter = Counter()
        for batch in batches:
            total.update(zip(*(batch.column(name).to_pylist() for name in where)))
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in total], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))]
                + [pa.array(list(total.values()), pa.int64())], names=[*where, "n"])

    def tasks(rows: DataFrame, deal, name: str) -> DataFrame:
        """In how many parts of ``ROOM`` rows each leaf falls; the work is done again rather than written out."""
        parts = rows.mapInArrow(lambda found: counted(deal(found)), "dim int, tree int, node bigint, n bigint")
        return parts.groupBy(*where).agg(F.ceil(F.sum("n") / ROOM).cast("int").alias(name))

    layout = "key binary, dim int, body binary, ids array<bigint>, tree int, node bigint"
    where = ["dim", "tree", "node"]
    asked = rows.filter(F.col("vec_id") % every == 0)
    asking = stage(entries.join(asked.select("key").distinct(), "key", "left_semi")
                   .select("key", "dim", "body", "ids"), "forest-queries")
    # a leaf and its queries meet in a grid of bounded tasks
    grid = stage(tasks(asking, searching, "across").join(tasks(entries, settled, "down"), where), "forest-grid")
    held, sought = entries.mapInArrow(settled, layout), asking.mapInArrow(searching, layout)
    place = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    held = held.join(grid, where).withColumn("row", place("down")).withColumn(
        "column", F.explode(F.sequence(F.lit(0), F.col("across") - 1)))
    sought = sought.join(grid, where).withColumn("column", place("across")).withColumn(
        "row", F.explode(F.sequence(F.lit(0), F.col("down") - 1)))

    def compare(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        least = np.array([ids[0] for ids in candidates.column("ids").to_pylist()], np.int64)
        parts = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        if queries.num_rows and candidates.num_rows:
            x, y = matrix(queries.column("body"), kind), matrix(candidates.column("body"), kind)
            for at in range(0, len(x), 256):
                q, r, score = nearest_of(x[at : at + 256], y, least, k + 1)
                parts.append((q + at, r, score))
        q, r, score = (np.concatenate(p) for p in zip(*parts))
        return pa.table({"key": queries.column("key").take(pa.array(q)), "near": candidates.column("key").take(pa.array(r)),
                         "ids": candidates.column("ids").take(pa.array(r)), "score": pa.array(score)})

    cell = [*where, "row", "column"]
    met = sought.select(*cell, "key", "body").groupBy(*cell).cogroup(
        held.select(*cell, "key", "body", "ids").groupBy(*cell)).applyInArrow(
        compare, "key binary, near binary, ids array<bigint>, score double")
    # an entry met in several trees counts once; k + 1 as one of the ids may be the query's own
    met = met.groupBy("key", "near").agg(F.first("ids").alias("ids"), F.max("score").alias("score"))
    met = top_rows(met, ["key"], [F.desc("score"), F.col("ids")[0]], k + 1)
    met = met.select("key", "score", F.explode("ids").alias("found"))
    lists = top_rows(met, ["key"], [F.desc("score"), F.col("found")], k + 1)
    lists = lists.groupBy("key").agg(F.array_sort(F.collect_list(
        F.struct((-F.col("score")).alias("far"), F.col("found")))).alias("near"))  # k + 1 at most
    asked = asked.withColumnRenamed("vec_id", "query_id").join(lists, "key")
    own = F.slice(F.filter("near", lambda x: x["found"] != F.col("query_id")), 1, k)
    return asked.select("query_id", F.posexplode(own).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.found").alias("vec_id"), (-F.col("x.far")).alias("score"))


def op11(vectors: DataFrame) -> DataFrame:
    return nearest(vectors)
