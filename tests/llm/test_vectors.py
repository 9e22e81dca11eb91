"""Vector operators against brute force, and their defined results on odd rows."""

import hashlib
import math

import numpy as np
import pytest

from compare import SF
from palimpsest.llm import centroids, forest, whitening
from palimpsest.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<double>, key string, dim int, body string, cluster int, n int, tree int"
EXTRA = ("k", 1, "b", 2, 3, 4)


@pytest.fixture(scope="module")
def given(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    return [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows])


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, *EXTRA) for i, v in rows], schema)


def odd_rows(d, seed=0):
    """Sound vectors, repeated ones, ties, and all that takes no part."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, d)).round(2).tolist()
    rows = [(i, v) for i, v in enumerate(x)]
    rows += [(100 + i, x[7]) for i in range(150)]  # one vector, many times
    rows += [(50, x[50]), (None, x[3]), (300, None), (301, []), (302, [0.0] * d), (303, [math.nan] + x[0][1:]),
             (304, [math.inf] + x[0][1:]), (305, [None] + x[0][1:]), (306, x[0][:-1]), (307, x[1] + [1.0]),
             (350, [-0.0] * d), (400, [1e200] * d), (401, [1e-200] * d)]
    return rows


def brute_nearest(rows, k, every):
    held = {}
    for i, v in rows:
        ok = i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        if ok and (i not in held or np.array(v).tobytes() < np.array(held[i]).tobytes()):
            held[i] = v
    out = {}
    for i, v in held.items():
        if i % every == 0:
            scores = []
            for j, w in held.items():
                if j != i and len(w) == len(v):
                    a, b = (np.array(u) / np.abs(u).max() for u in (v, w))
                    scores.append((-round(float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)), 12), j))
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return {i: v for i, v in out.items() if v}


def found_nearest(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 12)))
    return out


@pytest.mark.parametrize("d", [3, 64])
def test_nearest_on_odd_rows(spark, d):
    rows = odd_rows(d)
    found = found_nearest(forest.nearest(table(spark, rows)))
    assert found == brute_nearest(rows, 5, 50) and {0, 50, 100, 150, 400} <= set(found)


def test_nearest_over_split_leaves(spark, monkeypatch):
    """Leaves larger than a task and more queries than a task lose nothing."""
    monkeypatch.setattr(forest, "ROOM", 16)
    rows = odd_rows(4)
    assert found_nearest(forest.nearest(table(spark, rows), every=1)) == brute_nearest(rows, 5, 1)


def test_nearest_recall(spark, given):
    ids, x = given
    x = x / np.linalg.norm(x, axis=1)[:, None]
    df = forest.nearest(spark.read.parquet(f"{SF}/embeddings.parquet"), leaf=32, every=5)
    found, hit = found_nearest(df), 0
    asked = [i for i in ids if i % 5 == 0]
    for i in asked:
        near = x @ x[ids.index(i)]
        near[ids.index(i)] = -9
        hit += len({ids[j] for j in np.argsort(-near)[:5]} & {v for _, v, _ in found[i]})
        for rank, v, score in found[i]:
            assert math.isclose(score, near[ids.index(v)], abs_tol=1e-12)
    assert len(found) == len(asked) and hit / len(asked) / 5 >= 0.9


def test_queue_is_best_first():
    """The beam gives the leaves of a queue that is emptied node by node."""
    rng = np.random.default_rng(3)
    trees = forest.Forest.drawn(6, 64, 3, 4, 1)
    trees.cuts = rng.normal(size=trees.cuts.shape) / 3
    x = forest.unit(rng.normal(size=(5, 6)))
    heights = trees.heights(x)
    for q in range(5):
        leaves = []
        for t in range(3):
            for leaf in range(16):
                wrong, node = 0.0, 0
                for level in range(4):
                    over = heights[q, t, level] - trees.cuts[t, (1 << level) - 1 + node]
                    bit = leaf >> (3 - level) & 1
                    wrong, node = max(wrong, -over if bit else over), 2 * node + bit
                leaves.append((wrong, t, leaf))
        for most in (1, 7, 48):
            tree, node = trees.queue(x[q : q + 1], most)
            worst = sorted(leaves)[most - 1][0]
            got = set(zip(tree[0].tolist(), node[0].tolist()))
            assert len(got) == most and all(w <= worst for w, t, leaf in leaves if (t, leaf) in got)


def brute_clusters(rows, k, rounds, d):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [max(-(1 << 27), min(1 << 27, x)) for x in v]) for i, v in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    centres = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(x) for x in zip(*members[n])] if n in members else c for n, c in enumerate(centres)]
    out = [(i, *near(v)) for i, v in kept]
    total = {}
    for _, dist, c in out:
        total[c] = total.get(c, 0) + dist
    long = lambda x: x if x < 1 << 63 else None
    return sorted(((i, c, dist, long(total[c]), long(sum(total.values())),
                    hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, dist, c in out), key=str)


@pytest.mark.parametrize("k", [5, 500])
def test_clusters_on_odd_rows(spark, k):
    rows = odd_rows(6)
    found = [tuple(r) for r in centroids.cluster(table(spark, rows), k=k, dimension=6).collect()]
    assert sorted(found, key=str) == brute_clusters(rows, k, 5, 6)


def test_search_finds_the_nearest_with_ties():
    rng = np.random.default_rng(1)
    for spread in (3, 1000):
        x = rng.integers(-spread, spread, (800, 4))
        x[::2] += rng.integers(-50, 50, (400, 1)) * spread
        c = x[rng.integers(0, 800, 40)]
        number, distance, computed = centroids.Means(c).nearest(x)
        apart = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (number == apart.argmin(axis=1)).all() and (distance == apart.min(axis=1)).all()
        assert computed < 0.5 * apart.size  # most are rejected by their mean or deviation


def brute_whitening(x):
    n, total = len(x), x.sum(axis=0)
    apart = (n * x - total) / n
    cov = apart.T @ apart / n
    values, vectors = np.linalg.eigh(cov)
    return n, total, apart, values[::-1], vectors[:, ::-1], np.trace(cov)


def test_whitening_equals_a_plain_eigendecomposition(spark, given):
    ids, v = given
    x = np.floor(64 * v).astype(np.int64) + 1_000_000
    n, total, apart, values, vectors, trace = brute_whitening(x)
    found = {}
    for r in QUERIES["op13_secular_whitening"](spark, SF).collect():
        found[r["vec_id"], r["component"]] = r
    assert len(found) == 32 * n
    white = np.array([[found[i, c]["whitened"] for c in range(1, 33)] for i in ids])
    plain = apart @ vectors[:, :32] / np.sqrt(values[:32])
    assert np.abs(white - plain * np.sign((white * plain).sum(axis=0))).max() < 1e-9
    for c in range(32):
        assert math.isclose(found[ids[0], c + 1]["explained"], values[c] / trace, rel_tol=1e-9)
    for i, row in zip(ids, x):
        assert found[i, 1]["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total))
    assert {r["n"] for r in found.values()} == {n}
    error = {r["identity_error"] for r in found.values()}
    assert len(error) == 1 and math.isclose(error.pop(), np.abs(white.T @ white / n - np.eye(32)).max(), abs_tol=1e-12)


def test_whitening_on_odd_rows(spark):
    rows = odd_rows(6)
    kept = [(i, v) for i, v in rows if v is not None and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v)]
    held = np.array([[max(-(1 << 40), min(1 << 40, math.floor(64 * x))) + 1_000_000 for x in v] for _, v in kept])
    n, total, _, values, _, trace = brute_whitening(held)
    found = whitening.whiten(table(spark, rows)).collect()
    k = len({r["component"] for r in found})
    assert 1 <= k <= 6 and len(found) == k * n
    for c in range(1, k + 1):
        own = [r for r in found if r["component"] == c]
        assert sorted((r["vec_id"] for r in own), key=str) == sorted((i for i, _ in kept), key=str)
        assert math.isclose(own[0]["explained"], values[c - 1] / trace, rel_tol=1e-6)
    exact = {}
    for (i, _), row in zip(kept, held):
        value = sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total))
        exact[i] = value if value < 1 << 63 else None
    assert {r["vec_id"]: r["deviation"] for r in found} == exact


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_without_variance_no_component(spark, rows):
    assert whitening.whiten(table(spark, rows)).collect() == []


@pytest.mark.parametrize("rows", [[], [(50, None), (None, [1.0] * 64)]])
def test_empty_tables(spark, rows):
    df = table(spark, rows)
    assert forest.nearest(df).collect() == []
    assert len(centroids.cluster(df).collect()) == sum(v is not None for _, v in rows)


@pytest.mark.parametrize("kind", ["plain", "flat", "copies", "equal"])
def test_spectrum_by_rank_one_updates(kind):
    rng = np.random.default_rng(2)
    d = 24
    x = rng.normal(size=(400, d)) * 10 + 1e6
    if kind == "flat":
        x = rng.normal(size=(400, 3)) @ rng.normal(size=(3, d)) * 10 + 1e6
    if kind == "copies":
        x = np.repeat(x[:3], 100, axis=0)
    if kind == "equal":
        x = np.full((50, d), 1e6)
    one, two = whitening.Spectrum(d), whitening.Spectrum(d)
    cut = len(x) // 3
    for at in range(0, cut, 60):  # blocks above and below d rows
        one.take(x[at : min(at + 60, cut)])
    for at in range(cut, len(x), 11):
        two.take(x[at : at + 11])
    one.merge(whitening.Spectrum.unpacked(two.packed()))
    apart = x - x.mean(axis=0)
    scatter = apart.T @ apart
    size = max(1.0, np.abs(scatter).max())
    assert one.n == len(x) and np.allclose(one.mean, x.mean(axis=0), rtol=1e-12)
    assert np.abs(one.basis.T @ one.basis - np.eye(d)).max() < 1e-12
    assert np.abs(one.basis @ np.diag(one.values) @ one.basis.T - scatter).max() < 1e-8 * size
