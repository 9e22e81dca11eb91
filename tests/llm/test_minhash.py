"""Near-duplicate groups against all pairs of shingle sets."""

import random

import pytest

from palimpsest.llm import minhash


def shingles(text, size=5):
    words = (text or "").split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def components(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def changed(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"c{rng.random()}"
    return words


def near_threshold(rng):
    """Groups whose members differ more and more, about the threshold and along chains."""
    rows, number = [], 0
    for group in range(12):
        words = [f"g{group}w{j}" for j in range(120)]
        for step in range(12):
            words = changed(rng, words, rng.randrange(0, 5))
            rows.append((number, " ".join(words)))
            number += 1
    return rows


def templates(rng):
    """Documents that share a template but are less than similar, some of them with close copies."""
    base = [f"t{i}" for i in range(120)]
    rows = [(i, " ".join(base + [f"u{i}x{j}" for j in range(75)])) for i in range(80)]
    return rows + [(100 + i, " ".join(changed(rng, rows[i][1].split(), 2))) for i in range(0, 80, 3)]


def drifting(rng):
    """One large group of near copies, of which the far ends are not similar to each other."""
    base = [f"b{i}" for i in range(200)]
    return [(i, " ".join([f"d{i % 7}n{k}" if k < i // 4 else w for k, w in enumerate(base)])) for i in range(120)]


@pytest.mark.parametrize("make", [near_threshold, templates, drifting])
def test_components_equal_all_pairs(spark, make):
    rows = make(random.Random(6))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(
        spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == components(rows)


def test_empty_short_and_repeated(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, "x " * 40000), (8, "x " * 5),
            (9, " ".join(f"w{i}" for i in range(30000))), (9, " ".join(f"w{i}" for i in range(30000)))]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    found = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out}
    assert len(out) == len(rows)
    assert found == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True),
                     (7, 1, 7, True), (8, 1, 7, False), (9, 29996, 9, True)}


def test_template_makes_no_pairs(spark):
    """Twice the documents of a template make at most twice the rows that meet."""
    met = []
    for n in (60, 120):
        rows = [(i, " ".join([f"t{k}" for k in range(120)] + [f"u{i}x{j}" for j in range(75)])) for i in range(n)]
        staged = {}
        keep = minhash.stage

        def noted(df, name, staged=staged, keep=keep):
            staged[name] = keep(df, name)
            return staged[name]

        minhash.stage = noted
        try:
            minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        finally:
            minhash.stage = keep
        met.append(sum(staged[name].count() for name in ("minhash-stars", "minhash-met", "minhash-cross")))
    assert met[1] <= 2 * met[0] + 10
