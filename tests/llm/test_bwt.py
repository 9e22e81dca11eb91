"""Byte-level deduplication against brute force."""

import hashlib
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from palimpsest.llm import bwt
from palimpsest.llm.anchors import Layout


def brute(rows):
    rows = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, body in rows:
        for s in range(len(body) - 99):
            key = body[s : s + 100]
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for i, body in rows:
        gone = bytearray(len(body))
        for s in range(len(body) - 99):
            if first[body[s : s + 100]] < (i, s):
                gone[s : s + 100] = b"\1" * 100
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(b for b, g in zip(body, gone) if not g)
        out.append((None if i == 2**63 - 1 else i, len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows_for(seed):
    rng = random.Random(seed)
    prose = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(n))
    shared = [prose(40) for _ in range(4)]
    rows = [(i, prose(rng.randint(0, 60))) for i in range(60)]
    for i in range(60, 140):
        rows.append((i, prose(rng.randint(0, 20)) + rng.choice(shared)[: rng.randint(80, 220)] + prose(rng.randint(0, 20))))
    rows += [(200 + i, rows[70][1]) for i in range(30)]
    rows += [(300, "a" * 1000), (301, "ab" * 300), (302, "b" + "a" * 400), (303, shared[0] + shared[0]), (304, None), (305, ""),
             (306, "x" * 99), (307, "x" * 100), (308, "x" * 100), (None, rows[71][1]), (None, rows[71][1]),
             (65, shared[1]), (65, shared[1] + "!"), (65, prose(5) + shared[1]), (309, "\0" * 300)]
    rng.shuffle(rows)
    return rows


def measured(spark, rows, parts, **how):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    docs = docs.selectExpr("*", "1 AS mark", "2 AS body", "3 AS spans")
    return sorted((tuple(r) for r in bwt.measure(docs, **how).collect()), key=repr)


def test_equals_brute_force(spark):
    for seed, parts in ((1, 7), (2, 1), (3, 40)):
        rows = rows_for(seed)
        assert measured(spark, rows, parts) == brute(rows)


def test_fuller_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(bwt, "marked", lambda h, layout, bits: np.ones(len(h), bool))
    rows = rows_for(4)
    assert measured(spark, rows, 5) == brute(rows)


def test_empty(spark):
    assert measured(spark, [], 2) == []
    assert measured(spark, [(1, None), (2, "")], 2) == brute([(1, None), (2, "")])


def test_common_prefixes_of_merged_transforms():
    rng = np.random.default_rng(5)
    sizes = np.array([130, 140, 110, 150])
    base = rng.integers(1, 255, 150).astype(np.uint8)
    texts = [base[:n].copy() for n in sizes]
    texts[2][45] = 0
    body = np.concatenate([np.append(t, 0) for t in texts]).astype(np.uint8)
    gone = bwt.repeated(body, sizes, np.array([0, 0, 1, 2]), np.array([3, 4, 2, 1]), np.zeros(4, np.int64))
    windows = [bool(g) for g in gone]
    at = 0
    for k, n in enumerate(sizes):
        want = [k in (0, 1) or (k == 2 and s > 45) for s in range(n - 99)]
        assert windows[at : at + n - 99] == want
        at += n + 1


def in_contexts(n):
    """One phrase in ``n`` contexts, some of which come back under a later id, in part or whole."""
    rng = random.Random(6)
    word = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    rows = [(i, word(80) + "this phrase is the same in every text of the table" + word(80)) for i in range(n)]
    rows += [(n + i, word(rng.randint(0, 30)) + rows[i][1][rng.randint(0, 90) :]) for i in range(0, n, 7)]
    rows += [(rng.randint(0, 2 * n), rows[i][1]) for i in range(0, n, 11)] + [(None, rows[3][1]), (5, rows[9][1] + rows[9][1])]
    rng.shuffle(rows)
    return rows


def test_crowded_anchors_equal_brute_force(spark):
    rows = in_contexts(600)
    for crowd, parts in ((0, 3), (40, 9), (1 << 12, 4)):
        assert measured(spark, rows, parts, crowd=crowd) == brute(rows)
    rows = rows_for(7)
    assert measured(spark, rows, 6, crowd=0) == measured(spark, rows, 2, crowd=3) == brute(rows)


def test_one_phrase_in_many_contexts_spreads_over_buckets():
    """Both sides of a phrase differ everywhere: no bucket gets more than a small part of what is sent."""
    rows = [r for r in in_contexts(8000) if r[0] is not None]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in rows]), pa.array([t.encode() for _, t in rows], pa.binary()), pa.array(range(len(rows)), pa.int64())],
        names=["doc_id", "body", "mark"])
    layout = Layout(1 << 16, per_bucket=1 << 15)
    index = pa.Table.from_batches(bwt.anchor_rows(iter([batch]), layout))
    bits, many = np.zeros(layout.buckets * layout.width // 8, np.uint8), []
    for bucket in set(index.column("bucket").to_pylist()):
        share = bwt.share_rows(layout, 100)(index.filter(pc.equal(index.column("bucket"), bucket)))
        bits[bucket * layout.width // 8 : (bucket + 1) * layout.width // 8] = np.frombuffer(share["bits"][0].as_py(), np.uint8)
        many.append(np.frombuffer(share["crowded"][0].as_py(), np.uint32).astype(np.uint64) | np.uint64(bucket << 32))
    many = np.sort(np.concatenate(many))
    assert len(many)
    sent = Counter()
    for rows_ in bwt.snippet_rows(iter([batch]), layout, SimpleNamespace(value=bits), many):
        for bucket, body in zip(rows_.column("bucket").to_pylist(), rows_.column("bodies").to_pylist()):
            sent[bucket] += len(body or b"")
    assert max(sent.values()) < 0.02 * sum(sent.values())


def test_whole_copies_take_no_part_in_the_transforms(monkeypatch):
    """Twenty shards with one text and a shard with a changed one: only what differs is sorted."""
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000)).encode()
    texts = [text] * 20 + [text[:2000] + b"#" + text[2000:]]
    layout = Layout(1 << 10, per_bucket=1 << 15)
    bits = SimpleNamespace(value=np.full(layout.buckets * layout.width // 8, 255, np.uint8))
    rows = []
    for i, body in enumerate(texts):
        batch = pa.RecordBatch.from_arrays([pa.array([i]), pa.array([body], pa.binary()), pa.array([0])], names=["doc_id", "body", "mark"])
        rows += bwt.snippet_rows(iter([batch]), layout, bits, np.zeros(0, np.uint64))
    table, sorted_bytes, repeated = pa.Table.from_batches(rows), [], bwt.repeated
    monkeypatch.setattr(bwt, "repeated", lambda body, *rest: sorted_bytes.append(len(body)) or repeated(body, *rest))
    gone = {i: np.zeros(4001, bool) for i in range(21)}
    for bucket in set(table.column("bucket").to_pylist()):
        for row in bwt.span_rows(table.filter(pc.equal(table.column("bucket"), bucket))).to_pylist():
            for a, b in np.frombuffer(row["spans"], np.int64).reshape(2, -1).T:
                gone[row["doc_id"]][a : b + 1] = True
    assert not gone[0].any()
    assert all(gone[i][:3901].all() and not gone[i][3901:].any() for i in range(1, 20))
    assert (~gone[20][:3902]).sum() == 100 and not gone[20][1901:2001].any()
    assert 0 < sum(sorted_bytes) < 0.01 * sum(len(x or b"") for x in table.column("bodies").to_pylist())
