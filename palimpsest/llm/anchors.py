"""Substring deduplication by fixed-block anchors.

The words of each document are cut into blocks of seven; these are the index.  Every window of seven
words is a probe.  As a passage of 13 words holds at least one whole block of the document in which it
stands, and the other document meets that block with one of its windows, no common passage is missed.
Hits are extended to all windows of 13 words around them, and these, compared between documents, join
up to the maximal repeats.

1. Tasks reduce each chunk of texts to its distinct window hashes, with two bits: seen in several
   documents, seen as a block.  These are dealt to buckets by hash, as packed arrays; a passage that
   stands in any number of documents arrives once per chunk.
2. A bucket finds the hashes that are a block somewhere and stand in several documents, and marks them
   in its share of a filter.  The filter has a fixed largest size; a fuller one lets more through and
   costs time, not results.
3. Tasks probe the filter, extend hits and emit the passages, again once per chunk: of equal passages
   of a chunk all but that of the smallest id are settled at once.
4. Buckets compare passages over chunks and name those to be removed for each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.words import NOT_SPACE, Shared, Texts, U, Words, batches, joined, mix, slices

PASSAGE, BLOCK = 13, 7
READ = 1 << 20  # bytes of text whose words are held at once
CHUNK = 1 << 20  # words reduced at once
LAST = 2**63 - 1  # stands for a missing id: behind all others
FILTER_BITS = 1 << 28


class Layout:
    """Buckets by the upper bits of a hash, and the filter's bits in each."""

    def __init__(self, words: int, per_bucket: int = 1 << 21, least: int = 256):
        self.bits = max(least, 1 << max(0, (words // per_bucket)).bit_length()).bit_length() - 1
        wanted = max(64, words >> self.bits)
        self.width = 1 << min(wanted.bit_length(), 31, max(6, FILTER_BITS.bit_length() - 1 - self.bits))
        self.buckets = 1 << self.bits

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return (h >> U(64 - self.bits)).astype(np.int64)

    def print_(self, h: np.ndarray) -> np.ndarray:
        return ((h >> U(32 - self.bits)) & U(0xFFFFFFFF)).astype(np.uint32)

    def places(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = mix(prints.astype(U))
        return (wide & U(self.width - 1)).astype(np.int64), ((wide >> U(32)) & U(self.width - 1)).astype(np.int64)


def groups(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def chunks(found: Iterator[pa.RecordBatch], reduced: Callable[[Words, np.ndarray, np.ndarray], tuple]) -> Iterator[list[tuple]]:
    """Lists of what ``reduced`` makes of words, their hashes and the ids of their texts, bounded in words unless one text is longer.

    The words themselves are only held for a few texts at once.
    """
    held, size = [], 0
    for batch in batches(found, "body", READ):
        words = Words(Texts(batch.column("body")), NOT_SPACE)
        ids = batch.column("doc_id").fill_null(LAST).to_numpy(zero_copy_only=False)
        held.append(reduced(words, words.hashes(), ids))
        size += len(words.start)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def probes(words: Words, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Hashes of the windows of seven, their texts counted from 0, whether they are blocks; and how many texts."""
    seven, valid = words.windows(h, BLOCK)
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), words.count)
    place = np.arange(len(h)) - np.repeat(words.first[:-1], words.count)
    return seven[valid], owner[valid], (place % BLOCK == 0)[valid], len(ids)


def index_rows(found: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(found, probes):
        base = 0
        for _, owner, _, texts in chunk:
            owner += base
            base += texts
        h, owner, block = (np.concatenate(x) for x in list(zip(*chunk))[:3])
        del chunk[:]
        if not len(h):
            continue
        order = np.argsort(h)
        h, owner, block = h[order], owner[order], block[order]
        del order
        at = groups(h)
        several = np.minimum.reduceat(owner, at) != np.maximum.reduceat(owner, at)
        block = np.logical_or.reduceat(block, at)
        h = h[at]
        bucket, prints = layout.bucket(h), layout.print_(h)
        del h, owner, at
        cuts = np.append(groups(bucket), len(bucket))
        rows = [(int(bucket[a]), prints[a:b].tobytes(), np.packbits(several[a:b]).tobytes(), np.packbits(block[a:b]).tobytes())
                for a, b in zip(cuts[:-1], cuts[1:])]
        del bucket, prints, several, block
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(x), t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
            names=["bucket", "prints", "several", "block"])


def filter_rows(layout: Layout):
    def reduce(table: pa.Table) -> pa.Table:
        prints, several, block = [], [], []
        for p, s, b in zip(*[table.column(c).to_pylist() for c in ("prints", "several", "block")]):
            prints.append(np.frombuffer(p, np.uint32))
            several.append(np.unpackbits(np.frombuffer(s, np.uint8), count=len(prints[-1])).astype(bool))
            block.append(np.unpackbits(np.frombuffer(b, np.uint8), count=len(prints[-1])).astype(bool))
        p, s, b = np.concatenate(prints), np.concatenate(several), np.concatenate(block)
        order = np.argsort(p)
        p, s, b = p[order], s[order], b[order]
        at = groups(p)
        size = np.diff(np.append(at, len(p)))
        shared = ((size > 1) | np.logical_or.reduceat(s, at)) & np.logical_or.reduceat(b, at)
        bits = np.zeros(layout.width, bool)
        for places in layout.places(p[at][shared]):
            bits[places] = True
        return pa.table({"bucket": table.column("bucket")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    return reduce


def passages(words: Words, hashes: np.ndarray, layout: Layout, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the passages around hits, and their two hashes."""
    seven, valid = words.windows(hashes, BLOCK)
    at = np.flatnonzero(valid)
    h = seven[at]
    prints, bucket = layout.print_(h), layout.bucket(h)
    one, two = layout.places(prints)
    hit = np.zeros(len(hashes) + 1, np.int32)
    marked = np.ones(len(at), np.uint8)
    for place in (one, two):
        place += bucket * layout.width
        marked &= bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)
    hit[at] = marked & 1
    before = np.concatenate([[0], np.cumsum(hit)])
    reach = PASSAGE - BLOCK + 1
    last = np.minimum(np.arange(len(hashes)) + reach, len(hashes))
    whole, fits = words.windows(hashes, PASSAGE)
    start = np.flatnonzero(fits & (before[last] > before[np.arange(len(hashes))]))
    second, _ = words.windows(mix(hashes + U(0x5851F42D4C957F2D)), PASSAGE)
    return start, whole[start], (second[start] >> U(32)).astype(np.uint32)


def packed_rows(bucket: np.ndarray, ids: np.ndarray, one: np.ndarray, two: np.ndarray | None, kind: int) -> pa.RecordBatch:
    order = np.lexsort((ids, bucket))
    bucket, ids, one = bucket[order], ids[order], one[order]
    two = two[order] if two is not None else None
    cuts = np.append(groups(bucket), len(bucket))
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
    return pa.RecordBatch.from_arrays(
        [pa.array([int(bucket[a]) for a, _ in spans], pa.int64()), pa.array([kind] * len(spans), pa.int32()),
         pa.array([np.diff(ids[a:b], prepend=0).tobytes() for a, b in spans], pa.binary()),
         pa.array([one[a:b].tobytes() for a, b in spans], pa.binary()),
         pa.array([two[a:b].tobytes() if two is not None else None for a, b in spans], pa.binary())],
        names=["bucket", "kind", "ids", "one", "two"])


def passage_rows(found: Iterator[pa.RecordBatch], layout: Layout, bits: Shared) -> Iterator[pa.RecordBatch]:
    def owned(words: Words, hashes: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, one, two = passages(words, hashes, layout, bits.value)
        return own[np.searchsorted(words.first, start, side="right") - 1], one, two

    for chunk in chunks(found, owned):
        ids, one, two = (np.concatenate(x) for x in zip(*chunk))
        del chunk[:]
        if not len(ids):
            continue
        order = np.lexsort((ids, two, one))
        ids, one, two = ids[order], one[order], two[order]
        new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        at = np.flatnonzero(new)
        least = np.repeat(ids[at], np.diff(np.append(at, len(ids))))
        yield packed_rows(layout.bucket(one[at]), ids[at], one[at], two[at], 0)
        later = np.flatnonzero((ids != least) & np.concatenate([[True], (one[1:] != one[:-1]) | (ids[1:] != ids[:-1])]))
        if len(later):
            spread = (mix(ids[later].view(U)) >> U(64 - layout.bits)).astype(np.int64)
            yield packed_rows(spread, ids[later], one[later], None, 1)


def removal_rows(table: pa.Table) -> pa.Table:
    """For each id the hashes of its passages that stand under a smaller id, or were settled before."""
    kinds = table.column("kind").to_pylist()
    columns = [table.column(c).to_pylist() for c in ("ids", "one", "two")]
    out_ids, out_one, ids, one, two = [], [], [], [], []
    for kind, i, a, b in zip(kinds, *columns):
        i, a = np.cumsum(np.frombuffer(i, np.int64)), np.frombuffer(a, U)
        if kind:
            out_ids.append(i)
            out_one.append(a)
        else:
            ids.append(i)
            one.append(a)
            two.append(np.frombuffer(b, np.uint32))
    if ids:
        ids, one, two = np.concatenate(ids), np.concatenate(one), np.concatenate(two)
        order = np.lexsort((ids, two, one))
        ids, one, two = ids[order], one[order], two[order]
        at = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
        least = np.repeat(ids[at], np.diff(np.append(at, len(ids))))
        out_ids.append(ids[ids != least])
        out_one.append(one[ids != least])
    ids, one = np.concatenate(out_ids), np.concatenate(out_one)
    order = np.argsort(ids, kind="stable")
    ids, one = ids[order], one[order]
    cuts = np.append(groups(ids), len(ids))
    return pa.table({"doc_id": pa.array(ids[cuts[:-1]]),
                     "removed": pa.array([one[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, removed``: for each document with repeated passages the packed hashes of those.

    Documents without an id come after all others here, under the largest id there is.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("body"))
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    layout = Layout(size // 6)
    index = rows.mapInArrow(lambda found: index_rows(found, layout), "bucket bigint, prints binary, several binary, block binary")
    shares = index.groupBy("bucket").applyInArrow(filter_rows(layout), "bucket bigint, bits binary").toArrow()
    bits = np.zeros(layout.buckets * layout.width // 8, np.uint8)
    for bucket, share in zip(shares.column("bucket").to_pylist(), shares.column("bits").to_pylist()):
        bits[bucket * layout.width // 8 : (bucket + 1) * layout.width // 8] = np.frombuffer(share, np.uint8)
    shared = Shared(spark, bits)
    found = rows.mapInArrow(lambda batches_: passage_rows(batches_, layout, shared),
                            "bucket bigint, kind int, ids binary, one binary, two binary")
    return found.groupBy("bucket").applyInArrow(removal_rows, "doc_id bigint, removed binary").groupBy("doc_id").agg(
        F.collect_list("removed").alias("removed"))


def covered(words: Words, removed: list[list[bytes] | None]) -> np.ndarray:
    """Words that are part of a removed passage."""
    starts = np.zeros(len(words.start) + PASSAGE, np.int32)
    some = [i for i, x in enumerate(removed) if x]
    if some:
        whole, fits = words.windows(words.hashes(), PASSAGE)
        for i in some:
            a, b = words.first[i], words.first[i + 1]
            gone = np.concatenate([np.frombuffer(x, U) for x in removed[i]])
            at = a + np.flatnonzero(np.isin(whole[a:b], gone) & fits[a:b])
            starts[at] += 1
            starts[at + PASSAGE] -= 1
    return np.cumsum(starts)[: len(words.start)] > 0


COUNTED = "struct<n_words: bigint, n_removed: bigint, kept_sha256: string>"


def counter():
    @F.arrow_udf(COUNTED)
    def count(body: pa.Array, removed: pa.Array) -> pa.Array:
        out, at = [], 0
        for part in slices(body, READ):
            words = Words(Texts(part), NOT_SPACE)
            gone = covered(words, removed.slice(at, len(part)).to_pylist())
            at += len(part)
            lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
            for n, lose, kept in zip(words.count.tolist(), lost.tolist(), joined(words, ~gone)):
                out.append({"n_words": n, "n_removed": lose, "kept_sha256": hashlib.sha256(kept).hexdigest()})
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]))

    return count


def cutter():
    @F.arrow_udf("struct<text: string, n_kept: bigint>")
    def cut(body: pa.Array, removed: pa.Array) -> pa.Array:
        out, at = [], 0
        for part in slices(body, READ):
            texts = Texts(part)
            words = Words(texts, NOT_SPACE)
            gone = covered(words, removed.slice(at, len(part)).to_pylist())
            at += len(part)
            lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
            # a removed word goes with the white space up to the next word of its text
            until = np.minimum(np.append(words.start[1:], len(texts.data)), np.repeat(texts.offsets[1:], words.count))
            edges = np.zeros(len(texts.data) + 1, np.int32)
            np.add.at(edges, words.start[gone], 1)
            np.subtract.at(edges, until[gone], 1)
            stays = np.cumsum(edges)[:-1] == 0
            for i in range(texts.n):
                a, b = texts.offsets[i], texts.offsets[i + 1]
                whole = texts.data[a:b]
                out.append({"text": (whole if not lost[i] else whole[stays[a:b]]).tobytes().decode("utf-8", "replace"),
                            "n_kept": int(words.count[i] - lost[i])})
        return pa.array(out, pa.struct([("text", pa.string()), ("n_kept", pa.int64())]))

    return cut


def _joined(docs: DataFrame, found: DataFrame, doc_id: str) -> DataFrame:
    """All columns of ``docs`` as ``row``, with the removed passages beside."""
    found = found.select(F.col("doc_id").alias("found_id"), "removed")
    held = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LAST)).alias("held_id"))
    return held.join(found, F.col("held_id") == F.col("found_id"), "left")


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row.

    A word is removed if it lies in a passage of 13 words that also starts in a document with a smaller
    id.  Rows with the same id do not remove each other's words; a row without an id comes after all
    others.  A null text has no words.  Other columns are ignored.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    joined_ = _joined(own, removals(own), "doc_id")
    return joined_.select("row.doc_id", counter()(F.col("row.text").cast("binary"), F.col("removed")).alias("c")).select(
        "doc_id", "c.*")


def cut(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs``, with all their columns, without repeated passages.

    The column named ``length`` follows the new text.  A row all of whose words are repeated is left out;
    texts without repeats stay as they are, null and empty ones too.
    """
    joined_ = _joined(docs, removals(docs, doc_id, text), doc_id)
    found = F.col("removed").isNotNull()
    body = F.when(found, F.col(f"row.{text}").cast("binary"))  # a text that stays as it is need not go to Python
    made = joined_.select("row", "removed", F.when(found, cutter()(body, F.col("removed"))).alias("c"))
    made = made.filter("c IS NULL OR c.n_kept > 0").withColumn("new", F.coalesce("c.text", F.col(f"row.{text}")))
    columns = []
    for name in docs.columns:
        own = F.col("row").getField(name)
        if name == text:
            own = F.col("new")
        elif name == length:
            own = F.when(F.col("c").isNull(), own).otherwise(F.length("new")).cast(docs.schema[name].dataType)
        columns.append(own.alias(name))
    return made.select(*columns)


def op3(docs: DataFrame) -> DataFrame:
    return measure(docs)


OP3_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 12], ' ')) AS g FROM
    (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d WHERE len(words) > 12)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM win) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM again),
kept AS (SELECT w.doc_id, count(*) AS n, string_agg(w.word, ' ' ORDER BY w.p) AS body FROM
    (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM d) w
    ANTI JOIN gone ON gone.doc_id = w.doc_id AND gone.p = w.p GROUP BY 1)
SELECT d.doc_id, CAST(len(words) AS bigint) AS n_words, CAST(len(words) - coalesce(k.n, 0) AS bigint) AS n_removed,
  sha256(coalesce(k.body, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
