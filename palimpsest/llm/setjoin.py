"""Benchmark decontamination as a prefix-filtered set join.

A window is the set of its three-word shingles in their places.  Containment has to be complete, so
the necessary prefix of a window in the order of rarity is its single rarest shingle; rarity is the
number of places in all documents.  Each place in a document where such a shingle stands proposes the
windows that hold it.  Positional bounds (the shingle's place in the window) and length bounds (the
words left on both sides within the text) discard proposals, the whole window's words decide.

The benchmark is the stated query set.  It is taken in blocks of bounded size; the index of a block is
broadcast, and each block is one more column over the same scan.  Documents are never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from palimpsest.llm.words import WORDLIKE, Shared, Texts, U, Words, batches, slices

SHINGLE = 3
SIEVE = 20


class Keys:
    """Sorted shingle hashes with a sieve of their low bits before them."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[(keys & U((1 << SIEVE) - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``hashes`` that are among the keys, and the number of the key."""
        at = np.flatnonzero(self.sieve[(hashes & U((1 << SIEVE) - 1)).astype(np.int64)] & valid)
        if not len(self.keys) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        number = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[number] == hashes[at]
        return at[same], number[same]


class Block:
    """Distinct windows of some items, and their shingles by size."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        texts = Texts(pa.array([(text or "").encode() for _, text in items], pa.binary()), lower=True)
        words = Words(texts, WORDLIKE)
        hashes = words.hashes()
        data = texts.data.tobytes()
        self.windows: list[tuple[int, bytes]] = []  # number of words, words joined by a space
        self.items: list[list[str]] = []
        self.shingles: list[list[tuple[int, int]]] = []  # (size, hash) in the order of places
        known: dict[bytes, int] = {}
        grams = {k: words.windows(hashes, k)[0] for k in range(1, SHINGLE + 1)}
        for i, (item, _) in enumerate(items):
            first, last = int(words.first[i]), int(words.first[i + 1])
            length = min(size, last - first)
            for at in range(first, last - length + 1) if length else ():
                text = b" ".join(data[words.start[j] : words.end[j]] for j in range(at, at + length))
                if text not in known:
                    known[text] = len(self.windows)
                    k = min(SHINGLE, length)
                    self.windows.append((length, text))
                    self.items.append([])
                    self.shingles.append([(k, int(grams[k][j])) for j in range(at, at + length - k + 1)])
                if item not in self.items[known[text]]:
                    self.items[known[text]].append(item)

    def all_keys(self) -> dict[int, Keys]:
        found = defaultdict(set)
        for shingles in self.shingles:
            for k, value in shingles:
                found[k].add(value)
        return {k: Keys(np.array(sorted(values), U)) for k, values in found.items()}

    def index(self, counts: dict[tuple[int, int], int]) -> dict[int, tuple[Keys, list[list[tuple[int, int]]]]]:
        """For each shingle size the prefix keys, and for each key its (window, place in it)."""
        chosen: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for window, shingles in enumerate(self.shingles):
            place = min(range(len(shingles)), key=lambda j: (counts.get(shingles[j], 0), shingles[j], j))
            k, value = shingles[place]
            chosen[k][value].append((window, place))
        return {k: (Keys(np.array(sorted(found), U)), [found[v] for v in sorted(found)])
                for k, found in chosen.items()}


def shingle_counts(found: Iterator[pa.RecordBatch], keys: Shared) -> Iterator[pa.RecordBatch]:
    totals = {k: np.zeros(len(own.keys), np.int64) for k, own in keys.value.items()}
    for batch in batches(found, "body"):
        words = Words(Texts(batch.column("body"), lower=True), WORDLIKE)
        hashes = words.hashes()
        for k, own in keys.value.items():
            _, number = own.find(*words.windows(hashes, k))
            totals[k] += np.bincount(number, minlength=len(own.keys))
    for k, own in keys.value.items():
        some = np.flatnonzero(totals[k])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(some), k, np.int32)), pa.array(own.keys[some].view(np.int64)),
             pa.array(totals[k][some])], names=["k", "shingle", "n"])


FOUND = "struct<n_words: bigint, n_hit: bigint, hits: binary, items: array<string>>"
ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("hits", pa.binary()),
                   ("items", pa.list_(pa.string()))])


def search(column: pa.Array, block: Block, index: dict) -> list[dict]:
    texts = Texts(column, lower=True)
    words = Words(texts, WORDLIKE)
    hashes = words.hashes()
    hit = np.zeros(len(hashes) + 1, np.int32)
    items: dict[int, set[str]] = defaultdict(set)
    for k, (keys, entries) in index.items():
        at, number = keys.find(*words.windows(hashes, k))
        owner = np.searchsorted(words.first, at, side="right") - 1
        for place, key, doc in zip(at.tolist(), number.tolist(), owner.tolist()):
            for window, offset in entries[key]:
                length, text = block.windows[window]
                start = place - offset
                if start < words.first[doc] or start + length > words.first[doc + 1]:
                    continue
                if text == b" ".join(texts.data[words.start[j] : words.end[j]].tobytes()
                                     for j in range(start, start + length)):
                    hit[start] += 1
                    hit[start + length] -= 1
                    items[doc].update(block.items[window])
    inside = np.cumsum(hit)[:-1] > 0
    out = []
    for i in range(texts.n):
        own = inside[words.first[i] : words.first[i + 1]]
        out.append({"n_words": len(own), "n_hit": int(own.sum()),
                    "hits": np.packbits(own).tobytes() if i in items else None, "items": sorted(items.get(i, ()))})
    return out


def finder(block: Shared):
    @F.arrow_udf(FOUND)
    def find(body: pa.Array) -> pa.Array:
        rows = [row for part in slices(body) for row in search(part, *block.value)]
        return pa.array(rows, ARROW)

    return find


@F.arrow_udf(LongType())
def joint_hits(maps: pa.Array) -> pa.Array:
    """Words hit by any block."""
    out = []
    for row in maps:
        some = [np.frombuffer(x.as_py(), np.uint8) for x in row.values if x.is_valid]
        out.append(int(np.unpackbits(np.bitwise_or.reduce(some)).sum()) if some else 0)
    return pa.array(out, pa.int64())


def matches(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = 8 << 20,
            text: str = "text", item_id: str = "item_id", item_text: str = "text") -> Column:
    """A column of structs ``n_words, n_hit, items`` for the rows of ``docs``.

    Running this function counts the rarity of the benchmark's shingles over all of ``docs``.  Null
    texts have no words, null or wordless items no windows; repeated items count once, an item without
    an id is named by the empty string.  ``block_bytes`` bounds what is held of the benchmark at once.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    body = F.col(text).cast("string").cast("binary")
    found = []
    for number in range(count):
        own = items.filter(F.expr(f"pmod(xxhash64(item, text), {count}) = {number}"))
        block = Block([(row.item, row.text) for row in own.collect()], size)
        keys = Shared(spark, block.all_keys())
        counted = docs.select(body.alias("body")).mapInArrow(
            lambda rows, keys=keys: shingle_counts(rows, keys), "k int, shingle bigint, n bigint")
        counts = {(row.k, row.shingle % 2**64): row.n
                  for row in counted.groupBy("k", "shingle").agg(F.sum("n").alias("n")).collect()}
        ready = Shared(spark, (block, block.index(counts)))
        found.append(finder(ready)(body))
    names = F.array_sort(F.array_distinct(F.flatten(F.array(*[f["items"] for f in found]))))
    hits = found[0]["n_hit"] if count == 1 else joint_hits(F.array(*[f["hits"] for f in found]))
    return F.struct(found[0]["n_words"].alias("n_words"), hits.alias("n_hit"), names.alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  **options) -> DataFrame:
    """``doc_id, n_words, n_hit, items`` for every row of ``docs``; other columns are ignored."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return own.select("doc_id", matches(own, benchmark, **options).alias("m")).select("doc_id", "m.*")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of the benchmark stands."""
    held = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    marked = held.select("row", matches(held, benchmark, **options).alias("m"))
    return marked.filter("m.n_hit = 0").select("row.*")


def op8(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',"
          " 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT CAST(item_id AS varchar) AS item, {_WORDS} AS words FROM benchmark),
w AS (SELECT item, least(10, len(words)) AS k, unnest(range(1, greatest(len(words) - 8, 2))) AS i, words FROM b WHERE len(words) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(words[i:i + k - 1], ' ') AS g FROM w),
places AS (SELECT doc_id, k, i, array_to_string(words[i:i + k - 1], ' ') AS g FROM
    (SELECT doc_id, k, words, unnest(range(1, len(words) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(words) >= k)),
found AS (SELECT doc_id, item, win.k, i FROM places JOIN win ON win.k = places.k AND win.g = places.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY 1),
its AS (SELECT doc_id, list_sort(list_distinct(list(item))) AS items FROM found GROUP BY 1)
SELECT d.doc_id, CAST(len(words) AS bigint) AS n_words, CAST(coalesce(hit.n, 0) AS bigint) AS n_hit,
  CAST(coalesce(len(items), 0) AS bigint) AS n_items,
  sha256(array_to_string(coalesce(items, []), ',')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""
