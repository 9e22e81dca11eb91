"""Byte-level deduplication by merged Burrows-Wheeler transforms.

A byte is removed if a string of 100 bytes around it also starts earlier: in a document with a smaller
id, or before in its own.

1. Every window of 100 bytes is assigned to its anchor, the 24-gram of least hash in it (the leftmost of
   equals).  Equal windows have equal anchors at the same place, so windows only meet under one anchor.
   Tasks deal the distinct anchors of a shard of texts to buckets; a bucket marks those found twice in its
   share of a filter.  The filter has a fixed largest size; a fuller one costs time, not results.
2. Consecutive windows of one marked anchor make a snippet.  A snippet repeated within a shard is settled
   there; the first of each kind goes to the bucket of its anchor, once per shard.  There snippets that are
   whole copies across shards are settled first; windows of one snippet differ, as their anchor stands at another
   place in each, so an anchor left with a single snippet holds no repeat, and its snippet takes no further part.
   An anchor with too many different snippets is crowded (a fixed phrase in ever new contexts).  Its windows
   go one by one to buckets by a 128-bit hash of their bytes, so that only equal ones meet; those repeated
   within a part of a shard are settled there.
3. A bucket holds the different snippets of many shards.  For each shard they form a collection of strings over an
   alphabet of 25-byte blocks (each place starts one, so every suffix is there), with a transform of its
   own.  The transforms are merged by refining their interleave: one round deals the shards' symbols out
   in the order so far, which sorts by one block more, and a boundary that first shows in round h
   tells a common prefix of h - 1 blocks.  No suffix is compared with another.  After four rounds the
   intervals without a boundary are the repeated windows; all but the first of each are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.anchors import LAST, Layout, groups
from palimpsest.llm.words import K1, K2, KEEP, Shared, Texts, U, batches, mix, slices

LENGTH, GRAM, BLOCK = 100, 24, 25
ROUNDS = LENGTH // BLOCK
SHARD = 16 << 20  # bytes of text settled at once
CROWD = 1 << 12  # different snippets of an anchor, added up over shards, beyond which it is crowded
WINDOWS = 1 << 19  # windows of crowded anchors settled at once
SEEDS = (LENGTH, LENGTH << 32)

SNIPPETS = "bucket bigint, kind int, ids binary, marks binary, starts binary, sizes binary, anchors binary, bodies binary"
SPANS = "doc_id bigint, mark bigint, spans binary"


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each place on."""
    n = len(data) - size + 1
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = np.full(n, size, U)
    for at in range(0, size, 8):
        h = mix((h ^ (eight[at : at + n] & KEEP[min(8, size - at)])) * K1 + K2)
    return h


def hashes_at(data: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of the ``LENGTH`` bytes from each place of ``at`` on."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = np.full(len(at), seed, U)
    for step in range(0, LENGTH, 8):
        h = mix((h ^ (eight[at + step] & KEEP[min(8, LENGTH - step)])) * K1 + K2)
    return h


def anchored(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: the first start, the last start, and the hash of the anchor."""
    data = texts.data
    if len(data) < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U)
    h = gram_hashes(data, GRAM)
    least = ((h >> U(32)) << U(32)) | np.arange(len(h), dtype=U)
    width, have = LENGTH - GRAM + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if width > have:
        least = np.minimum(least[: have - width], least[width - have :])
    place = (least & U(0xFFFFFFFF)).astype(np.int64)
    edges = np.zeros(len(data) + 1, np.int32)
    long = np.diff(texts.offsets) >= LENGTH
    np.add.at(edges, texts.offsets[:-1][long], 1)
    np.subtract.at(edges, texts.offsets[1:][long] - LENGTH + 1, 1)
    inside = np.cumsum(edges)[: len(place)] > 0
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    first, last = first[inside[first]], last[inside[first]]
    return first, last, mix(h[place[first]])  # mixed anew, as anchors have small hashes


def shards(found: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[Texts, pa.RecordBatch, tuple]]]:
    """Lists of texts with their anchored runs, bounded in bytes unless one text is longer."""
    held, size = [], 0
    for batch in batches(found, "body", 2 << 20):
        texts = Texts(batch.column("body"))
        held.append((texts, batch, anchored(texts)))
        size += len(texts.data)
        if size >= SHARD:
            yield held
            held, size = [], 0
    if held:
        yield held


def anchor_rows(found: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    """The distinct anchors of each shard, whether they stand in it more than once, and if so with how many snippets."""
    for shard in shards(found):
        h = np.concatenate([runs[2] for _, _, runs in shard])
        if not len(h):
            continue
        order = np.argsort(h)
        at = groups(h[order])
        size = np.diff(np.append(at, len(h)))
        several = size > 1
        # the first and the last window hold all bytes of a snippet
        again = np.zeros(len(h), bool)
        again[order] = np.repeat(several, size)
        bodies, base = np.zeros(len(h), U), 0
        for texts, _, (first, last, own) in shard:
            live = np.flatnonzero(again[base : base + len(own)])
            ends = [hashes_at(texts.data, place[live], LENGTH) for place in (first, last)]
            bodies[base + live] = mix(ends[0] * K1 + ends[1] + (last - first)[live].astype(U))
            base += len(own)
        inner = order[again[order]]
        inner = inner[np.lexsort((bodies[inner], h[inner]))]
        new = np.concatenate([[True], (h[inner][1:] != h[inner][:-1]) | (bodies[inner][1:] != bodies[inner][:-1])]) if len(inner) else again[:0]
        counts = np.add.reduceat(new.astype(np.uint32), groups(h[inner])) if len(inner) else np.zeros(0, np.uint32)
        h = h[order][at]
        bucket, prints = layout.bucket(h), layout.print_(h)
        cuts = np.append(groups(bucket), len(bucket))
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        told = np.concatenate([[0], np.cumsum(several)]).tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(bucket[a]) for a, _ in spans], pa.int64()),
             pa.array([prints[a:b].tobytes() for a, b in spans], pa.binary()),
             pa.array([np.packbits(several[a:b]).tobytes() for a, b in spans], pa.binary()),
             pa.array([counts[told[a] : told[b]].astype(np.uint32).tobytes() for a, b in spans], pa.binary())],
            names=["bucket", "prints", "several", "counts"])


def share_rows(layout: Layout, crowd: int):
    """A bucket's share of the filter, and its anchors with more than ``crowd`` snippets."""
    def reduce(table: pa.Table) -> pa.Table:
        prints, counts, several = [], [], []
        for p, s, c in zip(*[table.column(c).to_pylist() for c in ("prints", "several", "counts")]):
            prints.append(np.frombuffer(p, np.uint32))
            several.append(np.unpackbits(np.frombuffer(s, np.uint8), count=len(prints[-1])).astype(bool))
            counts.append(np.ones(len(prints[-1]), np.int64))
            counts[-1][several[-1]] = np.frombuffer(c, np.uint32)
        p, s, n = np.concatenate(prints), np.concatenate(several), np.concatenate(counts)
        order = np.argsort(p)
        p, s, n = p[order], s[order], n[order]
        at = groups(p)
        shared = (np.diff(np.append(at, len(p))) > 1) | np.logical_or.reduceat(s, at)
        bits = np.zeros(layout.width, bool)
        for places in layout.places(p[at][shared]):
            bits[places] = True
        crowded = p[at][shared & (np.add.reduceat(n, at) > crowd)]
        return pa.table({"bucket": table.column("bucket")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()),
                         "crowded": pa.array([crowded.tobytes()], pa.binary())})

    return reduce


def marked(h: np.ndarray, layout: Layout, bits: np.ndarray) -> np.ndarray:
    bucket = layout.bucket(h)
    out = np.ones(len(h), np.uint8)
    for place in layout.places(layout.print_(h)):
        place = place + bucket * layout.width
        out &= bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)
    return (out & 1).astype(bool)


def within(h: np.ndarray, layout: Layout, crowded: np.ndarray) -> np.ndarray:
    """Which anchors are among ``crowded``, sorted buckets and prints in one number."""
    if not len(crowded):
        return np.zeros(len(h), bool)
    key = h >> U(32 - layout.bits)
    return crowded[np.minimum(np.searchsorted(crowded, key), len(crowded) - 1)] == key


def snippet_batch(kind: int, bucket: np.ndarray, ids, marks, starts, sizes, bodies: list[bytes] | np.ndarray | None,
                  anchors=None) -> pa.RecordBatch:
    """Rows of one kind, packed by bucket; each body is followed by one zero byte, hashes stand as they are."""
    ids, marks, starts = (np.array(x, np.int64) for x in (ids, marks, starts))
    sizes = np.array(sizes, np.int32)
    order = np.lexsort((starts, ids, bucket))
    bucket, ids, marks, starts, sizes = bucket[order], ids[order], marks[order], starts[order], sizes[order]
    cuts = np.append(groups(bucket), len(bucket))
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
    packed = [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (ids, marks, starts, sizes)]
    anchors = np.array(anchors, U)[order] if anchors is not None else None
    if isinstance(bodies, np.ndarray):
        text = [bodies[order[a:b]].tobytes() for a, b in spans]
    else:
        text = [b"".join(bodies[i] + b"\0" for i in order[a:b].tolist()) if bodies else None for a, b in spans]
    return pa.RecordBatch.from_arrays(
        [pa.array([int(bucket[a]) for a, _ in spans], pa.int64()), pa.array([kind] * len(spans), pa.int32()), *packed,
         pa.array([anchors[a:b].tobytes() if anchors is not None else None for a, b in spans], pa.binary()),
         pa.array(text, pa.binary())], names=["bucket", "kind", "ids", "marks", "starts", "sizes", "anchors", "bodies"])


def earliest(hashes: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Marks the windows of which no equal one starts earlier; ``hashes`` has two columns."""
    order = np.lexsort((starts, ids, hashes[:, 1], hashes[:, 0]))
    found = hashes[order]
    at = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]).any(axis=1)]))
    least = np.repeat(order[at], np.diff(np.append(at, len(order))))
    out = np.empty(len(order), bool)
    out[order] = (ids[order] == ids[least]) & (starts[order] == starts[least])
    return out


def id_bucket(ids: np.ndarray, layout: Layout) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U)) >> U(64 - layout.bits)).astype(np.int64)


def window_rows(runs: list[tuple[np.ndarray, ...]], layout: Layout) -> Iterator[pa.RecordBatch]:
    """Kind 2: the first of each window under crowded anchors.  Kind 1: its repeats.  Settled part by part.

    ``runs`` are of one list of texts each: its bytes, and for each run anchor, place, windows, id, mark, start.
    """
    data = np.concatenate([run[0] for run in runs])
    base = np.cumsum([0] + [len(run[0]) for run in runs])
    h, begin, width, ids, marks, starts = (np.concatenate(x) for x in zip(*(run[1:] for run in runs)))
    begin = begin + np.repeat(base[:-1], [len(run[1]) for run in runs])
    order = np.argsort(h, kind="stable")
    upto = np.cumsum(width[order])
    for part in np.split(order, np.searchsorted(upto, np.arange(WINDOWS, upto[-1], WINDOWS))):
        if not len(part):
            continue
        n = width[part]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, i, m, s = np.repeat(begin[part], n) + step, np.repeat(ids[part], n), np.repeat(marks[part], n), np.repeat(starts[part], n) + step
        hashes = np.stack([hashes_at(data, at, seed) for seed in SEEDS], axis=1)
        first = earliest(hashes, i, s)
        bucket = layout.bucket(hashes[first, 0])
        yield snippet_batch(2, bucket, i[first], m[first], s[first], np.full(len(bucket), LENGTH), hashes[first])
        if first.all():
            continue
        i, m, s = i[~first], m[~first], s[~first]
        by = np.lexsort((s, m, i))
        i, m, s = i[by], m[by], s[by]
        new = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (m[1:] != m[:-1]) | (s[1:] - s[:-1] > 1)]))
        last = s[np.append(new[1:], len(s)) - 1]
        yield snippet_batch(1, id_bucket(i[new], layout), i[new], m[new], s[new], last - s[new] + LENGTH, None)


def snippet_rows(found: Iterator[pa.RecordBatch], layout: Layout, bits: Shared, crowded: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Kind 0: the first of each marked snippet of a shard.  Kind 1: its repeats there, without text.

    Snippets under crowded anchors are left to ``window_rows``.
    """
    for shard in shards(found):
        first: dict[bytes | tuple[bytes, int], tuple[int, ...]] = {}
        later: list[tuple[int, int, int, int]] = []
        apart = []
        for texts, batch, (begin, end, h) in shard:
            hit = marked(h, layout, bits.value)
            begin, end, h = begin[hit], end[hit], h[hit]
            owner = np.searchsorted(texts.offsets, begin, side="right") - 1
            ids = batch.column("doc_id").fill_null(LAST).to_numpy(zero_copy_only=False)[owner]
            marks = batch.column("mark").to_numpy(zero_copy_only=False)[owner]
            starts = begin - texts.offsets[owner]
            many = within(h, layout, crowded)
            if many.any():
                apart.append((texts.data, *(x[many] for x in (h, begin, end - begin + 1, ids, marks, starts))))
            columns = (x[~many].tolist() for x in (begin, end + LENGTH, ids, marks, starts, layout.bucket(h), h))
            whole = texts.data.tobytes()
            for a, b, i, m, s, k, g in zip(*columns):
                body, new = whole[a:b], (i, s, m, k, g)
                old = first.setdefault(body, new)
                if old is new or old[:3] == new[:3]:
                    continue
                if old[:2] == new[:2]:  # another text under the same id: neither is earlier
                    first[body, m] = new
                elif new < old:
                    first[body] = new
                    later.append((*old[:3], b - a))
                else:
                    later.append((*new[:3], b - a))
        # a second text under an id that is no longer the first is a repeat like any other
        for key in [k for k in first if isinstance(k, tuple)]:
            if first[key][:2] != first[key[0]][:2]:
                later.append((*first.pop(key)[:3], len(key[0])))
        if first:
            ids, starts, marks, bucket, anchors = zip(*first.values())
            bodies = [k[0] if isinstance(k, tuple) else k for k in first]
            yield snippet_batch(0, np.array(bucket, np.int64), ids, marks, starts, [len(x) for x in bodies], bodies, anchors)
        if later:
            ids, starts, marks, sizes = (np.array(x) for x in zip(*later))
            yield snippet_batch(1, id_bucket(ids, layout), ids, marks, starts, sizes, None)
        if apart:
            yield from window_rows(apart, layout)


def ranked(keys: np.ndarray, bits: int) -> np.ndarray:
    """The stable order of ``keys``, by 16 bits at a time, which numpy deals out without comparing."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable").astype(np.int32)
    for low in range(16, bits, 16):
        digit = ((keys >> keys.dtype.type(low)) & keys.dtype.type(0xFFFF)).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
    return order


def numbered(hashes: np.ndarray) -> np.ndarray:
    """Equal hashes get equal numbers from 0 on."""
    order = ranked(hashes, 64)
    found = hashes[order]
    out = np.empty(len(hashes), np.int32)
    out[order] = np.cumsum(np.concatenate([[False], found[1:] != found[:-1]]), dtype=np.int32)
    return out


def deal(order: np.ndarray, offset: np.ndarray, symbol: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    """One round within shards: places sorted by one block more than in ``order``."""
    before = order[offset[order] >= BLOCK] - BLOCK
    return np.concatenate([ends, before[ranked(symbol[before], bits)]])


def transforms(offset: np.ndarray, symbol: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of each shard's suffixes in order, shard after shard, and the block before each (-1: none)."""
    ends = np.flatnonzero(symbol < 0).astype(np.int32)
    order = np.concatenate([ends, np.flatnonzero(symbol >= 0).astype(np.int32)])
    bits = int(symbol.max()).bit_length()
    for _ in range(ROUNDS):
        order = deal(order, offset, symbol, ends, bits)
    order = order[ranked(shard[order], int(shard[-1]).bit_length())]
    return order, np.where(offset[order] >= BLOCK, symbol[order - BLOCK], -1)


def interleave(before: np.ndarray, shard: np.ndarray, n_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges transforms that stand one after the other, those of shard s being ``before[shard == s]``.

    Returns for each merged place the row in ``before``, and how many blocks it has in common with the
    place before it (``ROUNDS``: all that were looked at).  ``n_ends`` are the suffixes of less than a
    block in each shard, which come first.
    """
    n = len(before)
    kind = np.uint16 if len(n_ends) < 1 << 16 else np.int64
    z = shard.astype(kind)
    ends = np.repeat(np.arange(len(n_ends), dtype=kind), n_ends)
    common = np.full(n, ROUNDS, np.int32)
    common[:1] = 0
    interval = np.zeros(n, np.int32)
    bits = int(before.max()).bit_length()
    for h in range(1, ROUNDS + 1):
        row = np.empty(n, np.int32)
        row[np.argsort(z, kind="stable")] = np.arange(n, dtype=np.int32)
        found = before[row]
        has = np.flatnonzero(found >= 0).astype(np.int32)
        has = has[ranked(found[has], bits)]
        symbol, source = found[has], interval[has]
        z = np.concatenate([ends, z[has]])
        new = np.zeros(n, bool)
        new[len(ends) :] = np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (source[1:] != source[:-1])]) if len(has) else []
        common[new & (common == ROUNDS)] = h - 1
        interval = np.cumsum(new, dtype=np.int32)
    row = np.empty(n, np.int32)
    row[np.argsort(z, kind="stable")] = np.arange(n, dtype=np.int32)
    return row, common


def repeated(body: np.ndarray, sizes: np.ndarray, shard: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Marks the places of ``body`` at which a window starts that also starts earlier.

    ``body`` holds snippets of ``sizes`` bytes, each followed by a zero byte; ``shard`` runs upwards from 0.
    """
    slots = sizes.astype(np.int64) + 1
    own = np.repeat(np.arange(len(sizes), dtype=np.int32), slots)
    offset = (np.arange(len(body)) - np.repeat(np.cumsum(slots) - slots, slots)).astype(np.int32)
    room = np.repeat(sizes.astype(np.int32), slots) - offset
    symbol = np.full(len(body), -1, np.int32)
    full = np.flatnonzero(room >= BLOCK)
    symbol[full] = numbered(gram_hashes(body, BLOCK)[full])
    place_shard = shard[own].astype(np.int32)
    order, before = transforms(offset, symbol, place_shard)
    n_ends = np.bincount(place_shard[symbol < 0], minlength=int(shard[-1]) + 1)
    row, common = interleave(before, place_shard[order], n_ends)
    place, interval = order[row], np.cumsum(common < ROUNDS)
    whole = room[place] >= LENGTH
    place, interval = place[whole], interval[whole]
    at = groups(interval)
    width = np.diff(np.append(at, len(interval)))
    least = np.repeat(np.minimum.reduceat(ids[own[place]], at), width)
    start = starts[own[place]] + offset[place]
    start_of_least = np.where(ids[own[place]] == least, start, LAST)
    first = np.repeat(np.minimum.reduceat(start_of_least, at), width)
    gone = np.zeros(len(body), bool)
    gone[place[start_of_least != first]] = True
    return gone


def settled(body: np.ndarray, sizes: np.ndarray, anchors: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks the snippets of which no copy starts earlier, and those whose anchor has different snippets."""
    ends = np.cumsum(sizes.astype(np.int64) + 1)
    whole, seen = body.tobytes(), {}
    numbers = np.array([seen.setdefault(whole[b - n - 1 : b - 1], len(seen)) for b, n in zip(ends.tolist(), sizes.tolist())], U)
    first = earliest(np.stack([anchors, numbers], axis=1), ids, starts)
    order = np.argsort(anchors, kind="stable")
    at = groups(anchors[order])
    several = np.minimum.reduceat(numbers[order], at) != np.maximum.reduceat(numbers[order], at)
    contested = np.empty(len(sizes), bool)
    contested[order] = np.repeat(several, np.diff(np.append(at, len(order))))
    return first, contested


def span_rows(table: pa.Table) -> pa.Table:
    """``doc_id, mark, spans``: first and last starts of removed windows, packed per document."""
    found, parts, windows = [], [], []
    columns = [table.column(c).to_pylist() for c in ("kind", "ids", "marks", "starts", "sizes", "anchors", "bodies")]
    for kind, *packed, anchors, body in zip(*columns):
        ids, marks, starts = (np.frombuffer(x, np.int64) for x in packed[:3])
        sizes = np.frombuffer(packed[3], np.int32)
        if kind == 2:
            windows.append((ids, marks, starts, np.frombuffer(body, U).reshape(-1, 2)))
        elif kind:
            found.append((ids, marks, starts, starts + sizes - LENGTH))
        else:
            parts.append((ids, marks, starts, sizes, np.frombuffer(anchors, U), np.frombuffer(body, np.uint8)))
    live = np.zeros(0, bool)
    if parts:
        ids, marks, starts, sizes, anchors, body = (np.concatenate(x) for x in zip(*parts))
        shard = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        first, contested = settled(body, sizes, anchors, ids, starts)
        found.append((ids[~first], marks[~first], starts[~first], (starts + sizes - LENGTH)[~first]))
        live = first & contested
    if live.any():
        body = body[np.repeat(live, sizes.astype(np.int64) + 1)]
        ids, marks, starts, sizes = ids[live], marks[live], starts[live], sizes[live]
        shard = np.unique(shard[live], return_inverse=True)[1]
        gone = repeated(body, sizes, shard, ids, starts)
        edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        slots = sizes.astype(np.int64) + 1
        at = np.cumsum(slots) - slots
        own = np.searchsorted(at, a, side="right") - 1
        found.append((ids[own], marks[own], starts[own] + a - at[own], starts[own] + b - at[own]))
    if windows:
        ids, marks, starts, hashes = (np.concatenate(x) for x in zip(*windows))
        gone = ~earliest(hashes, ids, starts)
        found.append((ids[gone], marks[gone], starts[gone], starts[gone]))
    ids, marks, a, b = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((a, marks, ids))
    ids, marks, a, b = ids[order], marks[order], a[order], b[order]
    new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])])) if len(ids) else ids
    cuts = np.append(new, len(ids)).tolist()
    return pa.table({"doc_id": pa.array(ids[new]), "mark": pa.array(marks[new]),
                     "spans": pa.array([np.concatenate([a[i:j], b[i:j]]).tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())})


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """``doc_id, mark, spans``: packed first and last starts of removed windows; ``mark`` is a hash of the text.

    ``crowd`` is how many snippets may meet under one anchor; it decides the way taken, not the result.

    Rows without an id come behind all others, under the largest id there is.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("body"))
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    layout = Layout(size // 40, per_bucket=1 << 15)
    index = rows.select("doc_id", "body").mapInArrow(
        lambda found: anchor_rows(found, layout), "bucket bigint, prints binary, several binary, counts binary")
    shares = index.groupBy("bucket").applyInArrow(share_rows(layout, crowd), "bucket bigint, bits binary, crowded binary").toArrow()
    bits = np.zeros(layout.buckets * layout.width // 8, np.uint8)
    many = [np.zeros(0, U)]
    for bucket, share, crowded in zip(*(shares.column(c).to_pylist() for c in ("bucket", "bits", "crowded"))):
        many.append((U(bucket) << U(32)) | np.frombuffer(crowded, np.uint32).astype(U))
        bits[bucket * layout.width // 8 : (bucket + 1) * layout.width // 8] = np.frombuffer(share, np.uint8)
    shared, many = Shared(docs.sparkSession, bits), np.sort(np.concatenate(many))
    found = rows.withColumn("mark", F.xxhash64("body")).mapInArrow(
        lambda batches_: snippet_rows(batches_, layout, shared, many), SNIPPETS)
    return found.groupBy("bucket").applyInArrow(span_rows, SPANS).groupBy("doc_id", "mark").agg(
        F.collect_list("spans").alias("spans"))


def covered(size: int, spans: list[bytes] | None) -> np.ndarray:
    """Bytes of a text of this size that lie in a removed window."""
    edges = np.zeros(size + 1, np.int32)
    for part in spans or []:
        a, b = np.frombuffer(part, np.int64).reshape(2, -1)
        np.add.at(edges, a, 1)
        np.subtract.at(edges, b + LENGTH, 1)
    return np.cumsum(edges[:-1]) > 0


MEASURED = "struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept_sha256: string>"


def counter():
    @F.arrow_udf(MEASURED)
    def count(body: pa.Array, spans: pa.Array) -> pa.Array:
        out, at = [], 0
        for part in slices(body):
            texts = Texts(part)
            for i, own in enumerate(spans.slice(at, len(part)).to_pylist()):
                whole = texts.data[texts.offsets[i] : texts.offsets[i + 1]]
                gone = covered(len(whole), own)
                out.append({"n_bytes": len(whole), "n_removed": int(gone.sum()),
                            "n_spans": int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()),
                            "kept_sha256": hashlib.sha256(whole[~gone].tobytes()).hexdigest()})
            at += len(part)
        return pa.array(out, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                                        ("kept_sha256", pa.string())]))

    return count


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row.

    A null or empty text has no bytes, and a text of less than 100 bytes loses none.  Of rows with the
    same id only an earlier start counts as earlier, so that two equal rows of one id both stay; a row
    without an id comes after all others.  Other columns are ignored.
    """
    found = repeats(docs, doc_id, text, crowd).select(F.col("doc_id").alias("found_id"), F.col("mark").alias("found_mark"), "spans")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("body")).select(
        "doc_id", "body", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("held_id"),
        F.xxhash64("body").alias("held_mark"))
    joined = own.join(found, (F.col("held_id") == F.col("found_id")) & (F.col("held_mark") == F.col("found_mark")), "left")
    return joined.select("doc_id", counter()(F.col("body"), F.col("spans")).alias("c")).select("doc_id", "c.*")


def op1(docs: DataFrame) -> DataFrame:
    return measure(docs)
