"""Near-duplicate groups by b-bit MinHash.

Each distinct word sequence is one node.  Its signature keeps the low bits of 128 minima, packed into
eight longs; the full minima only serve to form band keys and are not kept.  Nodes that share a band
key are candidates, the share of equal low bits, corrected for chance agreement, rejects most of the
wrong ones, and the rest are confirmed on whole shingle sets.

No group is ever written out as pairs.  In each bucket all nodes are first compared with one of it, the first
by an order of all nodes; as the order is the same in every bucket, a group of any size is linked by hardly
more pairs than members.  Where several components are left in a bucket this is done again with other
``CENTRES``, only between nodes of different components.  What is then left is searched by its rarest shingles: two sets as similar as asked share one of the first
``|x| - ceil(threshold * |x|) + 1`` shingles of each in any order common to all, here from rare to frequent,
and the first one they share stands so far in front in both that what follows can still suffice.  Documents
that only share a template, a passage or a boilerplate do not meet there.  Only nodes of different components
are compared, and never two of the largest one of a shingle.  So each pair that shares a band key is either
connected already or tested.  How frequent a shingle is follows from counts in a table of
``CELLS`` cells; these only choose the order, any order finds all pairs.

A pair at the threshold shares none of the 32 bands of 4 minima with probability 5e-6, and the
estimates are accepted from five standard deviations below the threshold: 0.2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.words import NOT_SPACE, Shared, Texts, U, Words, batches, distinct, mix
from palimpsest.scratch import stage

MINIMA, ROWS, BITS = 128, 4, 4
BANDS, LANES = MINIMA // ROWS, 64 // BITS
SLACK = 0.2
CENTRES = (1, 4, 4)  # nodes of a bucket with which the others are compared, turn by turn
CELLS = 1 << 20
BATCH = 2 << 20  # bytes of text in a task at once
_seeds = np.random.default_rng(20240607)
MULTIPLY = (_seeds.integers(0, 2**32, MINIMA, dtype=np.uint64) | U(1)).astype(np.uint32)
ADD = _seeds.integers(0, 2**32, MINIMA, dtype=np.uint64).astype(np.uint32)


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """For each text the sorted distinct shingle hashes, and a key of its word sequence."""
    words = Words(Texts(column, lower=True), NOT_SPACE)
    hashes = words.hashes()
    whole, _ = words.windows(hashes, size)
    for first, last in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        own = hashes[first:last]
        key = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
        if last - first >= size:
            yield distinct(whole[first : last - size + 1]), key
        elif last > first:
            yield np.frombuffer(key[:8], "<u8"), key
        else:
            yield np.zeros(0, U), key


def minima(shingles: np.ndarray) -> np.ndarray:
    low = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    half = (shingles >> U(32)).astype(np.uint32)
    for at in range(0, len(half), 2048):
        part = half[None, at : at + 2048] * MULTIPLY[:, None] + ADD[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    quads = low.reshape(BANDS, ROWS).astype(U)
    key = np.arange(1, BANDS + 1, dtype=U)
    for r in range(ROWS):
        key = mix(key ^ quads[:, r])
    return key.view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """The low bits of the minima, ``LANES`` to a long.  Minima are mixed first: a product's own low
    bits say little."""
    bits = (mix(low.astype(U)) & U(2**BITS - 1)).reshape(-1, LANES)
    return np.bitwise_or.reduce(bits << (np.arange(LANES, dtype=U) * U(BITS)), axis=1).view(np.int64)


DIGEST = "rid bigint, doc_id bigint, sequence binary, n_shingles bigint, signature array<bigint>, bands array<bigint>"


def digests(found: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches(found, "body", BATCH):
        counts, keys, signatures, bands = [], [], [], []
        for shingles, key in shingle_sets(batch.column("body"), size):
            counts.append(len(shingles))
            keys.append(key)
            low = minima(shingles) if len(shingles) else None
            signatures.append(packed(low) if low is not None else None)
            bands.append(band_keys(low) if low is not None else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid"), batch.column("doc_id"), pa.array(keys, pa.binary()),
             pa.array(counts, pa.int64()), pa.array(signatures, pa.list_(pa.int64())),
             pa.array(bands, pa.list_(pa.int64()))],
            names=["rid", "doc_id", "sequence", "n_shingles", "signature", "bands"],
        )


def sets_of(found: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches(found, "body", BATCH):
        pairs = list(shingle_sets(batch.column("body"), size))
        yield pa.RecordBatch.from_arrays(
            [pa.array([key for _, key in pairs], pa.binary()),
             pa.array([s.view(np.int64) for s, _ in pairs], pa.list_(pa.int64()))],
            names=["sequence", "shingles"],
        )


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]].view(U), offsets - offsets[0]


def cells(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets of a task hold a shingle of each cell."""
    total = np.zeros(CELLS, np.int64)
    for batch in found:
        values, _ = flat(batch.column("shingles"))
        total += np.bincount((values % U(CELLS)).astype(np.int64), minlength=CELLS)
    some = np.flatnonzero(total)
    for at in range(0, len(some), 1 << 16):
        part = some[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["cell", "n"])


def prefixes(found: Iterator[pa.RecordBatch], counts: Shared, percent: int) -> Iterator[pa.RecordBatch]:
    """The shingles of which each pair of similar sets shares one, with the size of the set."""
    often = counts.value
    for batch in found:
        values, offsets = flat(batch.column("shingles"))
        nodes, tokens, places, sizes = [], [], [], []
        for node, a, b in zip(batch.column("node").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            own = values[a:b]
            first = len(own) - -(-percent * len(own) // 100) + 1
            order = np.lexsort((own, often[(own % U(CELLS)).astype(np.int64)]))[:first]
            tokens.append(own[order])
            places.append(np.arange(len(order)))
            nodes.append(np.full(len(order), node))
            sizes.append(np.full(len(order), len(own)))
        none = [np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([*tokens, np.zeros(0, U)]).view(np.int64)), pa.array(np.concatenate(nodes + none)),
             pa.array(np.concatenate(places + none)), pa.array(np.concatenate(sizes + none))],
            names=["token", "node", "place", "size"])


def estimate(a: str, b: str) -> str:
    """SQL of the collision-corrected similarity of two packed signatures."""
    mask = "1229782938247303441"  # 0x1111111111111111
    lanes = []
    for i in range(MINIMA // LANES):
        x = f"({a}[{i}] ^ {b}[{i}])"
        lanes.append(
            f"bit_count(({x} | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2)"
            f" | shiftrightunsigned({x}, 3)) & {mask})"
        )
    chance = 1 / 2**BITS
    return f"((1D - ({' + '.join(lanes)}) / {MINIMA}D - {chance}D) / {1 - chance}D)"


def shingles_of(asked: DataFrame, texts: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``node, shingles`` of the asked nodes, made again from the texts in question only."""
    asked = stage(nodes.join(asked.select("node").distinct(), "node").select("node", "doc_id", "sequence"), "minhash-asked")
    wanted = asked.select("doc_id").distinct()
    bodies = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi").select("body")
    sets = bodies.mapInArrow(lambda found: sets_of(found, size), "sequence binary, shingles array<bigint>")
    sets = sets.join(asked.select("node", "sequence"), "sequence").select("node", "shingles").dropDuplicates(["node"])
    return stage(sets, "minhash-sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those ``pairs`` (a, b) of nodes whose whole shingle sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("one"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("two"))
    common = F.size(F.array_intersect("one", "two"))
    return (
        pairs.join(left, "a").join(right, "b")
        .select("a", "b", common.alias("common"), (F.size("one") + F.size("two")).alias("both"))
        .filter(100 * F.col("common") >= percent * (F.col("both") - F.col("common")))
        .select("a", "b")
    )


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node in ``links`` (a, b): ``root`` is the smallest node reachable.

    Smallest neighbour labels with pointer jumping; each round is written, so lineage stays short.
    """
    edges = stage(links.union(links.select("b", "a")).distinct(), "component-edges")
    labels = stage(
        edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        .select("node", F.least("node", "root").alias("root")), "component-labels")
    while True:
        seen = edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(
            F.min("root").alias("near"))
        hooked = labels.join(seen, "node").select("node", "root", F.least("root", "near").alias("near"))
        # the old root learns of the smaller label as well, so that whole trees move
        told = hooked.filter("near < root").groupBy(F.col("root").alias("node")).agg(F.min("near").alias("told"))
        new = hooked.join(told, "node", "left").select(
            "node", F.col("root").alias("was"), F.least("near", F.coalesce("told", "near")).alias("root"))
        jump = new.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = stage(new.join(jump, "root", "left").select(
            "node", "was", F.least("root", F.coalesce("next", "root")).alias("root")), "component-labels")
        labels = new.select("node", "root")
        if new.filter("was <> root").isEmpty():
            return labels


def absorbed(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``node, root`` of all nodes after new ``links`` (a, b): only the components that they join are worked on."""
    if links.isEmpty():
        return roots
    one = roots.select(F.col("node").alias("a"), F.col("root").alias("one"))
    two = roots.select(F.col("node").alias("b"), F.col("root").alias("two"))
    between = links.join(one, "a").join(two, "b").filter("one <> two").select(F.col("one").alias("a"), F.col("two").alias("b"))
    joined = components(between.distinct()).select(F.col("node").alias("root"), F.col("root").alias("new"))
    return stage(roots.join(joined, "root", "left").select("node", F.coalesce("new", "root").alias("root")), "minhash-roots")


def still_open(crowded: DataFrame, roots: DataFrame) -> DataFrame:
    """``band, key, node, signature, root`` of the buckets that hold several components."""
    members = crowded.select("band", "key", "node", "signature").join(roots, "node")
    mixed = members.groupBy("band", "key").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    return stage(members.join(mixed.filter("least <> most").select("band", "key"), ["band", "key"]), "minhash-open")


def near_duplicates(docs: DataFrame, percent: int = 75, size: int = 5, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Texts are linked when ``100 * |intersection| >= percent * |union|`` of their sets of ``size``-word
    shingles (a shorter text: its whole word sequence); links are followed through.  Null and empty
    texts are linked with nothing.  Rows that share a doc_id are one document.  A row without a doc_id
    gets the component of its copies, else null, and is kept if it has none.  Other columns are ignored.
    """
    texts = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("body"))
    digest = stage(
        texts.withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", "body")
        .mapInArrow(lambda found: digests(found, size), DIGEST), "minhash-digest")

    kinds = digest.filter("n_shingles > 0").groupBy("sequence").agg(
        F.min("rid").alias("node"), F.min("doc_id").alias("least_id"))
    rows = digest.filter("n_shingles > 0").join(kinds, "sequence")
    rows = stage(rows.select(
        "rid", "doc_id", "sequence", "node", "least_id",
        F.expr("CASE WHEN rid = node THEN signature END").alias("signature"),
        F.expr("CASE WHEN rid = node THEN bands END").alias("bands")), "minhash-rows")
    nodes = rows.filter("rid = node")

    # rows of one doc_id are one document, even if their texts differ
    same = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("node").alias("a"), F.max("node").alias("top")).filter("a <> top").select("doc_id", "a")
    same = rows.join(same, "doc_id").filter("node <> a").select("a", F.col("node").alias("b"))

    entries = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = entries.groupBy("band", "key").agg(F.count("*").alias("held")).filter("held > 1")
    signed = nodes.select("node", "signature")
    # few nodes are in such buckets; from here on they carry their signatures
    crowded = stage(entries.join(buckets.select("band", "key"), ["band", "key"]).join(signed, "node"), "minhash-crowded")
    sets = shingles_of(crowded, texts, nodes, size)

    roots = absorbed(nodes.select("node", F.col("node").alias("root")), stage(same, "minhash-links"))
    open_ = still_open(crowded, roots)
    for turn, n in enumerate(CENTRES):
        orders = [F.xxhash64("node", F.lit(turn), F.lit(i)) for i in range(n)]
        centres = open_.groupBy("band", "key").agg(
            *[F.min_by(F.struct("node", "root", "signature"), order).alias(f"centre{i}") for i, order in enumerate(orders)])
        pairs = open_.join(centres, ["band", "key"]).select(
            "node", "root", "signature", F.explode(F.array(*[f"centre{i}" for i in range(n)])).alias("centre"))
        likely = f"{estimate('signature', 'centre.signature')} >= {percent / 100 - SLACK}D"
        stars = pairs.filter(f"root <> centre.root AND {likely}").select(
            F.least("node", "centre.node").alias("a"), F.greatest("node", "centre.node").alias("b"))
        stars = stage(stars.distinct(), "minhash-stars")
        links = stage(confirmed(stars, sets, percent), "minhash-links")
        if links.isEmpty():
            break
        roots = absorbed(roots, links)
        open_ = still_open(crowded, roots)

    open_ = stage(open_.select("node", "root").distinct(), "minhash-nodes")
    sets_open = sets.join(open_.select("node"), "node")
    counts = np.zeros(CELLS, np.int64)
    seen = sets_open.select("shingles").mapInArrow(cells, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts[seen.column("cell").to_numpy()] = seen.column("n").to_numpy()
    shared = Shared(docs.sparkSession, counts)
    tokens = sets_open.select("node", "shingles").mapInArrow(
        lambda found: prefixes(found, shared, percent), "token bigint, node bigint, place bigint, size bigint")
    tokens = stage(tokens.join(open_, "node"), "minhash-tokens")
    parts = tokens.groupBy("token", "root").agg(F.count("*").alias("n"))
    met = parts.groupBy("token").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    tokens = stage(tokens.join(met.select("token", "main"), "token").join(signed, "node"), "minhash-met")
    outer = tokens.filter("root <> main").select("token", *[
        F.col(c).alias(f"x_{c}") for c in ("node", "root", "place", "size", "signature")])
    cross = outer.join(tokens, "token").filter(
        "x_root <> root AND (root = main OR x_node < node)"
        f" AND 100 * least(x_size, size) >= {percent} * greatest(x_size, size)"
        f" AND {100 + percent} * least(x_size - x_place, size - place) >= {percent} * (x_size + size)"
        f" AND {estimate('x_signature', 'signature')} >= {percent / 100 - SLACK}D")
    cross = cross.select(F.least("x_node", "node").alias("a"), F.greatest("x_node", "node").alias("b"))
    cross = stage(cross.distinct(), "minhash-cross")
    roots = absorbed(roots, stage(confirmed(cross, sets, percent), "minhash-links"))

    rooted = rows.select("rid", "node", "least_id").join(roots, "node")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select("rid", "component_id")
    out = digest.select("rid", "doc_id", "n_shingles").join(named, "rid", "left")
    # texts without a word are alone
    return out.select(
        "doc_id", "n_shingles",
        F.expr("CASE WHEN n_shingles = 0 THEN doc_id ELSE component_id END").alias("component_id"),
    ).withColumn("kept", F.expr("doc_id <=> component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns: one document of each group, one row of each document.

    Rows without a doc_id cannot be told apart by it; of those, one of each text stays.
    """
    kept = near_duplicates(docs, doc_id=doc_id, text=text, **options).filter("kept AND doc_id IS NOT NULL")
    kept = kept.select(F.col("doc_id").alias("kept_id")).distinct()
    held = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("bigint").alias("held_id"))
    named = held.join(kept, F.col("held_id") == F.col("kept_id"), "left_semi")
    first = F.row_number().over(Window.partitionBy("held_id").orderBy(F.col(f"row.{text}")))
    named = named.withColumn("first", first).filter("first = 1").select("row.*")
    return named.unionByName(docs.filter(F.col(doc_id).isNull()).dropDuplicates([text]))


def op10(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


OP10_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g FROM
    (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
pair AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, pair.b FROM reach r JOIN pair ON pair.a = r.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS bigint) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN comp USING (doc_id) LEFT JOIN n ON n.doc_id = w.doc_id
"""
