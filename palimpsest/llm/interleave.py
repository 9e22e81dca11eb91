"""Shards that all carry the mixture of sources: proportional stratified interleaving.

Rows are shuffled within each source by a seeded hash, row ``r`` of ``n`` gets the fractional rank
``(r - 1/2) / n``, all rows are put in order of that rank, and the order is cut into equal runs.

Ranks come without a sort of a whole source or of all rows in one task: rows fall into slots of some
hundred rows each (by the hash within a source, by the fractional rank overall; both are spread
evenly), slots are counted, and a row's rank is the sum of the slots before plus its place in its own.
A source that holds most rows only has fuller slots next to those of the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.scratch import stage

STEP = 1024  # slots summed into one coarse slot


def slot_offsets(slots: DataFrame, keys: list[str], slot: str, count: str) -> DataFrame:
    """Adds ``before``, the rows of smaller slots of the same keys, and ``total``, those of all slots.

    Two levels, so that no window sees more than the coarse slots of one key or one coarse slot.
    """
    slots = slots.withColumn("coarse", F.expr(f"`{slot}` div {STEP}"))
    by_key = Window.partitionBy(*keys)
    upper = (
        slots.groupBy(*keys, "coarse").agg(F.sum(count).alias("held"))
        .withColumn("total", F.sum("held").over(by_key))
        .withColumn("ahead", F.sum("held").over(by_key.orderBy("coarse")) - F.col("held"))
        .drop("held")
    )
    lower = F.sum(count).over(Window.partitionBy(*keys, "coarse").orderBy(slot)) - F.col(count)
    return (
        slots.withColumn("inner", lower)
        .join(upper, [*keys, "coarse"])
        .select(*keys, slot, (F.col("ahead") + F.col("inner")).alias("before"), "total")
    )


def assign_shards(
    docs: DataFrame, shards: int = 40, seed: int = 17, slot_rows: int = 250,
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, stratum, size, text_crc32, shard, slot``.

    The counts of shards differ by one at most, and each source is spread over all shards.
    Null texts have no bytes; rows without a source are a stratum of their own; rows that agree in
    everything that is ranked are interchangeable; other columns are ignored; no rows give no rows.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.when(F.col(source).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(source).cast("string")))
        .alias("stratum"),
        (F.octet_length(body) + 16).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
        .alias("shuffle"),
    )
    base = stage(base, "shard-base")
    rows = base.count()
    slots = max(1, -(-rows // slot_rows))

    base = base.withColumn(
        "place", F.expr(f"(cast(conv(substr(shuffle, 1, 8), 16, 10) AS bigint) * {slots}) div 4294967296")
    )
    offsets = slot_offsets(base.groupBy("stratum", "place").agg(F.count("*").alias("n")),
                           ["stratum"], "place", "n")
    order = ["shuffle", "doc_id", "size", "text_crc32"]
    within = F.row_number().over(Window.partitionBy("stratum", "place").orderBy(*order))
    ranked = (
        base.withColumn("within", within)
        .join(offsets, ["stratum", "place"])
        .withColumn("share", (2 * (F.col("before") + F.col("within")) - 1).cast("double")
                    / (2 * F.col("total")).cast("double"))
        .select("doc_id", "stratum", "size", "text_crc32", "shuffle", "share",
                F.floor(F.col("share") * slots).cast("bigint").alias("run"))
    )
    ranked = stage(ranked, "shard-ranked")
    runs = slot_offsets(ranked.groupBy("run").agg(F.count("*").alias("n")).withColumn("all", F.lit(0)),
                        ["all"], "run", "n").select("run", "before")
    inside = F.row_number().over(Window.partitionBy("run").orderBy("share", "stratum", *order))
    at = ranked.withColumn("inside", inside).join(runs, "run").withColumn("at", F.expr("before + inside - 1"))
    return at.withColumn("shard", F.expr(f"cast((at * {shards}) div {max(rows, 1)} AS int)")).select(
        "doc_id", "stratum", "size", "text_crc32", "shard",
        F.expr(f"at - ((cast(shard AS bigint) * {rows} + {shards - 1}) div {shards})").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, doc_id: str = "doc_id", **options) -> None:
    """Write whole rows as one folder per shard, ordered by slot within each file.

    ``doc_id`` has to be unique here, as rows and their places are joined by it.
    """
    places = assign_shards(docs, doc_id=doc_id, **options).select(
        F.col("doc_id").alias("_place_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot")
    )
    joined = docs.join(places, docs[doc_id] == places["_place_id"]).drop("_place_id")
    joined.repartition("_shard", F.expr("_slot div 100000")).sortWithinPartitions("_shard", "_slot").write.partitionBy(
        "_shard").parquet(path)


def op9(docs: DataFrame) -> DataFrame:
    """The contract's digest: law ``rows``."""
    return assign_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


OP9_SQL = """
WITH base AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS stratum,
    CAST(strlen(coalesce(text, '')) + 16 AS bigint) AS size, coalesce(text, '') AS body,
    md5('17:' || coalesce(CAST(doc_id AS varchar), '')) AS shuffle FROM documents),
ranked AS (
  SELECT *, CAST(2 * row_number() OVER (PARTITION BY stratum ORDER BY shuffle, doc_id, size) - 1 AS double)
    / CAST(2 * count(*) OVER (PARTITION BY stratum) AS double) AS share FROM base),
placed AS (
  SELECT *, row_number() OVER (ORDER BY share, stratum, shuffle, doc_id, size) - 1 AS pos,
    count(*) OVER () AS n FROM ranked),
bytes AS (SELECT doc_id, hex(encode(body)) AS h FROM base),
crc_table AS (
  SELECT b, list_reduce(list_prepend(CAST(b AS bigint), CAST(range(8) AS bigint[])),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS b)),
lookup AS (SELECT list(v ORDER BY b) AS t FROM crc_table),
crcs AS (
  SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS bigint), list_transform(range(length(h) // 2),
      lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS bigint))),
    lambda c, x: xor(c >> 8, t[CAST(xor(c & 255, x) + 1 AS bigint)])), 4294967295) AS text_crc32
  FROM bytes, lookup)
SELECT p.doc_id, p.size, c.text_crc32, 'rows' AS law, CAST((pos * 40) // n AS int) AS shard,
  pos - (((pos * 40) // n) * n + 39) // 40 AS slot, CAST(NULL AS int) AS grown_shard
FROM placed p JOIN crcs c ON c.doc_id = p.doc_id
"""
