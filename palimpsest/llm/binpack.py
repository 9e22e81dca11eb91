"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted.  Pieces are taken from long to short; each goes to the open
bin with the least room that still holds it.  If none does, a bin is opened with the length whose cost
per expected token is least: a length costs more than in proportion (attention), but a longer bin is
only worth it as far as the pieces left can fill it.  At the end each bin shrinks to the smallest
permitted length that holds its contents.

Pieces are dealt to groups of some thousand by a hash of their row, and each group is packed on its
own, so the work grows with the rows and no task sees more than a group.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.scratch import stage

CAPACITIES = (512, 1024, 2048, 4096, 8192)


def cost(capacity: int, horizon: int = 16384, overhead: int = 16) -> float:
    """Cost of a sequence of this length: linear work, attention, and a fixed part."""
    return capacity * (1 + capacity / horizon) + overhead


def best_fit(lengths: list[int], capacities: tuple[int, ...]) -> list[int]:
    """The number of the bin of each length.  ``lengths`` run from long to short."""
    rest = sum(lengths)
    rooms: list[int] = []  # distinct rooms of open bins, sorted
    open_: dict[int, list[int]] = {}
    out, bins = [], 0
    for length in lengths:
        rest -= length
        at = bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms[at]
            number = open_[room].pop()
            if not open_[room]:
                del rooms[at], open_[room]
        else:
            room = min((c for c in capacities if c >= length),
                       key=lambda c: (cost(c) / min(c, length + rest), c))
            number, bins = bins, bins + 1
        if room > length:
            if room - length not in open_:
                insort(rooms, room - length)
                open_[room - length] = []
            open_[room - length].append(number)
        out.append(number)
    return out


def packer(capacities: tuple[int, ...]):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "rid", "piece"], ascending=[False, True, True], ignore_index=True)
        group["bin"] = best_fit(group["n_tokens"].tolist(), capacities)
        group["bin_tokens"] = group.groupby("bin")["n_tokens"].transform("sum")
        group["bin_capacity"] = [capacities[bisect_left(capacities, n)] for n in group["bin_tokens"].tolist()]
        group["slot"] = group.groupby("bin").cumcount()
        group["bin_id"] = group["group"] * 2**24 + group["bin"]
        return group[["rid", "piece", "bin_id", "slot", "bin_tokens", "bin_capacity"]]

    return pack


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, group_rows: int = 2000,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, n_tokens, bin_id, slot, bin_tokens, bin_capacity``.

    Tokens are the words between white space and one end mark per row, so that a null or empty text is
    one token long.  A longer row than the largest capacity is cut into pieces of that size and a rest;
    no token is lost.  Repeated rows are packed each by itself; other columns are ignored.
    """
    capacities = tuple(sorted(set(capacities)))
    top = capacities[-1]
    words = F.expr(f"size(array_remove(split(coalesce(cast(`{text}` AS string), ''), '[\\\\x20\\\\x09-\\\\x0D]+'), ''))")
    sized = docs.select(F.col(doc_id).alias("doc_id"), (words + 1).cast("bigint").alias("total"))
    sized = stage(sized.withColumn("rid", F.monotonically_increasing_id()), "pack-sizes")
    pieces = sized.select(
        "rid", "doc_id", F.explode(F.expr(f"sequence(0, (total - 1) div {top})")).alias("piece"), "total"
    ).select(
        "rid", "doc_id", F.col("piece").cast("bigint").alias("piece"), F.expr(f"piece * {top}").cast("bigint").alias("start"),
        F.expr(f"least({top}, total - piece * {top})").cast("bigint").alias("n_tokens"))
    count = sized.agg(F.sum(F.expr(f"(total - 1) div {top} + 1"))).first()[0] or 0
    groups = max(1, -(-count // group_rows))
    pieces = pieces.withColumn("group", F.expr(f"pmod(xxhash64(rid, piece), {groups})"))
    packed = pieces.select("group", "rid", "piece", "n_tokens").groupBy("group").applyInPandas(
        packer(capacities), "rid bigint, piece bigint, bin_id bigint, slot bigint, bin_tokens bigint, bin_capacity bigint")
    return pieces.join(packed, ["rid", "piece"]).select(
        "doc_id", "piece", "start", "n_tokens", "bin_id", "slot", "bin_tokens", "bin_capacity")


def op7(docs: DataFrame) -> DataFrame:
    return pack_documents(docs)
