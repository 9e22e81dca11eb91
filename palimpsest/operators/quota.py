"""Daily quota and repeated uploads, without putting one user's or file's rows into one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import fixed
from palimpsest.scratch import stage

HOURS = 2
SLICE_SECONDS = 60


def micros(ts: Column) -> Column:
    """Microseconds of a wall-clock time, the same in every session time zone."""
    since = ts - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    part = lambda unit: F.extract(F.lit(unit), since)
    minutes = (part("DAY").cast("long") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return minutes * 60_000_000 + (part("SECOND") * 1_000_000).cast("long")


def running_count(rows: DataFrame, keys: list[str], counts: str, ts: str, tie: str, name: str):
    """Running sum of ``counts`` per key in order of ``ts, tie``.

    Rows are ranked inside slices of a minute, and the sums of the earlier slices are added.  A
    window over the key itself only sees one row per slice.
    """
    sliced = rows.withColumn("_slice", F.floor(micros(F.col(ts)) / (SLICE_SECONDS * 1_000_000)))
    sums = sliced.groupBy(*keys, "_slice").agg(F.sum(counts).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.col("_slice").alias("_s"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"),
    )
    local = Window.partitionBy(*keys, "_slice").orderBy(ts, tie).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = sliced.withColumn("_local", F.sum(counts).over(local))
    same = F.col("_slice") == F.col("_s")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_{key}"))
    joined = ranked.join(offsets, same)
    return joined.withColumn(name, F.col("_offset") + F.col("_local")).drop(
        "_slice", "_local", "_offset", "_s", *[f"_{k}" for k in keys]
    )


def daily_quota(requests: DataFrame, users: DataFrame, docs: DataFrame) -> DataFrame:
    """``request_id, user_id, document_id, ts, day, accepted, remaining, reason`` per request.

    ``requests(request_id, user_id, document_id, ts)`` are taken in order of time.  A Student is
    accepted while fewer than ``daily_check_limit`` requests of the day were accepted, everybody
    else always.  ``users`` may carry ``checks_used_today`` and ``last_check_reset_date``: what was
    used on that day counts, a later day starts at zero.
    """
    carried = {"checks_used_today", "last_check_reset_date"} <= set(users.columns)
    people = users.select(
        F.col("id").alias("user_id"),
        "role",
        F.col("daily_check_limit").alias("limit"),
        (F.col("checks_used_today") if carried else F.lit(0)).alias("used"),
        (F.to_date("last_check_reset_date") if carried else F.lit(None).cast("date")).alias("used_on"),
    )
    known = docs.select(F.col("id").alias("document_id"), F.lit(True).alias("has_document"))
    rows = requests.join(known, "document_id", "left").join(people, "user_id", "left")
    valid = F.col("has_document").isNotNull() & F.col("role").isNotNull()
    rows = rows.withColumns({"day": F.to_date("ts"), "valid": valid.cast("int")})
    ranked = running_count(rows, ["user_id", "day"], "valid", "ts", "request_id", "rank")
    used = F.when(F.col("used_on") >= F.col("day"), F.col("used")).otherwise(0) + F.col("rank")
    free = (F.col("role") != "Student") | (used <= F.col("limit"))
    accepted = (F.col("valid") == 1) & free
    return ranked.select(
        "request_id",
        "user_id",
        "document_id",
        "ts",
        "day",
        accepted.alias("accepted"),
        F.when(accepted, F.col("limit") - used).alias("remaining"),
        F.when(F.col("has_document").isNull(), fixed.NO_DOCUMENT)
        .when(F.col("role").isNull(), fixed.NO_USER)
        .when(~free, F.format_string(fixed.QUOTA_SPENT, F.col("limit")))
        .alias("reason"),
    )


def upload_dedup(
    uploads: DataFrame,
    keys: tuple[str, ...] = ("user_id", "file_name", "file_size"),
    hours: int = HOURS,
    stored: DataFrame | None = None,
) -> DataFrame:
    """``id, *keys, ts, anchor_id, is_repeat`` per upload.

    An upload is a repeat when the same key has a stored upload less than ``hours`` older; repeats
    store nothing, so the age is measured from the stored one (the anchor), not from the last.
    ``stored(id, *keys, ts)`` are earlier uploads known to be stored.

    Anchors of a key are at least ``hours`` apart, so a time slot of that width holds one at most,
    and everything can be joined by key and slot.  Every upload points to the first one that may
    follow it as an anchor.  Where a gap of ``hours`` precedes an upload it is an anchor for
    certain; the others are reached from those by doubling the pointers, in log2(slots of the
    longest gap-free stretch) rounds.
    """
    keys = list(keys)
    width = hours * 3600 * 1_000_000
    at = micros(F.col("ts"))
    new = uploads.select("id", *keys, "ts", at.alias("us"), F.lit(False).alias("given"))
    rows = new
    if stored is not None:
        rows = new.unionByName(
            stored.select("id", *keys, "ts", at.alias("us"), F.lit(True).alias("given"))
        )
    # Rows without a full key never repeat anything: null equals nothing.
    full = F.lit(True)
    for key in keys:
        full = full & F.col(key).isNotNull()

    nodes = rows.filter(full).groupBy(*keys, "us").agg(
        F.min_by("id", F.struct(~F.col("given"), "id")).alias("id"), F.max("given").alias("given")
    )
    nodes = stage(nodes.withColumn("slot", F.floor(F.col("us") / width)), "upload-nodes")

    slots = nodes.groupBy(*keys, "slot").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    by_key = Window.partitionBy(*keys).orderBy("slot")
    later = by_key.rangeBetween(2, Window.unboundedFollowing)
    apart = F.col("first") - F.lag("last").over(by_key) >= width
    slots = slots.withColumns(
        {"after": F.min("first").over(later), "starts": F.coalesce(apart, F.lit(True))}
    )
    stretch = F.sum(F.col("starts").cast("int")).over(by_key)
    slots = stage(slots.withColumn("stretch", stretch), "upload-slots")

    # The first upload at or after us + width stands in the next slot or in a later one.
    asks = nodes.select(*keys, "us", (F.col("slot") + 1).alias("slot"), (F.col("us") + width).alias("t"), F.lit(0).alias("kind"))
    gives = nodes.select(*keys, "us", "slot", F.col("us").alias("t"), F.lit(1).alias("kind"))
    onward = (
        Window.partitionBy(*keys, "slot").orderBy("t", "kind")
        .rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    found = asks.unionByName(gives).withColumn(
        "near", F.min(F.when(F.col("kind") == 1, F.col("us"))).over(onward)
    )
    near = found.filter("kind = 0").select(*keys, "us", (F.col("slot") - 1).alias("slot"), "near")
    pointers = near.join(slots.select(*keys, "slot", "after"), [*keys, "slot"]).select(
        *keys, "us", F.coalesce("near", "after").alias("next")
    )
    jump = stage(pointers.filter("next is not null"), "upload-next")

    starts = slots.filter("starts").select(*keys, F.col("first").alias("us"))
    reached = starts.unionByName(nodes.filter("given").select(*keys, "us")).distinct()
    longest = (
        slots.groupBy(*keys, "stretch").agg((F.max("slot") - F.min("slot") + 1).alias("n"))
        .agg(F.max("n").alias("n")).first()["n"]
    )
    rounds = math.ceil(math.log2(longest)) if longest and longest > 1 else 0
    for turn in range(rounds):
        hops = reached.join(jump, [*keys, "us"]).select(*keys, F.col("next").alias("us"))
        reached = stage(reached.unionByName(hops).distinct(), "upload-anchors")
        if turn + 1 < rounds:
            second = jump.select(*keys, F.col("us").alias("next"), F.col("next").alias("next2"))
            jump = stage(
                jump.join(second, [*keys, "next"]).select(*keys, "us", F.col("next2").alias("next")),
                "upload-next",
            )

    anchors = nodes.join(reached, [*keys, "us"]).select(
        *keys, "slot", F.col("us").alias("anchor_us"), F.col("id").alias("anchor")
    )
    here = anchors.withColumnsRenamed({"anchor_us": "here_us", "anchor": "here"})
    before = anchors.select(*keys, (F.col("slot") + 1).alias("slot"), F.col("anchor").alias("before"))
    placed = (
        rows.filter(~F.col("given")).withColumn("slot", F.floor(F.col("us") / width))
        .join(here, [*keys, "slot"], "left").join(before, [*keys, "slot"], "left")
    )
    anchor = F.when(F.col("here_us") <= F.col("us"), F.col("here")).otherwise(F.col("before"))
    return placed.select("id", *keys, "ts", F.coalesce(anchor, F.col("id")).alias("anchor_id")).withColumn(
        "is_repeat", F.col("anchor_id") != F.col("id")
    )
