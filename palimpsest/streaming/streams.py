"""Streams of check requests and uploads.

Quota and repeated uploads need to remember something of each user or file: it is kept by key in the
state store of the query, is updated only where rows arrive, and goes by itself when it is too old to
matter.  Checks need none; every micro-batch is one job whose results are stored once for each check.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.functions import fixed
from palimpsest.operators.match import Corpus
from palimpsest.operators.quota import HOURS
from palimpsest.plans.check import check_requests
from palimpsest.scratch import staging
from palimpsest.sources.sink import write_results

HOUR_MS = 3600 * 1000
SPREAD = 64  # parts of the rows that need no state
ONCE = {"availableNow": True}
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/out")


def _append(rows: DataFrame, folder: str, trigger: dict | None) -> StreamingQuery:
    """Write a stream's rows once each, by the log of the file sink.

    Micro-batches without data are off for this query: with timers Spark would run them without end.
    """
    conf = rows.sparkSession.conf
    before = conf.get(NO_DATA)
    conf.set(NO_DATA, "false")
    try:
        return (
            rows.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/progress").trigger(**(trigger or ONCE)).start()
        )
    finally:
        conf.set(NO_DATA, before)


ASKED = ("request_id", "user_id", "document_id", "role", "limit")
QUOTA = ("request_id bigint, user_id bigint, document_id bigint, ts timestamp_ntz, day date, accepted boolean,"
         " remaining bigint, reason string")


def _quota_of_user(linger_ms: int) -> Callable:
    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # Plain arrays: a user has few rows in a micro-batch, and there are many users.
        found = list(frames)
        frame = found[0] if len(found) == 1 else pd.concat(found, ignore_index=True)
        at = frame["ts"].to_numpy().astype("datetime64[us]")
        order = np.lexsort((frame["request_id"].to_numpy(), at))
        at, rows = at[order], {name: frame[name].to_numpy()[order] for name in ASKED}
        days = at.astype("datetime64[D]")
        timed = int(np.count_nonzero(~np.isnat(days)))  # rows without a time sort last, use nothing up
        held_day, held = state.get if state.exists else (None, 0)
        before = np.datetime64(held_day, "D") if held_day is not None else None
        used = np.zeros(len(at), np.int64)
        begin = 0
        while begin < timed:
            end = int(np.searchsorted(days[:timed], days[begin], side="right"))
            used[begin:end] = np.arange(1, end - begin + 1) + (held if before is not None and before >= days[begin] else 0)
            begin = end
        limit = np.nan_to_num(rows["limit"]).astype(np.int64)
        accepted = (rows["role"] != "Student") | (used <= limit)
        if timed:
            last = days[timed - 1]
            if before is not None and before >= last:
                state.update((held_day, held + int(accepted[:timed].sum())))
            else:
                state.update((last.item(), int(accepted[:timed][days[:timed] == last].sum())))
            state.setTimeoutDuration(linger_ms)
        spent = [None if free else fixed.QUOTA_SPENT % n for free, n in zip(accepted.tolist(), limit.tolist())]
        yield pd.DataFrame({
            "request_id": rows["request_id"], "user_id": rows["user_id"], "document_id": rows["document_id"], "ts": at,
            "day": [None if pd.isnull(day) else day for day in days.tolist()], "accepted": accepted,
            "remaining": pd.arrays.IntegerArray(limit - used, ~accepted), "reason": np.array(spent, object)})

    return fold


def quota_stream(
    requests: DataFrame, users: DataFrame, docs: DataFrame, folder: str, linger_hours: float = 48,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Daily quota on a stream of ``request_id, user_id, document_id, ts``.

    The state of a user is the last day and what was used on it.  A micro-batch is taken in order of time,
    micro-batches in order of arrival: a request for a day before the last one counts on the last one, as
    there is only one counter.  A user's state goes ``linger_hours`` after the last valid request, when its
    day is over; it must be more than a day plus the time by which the stream may lag behind.
    The rows of one user in one micro-batch are held in memory together, so the source's limit of a
    micro-batch bounds them.  Requests of unknown users or documents need no state and don't go through it.
    """
    people = users.select(F.col("id").alias("user_id"), "role", F.col("daily_check_limit").cast("long").alias("limit"))
    known = docs.select(F.col("id").alias("document_id"), F.lit(True).alias("has_document"))
    rows = requests.join(known, "document_id", "left").join(people, "user_id", "left")
    rows = rows.select("request_id", "user_id", "document_id", "ts", "has_document", "role", "limit")
    valid = F.col("has_document").isNotNull() & F.col("role").isNotNull()
    counted = rows.filter(valid).drop("has_document").groupBy("user_id").applyInPandasWithState(
        _quota_of_user(int(linger_hours * HOUR_MS)), QUOTA, "day date, used bigint", "append",
        GroupStateTimeout.ProcessingTimeTimeout)
    refused = rows.filter(~valid).select(
        "request_id", "user_id", "document_id", "ts", F.to_date("ts").alias("day"), F.lit(False).alias("accepted"),
        F.lit(None).cast("bigint").alias("remaining"),
        F.when(F.col("has_document").isNull(), fixed.NO_DOCUMENT).otherwise(fixed.NO_USER).alias("reason"))
    out = counted.unionByName(refused)
    return _append(out, folder, trigger)


def _uploads_of_file(keys: list[str], width: int, linger_ms: int) -> Callable:
    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "id"], kind="stable", ignore_index=True)
        ids, at = rows["id"].to_numpy(), rows["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        anchors = ids.copy()
        if key[-1] == 0:
            anchor, since = state.get if state.exists else (None, None)
            # what is older than the stored upload is settled among itself and leaves the state alone
            late = int(np.searchsorted(at, since, side="left")) if since is not None else 0
            for begin, end, held, start in ((0, late, None, None), (late, len(at), anchor, since)):
                while begin < end:
                    if held is None or at[begin] >= start + width:
                        held, start = int(ids[begin]), int(at[begin])
                    stop = min(end, int(np.searchsorted(at, start + width, side="left")))
                    anchors[begin:stop] = held
                    begin = stop
                if end == len(at) and held is not None:
                    anchor, since = held, start
            state.update((anchor, since))
            state.setTimeoutDuration(linger_ms)
        yield rows[["id", *keys, "ts"]].assign(anchor_id=anchors, is_repeat=anchors != ids)

    return fold


def upload_dedup_stream(
    uploads: DataFrame, folder: str, hours: float = HOURS, lag_hours: float = 168, trigger: dict | None = None,
) -> StreamingQuery:
    """Repeated uploads on a stream of ``id, user_id, file_name, file_size, ts``.

    The state of a key is the upload last stored (the anchor) and its time.  It goes by itself ``hours`` plus
    ``lag_hours`` after the key's last upload; ``lag_hours`` is how far the stream may fall behind without
    losing an anchor.  No upload is dropped for its time: one in the future only concerns its own key, and
    one older than the anchor is compared with the others of its micro-batch that are, and changes no state.
    There is no watermark, as that would drop late rows, and let one time in the future drop all others.
    The rows of one key in one micro-batch are held in memory together, so the source's limit of a
    micro-batch bounds them.  Rows without a full key repeat nothing, need no state and are spread.
    """
    keys = ["user_id", "file_name", "file_size"]
    full = F.lit(True)
    for key in keys:
        full = full & F.col(key).isNotNull()
    part = F.when(full, 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(SPREAD)) + 1).cast("int")
    rows = uploads.select(F.col("id").cast("long").alias("id"), *keys, "ts").withColumn("part", part)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ["id", *keys, "ts"])
    out = rows.groupBy(*keys, "part").applyInPandasWithState(
        _uploads_of_file(keys, int(hours * HOUR_MS * 1000), int((hours + lag_hours) * HOUR_MS)),
        f"{kinds}, anchor_id bigint, is_repeat boolean", "anchor bigint, since bigint", "append",
        GroupStateTimeout.ProcessingTimeTimeout)
    return _append(out, folder, trigger)


def check_stream(
    requests: DataFrame, corpus: Corpus, folder: str, exclude_self: bool = True, min_percent: float = 0.0,
    grain: str = "day", trigger: dict | None = None,
) -> StreamingQuery:
    """Check requests ``check_id, id, content, check_date`` as they arrive; every micro-batch is one job.

    Checks with their AI result, and their matches, are stored under ``folder/results`` once for each
    ``check_id``, so a micro-batch that is repeated changes nothing.  A request without a text ends as
    Failed; an error of the job (a lost executor, a full disk) ends the query, and its restart takes the
    micro-batch up again.
    """

    def handle(batch: DataFrame, number: int) -> None:
        with staging(batch.sparkSession):
            checks, matches = check_requests(batch, corpus, exclude_self, min_percent)
            write_results(checks, matches, f"{folder}/results", F.col("check_date"), grain, "check_id")

    return (
        requests.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/progress")
        .trigger(**(trigger or ONCE)).start()
    )


def check_status(requests: DataFrame, checks: DataFrame) -> DataFrame:
    """``check_id, status`` of every request so far: Processing until its check is stored."""
    known = checks.select("check_id", "status")
    return requests.select("check_id").distinct().join(known, "check_id", "left").select(
        "check_id", F.coalesce("status", F.lit("Processing")).alias("status"))
