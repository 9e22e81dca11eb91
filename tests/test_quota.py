import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import fixed
from palimpsest.operators import match, quota
from palimpsest.operators import segments as seg
from palimpsest.plans import check
from palimpsest.sources import sink
from palimpsest.streaming import streams

DAY = datetime(2024, 3, 1)
REQUESTS = "request_id long, user_id long, document_id long, ts timestamp_ntz"
UPLOADS = "id long, user_id long, file_name string, file_size long, ts timestamp_ntz"


def users(spark, used=0, reset=None):
    rows = [(1, "Student", 5, used, reset), (2, "Admin", 5, used, reset)]
    return spark.createDataFrame(
        rows, "id long, role string, daily_check_limit int, checks_used_today int, last_check_reset_date timestamp_ntz"
    )


def docs(spark):
    return spark.createDataFrame([(7,)], "id long")


def requests(spark, rows):
    return spark.createDataFrame([(i, u, d, DAY + timedelta(minutes=m)) for i, u, d, m in rows], REQUESTS)


def test_sixth_request_of_a_day(spark):
    rows = [(i, 1, 7, 10 * i) for i in range(6)] + [(10 + i, 2, 7, 10 * i) for i in range(6)]
    rows += [(20, 1, 7, 24 * 60), (21, 9, 7, 5), (22, 1, 8, 5), (23, 9, 8, 5)]
    got = {r.request_id: r for r in quota.daily_quota(requests(spark, rows), users(spark), docs(spark)).collect()}
    assert [got[i].accepted for i in range(6)] == [True] * 5 + [False]
    assert [got[i].remaining for i in range(6)] == [4, 3, 2, 1, 0, None]
    assert got[5].reason == fixed.QUOTA_SPENT % 5
    assert [got[10 + i].remaining for i in range(6)] == [4, 3, 2, 1, 0, -1]
    assert got[20].accepted and got[20].remaining == 4
    assert (got[21].reason, got[22].reason, got[23].reason) == (fixed.NO_USER, fixed.NO_DOCUMENT, fixed.NO_DOCUMENT)


def test_counter_of_the_user_row_counts_on_its_day_only(spark):
    people = users(spark, used=4, reset=DAY + timedelta(hours=1))
    rows = [(1, 1, 7, 100), (2, 1, 7, 101), (3, 1, 7, 24 * 60 + 1)]
    got = {r.request_id: r.remaining for r in quota.daily_quota(requests(spark, rows), people, docs(spark)).collect()}
    assert got == {1: 0, 2: None, 3: 4}


def upload_frame(spark, minutes, key=(1, "a.txt", 10), start=0):
    return spark.createDataFrame(
        [(start + i, *key, DAY + timedelta(minutes=m)) for i, m in enumerate(minutes)], UPLOADS
    )


def folded(rows, hours=2):
    anchors, out = {}, {}
    for row in sorted(rows, key=lambda r: (r[4], r[0])):
        key = row[1:4]
        if key in anchors and row[4] - anchors[key][1] < timedelta(hours=hours):
            out[row[0]] = anchors[key][0]
        else:
            anchors[key] = (row[0], row[4])
            out[row[0]] = row[0]
    return out


def test_age_is_measured_from_the_stored_upload(spark):
    got = {r.id: r.anchor_id for r in quota.upload_dedup(upload_frame(spark, [0, 119, 120, 210, 241])).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


@pytest.mark.parametrize("seed,step", [(1, 5), (2, 60), (3, 170), (4, 1)])
def test_upload_dedup_equals_a_fold(spark, seed, step):
    rng, at, rows = random.Random(seed), 0, []
    for i in range(300):
        at += rng.choice([0, 1, step, 2 * step])
        rows.append((i, rng.randint(1, 2), "a", rng.randint(1, 2), DAY + timedelta(minutes=at)))
    got = {r.id: r.anchor_id for r in quota.upload_dedup(spark.createDataFrame(rows, UPLOADS)).collect()}
    assert got == folded(rows)


def write_parts(frame, folder, column, parts):
    """Several files in order of time, one micro-batch each."""
    total = frame.count()
    ordered = frame.orderBy(column).collect()
    for i in range(parts):
        chunk = ordered[i * total // parts : (i + 1) * total // parts]
        frame.sparkSession.createDataFrame(chunk, frame.schema).coalesce(1).write.mode("append").parquet(folder)


def arriving(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_quota_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), rng.choice([7, 7, 7, 8]), i * 40) for i in range(80)]
    frame = requests(spark, rows)
    write_parts(frame, str(tmp_path / "in"), "ts", 4)
    people = users(spark).select("id", "role", "daily_check_limit")
    streams.quota_stream(arriving(spark, str(tmp_path / "in"), frame.schema), people, docs(spark), str(tmp_path / "q")).awaitTermination()
    got = sorted(tuple(r) for r in streams.read_results(spark, str(tmp_path / "q")).select("request_id", "accepted", "remaining").collect())
    want = sorted(tuple(r) for r in quota.daily_quota(frame, people, docs(spark)).select("request_id", "accepted", "remaining").collect())
    assert got == want


def test_upload_stream_equals_batch(spark, tmp_path):
    rng, at, rows = random.Random(8), 0, []
    for i in range(120):
        at += rng.choice([1, 20, 70])
        rows.append((i, rng.randint(1, 2), "a", 1, DAY + timedelta(minutes=at)))
    frame = spark.createDataFrame(rows, UPLOADS)
    write_parts(frame, str(tmp_path / "in"), "ts", 5)
    streams.upload_dedup_stream(arriving(spark, str(tmp_path / "in"), frame.schema), str(tmp_path / "u")).awaitTermination()
    got = {r.id: r.anchor_id for r in streams.read_results(spark, str(tmp_path / "u")).collect()}
    assert got == folded(rows)


ASKED = "check_id long, id long, content string, check_date timestamp_ntz"


def small_corpus(spark):
    return match.Corpus(seg.contents(spark.createDataFrame(
        [(5, "one two three four five six seven"), (6, "Other words of another text stand here.")], "id long, content string")))


def asked(spark, rows):
    return spark.createDataFrame([(c, i, t, DAY) for c, i, t in rows], ASKED)


def test_check_stream_by_check_id(spark, tmp_path):
    """A document asked for twice has two checks, two versions of one are told apart, and only the row without text fails."""
    first = asked(spark, [(1, 50, "Two three four five six."), (2, 50, "Two three four five six."), (3, 51, None)])
    second = asked(spark, [(4, 50, "Nothing like it here at all."), (1, 50, "Two three four five six.")])
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    streams.check_stream(arriving(spark, str(tmp_path / "in"), first.schema), small_corpus(spark), str(tmp_path / "c")).awaitTermination()
    results = str(tmp_path / "c" / "results")
    rows = sink.read_checks(spark, results).collect()
    got = {r.check_id: r for r in rows}
    assert len(rows) == 4 and [got[i].status for i in (1, 2, 3, 4)] == ["Completed", "Completed", "Failed", "Completed"]
    assert (got[1].source_document_id, got[1].overall_similarity, got[1].total_matched_documents) == (50, 100.0, 1)
    assert got[2].overall_similarity == 100.0 and got[4].overall_similarity == 0.0
    assert got[3].notes.startswith(fixed.CHECK_FAILED) and got[3].ai_detection_json is None
    assert '"detection_level"' in got[1].ai_detection_json
    matches = {(r.check_id, r.matched_document_id) for r in sink.read_matches(spark, results, "check_id").collect()}
    assert {(1, 5), (2, 5)} <= matches and not {c for c, _ in matches} & {3, 4}
    status = streams.check_status(asked(spark, [(1, 50, ""), (9, 50, "")]), sink.read_checks(spark, results))
    assert {tuple(r) for r in status.collect()} == {(1, "Completed"), (9, "Processing")}


def test_an_error_of_the_job_ends_the_check_stream(spark, tmp_path):
    corpus = small_corpus(spark)
    broken = match.Corpus.__new__(match.Corpus)
    broken.k, broken.units, broken.ids = 2, corpus.units.drop("grams"), corpus.ids
    frame = asked(spark, [(1, 50, "Two three four five six.")])
    frame.write.parquet(str(tmp_path / "in"))
    with pytest.raises(Exception):
        streams.check_stream(arriving(spark, str(tmp_path / "in"), frame.schema), broken, str(tmp_path / "f")).awaitTermination()
    # the restart takes the same requests up again
    streams.check_stream(arriving(spark, str(tmp_path / "in"), frame.schema), corpus, str(tmp_path / "f")).awaitTermination()
    assert sink.read_checks(spark, str(tmp_path / "f" / "results")).count() == 1


def test_a_document_given_twice(spark):
    """Words are counted once however often the document is named."""
    corpus = small_corpus(spark)
    text = "Two three four five six. And this is a different sentence here."
    given = spark.createDataFrame([(1, text), (1, text), (2, "one two three four five.")], "id long, content string")
    result = check.check_documents(given, corpus)
    rows = [tuple(r)[:4] for r in result.checks.orderBy("src_id").collect()]
    assert rows[0] == rows[1] and [r[0] for r in rows] == [1, 1, 2]
    assert rows[0][3] == 12 and rows[0][2] == 5
    assert result.segments.count() == 3


def test_results_written_twice_stand_once(spark, tmp_path):
    checks = spark.createDataFrame([(1, DAY), (2, DAY + timedelta(days=40))], "id long, check_date timestamp_ntz")
    matches = spark.createDataFrame([(1, 0, DAY), (1, 1, DAY), (2, 0, DAY + timedelta(days=40))],
                                    "check_id long, pos int, check_date timestamp_ntz")
    folder = str(tmp_path / "r")
    sink.write_results(checks.filter("id = 1"), matches.filter("check_id = 1"), folder, F.col("check_date"))
    # the job ended after the matches of check 2: nobody sees them
    sink.append_new(matches.filter("check_id = 2"), f"{folder}/matches", ["check_id", "pos"],
                    F.to_date(F.date_trunc("month", "check_date")))
    assert {r.check_id for r in sink.read_matches(spark, folder).collect()} == {1}
    for _ in range(2):
        sink.write_results(checks, matches, folder, F.col("check_date"))
    assert sink.read_checks(spark, folder).count() == 2 and sink.read_matches(spark, folder).count() == 3
    assert spark.read.parquet(f"{folder}/matches").count() == 3


def test_late_uploads_keep_the_anchor(spark, tmp_path):
    parts = [[(1, 0), (2, 300)], [(3, 10), (4, 60), (5, 310)], [(6, 500)]]
    rows = [[(i, 1, "a", 1, DAY + timedelta(minutes=at)) for i, at in part] for part in parts]
    for part in rows:
        spark.createDataFrame(part, UPLOADS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame = spark.createDataFrame(rows[0], UPLOADS)
    streams.upload_dedup_stream(arriving(spark, str(tmp_path / "in"), frame.schema), str(tmp_path / "u")).awaitTermination()
    got = {r.id: r.anchor_id for r in streams.read_results(spark, str(tmp_path / "u")).collect()}
    # 3 and 4 are older than the stored upload 2: settled among themselves, and 5 still repeats 2
    assert got == {1: 1, 2: 2, 3: 3, 4: 3, 5: 2, 6: 6}


class Held:
    """A group's state outside a query."""

    def __init__(self, value=None, timed_out=False):
        self.value, self.hasTimedOut, self.timeout = value, timed_out, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_state_goes_by_itself():
    for fold in (streams._quota_of_user(1000), streams._uploads_of_file(["user_id"], 10, 1000)):
        held = Held((1, 2), timed_out=True)
        assert list(fold((1, 0), iter(()), held)) == [] and held.value is None
    frame = pd.DataFrame({"id": [1], "user_id": [1], "ts": pd.to_datetime([DAY])})
    held = Held()
    list(streams._uploads_of_file(["user_id"], 10, 5000)((1, 0), iter([frame]), held))
    assert held.value[0] == 1 and held.timeout == 5000
    held = Held()
    list(streams._uploads_of_file(["user_id"], 10, 5000)((None, 3), iter([frame]), held))
    assert held.value is None  # nothing is kept for a row without a full key


def test_a_time_in_the_future_drops_no_other_key(spark, tmp_path):
    minutes = [(1, "a", 0), (2, "b", 10), (3, "far", 60 * 24 * 365), (4, "a", 30), (5, "b", 40)]
    rows = [(i, 1, name, 1, DAY + timedelta(minutes=at)) for i, name, at in minutes]
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, UPLOADS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame = spark.createDataFrame(rows, UPLOADS)
    streams.upload_dedup_stream(arriving(spark, str(tmp_path / "in"), frame.schema), str(tmp_path / "u")).awaitTermination()
    got = {r.id: r.anchor_id for r in streams.read_results(spark, str(tmp_path / "u")).collect()}
    assert got == folded(rows)


def test_results_after_a_batch_without_matches(spark, tmp_path):
    """The folder of the matches is there, but holds no file to read a schema from."""
    (tmp_path / "matches").mkdir()
    rows = spark.createDataFrame([(1, 0, DAY)], "check_id long, pos int, check_date timestamp_ntz")
    sink.append_new(rows, str(tmp_path / "matches"), ["check_id", "pos"], F.to_date("check_date"))
    assert spark.read.parquet(str(tmp_path / "matches")).count() == 1


def test_a_repeated_write_moves_keys_only(spark, tmp_path):
    """The rows themselves are neither staged nor compared, and a row without a key is added as before."""
    from pathlib import Path

    from palimpsest.scratch import shared_dir

    staged = lambda: set(Path(shared_dir(spark), "palimpsest").glob("sink-*"))
    before, path = staged(), str(tmp_path / "m")
    rows = spark.createDataFrame([(1, 0, "a", DAY), (1, 1, "b", DAY), (None, 0, "c", DAY)],
                                 "check_id long, pos int, matched_text string, check_date timestamp_ntz")
    sink.append_new(rows.filter("check_id = 1 AND pos = 0"), path, ["check_id", "pos"], F.to_date("check_date"))
    for _ in range(2):
        sink.append_new(rows, path, ["check_id", "pos"], F.to_date("check_date"))
    assert sorted(r.matched_text for r in spark.read.parquet(path).collect()) == ["a", "b", "c", "c"]
    made = staged() - before
    assert made and not any("matched_text" in spark.read.parquet(str(p)).columns for p in made if list(p.glob("*.parquet")))


def test_quota_of_a_user_is_folded_by_day():
    """A batch that goes back before the stored day counts on the stored one."""
    at = lambda day, minute: pd.Timestamp(DAY) + pd.Timedelta(days=day, minutes=minute)
    fold, held = streams._quota_of_user(1000), Held()

    def step(times):
        frame = pd.DataFrame({"request_id": range(len(times)), "user_id": 1, "document_id": 7, "ts": times,
                              "role": "Student", "limit": 2})
        return next(fold((1,), iter([frame.iloc[:1], frame.iloc[1:]]), held))

    first = step([at(1, 5), at(0, 1), at(1, 3), at(1, 4)])
    assert first["request_id"].tolist() == [1, 2, 3, 0] and first["accepted"].tolist() == [True, True, True, False]
    assert held.value == ((DAY + timedelta(days=1)).date(), 2) and first["remaining"].isna().tolist() == [False] * 3 + [True]
    late = step([at(0, 9), at(2, 0)])
    assert late["accepted"].tolist() == [False, True] and late["reason"].tolist() == [fixed.QUOTA_SPENT % 2, None]
    assert held.value == ((DAY + timedelta(days=2)).date(), 1) and held.timeout == 1000


def test_requests_without_a_user_pass_no_state(spark, tmp_path):
    frame = requests(spark, [(1, 1, 7, 0), (2, 9, 7, 1), (3, 1, 8, 2), (4, None, 7, 3)])
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    people = users(spark).select("id", "role", "daily_check_limit")
    asked = streams.quota_stream(arriving(spark, str(tmp_path / "in"), frame.schema), people, docs(spark), str(tmp_path / "q"))
    asked.awaitTermination()
    got = {r.request_id: (r.accepted, r.remaining, r.reason, r.day) for r in streams.read_results(spark, str(tmp_path / "q")).collect()}
    day = DAY.date()
    assert got == {1: (True, 4, None, day), 2: (False, None, fixed.NO_USER, day),
                   3: (False, None, fixed.NO_DOCUMENT, day), 4: (False, None, fixed.NO_USER, day)}
