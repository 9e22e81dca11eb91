from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import fixed
from palimpsest.operators import changes, filters, integrity, reports
from palimpsest.sources import ingest, sink

NOW = datetime(2024, 5, 1, 10, 0)


def as_of():
    return F.lit(NOW).cast("timestamp_ntz")


def test_upsert_overwrites_all_fields_and_stamps(spark):
    schema = "id int, code string, name string, is_active boolean, created_date timestamp_ntz, updated_date timestamp_ntz"
    base = spark.createDataFrame([(1, "A", "a", True, NOW, None), (2, "B", "b", False, NOW, None)], schema)
    new = spark.createDataFrame([(2, "B2", None, True), (3, "C", "c", False)], "id int, code string, name string, is_active boolean")
    got = {r.id: r for r in changes.upsert_dim(base, new, as_of()).collect()}
    assert (got[1].code, got[1].updated_date) == ("A", None)
    assert (got[2].code, got[2].name, got[2].is_active, got[2].updated_date) == ("B2", None, True, NOW)
    assert (got[3].is_active, got[3].created_date, got[3].updated_date) == (True, NOW, None)


def people(spark):
    rows = [(1, "An", "an@x", "An A", True), (2, "Binh", "binh@x", "Binh B", False), (3, "Chi", "chi@x", "Chi C", False)]
    return spark.createDataFrame(rows, "id long, username string, email string, full_name string, is_active boolean")


def run_merge(spark, rows):
    batch = spark.createDataFrame(rows, "seq long, username string, email string, full_name string")
    users, outcomes = changes.merge_users(people(spark), batch, as_of())
    return {r.id: r for r in users.collect()}, {r.seq: (r.outcome, r.user_id, r.reason) for r in outcomes.collect()}


def sequential(rows):
    table = {1: ["an", "an@x", True], 2: ["binh", "binh@x", False], 3: ["chi", "chi@x", False]}
    out = {}
    for seq, name, mail, _ in sorted(rows):
        name, mail = name.lower(), mail.lower()
        by_name = min((i for i, r in table.items() if r[0] == name), default=None)
        by_mail = min((i for i, r in table.items() if r[1] == mail), default=None)
        if by_name and table[by_name][2]:
            out[seq] = ("rejected", None, fixed.USERNAME_TAKEN)
        elif by_mail and table[by_mail][2]:
            out[seq] = ("rejected", None, fixed.EMAIL_TAKEN)
        else:
            target = by_mail or by_name
            out[seq] = ("reactivated" if target else "inserted", target or seq + 4, None)
            table[target or seq + 4] = [name, mail, True]
    return out


def test_merge_users_equals_the_sequence(spark):
    rows = [
        (1, "AN", "new@x", "n"), (2, "new", "AN@X", "n"), (3, "an", "an@x", "n"),
        (4, "Chi", "BINH@x", "moved"), (5, "binh", "other@x", "n"), (6, "chi", "chi@x", "n"),
        (7, "dup", "d1@x", "n"), (8, "Dup", "d2@x", "n"), (9, "free", "d2@x", "n"), (10, "free", "an@x", "n"),
        (11, "fresh", "an@x", "n"), (12, "fresh", "f@x", "n"), (13, "fresh", "an@x", "n"),
    ]
    users, got = run_merge(spark, rows)
    assert got == sequential(rows)
    assert users[2].username == "Chi" and users[2].is_active


def test_merge_users_settles_a_hot_name(spark):
    rows = [(i, "same", f"m{i}@x", "n") for i in range(40)]
    _, got = run_merge(spark, rows)
    assert got == sequential(rows)


def test_soft_delete_and_updates(spark):
    keys = spark.createDataFrame([(1,), (1,), (9,)], "id long")
    assert {r.id: r.is_active for r in changes.soft_delete(people(spark), keys).collect()} == {1: False, 2: False, 3: False}
    new = spark.createDataFrame([(2, "Binh X", None, True)], "id long, full_name string, email string, is_active boolean")
    got = {r.id: r for r in changes.update_users(people(spark), new).collect()}
    assert (got[2].full_name, got[2].email, got[2].is_active) == ("Binh X", None, True) and got[1].email == "an@x"


def test_cascade_and_blocked_documents(spark):
    docs = spark.createDataFrame([(i,) for i in (1, 2, 3)], "id long")
    checks = spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "id long, source_document_id long")
    matches = spark.createDataFrame([(10, 3), (11, 3), (12, 1)], "check_id long, matched_document_id long")
    keys = spark.createDataFrame([(2,), (3,), (99,)], "id long")
    left = integrity.delete_documents(docs, checks, matches, keys)
    ids = lambda name, c="id": sorted(r[c] for r in left[name].collect())
    assert ids("blocked") == [3] and ids("documents") == [1, 3] and ids("checks") == [10, 12]
    assert ids("matches", "check_id") == [10, 12]
    # 1 -> 2 -> 3 and 4 <-> 5: a chain goes as a whole unless its head stays
    docs = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    checks = spark.createDataFrame([(10, 1), (11, 2), (12, 4), (13, 5)], "id long, source_document_id long")
    matches = spark.createDataFrame([(10, 2), (11, 3), (12, 5), (13, 4)], "check_id long, matched_document_id long")
    for named, stay in (([1, 2, 3, 4, 5], []), ([2, 3, 4], [2, 3, 4]), ([2, 3, 4, 5], [2, 3])):
        left = integrity.delete_documents(docs, checks, matches, spark.createDataFrame([(i,) for i in named], "id long"), same_batch=True)
        assert ids("blocked") == stay and ids("deleted_documents") == sorted(set(named) - set(stay))
    users = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id long, faculty_id long")
    faculties = spark.createDataFrame([(5,), (6,)], "id long")
    departments = spark.createDataFrame([(1, 6)], "id long, faculty_id long")
    done = integrity.delete_parents(faculties, faculties, [(departments, "faculty_id")], {"users": (users, "faculty_id")})
    assert [r.id for r in done["blocked"].collect()] == [6]
    assert {r.id: r.faculty_id for r in done["users"].collect()} == {1: None, 2: 6, 3: None}


def test_collated_lists_and_search(spark):
    names = ["Đặng Văn", "an", "Ánh", "Bình", "ánh nga", "An"]
    df = spark.createDataFrame(list(enumerate(names)), "id long, full_name string")
    got = [r.full_name for r in reports.sorted_list(df, "full_name", collation="UNICODE_CI").collect()]
    assert got == ["an", "An", "Ánh", "ánh nga", "Bình", "Đặng Văn"]
    assert [r.full_name for r in reports.sorted_list(df, "full_name").collect()][0] == "An"
    found = lambda q, c: sorted(r.id for r in filters.text_search(df, q, "full_name", collation=c).collect())
    assert found("ÁNH", "UNICODE_CI") == [2, 4] and found("anh", "UNICODE_CI_AI") == [2, 4] and found("anh", "UNICODE_CI") == []


def test_statistics_of_nothing_are_zero(spark):
    checks = spark.createDataFrame([], "id long, source_document_id long, user_id long, overall_similarity decimal(5,2), status string")
    docs = spark.createDataFrame([], "id long, subject_id int")
    row = reports.stats_summary(checks, docs).first()
    assert (row.total_checks, row.average_similarity, row.high_risk) == (0, 0.0, 0)


def test_import_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "Bao_cao-1.txt").write_text("Nội dung có dấu", encoding="utf-8")
    (tmp_path / "sub" / "blank.TXT").write_text("  \n ")
    (tmp_path / "sub" / "scan.pdf").write_bytes(b"%PDF")
    (tmp_path / "notes.md").write_text("not taken")
    docs, failed = ingest.import_files(ingest.read_folder(spark, str(tmp_path)), 3, as_of())
    row = docs.first()
    assert docs.count() == 1 and (row.title, row.content, row.user_id, row.year) == ("Bao cao 1", "Nội dung có dấu", 3, 2024)
    assert row.file_size == len("Nội dung có dấu".encode()) and row.is_public
    assert sorted(r.file_name for r in failed.collect()) == ["blank.TXT", "scan.pdf"]
    assert ingest.import_report(docs, failed).first().message == fixed.IMPORT_MESSAGE % (1, 3)
    assert ingest.import_report(docs.limit(0), failed.limit(0)).first().message == fixed.IMPORT_NOTHING


def test_import_of_bad_bytes_marks_and_missing_folders(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfgood \xff\xc3 end")
    (tmp_path / "b.Txt").write_bytes("wide".encode("utf-16"))
    (tmp_path / "c.txt").write_bytes(b"\xef\xbb\xbf \n")
    (tmp_path / "d.bin").write_bytes(b"\x00")
    docs, failed, report = ingest.import_folder(spark, str(tmp_path), 1, as_of())
    assert [r.content for r in docs.collect()] == ["good \ufffd\ufffd end"]
    assert sorted(r.file_name for r in failed.collect()) == ["b.Txt", "c.txt"]
    assert report.first().message == fixed.IMPORT_MESSAGE % (1, 3)
    docs, failed, report = ingest.import_folder(spark, str(tmp_path / "none"), 1, as_of())
    assert docs.count() == failed.count() == 0 and report.first().message == fixed.IMPORT_NO_FOLDER


def test_change_log_takes_the_last_change(spark):
    base = spark.createDataFrame([(1, "a", True)], "id int, name string, is_active boolean").withColumns(
        {"created_date": F.lit(None).cast("timestamp_ntz"), "updated_date": F.lit(None).cast("timestamp_ntz")})
    log = spark.createDataFrame([(1, 2, "z", False), (1, 1, "y", True), (2, 5, "n", False), (3, 1, "p", False), (3, 4, None, False),
                                 (None, 1, "x", True)], "id int, seq int, name string, is_active boolean")
    rows = {r.id: r for r in changes.upsert_dim(base, log, as_of(), "seq").collect()}
    assert {i: (r.name, r.is_active, r.created_date is not None, r.updated_date is not None) for i, r in rows.items()} == {
        1: ("z", False, False, True), 2: ("n", True, True, False), 3: (None, False, True, True)}
    assert [r.name for r in changes.update_fields(base, log, ["name"], "seq").collect()] == ["z"]
    for apply in (lambda: changes.upsert_dim(base, log.drop("seq"), as_of()), lambda: changes.update_fields(base, log, ["name"])):
        with pytest.raises(Exception, match="more than once"):
            apply().collect()
    once = log.filter("id = 2").drop("seq")
    assert changes.upsert_dim(base, once, as_of()).count() == 2


def test_pasted_and_generated_documents(spark):
    rows = spark.createDataFrame([(" ", "xin chào"), ("T", "é"), ("U", " \n")], "title string, content string")
    got = [(r.title, r.file_size) for r in ingest.pasted_documents(rows, as_of()).collect()]
    assert got == [("Văn bản dán_20240501_1000", 9), ("T", 2)]
    texts = spark.range(60).selectExpr("id", "concat('Một  hai ba', id, ' bốn năm sáu') AS content")
    rows = ingest.derived_documents(texts, 7, as_of()).collect()
    assert rows == ingest.derived_documents(texts.repartition(7), 7, as_of()).orderBy("id").collect()
    assert {r.document_type for r in rows if r.id % 3 == 0} == {"Thesis"}
    assert all(1 <= (NOW - r.upload_date).days <= 29 and r.file_size == len(r.content.encode()) for r in rows)
    assert rows[4].title == "Một hai ba4 bốn năm"


def test_results_are_partitioned_by_period(spark, tmp_path):
    checks = spark.createDataFrame([(1, datetime(2024, 1, 3)), (2, datetime(2024, 2, 3))], "id long, check_date timestamp_ntz")
    matches = checks.select(F.col("id").alias("check_id"), F.lit(0).alias("pos"), "check_date")
    sink.write_results(checks, matches, str(tmp_path / "r"), F.col("check_date"))
    back = spark.read.parquet(str(tmp_path / "r" / "checks"))
    assert back.filter("period = date'2024-02-01'").select("id").collect()[0].id == 2


def test_names_that_are_no_text_files(spark, tmp_path):
    """Text files are left out by name, before the scan makes tasks for them."""
    texts = {"a.txt", "b.TXT", ".x.Txt", "c.pdf.tXt"}
    others = {"a.pdf", "txt", "xt", "t", "a.tx", "atxt", "a.txt.md", "xxt", "T.docx", "a.ttt", "a.xxt", "a.tt"}
    for name in texts | others:
        (tmp_path / name).write_bytes(b"x")
    found = spark.read.format("binaryFile").option("pathGlobFilter", ingest.NOT_TEXT).load(str(tmp_path))
    assert {r.path.rsplit("/", 1)[1] for r in found.select("path").collect()} == others
    both = {r.path.rsplit("/", 1)[1]: r.content for r in ingest.read_folder(spark, str(tmp_path)).collect()}
    assert set(both) - {".x.Txt"} == (texts | others) - {".x.Txt"} and both["b.TXT"] == b"x" and both["a.pdf"] is None
