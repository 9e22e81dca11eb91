"""Detail of checks at any position of a match."""

from palimpsest.operators import reports


def test_check_detail_has_one_header_and_flat_matches(spark):
    checks = spark.createDataFrame(
        [(1, 7, 10), (2, 7, 10), (3, 7, 11), (4, 7, 99)], "id int, user_id int, source_document_id int")
    docs = spark.createDataFrame([(10, "ten"), (11, "eleven"), (12, "twelve")], "id int, title string")
    users = spark.createDataFrame([(7, "Seven")], "id int, full_name string")
    at = [(1, p) for p in (2500, 5, 1500, 999, 1000)] + [(2, 1500), (4, 0)]
    matches = spark.createDataFrame(
        [(c, p, 12, f"text {p}", p, p + 1, 50.0) for c, p in at],
        "check_id int, pos int, matched_document_id int, matched_text string, start_position int,"
        " end_position int, similarity_score double")
    head, rows = reports.check_detail(checks, docs, users, matches)
    assert sorted((r.id, r.source_title, r.user_name) for r in head.collect()) == [
        (1, "ten", "Seven"), (2, "ten", "Seven"), (3, "eleven", "Seven")]
    assert [(r.check_id, r.pos, r.matched_title, r.matched_text) for r in rows.collect()] == [
        (c, p, "twelve", f"text {p}") for c, p in [(1, 5), (1, 999), (1, 1000), (1, 1500), (1, 2500), (2, 1500)]]
    assert not {"page", "matches"} & {*head.columns, *rows.columns}
