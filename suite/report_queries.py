"""Scans, filters, lists, statistics, top-k and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import bands
from palimpsest.operators import filters, reports
from palimpsest.scratch import fresh_path, stage
from palimpsest.sources import sink
from suite.model import with_tables
from suite.registry import query

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


@query(
    "S1_scan_tables",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES),
)
def scan_tables(m):
    counts = [m.raw(t).agg(F.count("*").alias("n")).withColumn("table_name", F.lit(t)) for t in TABLES]
    return reduce(DataFrame.unionByName, counts)


@query(
    "S4_write_results",
    with_tables(
        "checks matches",
        """SELECT CAST(date_trunc('month', c.check_date) AS date) AS period, count(DISTINCT c.id) AS n_checks,
        count(m.check_id) AS n_matches, CAST(coalesce(sum(m.similarity_score), 0) AS double) AS sum_score
        FROM checks c LEFT JOIN matches m ON m.check_id = c.id GROUP BY ALL""",
    ),
)
def write_results(m):
    folder = fresh_path(m.spark, "results")
    checks = m.checks()
    matches = m.matches().join(checks.select(F.col("id").alias("check_id"), "check_date"), "check_id")
    # written twice, as by a repeated job: nothing stands there twice
    for _ in range(2):
        sink.write_results(checks, matches, folder, F.col("check_date"))
    stored = m.spark.read.parquet(f"{folder}/checks").groupBy("period").agg(F.count("*").alias("n_checks"))
    rows = m.spark.read.parquet(f"{folder}/matches").groupBy("period").agg(
        F.count("*").alias("n_matches"), F.sum("similarity_score").alias("s")
    )
    return stored.join(rows, "period", "left").select(
        "period", "n_checks", F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
        F.coalesce(F.col("s").cast("double"), F.lit(0.0)).alias("sum_score"),
    )


@query("F1_active_only", with_tables("users", "SELECT id, full_name, role FROM users WHERE is_active"))
def active_only(m):
    return filters.active_only(m.users()).select("id", "full_name", "role")


@query(
    "F2_optional_filters",
    with_tables(
        "papers users checks departments subjects",
        """SELECT 'subjects' AS kind, id FROM subjects WHERE department_id = 3
        UNION ALL SELECT 'documents' AS kind, id FROM papers WHERE document_type = 'Thesis' AND subject_id = 3
        UNION ALL SELECT 'checks', id FROM checks WHERE user_id = 7
        UNION ALL SELECT 'departments', id FROM departments WHERE faculty_id = 2
        UNION ALL SELECT 'users', id FROM users WHERE role = 'Lecturer'""",
    ),
)
def optional_filters(m):
    def ids(kind, df):
        return df.select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"))

    f = filters.optional_filters
    return (
        ids("documents", f(m.papers(), user_id=None, document_type="Thesis", subject_id=3))
        .unionByName(ids("checks", f(m.checks(), user_id=7, source_document_id=None)))
        .unionByName(ids("departments", f(m.departments(), faculty_id=2)))
        .unionByName(ids("subjects", f(m.subjects(), department_id=3)))
        .unionByName(ids("users", f(m.users(), role="Lecturer")))
    )


@query("F3_reference_corpus", with_tables("docs", "SELECT id, title FROM docs WHERE is_active AND is_public AND id <> 3"))
def reference_corpus(m):
    return filters.reference_corpus(m.documents(), 3).select("id", "title")


@query(
    "F4_row_scope",
    with_tables(
        "checks papers",
        """SELECT 'checks of a student' AS view, count(*) AS n, CAST(coalesce(sum(id), 0) AS bigint) AS sum_id FROM checks WHERE user_id = 11
        UNION ALL SELECT 'checks of an admin', count(*), CAST(sum(id) AS bigint) FROM checks
        UNION ALL SELECT 'documents of a student', count(*), CAST(coalesce(sum(id), 0) AS bigint) FROM papers WHERE user_id = 11
        UNION ALL SELECT 'documents of a lecturer', count(*), CAST(sum(id) AS bigint) FROM papers""",
    ),
)
def row_scope(m):
    views = {
        "checks of a student": filters.row_scope(m.checks(), 11, "Student"),
        "checks of an admin": filters.row_scope(m.checks(), 11, "Admin"),
        "documents of a student": filters.row_scope(m.papers(), 11, "Student", restricted="students"),
        "documents of a lecturer": filters.row_scope(m.papers(), 11, "Lecturer", restricted="students"),
    }
    parts = [
        df.agg(F.count("*").alias("n"), F.coalesce(F.sum("id"), F.lit(0)).cast("long").alias("sum_id"))
        .withColumn("view", F.lit(name))
        for name, df in views.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "F5_text_search",
    with_tables("papers users", """SELECT p.id, p.title, u.full_name AS user_name FROM papers p
    JOIN users u ON u.id = p.user_id
    WHERE contains(lower(p.title), '42') OR contains(lower(u.full_name), '42')"""),
)
def text_search(m):
    named = reports.document_list(m.papers(), m.users(), m.subjects())
    return filters.text_search(named, "42", "title", "user_name").select("id", "title", "user_name")


@query(
    "F5_collated_search",
    with_tables("papers", "SELECT id, title FROM papers WHERE contains(lower(title), lower('RING'))"),
)
def collated_search(m):
    return filters.text_search(m.papers(), "RinG", "title", collation="UNICODE_CI").select("id", "title")


@query(
    "F6_lookup",
    with_tables("users faculties departments", """SELECT u.id, u.full_name, f.name AS faculty_name,
    d.name AS department_name FROM users u LEFT JOIN faculties f ON f.id = u.faculty_id
    LEFT JOIN departments d ON d.id = u.department_id
    WHERE u.username = 'customer000000017' OR u.id = 23"""),
)
def lookup(m):
    view = reports.user_list(m.users(), m.faculties(), m.departments())
    both = filters.lookup(view, username="customer000000017").unionByName(filters.lookup(view, id=23))
    return both.select("id", "full_name", "faculty_name", "department_name")


@query(
    "F6_lookup_rows",
    with_tables("papers departments subjects", """SELECT 'document' AS kind, id, title AS name FROM papers WHERE id = 42
    UNION ALL SELECT 'department', id, name FROM departments WHERE id = 3
    UNION ALL SELECT 'department', id, name FROM departments WHERE code = 'D7'
    UNION ALL SELECT 'subject', id, name FROM subjects WHERE id = 12
    UNION ALL SELECT 'subject', id, name FROM subjects WHERE code = upper('Brand#21')"""),
)
def lookup_rows(m):
    """By id or code, active or not."""
    found = [
        ("document", m.papers().withColumn("name", F.col("title")), {"id": 42}), ("department", m.departments(), {"id": 3}),
        ("department", m.departments(), {"code": "D7"}), ("subject", m.subjects(), {"id": 12}),
        ("subject", m.subjects(), {"code": "BRAND#21"}),
    ]
    return reduce(DataFrame.unionByName, [
        filters.lookup(df, **key).select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), "name")
        for kind, df, key in found])


@query("F7_document_content", "SELECT text AS content FROM documents WHERE doc_id = 5")
def document_content(m):
    docs = m.raw("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return filters.document_content(docs, 5)


@query("F8_remaining_checks", with_tables("users", "SELECT id, CAST(daily_check_limit - checks_used_today AS bigint) AS remaining FROM users"))
def remaining(m):
    left = bands.remaining_checks(F.col("daily_check_limit"), F.col("checks_used_today"))
    return m.users().select("id", left.cast("long").alias("remaining"))


@query(
    "F9_risk_band",
    with_tables("checks", """SELECT id,
    CASE WHEN overall_similarity > 30 THEN 'high' WHEN overall_similarity >= 15 THEN 'medium' ELSE 'low' END AS report,
    CASE WHEN overall_similarity > 20 THEN 'Nguy cơ' WHEN overall_similarity > 10 THEN 'Xem xét' ELSE 'An toàn' END AS dashboard,
    CASE WHEN overall_similarity > 60 THEN 'high' WHEN overall_similarity > 30 THEN 'medium' ELSE 'low' END AS segment,
    CASE WHEN overall_similarity > 50 THEN 'high' WHEN overall_similarity > 20 THEN 'medium' ELSE 'low' END AS "match",
    CASE WHEN overall_similarity > 20 THEN 'Nguy cơ cao' ELSE 'An toàn' END AS verdict,
    CASE WHEN overall_similarity > 70 THEN 'High' WHEN overall_similarity > 40 THEN 'Medium' ELSE 'Low' END AS ai
    FROM checks"""),
)
def risk_bands(m):
    score = F.col("overall_similarity")
    scales = ("report", "dashboard", "segment", "match", "verdict", "ai")
    return m.checks().select("id", *[bands.risk_band(score, s).alias(s) for s in scales])


DOCUMENT_LIST = """SELECT d.id, d.title, u.full_name AS user_name, s.name AS subject_name, d.upload_date
    FROM papers d JOIN users u ON u.id = d.user_id LEFT JOIN subjects s ON s.id = d.subject_id
    WHERE d.is_active"""


@query("J1_document_list", with_tables("papers users subjects", DOCUMENT_LIST))
def document_list(m):
    return reports.document_list(filters.active_only(m.papers()), m.users(), m.subjects()).select(
        "id", "title", "user_name", "subject_name", "upload_date"
    )


@query(
    "J2_check_history",
    with_tables("checks papers users", """SELECT c.id, d.title AS source_title, u.full_name AS user_name,
    c.check_date, CAST(c.overall_similarity AS double) AS overall_similarity, c.status FROM checks c
    JOIN papers d ON d.id = c.source_document_id JOIN users u ON u.id = c.user_id"""),
)
def check_history(m):
    return reports.check_history(m.checks(), m.papers(), m.users()).select(
        "id", "source_title", "user_name", "check_date",
        F.col("overall_similarity").cast("double").alias("overall_similarity"), "status",
    )


@query(
    "J3_user_list",
    with_tables("users faculties departments", """SELECT u.id, u.full_name, f.name AS faculty_name,
    d.name AS department_name, CAST(u.daily_check_limit - u.checks_used_today AS bigint) AS remaining_checks
    FROM users u LEFT JOIN faculties f ON f.id = u.faculty_id
    LEFT JOIN departments d ON d.id = u.department_id WHERE u.is_active"""),
)
def user_list(m):
    rows = reports.user_list(filters.active_only(m.users()), m.faculties(), m.departments())
    return rows.select(
        "id", "full_name", "faculty_name", "department_name",
        F.col("remaining_checks").cast("long").alias("remaining_checks"),
    )


@query(
    "J4_catalog_list",
    with_tables("faculties departments subjects", """SELECT 'department' AS kind, d.id, d.name, f.name AS parent_name
    FROM departments d JOIN faculties f ON f.id = d.faculty_id WHERE d.is_active
    UNION ALL SELECT 'subject', s.id, s.name, d.name FROM subjects s
    JOIN departments d ON d.id = s.department_id WHERE s.is_active"""),
)
def catalog_list(m):
    departments = reports.with_parent_name(
        filters.active_only(m.departments()), m.faculties(), "faculty_id", "parent_name"
    )
    subjects = reports.with_parent_name(
        filters.active_only(m.subjects()), m.departments(), "department_id", "parent_name"
    )
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), "id", "name", "parent_name")
    return kind(departments, "department").unionByName(kind(subjects, "subject"))


@query(
    "J5_check_detail",
    with_tables("checks papers users matches", """SELECT c.id, d.title AS source_title, u.full_name AS user_name,
    coalesce(m.matches, '') AS matches, coalesce(m.n_matches, 0) AS n_matches FROM checks c
    JOIN papers d ON d.id = c.source_document_id JOIN users u ON u.id = c.user_id
    LEFT JOIN nested m ON m.check_id = c.id""",
    nested="""SELECT m.check_id, string_agg(m.pos || ':' || m.matched_document_id || ':' || d.title || ':' || m.matched_text, ';'
      ORDER BY m.pos, m.matched_document_id, d.title, m.matched_text) AS matches, count(*) AS n_matches
      FROM matches m JOIN papers d ON d.id = m.matched_document_id GROUP BY m.check_id"""),
)
def check_detail(m):
    head, rows = reports.check_detail(m.checks(), m.papers(), m.users(), m.matches(), ordered=False)
    entry = F.struct("pos", "matched_document_id", "matched_title", "matched_text")
    nested = rows.groupBy(F.col("check_id").alias("id")).agg(F.sort_array(F.collect_list(entry)).alias("matches"))
    told = F.transform(
        "matches",
        lambda e: F.concat_ws(":", e["pos"], e["matched_document_id"], e["matched_title"], e["matched_text"]),
    )
    return head.join(nested, "id", "left").select(
        "id", "source_title", "user_name",
        F.coalesce(F.array_join(told, ";"), F.lit("")).alias("matches"),
        F.coalesce(F.size("matches"), F.lit(0)).cast("long").alias("n_matches"),
    )


SUMMARY = """count(*) AS total_checks,
    coalesce(round(CAST(avg(overall_similarity) AS double), 4), 0) AS average_similarity,
    count(*) FILTER (WHERE overall_similarity > 30) AS high_risk,
    count(*) FILTER (WHERE overall_similarity >= 15 AND overall_similarity <= 30) AS medium_risk,
    count(*) FILTER (WHERE overall_similarity < 15) AS low_risk"""


@query(
    "A1_stats_summary",
    with_tables("checks papers", f"""SELECT 'all' AS scope, {SUMMARY} FROM checks WHERE status = 'Completed'
    UNION ALL SELECT 'user 7', {SUMMARY} FROM checks WHERE status = 'Completed' AND user_id = 7
    UNION ALL SELECT 'subject 3', {SUMMARY} FROM checks c JOIN papers d ON d.id = c.source_document_id
    WHERE status = 'Completed' AND d.subject_id = 3
    UNION ALL SELECT 'nobody', {SUMMARY} FROM checks WHERE status = 'Completed' AND user_id = -1"""),
)
def stats_summary(m):
    checks, docs = m.checks(), m.papers()
    views = {
        "all": reports.stats_summary(checks, docs),
        "user 7": reports.stats_summary(checks, docs, user_id=7),
        "subject 3": reports.stats_summary(checks, docs, subject_id=3),
        "nobody": reports.stats_summary(checks, docs, user_id=-1),
    }
    return reduce(DataFrame.unionByName, [df.withColumn("scope", F.lit(k)) for k, df in views.items()])


@query(
    "A2_stats_by_subject",
    with_tables("checks papers subjects", """SELECT d.subject_id, s.name AS subject_name, count(*) AS document_count,
    round(CAST(avg(c.overall_similarity) AS double), 4) AS average_similarity FROM checks c
    JOIN papers d ON d.id = c.source_document_id JOIN subjects s ON s.id = d.subject_id
    WHERE c.status = 'Completed' GROUP BY ALL ORDER BY average_similarity DESC, subject_id"""),
)
def stats_by_subject(m):
    return reports.stats_by_subject(m.checks(), m.papers(), m.subjects())


@query(
    "A3_entity_counts",
    with_tables("papers users faculties subjects", """SELECT
    (SELECT count(*) FROM papers WHERE is_active) AS total_documents, (SELECT count(*) FROM users) AS total_users,
    (SELECT count(*) FROM users WHERE role = 'Student') AS total_students,
    (SELECT count(*) FROM faculties) AS total_faculties, (SELECT count(*) FROM subjects) AS total_subjects"""),
)
def entity_counts(m):
    return reports.entity_counts(m.papers(), m.users(), m.faculties(), m.subjects())


@query(
    "J5_match_rows",
    with_tables("checks papers users matches", """SELECT m.check_id, m.pos, m.matched_document_id, d.title AS matched_title, m.matched_text
    FROM matches m JOIN papers d ON d.id = m.matched_document_id WHERE m.check_id IN (
      SELECT c.id FROM checks c JOIN papers p ON p.id = c.source_document_id JOIN users u ON u.id = c.user_id)"""),
)
def match_rows(m):
    _, rows = reports.check_detail(m.checks(), m.papers(), m.users(), m.matches(), ordered=False)
    return rows.select("check_id", "pos", "matched_document_id", "matched_title", "matched_text")


@query(
    "statistics",
    with_tables("checks papers users faculties subjects", """SELECT 'summary' AS part, 'total_checks' AS entry, count(*) AS n,
      round(CAST(coalesce(avg(overall_similarity), 0) AS double), 4) AS value FROM checks WHERE status = 'Completed' AND user_id = 7
    UNION ALL SELECT 'summary', 'high_risk', count(*) FILTER (WHERE overall_similarity > 30), 0 FROM checks WHERE status = 'Completed' AND user_id = 7
    UNION ALL SELECT 'entities', 'total_documents', count(*) FILTER (WHERE is_active), 0 FROM papers
    UNION ALL SELECT 'entities', 'total_students', count(*) FILTER (WHERE role = 'Student'), 0 FROM users
    UNION ALL SELECT 'subjects', s.name, count(*), round(CAST(avg(c.overall_similarity) AS double), 4) FROM checks c
      JOIN papers d ON d.id = c.source_document_id JOIN subjects s ON s.id = d.subject_id
      WHERE c.status = 'Completed' AND c.user_id = 7 GROUP BY s.name"""),
)
def statistics(m):
    """The statistics page of one user as rows."""
    parts = reports.statistics(m.checks(), m.papers(), m.users(), m.faculties(), m.subjects(), user_id=7)

    def told(part, entry, n, value):
        return parts[part].select(F.lit(part).alias("part"), entry.alias("entry"), F.col(n).alias("n"), value.alias("value"))

    none = F.lit(0.0)
    return reduce(DataFrame.unionByName, [
        told("summary", F.lit("total_checks"), "total_checks", F.col("average_similarity")),
        told("summary", F.lit("high_risk"), "high_risk", none),
        told("entities", F.lit("total_documents"), "total_documents", none),
        told("entities", F.lit("total_students"), "total_students", none),
        told("subjects", F.col("subject_name"), "document_count", F.col("average_similarity")),
    ])


@query(
    "T1_history_top_n",
    with_tables("checks", "SELECT id, check_date, status FROM checks ORDER BY check_date DESC, id DESC LIMIT 20"),
)
def history_top_n(m):
    return reports.history_top_n(m.checks().select("id", "check_date", "status"), 20)


@query(
    "T2_high_risk",
    with_tables("checks", """SELECT id, check_date, CAST(overall_similarity AS double) AS overall_similarity FROM checks
    WHERE status = 'Completed' AND overall_similarity >= 50
    ORDER BY overall_similarity DESC, check_date DESC, id DESC LIMIT 10"""),
)
def high_risk(m):
    return reports.high_risk(m.checks()).select(
        "id", "check_date", F.col("overall_similarity").cast("double").alias("overall_similarity")
    )


@query(
    "T3_sorted_lists",
    with_tables("papers users", """SELECT 'users' AS list, id, full_name AS entry, row_number() OVER (ORDER BY full_name, id) AS place FROM users WHERE is_active
    UNION ALL SELECT 'documents', id, CAST(upload_date AS varchar), row_number() OVER (ORDER BY upload_date DESC, id) FROM papers WHERE is_active"""),
)
def sorted_lists(m):
    """The place is numbered per partition of the sorted list, plus the rows before it."""
    users = reports.sorted_list(filters.active_only(m.users()), "full_name")
    papers = reports.sorted_list(filters.active_only(m.papers()), "upload_date", descending=True)
    return numbered(users.select("id", F.col("full_name").alias("entry")), "users").unionByName(
        numbered(papers.select("id", F.date_format("upload_date", "yyyy-MM-dd HH:mm:ss").alias("entry")), "documents")
    )


def numbered(ordered: DataFrame, name: str) -> DataFrame:
    marked = ordered.withColumns({"p": F.spark_partition_id(), "i": F.monotonically_increasing_id()})
    marked = stage(marked, "sorted")
    per = marked.groupBy("p").agg(F.count("*").alias("n"), F.min("i").alias("base"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("p", "base", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return marked.join(offsets, "p").select(
        F.lit(name).alias("list"), F.col("id").cast("long").alias("id"), "entry",
        (F.col("offset") + F.col("i") - F.col("base") + 1).alias("place"),
    )


@query(
    "T3_catalog_lists",
    with_tables("faculties departments subjects", " UNION ALL ".join(
        f"SELECT '{t}' AS list, CAST(id AS bigint) AS id, name AS entry, row_number() OVER (ORDER BY name, id) AS place FROM {t} WHERE is_active"
        for t in ("faculties", "departments", "subjects"))),
)
def catalog_lists(m):
    """Sorted without regard to case."""
    parts = []
    for name, df in (("faculties", m.faculties()), ("departments", m.departments()), ("subjects", m.subjects())):
        rows = reports.sorted_list(filters.active_only(df), "name", collation="UNICODE_CI")
        parts.append(numbered(rows.select("id", F.col("name").alias("entry")), name))
    return reduce(DataFrame.unionByName, parts)


@query(
    "history",
    with_tables("checks papers users", """SELECT c.id, c.check_date, c.status, p.title AS source_title, u.full_name AS user_name FROM (
      SELECT * FROM checks WHERE user_id = (SELECT max(user_id) FROM checks WHERE user_id % 2 = 1)
      ORDER BY check_date DESC, id DESC LIMIT 5) c JOIN papers p ON p.id = c.source_document_id JOIN users u ON u.id = c.user_id"""),
)
def history_job(m):
    """The last checks of one user with their names."""
    user = m.checks().filter("user_id % 2 = 1").agg(F.max("user_id")).first()[0]
    rows = reports.history(m.checks(), m.papers(), m.users(), user_id=user, limit=5)
    return rows.select("id", "check_date", "status", "source_title", "user_name")


@query(
    "U3_distinct_by",
    with_tables("matches", "SELECT DISTINCT check_id, matched_document_id FROM matches"),
)
def distinct_by(m):
    return reports.distinct_matched(m.matches())
