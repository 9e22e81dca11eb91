"""Quota, repeated uploads, table changes, integrity, ingest and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import ai, fixed
from palimpsest.operators import changes, integrity, quota
from palimpsest.scratch import fresh_path
from palimpsest.sources import ingest, sink
from palimpsest.sources.tables import spread
from palimpsest.streaming import streams
from suite.match_queries import OVERALL, OVERALL_OUT, R2, bench_corpus, bench_sql
from suite.model import with_tables
from suite.registry import query
from suite.text_queries import AI_OUT
from suite.textsql import quoted

AS_OF = "2024-05-01 10:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


# --- quota ---------------------------------------------------------------------------------------
TIGHT = "SELECT id, role, CASE WHEN role = 'Student' THEN 1 ELSE daily_check_limit END AS daily_check_limit FROM users"
SPENT = fixed.QUOTA_SPENT.split("%d")


def quota_sql(people: str) -> str:
    return with_tables("requests users papers", f"""SELECT request_id, user_id, accepted,
    CASE WHEN accepted THEN CAST(daily_check_limit - used AS bigint) END AS remaining,
    CASE WHEN NOT has_doc THEN {quoted(fixed.NO_DOCUMENT)} WHEN role IS NULL THEN {quoted(fixed.NO_USER)}
    WHEN NOT accepted THEN {quoted(SPENT[0])} || daily_check_limit || {quoted(SPENT[1])} END AS reason FROM (
      SELECT *, valid AND (role <> 'Student' OR used <= daily_check_limit) AS accepted FROM (
        SELECT *, sum(valid::int) OVER (PARTITION BY user_id, CAST(ts AS date) ORDER BY ts, request_id
          ROWS UNBOUNDED PRECEDING) AS used FROM (
          SELECT r.request_id, r.user_id, r.ts, p.id IS NOT NULL AS has_doc, u.role, u.daily_check_limit,
          p.id IS NOT NULL AND u.role IS NOT NULL AS valid FROM requests r
          LEFT JOIN papers p ON p.id = r.document_id LEFT JOIN people u ON u.id = r.user_id)))""", people=people)


def tight_users(m):
    """Students with one request a day, so that the limit binds."""
    limit = F.when(F.col("role") == "Student", F.lit(1)).otherwise(F.col("daily_check_limit"))
    return m.users().select("id", "role", limit.alias("daily_check_limit"))


@query("W1_daily_quota", quota_sql(TIGHT))
def daily_quota(m):
    rows = quota.daily_quota(m.requests(), tight_users(m), m.papers())
    return rows.select("request_id", "user_id", "accepted", "remaining", "reason")


def arriving(rows, name, thirds, files=4):
    """The rows as a stream of three micro-batches, one for each condition in ``thirds``.

    Files are taken from old to new, so a micro-batch is what was written together.
    """
    folder = fresh_path(rows.sparkSession, name)
    for third in thirds:
        rows.filter(third).repartition(files).write.mode("append").parquet(folder)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def in_thirds(rows, name, ts="ts"):
    """In order of time, cut at the thirds of the time covered."""
    least, most = rows.agg(F.min(ts), F.max(ts)).first()
    one, two = (F.lit(least + (most - least) * i / 3).cast("timestamp_ntz") for i in (1, 2))
    at = F.col(ts)
    return arriving(rows, name, [at < one, (at >= one) & (at < two), at >= two])


@query("R2_quota_stream", quota_sql(TIGHT))
def quota_stream(m):
    folder = fresh_path(m.spark, "quota-stream")
    streams.quota_stream(in_thirds(m.requests(), "quota-requests"), tight_users(m), m.papers(), folder).awaitTermination()
    out = streams.read_results(m.spark, folder)
    return out.select("request_id", "user_id", "accepted", "remaining", "reason")


UPLOADS = """SELECT id, user_id, file_name, file_size, anchor_id, anchor_id <> id AS is_repeat FROM marked"""
UPLOAD_STEPS = {
    "ordered": """SELECT *, row_number() OVER (PARTITION BY user_id, file_name, file_size ORDER BY ts, id) AS n FROM uploads""",
    "marked": """SELECT * FROM walk""",
}
UPLOAD_SQL = with_tables("uploads", UPLOADS, **UPLOAD_STEPS).replace("WITH ", "WITH RECURSIVE ", 1).replace(
    "marked AS (", """walk(id, user_id, file_name, file_size, n, anchor_id, anchor_ts) AS (
      SELECT id, user_id, file_name, file_size, n, id, ts FROM ordered WHERE n = 1
      UNION ALL SELECT o.id, o.user_id, o.file_name, o.file_size, o.n,
        CASE WHEN o.ts < w.anchor_ts + INTERVAL 2 HOURS THEN w.anchor_id ELSE o.id END,
        CASE WHEN o.ts < w.anchor_ts + INTERVAL 2 HOURS THEN w.anchor_ts ELSE o.ts END
      FROM walk w JOIN ordered o ON o.user_id = w.user_id AND o.file_name = w.file_name
      AND o.file_size = w.file_size AND o.n = w.n + 1),
    marked AS (""")


@query("W4_upload_dedup", UPLOAD_SQL)
def upload_dedup(m):
    return quota.upload_dedup(m.uploads()).drop("ts")


@query("R3_upload_dedup_stream", UPLOAD_SQL)
def upload_dedup_stream(m):
    folder = fresh_path(m.spark, "upload-stream")
    streams.upload_dedup_stream(in_thirds(m.uploads(), "upload-rows"), folder).awaitTermination()
    return streams.read_results(m.spark, folder).drop("ts")


#: Every document is asked for once, and each tenth a second time under another check id.
ASKED = """SELECT id, id AS check_id FROM docs UNION ALL SELECT id, id + 1000000000 FROM docs WHERE id % 10 = 0"""

R1_SQL = bench_sql("""SELECT q.check_id, o.src_id AS source_document_id, 'Completed' AS status, o.overall_similarity,
    o.total_matched_documents, a.ai_probability, a.detection_level AS ai_detection_level, a.n_sentences, NULL::varchar AS notes
    FROM asked q JOIN totals o ON o.src_id = q.id JOIN ai a ON a.doc_id = q.id""",
    asked=ASKED, overall=OVERALL, totals=OVERALL_OUT, ai=AI_OUT)


def stored_checks(m):
    """Requests in three micro-batches, checked against the benchmark texts; the folder of the results."""
    docs = spread(m.raw("documents")).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    first = docs.select(F.col("id").alias("check_id"), "id", "content", as_of().alias("check_date"))
    again = first.filter("id % 10 = 0").withColumn("check_id", F.col("check_id") + 1000000000)
    third = F.pmod(F.xxhash64("check_id"), F.lit(3))
    requests = arriving(first.unionByName(again), "check-requests", [third == i for i in range(3)])
    folder = fresh_path(m.spark, "check-stream")
    streams.check_stream(requests, bench_corpus(m), folder, exclude_self=False, min_percent=20.0).awaitTermination()
    return f"{folder}/results"


@query("R1_check_stream", R1_SQL)
def check_stream(m):
    checks = sink.read_checks(m.spark, stored_checks(m))
    sentences = F.size(ai.from_stored(F.col("ai_detection_json"))["sentences"]).cast("long")
    return checks.withColumn("n_sentences", sentences).drop("ai_detection_json", "check_date", "period")


@query("R1_stored_matches", bench_sql(f"""SELECT q.check_id, b.pos, b.matched_id AS matched_document_id, c.clean AS matched_text,
    CAST({R2.format('b.score_raw')} AS double) AS similarity_score FROM asked q JOIN best b ON b.src_id = q.id
    JOIN counted c ON c.src_id = b.src_id AND c.pos = b.pos
    WHERE {R2.format('b.score_raw')} > 20 AND b.matched_id IS NOT NULL""", asked=ASKED))
def stored_matches(m):
    rows = sink.read_matches(m.spark, stored_checks(m), "check_id")
    return rows.select("check_id", "pos", "matched_document_id", "matched_text",
                       F.col("similarity_score").cast("double").alias("similarity_score"))


# --- table changes ---------------------------------------------------------------------------------
D1_CHANGES = """SELECT s_suppkey AS id, 'S' || s_suppkey AS code, s_name AS name,
    s_nationkey % 5 AS faculty_id, s_acctbal >= 0 AS is_active FROM supplier"""


@query("D1_upsert_dim", with_tables("departments", """SELECT CAST(coalesce(d.id, c.id) AS bigint) AS id, coalesce(c.code, d.code) AS code,
    coalesce(c.name, d.name) AS name, CAST(coalesce(c.faculty_id, d.faculty_id) AS bigint) AS faculty_id,
    CASE WHEN d.id IS NULL THEN true WHEN c.id IS NULL THEN d.is_active ELSE c.is_active END AS is_active,
    d.id IS NULL AS is_created, d.id IS NOT NULL AND c.id IS NOT NULL AS is_updated
    FROM departments d FULL JOIN ch c ON c.id = d.id""", ch=D1_CHANGES))
def upsert_dim(m):
    none = F.lit(None).cast("timestamp_ntz")
    base = m.departments().withColumns({"created_date": none, "updated_date": none})
    new = m.raw("supplier").selectExpr(
        "s_suppkey AS id", "concat('S', s_suppkey) AS code", "s_name AS name", "s_nationkey % 5 AS faculty_id",
        "s_acctbal >= 0 AS is_active",
    )
    merged = changes.upsert_dim(base, new, as_of())
    return merged.select(
        F.col("id").cast("long").alias("id"), "code", "name", F.col("faculty_id").cast("long").alias("faculty_id"),
        "is_active", F.col("created_date").isNotNull().alias("is_created"), F.col("updated_date").isNotNull().alias("is_updated"),
    )


#: A log of changes that names each id several times; the last one counts.
CHANGE_LOG = """SELECT arg_max(struct_pack(code := 'S' || s_suppkey, name := s_name, faculty_id := s_nationkey % 5,
    is_active := s_acctbal >= 0, public := s_acctbal > 0, subject_id := CASE WHEN s_nationkey > 5 THEN s_nationkey END), s_suppkey) AS c,
    s_suppkey % 40 AS id, count(*) AS times FROM supplier GROUP BY s_suppkey % 40"""


def change_log(m, *columns):
    return m.raw("supplier").selectExpr("s_suppkey % 40 AS id", "s_suppkey AS seq", *columns)


@query("D1_change_log", with_tables("departments", """SELECT CAST(coalesce(d.id, l.id) AS bigint) AS id, coalesce(l.c.code, d.code) AS code,
    coalesce(l.c.name, d.name) AS name, CAST(coalesce(l.c.faculty_id, d.faculty_id) AS bigint) AS faculty_id,
    CASE WHEN l.id IS NULL THEN d.is_active WHEN d.id IS NULL AND l.times = 1 THEN true ELSE l.c.is_active END AS is_active,
    d.id IS NULL AS is_created, l.id IS NOT NULL AND (d.id IS NOT NULL OR l.times > 1) AS is_updated
    FROM departments d FULL JOIN log l ON l.id = d.id""", log=CHANGE_LOG))
def upsert_change_log(m):
    none = F.lit(None).cast("timestamp_ntz")
    base = m.departments().withColumns({"created_date": none, "updated_date": none})
    new = change_log(m, "concat('S', s_suppkey) AS code", "s_name AS name", "s_nationkey % 5 AS faculty_id",
                     "s_acctbal >= 0 AS is_active")
    merged = changes.upsert_dim(base, new, as_of(), "seq")
    return merged.select(
        F.col("id").cast("long").alias("id"), "code", "name", F.col("faculty_id").cast("long").alias("faculty_id"),
        "is_active", F.col("created_date").isNotNull().alias("is_created"), F.col("updated_date").isNotNull().alias("is_updated"),
    )


@query("D4_change_log", with_tables("papers", """SELECT p.id, coalesce(l.c.name, p.title) AS title,
    CASE WHEN l.id IS NULL THEN p.document_type ELSE 'Thesis' END AS document_type,
    CAST(CASE WHEN l.id IS NULL THEN p.subject_id ELSE l.c.subject_id END AS bigint) AS subject_id,
    coalesce(l.c.public, p.is_public) AS is_public FROM papers p LEFT JOIN log l ON l.id = p.id""", log=CHANGE_LOG))
def documents_change_log(m):
    new = change_log(m, "s_name AS title", "'Thesis' AS document_type",
                     "CASE WHEN s_nationkey > 5 THEN s_nationkey END AS subject_id", "s_acctbal > 0 AS is_public")
    rows = changes.update_documents(m.papers(), new, "seq")
    return rows.select("id", "title", "document_type", F.col("subject_id").cast("long").alias("subject_id"), "is_public")


@query("D5_change_log", with_tables("users", """SELECT u.id, coalesce(l.c.name, u.full_name) AS full_name,
    CASE WHEN l.id IS NULL THEN u.is_active ELSE l.c.is_active END AS is_active FROM users u LEFT JOIN log l ON l.id = u.id""",
    log=CHANGE_LOG))
def users_change_log(m):
    new = change_log(m, "s_name AS full_name", "s_acctbal >= 0 AS is_active")
    return changes.update_users(m.users(), new, "seq").select("id", "full_name", "is_active")


@query("D2_soft_delete", with_tables("users", """SELECT u.id, u.is_active AND s.s_suppkey IS NULL AS is_active
    FROM users u LEFT JOIN (SELECT DISTINCT s_suppkey FROM supplier WHERE s_acctbal < 1000) s ON s.s_suppkey = u.id"""))
def soft_delete(m):
    keys = m.raw("supplier").filter("s_acctbal < 1000").select(F.col("s_suppkey").alias("id"))
    return changes.soft_delete(m.users(), keys).select("id", "is_active")


D3_BATCH = """SELECT s_suppkey AS seq, CASE s_suppkey % 3 WHEN 0 THEN 'CUSTOMER' || lpad(CAST(s_suppkey AS varchar), 9, '0')
    WHEN 1 THEN s_name ELSE 'Nation' || s_nationkey END AS username,
    CASE s_suppkey % 5 WHEN 0 THEN 'Customer.' || lpad(CAST(s_suppkey AS varchar), 9, '0') || '@example.org'
    ELSE s_name || '@example.org' END AS email, s_name AS full_name, 'Student' AS role FROM supplier"""


# Rows of this batch meet only in the user name.  A name is taken once an earlier row got it, and a
# row gets it unless an active user has its mail.
ORACLE_D3 = with_tables("users", f"""SELECT seq, CASE WHEN taken OR mail_taken THEN 'rejected'
    WHEN target IS NULL THEN 'inserted' ELSE 'reactivated' END AS outcome,
    CASE WHEN NOT taken AND NOT mail_taken THEN coalesce(target, seq + (SELECT max(id) FROM users) + 1) END AS user_id,
    CASE WHEN taken THEN {quoted(fixed.USERNAME_TAKEN)} WHEN mail_taken THEN {quoted(fixed.EMAIL_TAKEN)} END AS reason
    FROM (SELECT *, name_taken OR coalesce(seq > min(CASE WHEN NOT mail_taken THEN seq END) OVER (PARTITION BY lower(username)), false) AS taken
      FROM hits)""", batch=D3_BATCH,
    hits="""SELECT b.seq, b.username, coalesce(n.is_active, false) AS name_taken, coalesce(e.is_active, false) AS mail_taken,
      coalesce(e.id, n.id) AS target FROM batch b LEFT JOIN users n ON lower(n.username) = lower(b.username)
      LEFT JOIN users e ON lower(e.email) = lower(b.email)""")


@query("D3_merge_users", ORACLE_D3)
def merge_users(m):
    batch = m.raw("supplier").selectExpr(*[
        "s_suppkey AS seq",
        "CASE s_suppkey % 3 WHEN 0 THEN concat('CUSTOMER', lpad(s_suppkey, 9, '0')) WHEN 1 THEN s_name"
        " ELSE concat('Nation', s_nationkey) END AS username",
        "CASE s_suppkey % 5 WHEN 0 THEN concat('Customer.', lpad(s_suppkey, 9, '0'), '@example.org')"
        " ELSE concat(s_name, '@example.org') END AS email",
        "s_name AS full_name", "'Student' AS role",
    ])
    return changes.merge_users(m.users(), batch, as_of())[1]


@query("D4_update_documents", with_tables("papers", """SELECT p.id, coalesce(c.title, p.title) AS title,
    CASE WHEN c.id IS NULL THEN p.document_type ELSE c.document_type END AS document_type,
    CAST(CASE WHEN c.id IS NULL THEN p.subject_id ELSE c.subject_id END AS bigint) AS subject_id,
    coalesce(c.is_public, p.is_public) AS is_public, coalesce(c.is_active, p.is_active) AS is_active
    FROM papers p LEFT JOIN ch c ON c.id = p.id""", ch="""SELECT s_suppkey AS id, s_name AS title, 'Thesis' AS document_type,
    CASE WHEN s_nationkey > 5 THEN s_nationkey END AS subject_id, s_acctbal > 0 AS is_public, true AS is_active FROM supplier"""))
def update_documents(m):
    new = m.raw("supplier").selectExpr(
        "s_suppkey AS id", "s_name AS title", "'Thesis' AS document_type",
        "CASE WHEN s_nationkey > 5 THEN s_nationkey END AS subject_id", "s_acctbal > 0 AS is_public", "true AS is_active",
    )
    rows = changes.update_documents(m.papers(), new)
    return rows.select(
        "id", "title", "document_type", F.col("subject_id").cast("long").alias("subject_id"), "is_public", "is_active"
    )


@query("D5_update_users", with_tables("users", """SELECT u.id, coalesce(c.s_name, u.full_name) AS full_name,
    CASE WHEN c.s_suppkey IS NULL THEN u.email ELSE lower(c.s_name) END AS email,
    CAST(CASE WHEN c.s_suppkey IS NULL THEN u.department_id ELSE c.s_nationkey END AS bigint) AS department_id, u.role
    FROM users u LEFT JOIN supplier c ON c.s_suppkey = u.id"""))
def update_users(m):
    new = m.raw("supplier").selectExpr(
        "s_suppkey AS id", "s_name AS full_name", "lower(s_name) AS email", "s_nationkey AS department_id",
    )
    rows = changes.update_users(m.users(), new)
    return rows.select("id", "full_name", "email", F.col("department_id").cast("long").alias("department_id"), "role")


# --- integrity -----------------------------------------------------------------------------------------
J13_KEYS = "SELECT CAST(floor(value) AS bigint) AS id FROM events WHERE event_type = 'error' GROUP BY ALL"


@query("J13_cascade_delete", with_tables("papers checks matches", """SELECT 'documents' AS part, count(*) AS n, CAST(coalesce(sum(id), 0) AS bigint) AS sum_id FROM papers WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'checks', count(*), CAST(coalesce(sum(id), 0) AS bigint) FROM checks WHERE id NOT IN (SELECT id FROM gone_checks)
    UNION ALL SELECT 'matches', count(*), CAST(coalesce(sum(check_id), 0) AS bigint) FROM matches WHERE check_id NOT IN (SELECT id FROM gone_checks)
    UNION ALL SELECT 'blocked', count(*), CAST(coalesce(sum(id), 0) AS bigint) FROM blocked""",
    wanted=J13_KEYS,
    blocked="""SELECT id FROM papers WHERE id IN (SELECT id FROM wanted) AND id IN (SELECT m.matched_document_id FROM matches m
      JOIN checks c ON c.id = m.check_id WHERE c.source_document_id <> m.matched_document_id)""",
    gone="SELECT id FROM papers WHERE id IN (SELECT id FROM wanted) AND id NOT IN (SELECT id FROM blocked)",
    gone_checks="SELECT id FROM checks WHERE source_document_id IN (SELECT id FROM gone)"))
def cascade_delete(m):
    keys = m.raw("events").filter("event_type = 'error'").selectExpr("cast(floor(value) AS bigint) AS id")
    left = integrity.delete_documents(m.papers(), m.checks(), m.matches(), keys)

    def told(part, column="id"):
        return left[part].agg(
            F.count("*").alias("n"), F.coalesce(F.sum(column), F.lit(0)).cast("long").alias("sum_id")
        ).withColumn("part", F.lit(part))

    return told("documents").unionByName(told("checks")).unionByName(told("matches", "check_id")).unionByName(told("blocked"))


@query("J13_cleared_keys", with_tables("faculties departments subjects users papers", """SELECT 'users' AS part, count(*) AS n, count(faculty_id) AS n_keys FROM users
    UNION ALL SELECT 'documents', count(*), count(subject_id) FILTER (WHERE subject_id NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)) FROM papers
    UNION ALL SELECT 'blocked faculties', count(*), 0 FROM faculties WHERE id IN (SELECT faculty_id FROM departments)
    UNION ALL SELECT 'subjects', count(*) FILTER (WHERE id NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)), 0 FROM subjects"""))
def cleared_keys(m):
    """All faculties are in use and stay; some subjects go and clear the key of their documents."""
    named = m.raw("supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("id"))
    faculties = integrity.delete_parents(
        m.faculties(), m.faculties().select("id"), [(m.departments(), "faculty_id")], {"users": (m.users(), "faculty_id")}
    )
    subjects = integrity.delete_parents(
        m.subjects(), named, [], {"documents": (m.papers(), "subject_id")}
    )

    def told(part, df, key=None):
        n_keys = F.lit(0).cast("long") if key is None else F.count(key)
        return df.agg(F.count("*").alias("n"), n_keys.alias("n_keys")).withColumn("part", F.lit(part))

    return (
        told("users", faculties["users"], "faculty_id")
        .unionByName(told("documents", subjects["documents"], "subject_id"))
        .unionByName(told("blocked faculties", faculties["blocked"]))
        .unionByName(told("subjects", subjects["kept"]))
    )


def orphan_sql(child: str, key: str, parent: str, id_col: str, name: str) -> str:
    return f"""SELECT '{name}.{key}' AS relation, CAST({id_col} AS varchar) AS row_id, CAST({key} AS bigint) AS missing_key
    FROM {child} c WHERE {key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.id = c.{key})"""


@query("J14_orphan_report", with_tables("faculties departments subjects users papers checks matches", " UNION ALL ".join([
    orphan_sql("departments", "faculty_id", "faculties", "id", "departments"),
    orphan_sql("subjects", "department_id", "departments", "id", "subjects"),
    orphan_sql("users", "faculty_id", "faculties", "id", "users"),
    orphan_sql("users", "department_id", "departments", "id", "users"),
    orphan_sql("papers", "user_id", "users", "id", "documents"),
    orphan_sql("papers", "subject_id", "subjects", "id", "documents"),
    orphan_sql("checks", "source_document_id", "papers", "id", "checks"),
    orphan_sql("checks", "user_id", "users", "id", "checks"),
    orphan_sql("matches", "check_id", "checks", "check_id", "matches"),
    orphan_sql("matches", "matched_document_id", "papers", "check_id", "matches"),
])))
def orphan_report(m):
    return integrity.orphan_report({
        "faculties": m.faculties(), "departments": m.departments(), "subjects": m.subjects(), "users": m.users(),
        "documents": m.papers(), "checks": m.checks(), "matches": m.matches(),
    })


@query("A9_unique_violations", """SELECT 'part.p_name' AS relation, p_name AS value, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1
    UNION ALL SELECT 'customer.c_name', c_name, count(*) FROM customer GROUP BY c_name HAVING count(*) > 1""")
def unique_violations(m):
    return integrity.unique_violations(m.raw("part"), "part.p_name", "p_name").unionByName(
        integrity.unique_violations(m.raw("customer"), "customer.c_name", "c_name")
    )


@query("A9_catalog_keys", with_tables("faculties departments subjects users", " UNION ALL ".join(
    f"SELECT '{relation}' AS relation, {column} AS value, count(*) AS n FROM (SELECT * FROM {table} UNION ALL SELECT * FROM {table} WHERE id % 3 = 0)"
    f" GROUP BY {column} HAVING count(*) > 1"
    for relation, table, column in (
        ("faculties.code", "faculties", "code"), ("departments.code", "departments", "code"), ("subjects.code", "subjects", "code"),
        ("users.username", "users", "username"), ("users.email", "users", "email")))))
def catalog_keys(m):
    """The unique keys of the catalog, on tables in which every third row stands twice."""
    parts = []
    for relation, df in (("faculties.code", m.faculties()), ("departments.code", m.departments()), ("subjects.code", m.subjects()),
                         ("users.username", m.users()), ("users.email", m.users())):
        twice = df.unionByName(df.filter("id % 3 = 0"))
        parts.append(integrity.unique_violations(twice, relation, relation.split(".")[1]))
    return reduce(DataFrame.unionByName, parts)


@query("J13_same_batch", "WITH RECURSIVE " + with_tables("papers checks matches", """SELECT 'blocked' AS part, count(*) AS n, CAST(coalesce(sum(id), 0) AS bigint) AS sum_id FROM (SELECT DISTINCT id FROM stays)
    UNION ALL SELECT 'deleted_documents', count(*), CAST(coalesce(sum(id), 0) AS bigint) FROM there WHERE id NOT IN (SELECT id FROM stays)
    UNION ALL SELECT 'checks', count(*), CAST(coalesce(sum(id), 0) AS bigint) FROM checks WHERE source_document_id NOT IN
      (SELECT id FROM there WHERE id NOT IN (SELECT id FROM stays))""",
    wanted="SELECT id FROM papers WHERE id % 8 <> 0", there="SELECT DISTINCT id FROM wanted",
    edges="""SELECT DISTINCT c.source_document_id AS s, m.matched_document_id AS d FROM matches m JOIN checks c ON c.id = m.check_id
      WHERE c.source_document_id <> m.matched_document_id AND m.matched_document_id IN (SELECT id FROM there)""",
    stays="""SELECT d AS id FROM edges WHERE s NOT IN (SELECT id FROM there) UNION
      SELECT e.d FROM stays b JOIN edges e ON e.s = b.id""").removeprefix("WITH "))
def delete_same_batch(m):
    """A document stays only if the check that points to it does."""
    keys = m.papers().filter("id % 8 <> 0").select("id")
    left = integrity.delete_documents(m.papers(), m.checks(), m.matches(), keys, same_batch=True)
    return reduce(DataFrame.unionByName, [
        left[part].agg(F.count("*").alias("n"), F.coalesce(F.sum("id"), F.lit(0)).cast("long").alias("sum_id"))
        .withColumn("part", F.lit(part)) for part in ("blocked", "deleted_documents", "checks")])


# --- ingest ------------------------------------------------------------------------------------------------
FILES = """SELECT '/inbox/' || source || '/' || lang || '_doc-' || doc_id || CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.TXT'
    WHEN 'de' THEN '.docx' ELSE '.md' END AS path, lang, doc_id, text FROM documents"""
IMPORTED = "SELECT * FROM files WHERE lang IN ('en', 'fr') AND regexp_matches(text, '\\S')"
FAILED = "SELECT * FROM files WHERE lang = 'de' OR (lang IN ('en', 'fr') AND NOT regexp_matches(text, '\\S'))"


def inbox(m):
    """The documents as files, with the columns a folder scan gives."""
    return m.raw("documents").selectExpr(
        "concat('/inbox/', source, '/', lang, '_doc-', doc_id, CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.TXT'"
        " WHEN 'de' THEN '.docx' ELSE '.md' END) AS path",
        "encode(text, 'UTF-8') AS content", "cast(octet_length(text) AS bigint) AS length",
    )


@query("S2_import_folder", with_tables("", """SELECT lang || ' doc ' || doc_id AS title, text AS content,
    octet_length(encode(text))::bigint AS file_size, 'Thesis' AS document_type, 'HK1' AS semester, 2024::bigint AS year FROM ok""",
    files=FILES, ok=IMPORTED))
def import_folder(m):
    docs, _ = ingest.import_files(inbox(m), 1, as_of())
    return docs.select("title", "content", "file_size", "document_type", "semester", F.col("year").cast("long").alias("year"))


def written_folder(m):
    """The texts as files of a folder: with a byte-order mark, with a byte that is no UTF-8, or as they are."""
    rows = m.raw("documents").filter("text IS NOT NULL").selectExpr(
        "doc_id", "CASE doc_id % 3 WHEN 0 THEN concat(X'EFBBBF', encode(text, 'UTF-8')) WHEN 1 THEN concat(encode(text, 'UTF-8'), X'20FF')"
        " ELSE encode(text, 'UTF-8') END AS body")
    folder = fresh_path(m.spark, "inbox")

    def put(found):
        # one file a document, by the file system of the folder
        import pyarrow as pa
        from pyarrow import fs

        local = "/" + folder.removeprefix("file:").lstrip("/")
        files, base = fs.FileSystem.from_uri(folder) if "://" in folder and not folder.startswith("file:") else (fs.LocalFileSystem(), local)
        files.create_dir(base)
        for batch in found:
            for number, body in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist()):
                with files.open_output_stream(f"{base}/my_doc-{number}.txt") as out:
                    out.write(body)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")], names=["doc_id"])

    rows.mapInArrow(put, "doc_id bigint").count()
    return folder


@query("S2_read_folder", """SELECT 'my doc ' || doc_id AS title, text || CASE doc_id % 3 WHEN 1 THEN ' ' || chr(65533) ELSE '' END AS content,
    (octet_length(encode(text)) + [3, 2, 0][doc_id % 3 + 1])::bigint AS file_size FROM documents WHERE regexp_matches(text, '\\S')
    OR (doc_id % 3 = 1 AND text IS NOT NULL)""")
def read_written_folder(m):
    docs, _, _ = ingest.import_folder(m.spark, written_folder(m), 1, as_of())
    return docs.select("title", "content", "file_size")


@query("A8_import_report", with_tables("", """SELECT (SELECT count(*) FROM ok) AS success_count, (SELECT count(*) FROM bad) AS failed_count,
    'Đã nhập thành công ' || (SELECT count(*) FROM ok) || '/' || ((SELECT count(*) FROM ok) + (SELECT count(*) FROM bad)) || ' tài liệu.' AS message""",
    files=FILES, ok=IMPORTED, bad=FAILED))
def import_report(m):
    return ingest.import_report(*ingest.import_files(inbox(m), 1, as_of()))


@query("A8_import_items", with_tables("", f"""SELECT 'imported' AS outcome, lang || ' doc ' || doc_id AS entry FROM ok
    UNION ALL SELECT 'failed', regexp_extract(path, '([^/]*)$', 1) || {quoted(fixed.IMPORT_FAILED.replace('%s', ''))} FROM bad""",
    files=FILES, ok=IMPORTED, bad=FAILED))
def import_items(m):
    return ingest.import_items(*ingest.import_files(inbox(m), 1, as_of()))


@query("S3_ingest_text", f"""SELECT conv_id, turn, CASE WHEN role = 'user' THEN {quoted(fixed.PASTED_TITLE + '20240501_1000')} ELSE role END AS title,
    octet_length(encode(text))::bigint AS file_size, {quoted(fixed.PASTED_FILE)} AS original_file_name, '' AS file_path
    FROM conversations WHERE regexp_matches(text, '\\S')""")
def ingest_text(m):
    rows = m.raw("conversations").withColumns({"title": F.when(F.col("role") == "user", "  ").otherwise(F.col("role"))})
    docs = ingest.pasted_documents(rows.withColumnRenamed("text", "content"), as_of())
    folder = fresh_path(m.spark, "pasted")
    ingest.append_documents(docs, folder)
    return m.spark.read.parquet(folder).select("conv_id", "turn", "title", "file_size", "original_file_name", "file_path")


def draw(what: str, n: int) -> str:
    return f"(('0x' || substr(md5('42:' || doc_id || ':{what}'), 1, 8))::bigint % {n})"


@query("S6_generate_corpus", f"""SELECT doc_id AS id,
    array_to_string(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[1:5], ' ') AS title, text AS content,
    CASE WHEN doc_id % 3 = 0 THEN 'Thesis' ELSE 'Essay' END AS document_type, octet_length(encode(text))::bigint AS file_size,
    'HK' || ({draw('term', 2)} + 1) || '-2024' AS semester,
    TIMESTAMP '{AS_OF}' - to_days(CAST({draw('age', 29)} + 1 AS int)) AS upload_date
    FROM documents WHERE regexp_matches(text, '\\S')""")
def generate_corpus(m):
    """Catalog rows for the given texts."""
    rows = m.raw("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return ingest.derived_documents(rows, 42, as_of()).drop("year", "is_public")
