"""Batches of changes applied to whole tables; each returns the new version of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import fixed
from palimpsest.scratch import stage

DOCUMENT_FIELDS = ["title", "document_type", "subject_id", "semester", "year", "is_public", "is_active"]
USER_FIELDS = ["full_name", "email", "phone_number", "faculty_id", "department_id", "is_active"]


REPEATED = "a change batch names the id %s more than once, and no sequence tells which change is last"


def last_changes(changes: DataFrame, fields: list[str], seq: str | None = None) -> DataFrame:
    """``id, _<field>..., _new, _times``: one row per id, the last change in order of ``seq``.

    Equal sequence numbers are decided by the change itself (the larger one), so the result doesn't depend
    on the order of rows.  Without ``seq`` an id may stand there once; a second one ends the job.  Only one
    change an id and task is shuffled, and the join by ``id`` that follows needs no further shuffle.
    """
    rows = changes.filter("id IS NOT NULL")
    order = [F.col(seq)] if seq is not None else []
    last = F.max(F.struct(*order, F.struct(F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in fields]).alias("row")))
    grouped = rows.groupBy("id").agg(last.alias("last"), F.count("*").alias("_times"))
    row = F.col("last.row")
    if seq is None:
        told = F.raise_error(F.format_string(REPEATED, F.col("id").cast("string"))).cast(grouped.select(row).schema[0].dataType)
        row = F.when(F.col("_times") > 1, told).otherwise(row)
    return grouped.select("id", row.alias("row"), "_times").select("id", "row.*", "_times")


def upsert_dim(base: DataFrame, changes: DataFrame, as_of: Column, seq: str | None = None) -> DataFrame:
    """Create or update by ``id``.  An update overwrites every field the change lists, also with
    null, and stamps ``updated_date``; a create is active and stamps ``created_date``.

    A batch that names an id several times needs ``seq``, the column that orders its changes: what
    counts is the last one.  Of an id that is new the first change creates, the others update it."""
    stamps = ("created_date", "updated_date")
    fields = [c for c in changes.columns if c not in ("id", seq) and c not in stamps]
    new = last_changes(changes, fields, seq)
    old = base.withColumn("_old", F.lit(True))
    joined = old.join(new, "id", "full_outer")
    is_new, is_old = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    is_update = is_new & (is_old | (F.col("_times") > 1))
    out = []
    for column in base.columns:
        if column == "created_date":
            value = F.when(is_old, F.col(column)).otherwise(as_of)
        elif column == "updated_date":
            value = F.when(is_update, as_of).otherwise(F.col(column))
        elif column == "is_active" and column in fields:
            value = F.when(is_update, F.col("_is_active")).when(is_new, F.lit(True)).otherwise(F.col(column))
        elif column == "is_active":
            value = F.coalesce(F.col(column), F.lit(True))
        elif column in fields:
            value = F.when(is_new, F.col(f"_{column}")).otherwise(F.col(column))
        else:
            value = F.col(column)
        out.append(value.alias(column))
    return joined.select(*out)


def update_fields(base: DataFrame, changes: DataFrame, fields: list[str], seq: str | None = None) -> DataFrame:
    """Overwrite ``fields`` of the rows named in ``changes``; unknown ids change nothing.

    Of several changes of one id the last in order of ``seq`` counts, as for ``upsert_dim``."""
    new = last_changes(changes, fields, seq)
    joined = base.join(new, "id", "left")
    return joined.select(
        *[
            F.when(F.col("_new").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
            if c in fields else F.col(c)
            for c in base.columns
        ]
    )


def update_documents(docs: DataFrame, changes: DataFrame, seq: str | None = None) -> DataFrame:
    return update_fields(docs, changes, [c for c in DOCUMENT_FIELDS if c in changes.columns], seq)


def update_users(users: DataFrame, changes: DataFrame, seq: str | None = None) -> DataFrame:
    return update_fields(users, changes, [c for c in USER_FIELDS if c in changes.columns], seq)


def soft_delete(base: DataFrame, keys: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Set the named rows inactive; with ``as_of`` their ``updated_date`` too."""
    marks = keys.select("id").distinct().withColumn("_hit", F.lit(True))
    hit = F.col("_hit").isNotNull()
    rows = base.join(marks, "id", "left").withColumn("is_active", F.when(hit, F.lit(False)).otherwise(F.col("is_active")))
    if as_of is not None:
        rows = rows.withColumn("updated_date", F.when(hit, as_of).otherwise(F.col("updated_date")))
    return rows.drop("_hit")


def merge_users(users: DataFrame, batch: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Apply account creations in order of ``seq``; returns ``(users, outcomes)``.

    Names and mails are compared without case.  A hit on an active user rejects the row, the name
    first; a hit on an inactive one (the mail's before the name's) takes that row over and makes it
    active, keeping its id; otherwise a user is added with the id ``max(id) + 1 + seq``.
    ``outcomes(seq, outcome, user_id, reason)``.

    Rows of one batch can depend on each other.  A round decides at once all rows whose names and
    mails no earlier open row touches.  Rows that hit an active name need no order, since nothing
    here makes a user inactive; a name asked for very often is settled in two rounds.
    """
    fields = [c for c in batch.columns if c not in ("seq",) and c in users.columns]
    start = users.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"] + 1
    current, open_rows, outcomes = users, stage(batch, "user-batch"), None
    while True:
        judged = stage(_judge(current, open_rows), "user-judged")
        rejected = judged.filter("name_taken")
        losing = judged.filter("NOT name_taken AND mail_taken")
        waiting = judged.filter("NOT name_taken AND NOT mail_taken")
        first = stage(_first_per_key(waiting), "user-first")
        held_up = first.filter("seq <> first_seq").select("seq").distinct()
        ready = stage(waiting.join(held_up, "seq", "left_anti"), "user-ready")
        # The mail alone rejects these, but an earlier open row may still take the name first.
        by_name = first.select(F.col("k").alias("_name_key"), "first_seq").distinct()
        losing = losing.withColumn("_name_key", F.concat(F.lit("u:"), F.col("_by_name"))).join(
            by_name, "_name_key", "left"
        )
        told = losing.filter("first_seq IS NULL OR first_seq > seq").select(*judged.columns)
        done = rejected.select("seq", F.lit(fixed.USERNAME_TAKEN).alias("reason")).unionByName(
            told.select("seq", F.lit(fixed.EMAIL_TAKEN).alias("reason"))
        )
        decided = done.select(
            "seq", F.lit("rejected").alias("outcome"), F.lit(None).cast("long").alias("user_id"), "reason"
        ).unionByName(
            ready.select(
                "seq",
                F.when(F.col("target").isNull(), "inserted").otherwise("reactivated").alias("outcome"),
                F.coalesce(F.col("target").cast("long"), F.col("seq") + start).alias("user_id"),
                F.lit(None).cast("string").alias("reason"),
            )
        )
        outcomes = stage(decided if outcomes is None else outcomes.unionByName(decided), "user-outcomes")
        current = stage(_apply(current, ready, fields, start, as_of), "users")
        open_rows = stage(
            open_rows.join(decided.select("seq"), "seq", "left_anti").select(*batch.columns), "user-open"
        )
        if open_rows.isEmpty():
            return current, outcomes


def _judge(users: DataFrame, rows: DataFrame) -> DataFrame:
    def side(column: str, prefix: str) -> DataFrame:
        # Of several users with the same lower-cased name the lowest id counts.
        hit = F.min(F.struct("id", "is_active", F.lower("username").alias("u"), F.lower("email").alias("e")))
        return users.groupBy(F.lower(column).alias(f"_{prefix}")).agg(hit.alias(prefix))

    keyed = rows.withColumns({"_by_name": F.lower("username"), "_by_mail": F.lower("email")})
    joined = keyed.join(side("username", "by_name"), "_by_name", "left").join(
        side("email", "by_mail"), "_by_mail", "left"
    )
    return joined.withColumns(
        {
            "name_taken": F.coalesce("by_name.is_active", F.lit(False)),
            "mail_taken": F.coalesce("by_mail.is_active", F.lit(False)),
            "target": F.coalesce(F.col("by_mail.id"), F.col("by_name.id")),
        }
    )


def _first_per_key(waiting: DataFrame) -> DataFrame:
    """``k, seq, first_seq``: the names and mails a row touches, and the first open row doing so."""
    touched = F.array_distinct(
        F.filter(
            F.array(
                F.concat(F.lit("u:"), F.col("_by_name")), F.concat(F.lit("e:"), F.col("_by_mail")),
                F.concat(F.lit("u:"), F.col("by_name.u")), F.concat(F.lit("e:"), F.col("by_name.e")),
                F.concat(F.lit("u:"), F.col("by_mail.u")), F.concat(F.lit("e:"), F.col("by_mail.e")),
            ),
            lambda k: k.isNotNull(),
        )
    )
    keys = waiting.select("seq", F.explode(touched).alias("k"))
    first = keys.groupBy("k").agg(F.min("seq").alias("first_seq"))
    return keys.join(first, "k")


def _apply(users: DataFrame, ready: DataFrame, fields: list[str], start: int, as_of: Column) -> DataFrame:
    stamped = "created_date" in users.columns
    new = ready.filter("target is not null").select(
        F.col("target").alias("id"), *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_new")
    )
    hit = F.col("_new").isNotNull()
    columns = []
    for column in users.columns:
        if column in fields:
            value = F.when(hit, F.col(f"_{column}")).otherwise(F.col(column))
        elif column == "is_active":
            value = F.when(hit, F.lit(True)).otherwise(F.col(column))
        elif column == "created_date":
            value = F.when(hit, as_of).otherwise(F.col(column))
        else:
            value = F.col(column)
        columns.append(value.alias(column))
    kept = users.join(new, "id", "left").select(*columns)
    added = ready.filter("target is null").select(
        (F.col("seq") + start).cast(users.schema["id"].dataType).alias("id"),
        *fields,
        F.lit(True).alias("is_active"),
        *([as_of.alias("created_date")] if stamped else []),
    )
    return kept.unionByName(added, allowMissingColumns=True)
