"""Collapse exact copies, and bounded rankings that keep a hot group out of one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_key(clean: Column) -> Column:
    """128-bit key of a text, 16 bytes."""
    return F.unhex(F.md5(clean))


def numbered(texts: DataFrame) -> DataFrame:
    """Adds ``nid``, a short number that stands for ``lid`` in joins.  To be staged at once: another
    run of the plan may deal the numbers anew."""
    return texts.withColumn("nid", F.monotonically_increasing_id())


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows per key.

    The rank filter lets Spark keep only ``k`` rows per key and task before the shuffle
    (WindowGroupLimit), so a key with a third of all rows sends a handful of them.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def collapse_copies(rows: DataFrame, key: str, member: str, k: int) -> tuple[DataFrame, DataFrame]:
    """``(units, members)`` of groups with equal ``key``.

    ``members`` keeps the ``k`` lowest ``member`` values of each group, ``units`` the lowest one.
    Copies have equal scores everywhere, so the best ``k`` documents of any segment are among the
    first ``k`` members of its best ``k`` units.
    """
    members = top_rows(rows.select(key, member), [key], [F.col(member)], k)
    units = rows.groupBy(key).agg(F.min(member).alias("rid"))
    return units, members
