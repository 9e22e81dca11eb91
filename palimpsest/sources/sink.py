"""Store check results, once for each key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.scratch import stage


def stored(spark, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def append_new(rows: DataFrame, path: str, keys: Sequence[str], period: Column) -> None:
    """Append the rows whose ``keys`` are not stored yet, partitioned by ``period``.

    A key's period never changes, so only the stored keys of the periods at hand are read.  Rows that share
    a key are stored together.  Only the keys are compared with what is stored, the whole rows meet no more
    than the keys found new; a batch that brings none writes nothing.  The rebalance step gathers a period's rows, so that it is not written as
    one small file per task, and splits a period that holds most of them.
    """
    spark = rows.sparkSession
    placed = rows.withColumn("period", period)
    if stored(spark, path):
        asked = stage(placed.select(*keys, "period"), "sink-keys")
        periods = [r["period"] for r in asked.select("period").distinct().collect()]  # of one batch: few
        # With the schema, as an earlier batch without rows may have left the folder without files.
        known = spark.read.schema(placed.schema).parquet(path).filter(F.col("period").isin(periods)).select(*keys)
        new = stage(asked.select(*keys).join(known, list(keys), "left_anti").distinct(), "sink-new")
        if new.isEmpty():
            return
        same = reduce(Column.__and__, [placed[key].eqNullSafe(new[key]) for key in keys])
        placed = placed.join(new, same, "left_semi")
    placed.hint("rebalance", "period").write.mode("append").partitionBy("period").parquet(path)


def write_results(
    checks: DataFrame, matches: DataFrame, folder: str, check_date: Column, grain: str = "month", key: str = "id",
) -> None:
    """Check and match rows under ``folder``, partitioned by the date of the check.

    Written twice, they stand there once: checks are known by ``key``, which is unique, matches by
    ``check_id, pos``.
    Matches come first.  If the job ends between the two, they belong to no stored check; readers
    start from the checks (``read_checks``, ``read_matches``), and the repeated job adds what is missing.
    """
    period = F.to_date(F.date_trunc(grain, check_date))
    append_new(matches, f"{folder}/matches", ["check_id", "pos"], period)
    append_new(checks.dropDuplicates([key]), f"{folder}/checks", [key], period)


def read_checks(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/checks")


def read_matches(spark, folder: str, key: str = "id") -> DataFrame:
    """The matches of stored checks."""
    known = read_checks(spark, folder).select(F.col(key).alias("check_id"), "period")
    return spark.read.parquet(f"{folder}/matches").join(known, ["check_id", "period"], "left_semi")
