"""Staging of intermediate tables in the shared folder of the session.

A staged table is written once as parquet and read back, so that later branches
of a job neither repeat the text work nor depend on blocks of executors that may
be gone.  The folder is the one the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_blocks = threading.local()


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="palimpsest-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, lasting: bool = False, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of the written table.

    A ``lasting`` table outlives the ``staging`` block it was first asked for in.
    """
    path = fresh_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    (writer.option("compression", codec) if codec else writer).parquet(path)
    for made in [] if lasting else getattr(_blocks, "open", []):
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_packed(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """As ``stage``, for jobs of many large tables: packed closer, and the shuffle files behind the table
    go once it is written instead of when the driver next collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return stage(df, name, lasting, "zstd")
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Remove the tables staged inside the block when it ends.

    For work that writes its result within the block, such as a micro-batch of a stream.
    """
    made: list[str] = []
    _blocks.open = [*getattr(_blocks, "open", []), made]
    try:
        yield
    finally:
        _blocks.open = _blocks.open[:-1]
        jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        for path in made:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
