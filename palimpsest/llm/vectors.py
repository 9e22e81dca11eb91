"""Vector columns as matrices, for work inside Spark tasks.

Vectors travel as binary little-endian floats of the width they had (4 bytes for ``array<float>``, else
8), so that a shuffle moves no more than the table holds; all arithmetic is in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

ROWS = 4096  # rows of a matrix at once


def width(df: DataFrame, vector: str) -> int:
    """Bytes of a component."""
    return 4 if isinstance(df.schema[vector].dataType.elementType, FloatType) else 8


def sound(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which vectors are neither null nor hold a null or non-finite component; all components; offsets."""
    values = column.values
    whole = np.asarray(pc.fill_null(values, float("nan"))) if values.null_count else values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(whole))])
    good = column.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]])
    return good, whole, offsets


def encoded(found: Iterator[pa.RecordBatch], kind: str, zeros: bool) -> Iterator[pa.RecordBatch]:
    for batch in found:
        column = batch.column("vector")
        good, whole, offsets = sound(column)
        if not zeros:
            some = np.concatenate([[0], np.cumsum(whole != 0)])
            good &= some[offsets[1:]] > some[offsets[:-1]]
        at = np.flatnonzero(good)
        whole = np.ascontiguousarray(whole, kind)
        bodies = [whole[a:b].tobytes() for a, b in zip(offsets[at].tolist(), offsets[at + 1].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id").take(pa.array(at)), pa.array((offsets[at + 1] - offsets[at]).astype(np.int32)),
             pa.array(bodies, pa.binary())], names=["vec_id", "dim", "body"])


def clean(df: DataFrame, vec_id: str, vector: str, zeros: bool = True) -> DataFrame:
    """``vec_id bigint, dim int, body binary`` of the rows whose vector is whole: not null, not empty, and
    without null or non-finite components; without ``zeros`` also not zero throughout."""
    kind = "<f4" if width(df, vector) == 4 else "<f8"
    element = "float" if kind == "<f4" else "double"
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast(f"array<{element}>").alias("vector"))
    return rows.mapInArrow(lambda found: encoded(found, kind, zeros), "vec_id bigint, dim int, body binary").filter("dim > 0")


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Bodies of one length as rows of doubles."""
    if not len(column):
        return np.zeros((0, 0))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)


def pieces(found: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in found:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
