"""Run a registered query and its SQL on the same tables and compare the results."""

from __future__ import annotations

import math
import os
import time
from collections import Counter
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf_dir: str):
    db = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v if os.environ.get("COMPARE_BITS") else round(v, 9)
    return v


def rows_of(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return names, Counter(tuple(value(v) for v in row) for row in zip(*columns))


def kinds(table):
    return {f.name: str(f.type).replace("large_", "").split("[")[0] for f in table.schema}


def compare(spark, db, name, build, sql, sf_dir):
    """Returns ``(problems, rows, seconds in Spark, seconds in SQL)``."""
    start = time.time()
    ours = build(spark, sf_dir).toArrow()
    middle = time.time()
    theirs = db.sql(sql).to_arrow_table()
    end = time.time()
    problems = []
    names, left = rows_of(ours)
    other, right = rows_of(theirs)
    if names != other:
        problems.append(f"columns {names} / {other}")
    elif left != right:
        problems.append(
            f"rows {sum(left.values())} / {sum(right.values())}: {list((left - right).items())[:3]}"
            f" / {list((right - left).items())[:3]}"
        )
    if kinds(ours) != kinds(theirs):
        a, b = kinds(ours), kinds(theirs)
        problems.append(f"types { {k: (a[k], b.get(k)) for k in a if a[k] != b.get(k)} }")
    return problems, ours.num_rows, middle - start, end - middle
