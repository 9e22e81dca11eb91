"""Bands, display classes and other one-row rules of the reports."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import fixed

_TESTS = {">": operator.gt, ">=": operator.ge}


def risk_band(score: Column, scale: str, bands: dict = fixed.BANDS) -> Column:
    """Label of the first step of the scale that the score reaches."""
    *steps, (_, _, lowest) = bands[scale]
    result = None
    for test, threshold, label in steps:
        reached = _TESTS[test](score, F.lit(threshold))
        result = (F.when if result is None else result.when)(reached, F.lit(label))
    return result.otherwise(F.lit(lowest))


def highlight(score: Column, is_excluded: Column) -> Column:
    """Display class of a segment: excluded is grey, a relevant score shows its severity."""
    return (
        F.when(is_excluded, F.lit("excluded"))
        .when(
            score > fixed.HIGHLIGHT_MIN_SCORE,
            F.concat(F.lit("highlight-"), risk_band(score, "segment")),
        )
        .otherwise(F.lit("plain"))
    )


def remaining_checks(limit: Column, used: Column) -> Column:
    return limit - used
