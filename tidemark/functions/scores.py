"""Scores, labels and the lock profile type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds and thresholds of published scores.
SCORE_MIN = 0.001
SCORE_MAX = 0.998
PASS_SCORE = 0.9
LOW_SCORE = 0.1
COMPLETE_MATCH = 0.999
DONE_TOLERANCE = 1e-9
FAILURE_COST = 0.05

# Feedback texts.
FAIL_INTEGRITY = "FAIL: Data integrity compromised. Rows dropped or corrupted."
PASS_PERFECT = "PASS: Perfect zero-downtime migration achieved."
PARTIAL_AVAILABILITY = "PARTIAL: Schema is correct, but availability dropped during migration."
PARTIAL_SCHEMA = "PARTIAL: Schema migration is incomplete."
DIRECT_PASS = "PASS: Grader returned a strong bounded score."
DIRECT_LOW = "PARTIAL: Grader returned a bounded fallback score."
DIRECT_MID = "PARTIAL: Grader returned a bounded score."


def bounded(col: Column) -> Column:
    """Clamp a score to its public range and round it to three digits."""
    return F.round(F.least(F.greatest(col.cast("double"), F.lit(SCORE_MIN)), F.lit(SCORE_MAX)), 3)


def unit(col: Column) -> Column:
    """Clamp to [0, 1]."""
    return F.least(F.greatest(col, F.lit(0.0)), F.lit(1.0))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 0 when there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def feedback(match: Column, availability: Column, integrity: Column) -> Column:
    """Verdict on a migration from its raw measures."""
    complete = match >= COMPLETE_MATCH
    return (
        F.when(integrity == 0, FAIL_INTEGRITY)
        .when(complete & (availability >= PASS_SCORE), PASS_PERFECT)
        .when(complete, PARTIAL_AVAILABILITY)
        .otherwise(PARTIAL_SCHEMA)
    )


def direct_feedback(score: Column) -> Column:
    """Verdict on a score that was graded on its own."""
    return (
        F.when(score >= PASS_SCORE, DIRECT_PASS).when(score <= LOW_SCORE, DIRECT_LOW).otherwise(DIRECT_MID)
    )
