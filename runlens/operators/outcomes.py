"""Three-state outcomes: pass, fail, unknown.

A published score or a re-execution is a nullable flag; null is *unknown*, not a failure.
Every rate is taken over the rows whose outcome is known and stands beside its coverage (the
share of rows it speaks for), and a pair of outcomes of one item is a transition between two
of the three states.  All of it is conditional aggregation: one pass, combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PASS, FAIL, UNKNOWN = "pass", "fail", "unknown"
STATES = (PASS, FAIL, UNKNOWN)


def from_score(score: str | Column) -> Column:
    """1.0 is a pass, any other score a fail, a missing (or NaN) score unknown."""
    s = F.col(score) if isinstance(score, str) else score
    s = s.cast("double")
    return F.when(s.isNotNull() & ~F.isnan(s), s == 1.0)


def state(flag: Column) -> Column:
    """Name of the state of a nullable flag."""
    return F.when(flag, F.lit(PASS)).when(~flag, F.lit(FAIL)).otherwise(F.lit(UNKNOWN))


def known(flag: Column) -> Column:
    """Number of rows with a known outcome."""
    return F.count(flag)


def rate(flag: Column) -> Column:
    """Passes in percent of the known outcomes; null when none is known."""
    return F.when(F.count(flag) > 0, F.lit(100.0) * F.count_if(flag) / F.count(flag))


def coverage(flag: Column) -> Column:
    """Known outcomes as a share of all rows."""
    return F.count(flag).cast("double") / F.count(F.lit(1))


def moved(before: Column, after: Column, start: str, end: str) -> Column:
    """Number of rows that go from one state to another."""
    return F.count_if((state(before) == start) & (state(after) == end))


def transition_counts(before: Column, after: Column) -> list[Column]:
    """All nine transitions as columns ``<start>_to_<end>``; they add up to the rows."""
    return [moved(before, after, a, b).alias(f"{a}_to_{b}") for a in STATES for b in STATES]
