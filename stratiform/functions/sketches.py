"""Distinct counts by sketches that can be stored, merged and estimated later.

A sketch has 2**LG_K registers, so at most a few kilobytes, and a standard error of 1.04 / sqrt(2**LG_K)
of the true count (1.6 % at 12); small counts are exact. Sketches kept at a fine grain answer every coarser
one without the rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LG_K = 12


def standard_error(lg_k: int = LG_K) -> float:
    """Relative standard error of an estimate."""
    return 1.04 / 2 ** (lg_k / 2)


def sketch(column: Column | str, lg_k: int = LG_K) -> Column:
    """Aggregate: the sketch of the distinct values of a column of text or whole numbers."""
    return F.hll_sketch_agg(column, F.lit(lg_k))


def merged(sketches: Column | str) -> Column:
    """Aggregate: one sketch of all the values behind stored sketches."""
    return F.hll_union_agg(sketches)


def estimate(stored: Column | str) -> Column:
    """Distinct values behind a sketch; 0 for none."""
    return F.coalesce(F.hll_sketch_estimate(stored), F.lit(0).cast("bigint"))


def is_close(estimated: Column, exact: Column, deviations: float = 3.0, lg_k: int = LG_K) -> Column:
    """Whether an estimate lies within so many standard errors of the true count."""
    return F.abs(estimated - exact) <= exact * F.lit(deviations * standard_error(lg_k))
