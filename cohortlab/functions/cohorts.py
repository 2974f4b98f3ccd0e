"""Cohort expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlab.spec import UNKNOWN


def cohort_of(value: Column, cutoffs: Sequence[float], names: Sequence[str]) -> Column:
    """Below the first cut-off, up to and including the second, above it.

    NULL and NaN belong to no cohort; Spark sorts NaN above every number, so
    it is turned into NULL first.
    """
    low, high = (F.lit(float(c)) for c in cutoffs)
    v = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    return (
        F.when(v < low, names[0])
        .when(v <= high, names[1])
        .when(v > high, names[2])
        .otherwise(UNKNOWN)
    )
