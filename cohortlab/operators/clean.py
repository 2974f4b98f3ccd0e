"""Cleaning operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.functions.cohorts import cohort_of


def normalize_columns(df: DataFrame) -> DataFrame:
    """Lower-case names with underscores for spaces."""
    return df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])


def dedup_rows(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """One row per distinct content; of copies the smallest ``row_id`` stays.

    Both forms are hash aggregates that combine on the map side, so a third
    of the table being copies of one row shrinks to one row per map task.
    """
    if row_id is None:
        return df.dropDuplicates()
    content = [c for c in df.columns if c != row_id]
    return df.groupBy(*content).agg(F.min(row_id).alias(row_id)).select(*df.columns)


def with_content_key(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Key a table of distinct rows by a hash of their content.

    Unlike a running number it needs no global order and stays the same when
    a task is repeated.
    """
    return df.withColumn(row_id, F.md5(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})))


def drop_sentinel(df: DataFrame, column: str, value) -> DataFrame:
    """Remove rows carrying the sentinel; a missing value is not the sentinel."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(value)))


def nan_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    wanted = set(df.columns if columns is None else columns)
    doubles = [f.name for f in df.schema if f.name in wanted and isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in doubles}) if doubles else df


def feature_columns(df: DataFrame, exclude: Iterable[str]) -> list[str]:
    left_out = set(exclude)
    return [c for c in df.columns if c not in left_out]


def numeric_columns(df: DataFrame, label: str | None = None) -> list[str]:
    """Numeric columns without the label; an error when none is left."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != label]
    if not names:
        raise ValueError("no numeric columns available")
    return names


def assign_cohort(
    df: DataFrame, column: str, cutoffs: Sequence[float], names: Sequence[str], output: str = "age_group"
) -> DataFrame:
    """Works on raw and on standardised values alike; only the cut-offs differ."""
    return df.withColumn(output, cohort_of(F.col(column), cutoffs, names))


def cohort_slice(df: DataFrame, name: str, cohort: str = "age_group") -> DataFrame:
    return df.filter(F.col(cohort) == name)
