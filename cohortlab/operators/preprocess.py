"""Standardising and one-hot encoding, fitted on the train side only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.operators.clean import assign_cohort, dedup_rows, drop_sentinel, nan_to_null, normalize_columns, with_content_key
from cohortlab.operators.sampling import stratified_split
from cohortlab.session import stage
from cohortlab.sources.tables import require_columns
from cohortlab.spec import TableSpec


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per column; small enough to be literals."""

    mean: Mapping[str, float]
    std: Mapping[str, float]

    def cutoffs(self, column: str, raw: Sequence[float]) -> tuple[float, ...]:
        """Raw cut-offs in standardised units."""
        return tuple((c - self.mean[column]) / self.std[column] for c in raw)


def scaler_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: mean and population deviation, 1 for a constant.

    MLlib's scaler divides by the sample deviation, a different number.
    """
    aggs = [a for c in columns for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]
    one = df.agg(*aggs)
    entries = F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"m_{c}").alias("mean"),
            F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")).alias("std"),
        )
        for c in columns
    ])
    return one.select(F.inline(entries))


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> Scaler:
    rows = scaler_table(df, columns).collect()
    if any(r["mean"] is None for r in rows):
        raise ValueError("cannot fit a scaler on a column without values")
    return Scaler({r["column"]: r["mean"] for r in rows}, {r["column"]: r["std"] for r in rows})


def apply_scaler(df: DataFrame, scaler: Scaler) -> DataFrame:
    return df.withColumns({
        c: (F.col(c) - F.lit(scaler.mean[c])) / F.lit(scaler.std[c]) for c in scaler.mean
    })


def one_hot(df: DataFrame, categories: Mapping[str, Sequence[int]]) -> DataFrame:
    """A 0/1 column per listed category but the first; unknown and NULL give zeros."""
    dummies = {
        f"{c}_{k}": F.when(F.col(c) == k, 1.0).otherwise(0.0)
        for c, ks in categories.items()
        for k in ks[1:]
    }
    return df.withColumns(dummies).drop(*categories) if dummies else df


def assemble(df: DataFrame, spec: TableSpec, keep: Sequence[str] = ()) -> DataFrame:
    """Key, numerics, dummies, binaries, label in that order; features as doubles."""
    features = [F.col(c).cast("double").alias(c) for c in spec.features]
    return df.select(spec.row_id, *features, F.col(spec.label).cast("int").alias(spec.label), *keep)


def transform(df: DataFrame, spec: TableSpec, scaler: Scaler) -> DataFrame:
    """Raw rows to processed rows; the cohort comes from the raw value."""
    named = assign_cohort(df, spec.cohort_by, spec.cutoffs, spec.cohorts, spec.cohort)
    encoded = one_hot(apply_scaler(named, scaler), spec.categorical)
    return assemble(encoded, spec, keep=[spec.cohort])


def clean(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Distinct rows (over every column given) without the sentinel."""
    kept = nan_to_null(require_columns(df, [spec.row_id, *spec.raw_columns]))
    if spec.sentinel:
        kept = drop_sentinel(kept, *spec.sentinel)  # before the shuffle: same rows, less to move
    return dedup_rows(kept, spec.row_id)


def clean_raw(df: DataFrame, spec: TableSpec) -> DataFrame:
    """``clean`` for a raw file: headers are normalised, and a table without a key gets one from its content."""
    named = normalize_columns(df)
    if spec.row_id not in named.columns:
        named = with_content_key(dedup_rows(named), spec.row_id)
    return clean(named, spec)


@dataclass(frozen=True)
class Prepared:
    train: DataFrame
    test: DataFrame
    train_raw: DataFrame
    test_raw: DataFrame
    scaler: Scaler
    cutoffs: tuple[float, ...]


def prepare(df: DataFrame, spec: TableSpec, test_size: float = 0.3, seed: int = 42) -> Prepared:
    """Clean, split exactly, fit on the train side, transform both sides.

    The cleaned table is staged once: it is the only shuffle, and split,
    scaler and both outputs read it.
    """
    cleaned = stage(clean(df, spec), "cleaned")
    train_raw, test_raw = stratified_split(cleaned, spec.row_id, spec.label, test_size, seed)
    scaler = fit_scaler(train_raw, spec.numeric)
    return Prepared(
        train=transform(train_raw, spec, scaler),
        test=transform(test_raw, spec, scaler),
        train_raw=train_raw,
        test_raw=test_raw,
        scaler=scaler,
        cutoffs=scaler.cutoffs(spec.cohort_by, spec.cutoffs),
    )
