"""Correlation, counts by cohort, dataset profile, table difference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def correlation_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of the strict lower triangle, (row, column, value).

    A first pass takes the mean of each column; a second sums products of the
    centred values, one sum per pair and, only for columns with missing
    values, the moments of the rows a pair shares. A pair uses the rows where both
    are present; a constant column gives NULL (the built-in ``corr`` raises there).
    """
    values = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    names = values.columns
    first = values.agg(
        F.count("*").alias("n"), *[F.avg(v).alias(f"m{v}") for v in names], *[F.count(v).alias(f"n{v}") for v in names],
    ).first()
    mean = {v: first[f"m{v}"] or 0.0 for v in names}
    whole = {v: first[f"n{v}"] == first["n"] for v in names}
    centred = values.select(*[(F.col(v) - F.lit(mean[v])).alias(v) for v in names])
    aggs, entries = {}, []

    def add(name: str, value: Column) -> Column:
        aggs.setdefault(name, value.alias(name))
        return F.col(name)

    for i, j in ((i, j) for j in range(len(names)) for i in range(j + 1, len(names))):
        x, y = names[i], names[j]
        both = "" if whole[x] and whole[y] else f"_{x}{y}"
        shared = F.col(x).isNotNull() & F.col(y).isNotNull()
        seen = lambda v: F.when(shared, v) if both else v  # noqa: E731, B023
        n = add(f"n{both}", F.count(seen(F.lit(1))))
        xy = add(f"{x}{y}", F.sum(F.col(x) * F.col(y)))
        sx, sy = (add(f"s{v}{both}", F.sum(seen(F.col(v)))) for v in (x, y))
        xx, yy = (add(f"q{v}{both}", F.sum(seen(F.col(v) * F.col(v)))) for v in (x, y))
        spans = [add(f"lo{v}{both}", F.min(seen(F.col(v)))) < add(f"hi{v}{both}", F.max(seen(F.col(v)))) for v in (x, y)]
        part = F.sqrt(F.greatest(xx - sx * sx / n, F.lit(0.0))) * F.sqrt(F.greatest(yy - sy * sy / n, F.lit(0.0)))
        value = F.when(spans[0] & spans[1], F.try_divide(xy - sx * sy / n, part))
        entries.append(F.struct(F.lit(columns[i]).alias("row_name"), F.lit(columns[j]).alias("column_name"), value.alias("correlation")))
    return centred.agg(*aggs.values()).select(F.inline(F.array(*entries)))


def cohort_counts(df: DataFrame, cohorts: Sequence[str], cohort: str, label: str) -> DataFrame:
    """Rows per cohort and class on the full grid, in report order."""
    grid = [(i, c, k) for i, c in enumerate(cohorts) for k in (0, 1)]
    counts = df.groupBy(cohort, label).agg(F.count("*").alias("n"))
    table = df.sparkSession.createDataFrame(grid, f"position int, `{cohort}` string, `{label}` int")
    joined = table.join(counts, [cohort, label], "left")
    return joined.select("position", cohort, label, F.coalesce(F.col("n"), F.lit(0)).alias("n"))


def profile(train: DataFrame, test: DataFrame, cohorts: Sequence[str], cohort: str, label: str) -> DataFrame:
    """Rows, class counts and cohort counts of both sides."""
    sides = [s.select(F.lit(name).alias("side"), label, cohort) for name, s in (("train", train), ("test", test))]
    count = lambda test: F.count_if(test)
    return (
        sides[0].unionByName(sides[1])
        .groupBy("side")
        .agg(
            F.count("*").alias("rows"),
            *[count(F.col(label) == k).alias(f"class_{k}") for k in (0, 1)],
            *[count(F.col(cohort) == c).alias(f"cohort_{c.lower()}") for c in cohorts],
        )
    )


def frame_diff(a: DataFrame, b: DataFrame, key: str, atol: float = 1e-9) -> DataFrame:
    """Per column how many rows of ``a`` and ``b`` disagree.

    Numbers agree within ``atol``, missing equals missing, everything else
    must be equal. A key on one side only counts against every column.
    """
    if a.columns != b.columns:
        raise ValueError("columns do not match")
    columns = [c for c in a.columns if c != key]
    kinds = {f.name: f.dataType for f in a.schema}
    other = {f.name: f.dataType for f in b.schema}
    left = a.select(F.col(key), F.lit(True).alias("_a"), F.struct(*columns).alias("l"))
    right = b.select(F.col(key), F.lit(True).alias("_b"), F.struct(*columns).alias("r"))
    both = left.join(right, key, "full_outer")
    lonely = F.col("_a").isNull() | F.col("_b").isNull()

    def differs(c: str):
        x, y = F.col("l")[c], F.col("r")[c]
        if isinstance(kinds[c], T.NumericType) and isinstance(other[c], T.NumericType):
            x, y = (F.nanvl(v.cast("double"), F.lit(None).cast("double")) for v in (x, y))
            near = F.coalesce((F.abs(x - y) <= atol) | (x == y), x.isNull() & y.isNull())
            return lonely | ~near
        return lonely | ~x.eqNullSafe(y)

    flags = both.agg(*[F.count_if(differs(c)).alias(c) for c in columns])
    return flags.unpivot([], columns, "column", "mismatches")


def require_match(a: DataFrame, b: DataFrame, key: str, name: str, atol: float = 1e-9) -> None:
    bad = frame_diff(a, b, key, atol).filter("mismatches > 0").orderBy("column").collect()
    if bad:
        raise ValueError(f"{name} differs in {', '.join(r['column'] for r in bad)}")
