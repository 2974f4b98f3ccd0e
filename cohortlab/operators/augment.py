"""Resizing a processed table to an exact number of rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.functions.cohorts import cohort_of
from cohortlab.functions.keyed import pick, uniform
from cohortlab.operators.allocate import largest_remainder
from cohortlab.operators.sampling import downsample, number_rows
from cohortlab.session import stage
from cohortlab.sources.tables import require_columns
from cohortlab.spec import TableSpec

LABELS = (0, 1)


def by_position(position: Column, values: Sequence) -> Column:
    """The literal at ``position`` of a short list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), position + 1)


def position_of(number: Column, sizes: Sequence[int]) -> Column:
    """Which consecutive range of the given sizes a running number falls into."""
    ends = list(accumulate(sizes))
    first = F.when(number < ends[0], 0)
    return reduce(lambda c, i: c.when(number < ends[i], i), range(1, len(ends)), first).cast("int")


def mix_features(
    a: Column, b: Column, weight: Column, seed: int, stream: str, slot: Column, continuous: Sequence[str],
    binary: Sequence[str], groups: Sequence[Sequence[str]],
) -> dict[str, Column]:
    """A row between two parents: numbers interpolate, a binary takes either
    parent's value, a dummy group is taken as a block from one parent."""
    mixed = {c: a[c] + weight * (b[c] - a[c]) for c in continuous}
    for c in binary:
        mixed[c] = F.when(uniform(seed, f"{stream}-{c}", slot) < 0.5, a[c]).otherwise(b[c])
    for names in groups:
        from_a = uniform(seed, f"{stream}-{names[0]}", slot) < 0.5
        mixed |= {c: F.when(from_a, a[c]).otherwise(b[c]) for c in names}
    return mixed


def new_key(kind: T.DataType, largest, slot: Column) -> Column:
    """Keys for made-up rows: above the largest number, or marked text."""
    if isinstance(kind, T.IntegralType):
        return (F.lit(largest) + 1 + slot).cast(kind)
    return F.concat(F.lit("synthetic-"), slot.cast("string"))


def resize(
    df: DataFrame, spec: TableSpec, total: int, bounds: Sequence[float] | None, seed: int = 42
) -> DataFrame:
    """Exactly ``total`` rows: the input, none of it, fewer of it, or it plus
    interpolated rows. ``bounds`` are the cohort cut-offs in the table's units."""
    if total < 0:
        raise ValueError("total must not be negative")
    if bounds is None:
        raise ValueError("cohort bounds of the train-fitted scaler are required")
    require_columns(df, [spec.row_id, *spec.features, spec.label])
    if total == 0:
        return df.limit(0)
    table = df.withColumn("_cohort", cohort_of(F.col(spec.cohort_by), bounds, spec.cohorts))
    order = [(label, cohort) for label in LABELS for cohort in spec.cohorts]
    extent = F.col(spec.cohort_by)
    stats = (
        table.groupBy(spec.label, "_cohort")
        .agg(F.count("*").alias("n"), F.min(extent).alias("lo"), F.max(extent).alias("hi"),
             F.max(spec.row_id).alias("last"))
        .collect()
    )
    rows = sum(r["n"] for r in stats)
    if total == rows:
        return df
    if total < rows:
        return downsample(table, spec.row_id, [spec.label, "_cohort"], order, total, seed).drop("_cohort")
    return _augment(df, table, spec, order, stats, rows, total, bounds, seed)


def _augment(df, table, spec, order, stats, rows, total, bounds, seed) -> DataFrame:
    counts = {(r[spec.label], r["_cohort"]): r["n"] for r in stats}
    weights = [counts.get(g, 0) for g in order]
    quotas = largest_remainder(weights, total - rows)

    # A stratum with a single row borrows parents from its whole label.
    label_rows = {label: sum(n for (l, _), n in counts.items() if l == label) for label in LABELS}
    wide = [n < 2 for n in weights]
    for (label, cohort), quota in zip(order, quotas):
        if quota and not label_rows[label]:
            raise ValueError(f"no parent rows for label {label}, cohort {cohort}")
    pools = [f"{label}/*" if w else f"{label}/{cohort}" for (label, cohort), w in zip(order, wide)]
    sizes = [label_rows[label] if w else n for (label, _), w, n in zip(order, wide, weights)]
    used = {p: n for p, n, q in zip(pools, sizes, quotas) if q}
    starts = dict(zip(used, accumulate([0, *used.values()])))

    low = min(r["lo"] for r in stats if r["lo"] is not None)
    high = max(r["hi"] for r in stats if r["hi"] is not None)
    spans = dict(zip(spec.cohorts, [(low, bounds[0]), (bounds[0], bounds[1]), (bounds[1], high)]))
    for (_, cohort), quota in zip(order, quotas):
        if quota and spans[cohort][0] > spans[cohort][1]:
            raise ValueError(f"no room to draw {spec.cohort_by} for cohort {cohort}")

    pool = F.concat_ws("/", F.col(spec.label).cast("string"), F.col("_cohort"))
    narrow = table.withColumn("_pool", pool)
    parents = narrow.filter(F.col("_pool").isin(list(used)))
    if any(p.endswith("/*") for p in used):
        whole = narrow.withColumn("_pool", F.concat(F.col(spec.label).cast("string"), F.lit("/*")))
        parents = parents.unionByName(whole.filter(F.col("_pool").isin(list(used))))
    features = [F.col(c) for c in spec.features]
    numbered = stage(  # read once per parent
        number_rows(parents, spec.row_id, "_pool", starts, seed, "parent").select("number", F.struct(*features).alias("p")),
        "parents",
    )

    drawn_at = df.sparkSession.range(total - rows).withColumn("g", position_of(F.col("id"), quotas))
    size, start = by_position(F.col("g"), sizes), by_position(F.col("g"), [starts.get(p, 0) for p in pools])
    slots = drawn_at.select(
        "id", "g",
        (start + pick(seed, "parent-a", size, "id")).alias("na"),
        (start + pick(seed, "parent-b", size, "id")).alias("nb"),
    )
    paired = slots.join(numbered.toDF("na", "a"), "na").join(numbered.toDF("nb", "b"), "nb")

    slot, at = F.col("id"), F.col("g")
    drawn = [spans[cohort] for _, cohort in order]
    lo, hi = by_position(at, [s[0] for s in drawn]), by_position(at, [s[1] for s in drawn])
    mixed = mix_features(
        F.col("a"), F.col("b"), uniform(seed, "alpha", slot), seed, "mix", slot,
        [c for c in spec.numeric if c != spec.cohort_by], spec.binary, list(spec.dummy_groups.values()),
    )
    mixed[spec.cohort_by] = lo + uniform(seed, "extent", slot) * (hi - lo)
    mixed[spec.label] = by_position(at, [label for label, _ in order])
    if spec.cohort in df.columns:
        mixed[spec.cohort] = by_position(at, [cohort for _, cohort in order])
    mixed[spec.row_id] = new_key(df.schema[spec.row_id].dataType, _last(stats), slot)
    kinds = {f.name: f.dataType for f in df.schema}
    made = paired.select(*[mixed[c].cast(kinds[c]).alias(c) for c in df.columns])
    return df.unionByName(made)


def _last(stats):
    return max(r["last"] for r in stats)
