"""Balancing a binary table with interpolated minority rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.functions.keyed import pick, uniform
from cohortlab.operators.augment import mix_features, new_key
from cohortlab.operators.neighbors import nearest_neighbors
from cohortlab.operators.sampling import number_rows
from cohortlab.session import stage

INFO_SCHEMA = (
    "scope string, applied boolean, reason string, minority_label int, before_counts map<int,bigint>,"
    " after_counts map<int,bigint>, generated_samples bigint, k_neighbors_used int"
)


# Reasons in the results.
ONE_CLASS, BALANCED = "single_class_train_data", "already_balanced"


@dataclass(frozen=True)
class SamplingInfo:
    applied: bool
    reason: str | None
    minority_label: int | None
    before_counts: Mapping[int, int]
    after_counts: Mapping[int, int]
    generated_samples: int = 0
    k_neighbors_used: int = 0

    @classmethod
    def untouched(cls, counts: Mapping[int, int], reason: str) -> SamplingInfo:
        return cls(False, reason, None, dict(counts), dict(counts))


def class_counts(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Both classes side by side, zero when absent."""
    columns = [F.coalesce(F.sum(F.when(F.col(label) == k, 1).otherwise(0)), F.lit(0)).alias(f"class_{k}") for k in (0, 1)]
    return df.groupBy(*by).agg(*columns)


def count_map(df: DataFrame, label: str) -> dict[int, int]:
    row = class_counts(df, label).first()
    return {0: row["class_0"], 1: row["class_1"]}


def column_kinds(
    df: DataFrame, features: Sequence[str], groups: Iterable[Sequence[str]] = (), binary: Iterable[str] = ()
) -> tuple[list[str], list[str], list[list[str]]]:
    """(continuous, binary, dummy groups) of the features.

    A dummy group keeps the members that are still features. Of the rest a
    column is binary by name, or when all its values are 0 or 1; one without
    any value is continuous. All columns are tested in one aggregate.
    """
    left = [[c for c in names if c in features] for names in groups]
    left = [names for names in left if names]
    grouped, named = {c for names in left for c in names}, set(binary)
    tested = [c for c in features if c not in grouped and c not in named]
    flags = {}
    if tested:
        doubles = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in tested]
        row = df.agg(*[F.bool_and(v.isin(0.0, 1.0)).alias(c) for c, v in zip(tested, doubles)]).first()
        flags = row.asDict()
    two_valued = [c for c in features if c not in grouped and (c in named or flags.get(c))]
    taken = grouped | set(two_valued)
    return [c for c in features if c not in taken], two_valued, left


def kinds_table(df: DataFrame, features: Sequence[str], groups=(), binary=()) -> DataFrame:
    continuous, two_valued, left = column_kinds(df, features, groups, binary)
    rows = [(c, "continuous") for c in continuous] + [(c, "binary") for c in two_valued]
    rows += [(c, "group") for names in left for c in names]
    return df.sparkSession.createDataFrame(rows, "column string, kind string")


def smote(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    row_id: str,
    groups: Iterable[Sequence[str]] = (),
    binary: Iterable[str] = (),
    k: int = 5,
    seed: int = 42,
) -> tuple[DataFrame, SamplingInfo]:
    """Grow the smaller class to the size of the larger one.

    Each new row starts from a random minority row and moves towards one of
    its k nearest minority rows. Returns key, features and label only.
    """
    table = df.select(row_id, *features, label)
    info = sampling_info(table, label, k)
    if not info.applied:
        return table, info
    made = _made_rows(table, features, label, row_id, groups, binary, info, seed)
    return table.unionByName(made), info


def sampling_info(df: DataFrame, label: str, k: int = 5) -> SamplingInfo:
    """What balancing ``df`` does, or why it does nothing, from its class counts."""
    before = count_map(df, label)
    if min(before.values()) == 0:
        return SamplingInfo.untouched(before, ONE_CLASS)
    if before[0] == before[1]:
        return SamplingInfo.untouched(before, BALANCED)
    minority, larger = min(before, key=before.get), max(before.values())
    after = {0: larger, 1: larger}
    return SamplingInfo(True, None, minority, before, after, larger - before[minority], min(k, before[minority] - 1))


def _made_rows(table, features, label, row_id, groups, binary, info, seed) -> DataFrame:
    spark, kinds = table.sparkSession, {f.name: f.dataType for f in table.schema}
    last = table.agg(F.max(row_id)).first()[0] if isinstance(kinds[row_id], T.IntegralType) else None
    minority, needed, used = info.minority_label, info.generated_samples, info.k_neighbors_used
    size = info.before_counts[minority]
    members = table.filter(F.col(label) == minority)
    slots, slot = spark.range(needed), F.col("id")

    if size == 1:
        only = members.first()
        mixed = {c: F.lit(only[c]) for c in features}
        made = slots
    else:
        members = members.withColumn("_pool", F.lit("minority"))
        numbered = stage(
            number_rows(members, row_id, "_pool", {"minority": 0}, seed, "member")
            .select("number", F.col(row_id).alias("member"), F.struct(*features).alias("f")),
            "minority",
        )
        drawn = slots.select(
            "id", pick(seed, "anchor", size, "id").alias("number"),
            (pick(seed, "neighbor", used, "id") + 1).cast("int").alias("rank"),
        )
        points = numbered.select("member", "number", "f.*")
        asked = points
        if needed < size:  # otherwise nearly every member is drawn
            asked = points.join(drawn.select("number").distinct(), "number", "left_semi")
        near = nearest_neighbors(
            asked, points, features, used, "member", skip_self=True, seed=seed, carry=features
        )
        other = F.struct(*[F.get("carried", F.lit(i)).alias(c) for i, c in enumerate(features)])
        made = drawn.join(numbered.toDF("number", "query", "a"), "number").join(
            near.select("query", "rank", other.alias("b")), ["query", "rank"]
        )
        continuous, two_valued, left = column_kinds(table, features, groups, binary)
        gap = uniform(seed, "gap", slot)
        mixed = mix_features(F.col("a"), F.col("b"), gap, seed, "smote", slot, continuous, two_valued, left)
    mixed[label], mixed[row_id] = F.lit(minority), new_key(kinds[row_id], last, slot)
    return made.select(*[mixed[c].cast(kinds[c]).alias(c) for c in table.columns])


def info_table(spark: SparkSession, infos: Mapping[str, SamplingInfo]) -> DataFrame:
    """One row per scope."""
    rows = [(scope, *asdict(info).values()) for scope, info in infos.items()]
    return spark.createDataFrame(rows, INFO_SCHEMA)


def sum_sampling(info: DataFrame) -> DataFrame:
    """Class counts before and after, added up over the scopes."""
    total = lambda column, k: F.coalesce(F.sum(F.col(column)[k]), F.lit(0)).cast("bigint")
    return info.agg(*[
        total(f"{when}_counts", k).alias(f"{when}_{k}") for when in ("before", "after") for k in (0, 1)
    ])


def generated_rows(info: DataFrame, total: str = "overall") -> DataFrame:
    """Rows added per scope and in total."""
    size = lambda column: F.coalesce(F.col(column)[0], F.lit(0)) + F.coalesce(F.col(column)[1], F.lit(0))
    added = info.select("scope", (size("after_counts") - size("before_counts")).alias("n"))
    rolled = added.rollup("scope").agg(F.sum("n").cast("bigint").alias("generated"), F.grouping("scope").alias("all"))
    return rolled.select(F.when(F.col("all") == 1, total).otherwise(F.col("scope")).alias("scope"), "generated")
