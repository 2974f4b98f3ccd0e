"""Feature choice by boosted-tree importance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions.text import names_text

METHOD = "boosted_tree_importance_top_k"


# Reasons in the results.
FEW, ONE_CLASS, CHOSEN = "feature_count_within_limit", "single_class_train_data", "top_k_selected"


@dataclass(frozen=True)
class FeatureChoice:
    applied: bool
    reason: str
    top_k: int
    selected: tuple[str, ...]
    importances: Mapping[str, float] | None = None


def choose_features(
    train: DataFrame, features: Sequence[str], label: str, top_k: int = 10, seed: int = 42,
    params: Mapping | None = None,
) -> FeatureChoice:
    """The ``top_k`` most important features; equal ones keep column order.

    Nothing is fitted when all features fit or the table has one class.
    """
    from cohortlab.models.catalogue import make_model

    if len(features) <= top_k:
        return FeatureChoice(False, FEW, top_k, tuple(features))
    classes = train.select(label).distinct().limit(2).count()
    if classes < 2:
        return FeatureChoice(False, ONE_CLASS, top_k, tuple(features))
    fitted = make_model("xgboost", params, seed).fit(train, features, label)
    weights = dict(zip(features, fitted.importances))
    chosen = sorted(features, key=lambda c: -weights[c])[:top_k]  # stable
    return FeatureChoice(True, CHOSEN, top_k, tuple(chosen), {c: weights[c] for c in chosen})


def choice_table(spark: SparkSession, choices: Mapping[str, FeatureChoice]) -> DataFrame:
    """One row per scope and chosen feature, with its place."""
    rows = [
        (scope, c.applied, c.reason, METHOD, c.top_k, i, name, c.importances and c.importances[name])
        for scope, c in choices.items()
        for i, name in enumerate(c.selected)
    ]
    schema = (
        "scope string, applied boolean, reason string, method string, requested_top_k int,"
        " position int, feature string, importance double"
    )
    return spark.createDataFrame(rows, schema)


def feature_text(chosen: DataFrame) -> DataFrame:
    """Comma list of the chosen features per scope, in order of choice."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "feature")))
    named = chosen.groupBy("scope").agg(F.transform(ordered, lambda s: s["feature"]).alias("names"))
    return named.select("scope", names_text(F.col("names")).alias("features"))


def importance_series(chosen: DataFrame) -> DataFrame:
    """Scope panels with their features from least to most important."""
    return chosen.filter(F.col("importance").isNotNull()).select("scope", "feature", "importance").orderBy(
        "scope", "importance", F.desc("position")
    )
