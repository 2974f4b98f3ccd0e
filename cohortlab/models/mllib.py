"""Models fitted by MLlib."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.models.base import with_probability

VECTOR = "_features"
DEEPEST = 30  # MLlib's limit, for trees without one
BINS = 256


def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=VECTOR, handleInvalid="error")


@dataclass(frozen=True)
class FittedMllib:
    model: object
    features: tuple[str, ...]

    def score(self, df: DataFrame) -> DataFrame:
        scored = with_probability(self.model.transform(assembler(self.features).transform(df)))
        return scored.select(*df.columns, F.col("prediction").cast("int"), "probability")


@dataclass(frozen=True)
class MllibModel:
    """``build(params, seed, width)`` gives the estimator to fit."""

    build: object
    params: Mapping
    seed: int

    def fit(self, train: DataFrame, features: Sequence[str], label: str, row_id: str = "row_id") -> FittedMllib:
        table = assembler(features).transform(train).select(F.col(label).cast("double").alias("label"), VECTOR)
        estimator = self.build(self.params, self.seed, len(features))
        return FittedMllib(estimator.fit(table), tuple(features))


def _columns() -> dict:
    return {"featuresCol": VECTOR, "labelCol": "label"}


def _depth(value) -> int:
    return DEEPEST if value is None or value < 0 else value


def random_forest(p, seed, width):
    return RandomForestClassifier(
        numTrees=p["n_estimators"], maxDepth=_depth(p["max_depth"]), minInstancesPerNode=p["min_samples_leaf"],
        featureSubsetStrategy="sqrt", seed=seed, **_columns(),
    )


def decision_tree(p, seed, width):
    return DecisionTreeClassifier(
        maxDepth=_depth(p["max_depth"]), minInstancesPerNode=p["min_samples_leaf"], maxBins=BINS,
        impurity=p.get("criterion", "gini"), seed=seed, **_columns(),
    )
