"""What every model offers: fit on a table, score a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Protocol

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Fitted(Protocol):
    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with a 0/1 ``prediction`` and the ``probability`` of class 1."""


class Model(Protocol):
    params: Mapping

    def fit(self, train: DataFrame, features: Sequence[str], label: str, row_id: str = "row_id") -> Fitted: ...


def sigmoid(value):
    return 1.0 / (1.0 + F.exp(-value))


def with_probability(df: DataFrame) -> DataFrame:
    """Class 1 probability; else the squashed decision value; else the prediction."""
    if "probability" in df.columns:
        p = vector_to_array("probability")[1]
    elif "rawPrediction" in df.columns:
        p = sigmoid(vector_to_array("rawPrediction")[1])
    elif "decision" in df.columns:
        p = sigmoid(F.col("decision"))
    else:
        p = F.col("prediction").cast("double")
    return df.withColumn("probability", p)


def class_totals(train: DataFrame, label: str) -> dict[int, int]:
    """Rows per class; a model needs both."""
    row = train.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")).first()
    if not row["n0"] or not row["n1"]:
        raise ValueError("training data has one class only")
    return {0: row["n0"], 1: row["n1"]}
