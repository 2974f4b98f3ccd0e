"""k nearest neighbour voting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.models.base import class_totals
from cohortlab.operators.neighbors import nearest_neighbors


def vote(near: DataFrame, weights: str = "distance") -> DataFrame:
    """(query, prediction, probability) from neighbours carrying their label.

    At distance zero only the exact hits vote; class 0 wins a tie.
    """
    one = F.get("carried", F.lit(0))
    if weights == "uniform":
        p = F.avg(one)
    else:
        exact = F.col("distance") == 0
        inverse = F.try_divide(F.lit(1.0), F.col("distance"))
        p = F.coalesce(F.avg(F.when(exact, one)), F.sum(one * inverse) / F.sum(inverse))
    shares = near.groupBy("query").agg(p.cast("double").alias("probability"))
    return shares.withColumn("prediction", F.when(F.col("probability") > 0.5, 1).otherwise(0))


@dataclass(frozen=True)
class FittedKNN:
    train: DataFrame
    features: tuple[str, ...]
    label: str
    row_id: str
    params: Mapping
    seed: int

    def score(self, df: DataFrame) -> DataFrame:
        p = self.params
        near = nearest_neighbors(
            df, self.train, self.features, p["n_neighbors"], self.row_id, skip_self=False, seed=self.seed, p=p["p"],
            carry=[self.label],
        )
        votes = vote(near, p["weights"]).withColumnRenamed("query", self.row_id)
        return df.join(votes, self.row_id, "left").select(*df.columns, "prediction", "probability")


@dataclass(frozen=True)
class KNN:
    params: Mapping
    seed: int

    def fit(self, train: DataFrame, features: Sequence[str], label: str, row_id: str = "row_id") -> FittedKNN:
        class_totals(train, label)
        return FittedKNN(train, tuple(features), label, row_id, self.params, self.seed)
