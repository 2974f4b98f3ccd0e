"""Gaussian naive Bayes: one aggregate to fit, one expression to score."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.models.base import sigmoid


@dataclass(frozen=True)
class FittedGaussianNB:
    features: tuple[str, ...]
    log_prior: tuple[float, float]
    mean: tuple[tuple[float, ...], tuple[float, ...]]
    var: tuple[tuple[float, ...], tuple[float, ...]]

    def _log_likelihood(self, k: int):
        constant = self.log_prior[k] - 0.5 * sum(math.log(2 * math.pi * v) for v in self.var[k])
        total = F.lit(constant)
        for name, m, v in zip(self.features, self.mean[k], self.var[k]):
            gap = F.col(name) - F.lit(m)
            total = total - gap * gap / F.lit(2 * v)
        return total

    def score(self, df: DataFrame) -> DataFrame:
        odds = self._log_likelihood(1) - self._log_likelihood(0)
        with_odds = df.withColumn("_odds", odds)
        return with_odds.select(
            *df.columns,
            F.when(F.col("_odds") > 0, 1).otherwise(0).alias("prediction"),
            sigmoid(F.col("_odds")).alias("probability"),
        )


@dataclass(frozen=True)
class GaussianNB:
    params: Mapping

    def fit(self, train: DataFrame, features: Sequence[str], label: str, row_id: str = "row_id") -> FittedGaussianNB:
        aggs = [a for i, c in enumerate(features) for a in (F.avg(c).alias(f"m{i}"), F.var_pop(c).alias(f"v{i}"))]
        rows = train.filter(F.col(label).isin(0, 1)).groupBy(label).agg(F.count("*").alias("n"), *aggs).collect()
        if len(rows) < 2:
            raise ValueError("training data has one class only")
        rows = sorted(rows, key=lambda r: r[label])
        n = [r["n"] for r in rows]
        span = range(len(features))
        mean = [[r[f"m{i}"] for i in span] for r in rows]
        var = [[r[f"v{i}"] for i in span] for r in rows]
        smoothing = self.params["var_smoothing"] * max(_pooled(n, [m[i] for m in mean], [v[i] for v in var]) for i in span)
        return FittedGaussianNB(
            tuple(features),
            tuple(math.log(c / sum(n)) for c in n),
            tuple(map(tuple, mean)),
            tuple(tuple(v + smoothing for v in vs) for vs in var),
        )


def _pooled(n, means, variances) -> float:
    """Variance of the whole from the moments of its parts."""
    total = sum(n)
    center = sum(c * m for c, m in zip(n, means)) / total
    return sum(c * (v + (m - center) ** 2) for c, m, v in zip(n, means, variances)) / total
