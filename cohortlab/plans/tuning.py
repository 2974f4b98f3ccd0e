"""Random search over a model's grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.models.catalogue import grid_points, make_model
from cohortlab.operators.metrics import roc_auc
from cohortlab.operators.sampling import stratified_split
from cohortlab.session import stage


def tune(
    df: DataFrame, features: Sequence[str], label: str, row_id: str, key: str, seed: int = 42,
    iterations: int | None = None, points: Sequence[Mapping] | None = None,
) -> DataFrame:
    """Grid points by ROC-AUC on a stratified holdout, best first."""
    table = stage(df.select(row_id, *features, label), "tuning")
    train, held = stratified_split(table, row_id, label, seed=seed)
    tried = []
    for point in points if points is not None else grid_points(key, seed, iterations):
        fitted = make_model(key, point, seed).fit(train, features, label, row_id)
        scored = fitted.score(held).withColumn("label", F.col(label))
        tried.append((roc_auc(scored).first()["roc_auc"], point))
    tried.sort(key=lambda t: -t[0])
    rows = [(i + 1, key, {k: str(v) for k, v in p.items()}, auc) for i, (auc, p) in enumerate(tried)]
    return df.sparkSession.createDataFrame(rows, "position int, model_key string, params map<string,string>, roc_auc double")
