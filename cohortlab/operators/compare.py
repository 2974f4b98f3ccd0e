"""Comparison tables between strategies, variants and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.operators.metrics import METRICS, long_metrics
from cohortlab.spec import OVERALL

# Report columns and names.
SUMMARY_METRICS = ("accuracy", "roc_auc", "pr_auc", "recall", "f1")
COHORT_METRICS = ("accuracy", "recall", "f1", "roc_auc", "pr_auc")
BASELINE, SPECIALIST = "baseline", "age_specialist"


def winner(a: Column, b: Column, names: tuple[str, str]) -> Column:
    """Name of the larger value, ``Tie``, or ``N/A`` when one is missing."""
    missing = a.isNull() | b.isNull() | F.isnan(a) | F.isnan(b)
    return F.when(missing, "N/A").when(b > a, names[1]).when(a > b, names[0]).otherwise("Tie")


def cross_model_summary(report: DataFrame) -> DataFrame:
    """One row per model: five metrics under both strategies and their
    difference, specialist minus baseline.

    ``report`` has a metric row per (model_key, model_name, strategy).
    """
    names = [BASELINE, SPECIALIST]
    wide = report.groupBy("model_key", "model_name").pivot("strategy", names).agg(
        *[F.first(m).alias(m) for m in SUMMARY_METRICS]
    )
    deltas = [(F.col(f"{SPECIALIST}_{m}") - F.col(f"{BASELINE}_{m}")).alias(f"delta_{m}") for m in SUMMARY_METRICS]
    both = [f"{s}_{m}" for s in names for m in SUMMARY_METRICS]
    return wide.select("model_key", "model_name", *both, *deltas)


def delta_matrix(summary: DataFrame) -> DataFrame:
    """(model, metric, delta) in long form."""
    renamed = summary.select("model_key", "model_name", *[F.col(f"delta_{m}").alias(m) for m in SUMMARY_METRICS])
    return renamed.unpivot(["model_key", "model_name"], list(SUMMARY_METRICS), "metric", "delta")


def strategy_winners(summary: DataFrame, names: tuple[str, str] = ("Baseline", "Age-Specialist")) -> DataFrame:
    """(model, metric, both values, winner)."""
    rows = F.array(*[
        F.struct(
            F.lit(m).alias("metric"),
            F.col(f"{BASELINE}_{m}").alias("baseline_value"),
            F.col(f"{SPECIALIST}_{m}").alias("specialist_value"),
        )
        for m in SUMMARY_METRICS
    ])
    long = summary.select("model_key", F.inline(rows))
    return long.withColumn("winner", winner(F.col("baseline_value"), F.col("specialist_value"), names))


def compare_variants(
    a: DataFrame, b: DataFrame, names: tuple[str, str] = ("Without SMOTE", "With SMOTE"),
    overall: Sequence[str] = METRICS, cohort: Sequence[str] = COHORT_METRICS,
) -> DataFrame:
    """Two metric reports side by side: (scope, metric, a, b, delta, winner)."""
    def side(report: DataFrame, value: str) -> DataFrame:
        wanted = F.when(F.col("scope") == OVERALL, F.col("metric").isin(list(overall))).otherwise(
            F.col("metric").isin(list(cohort))
        )
        return long_metrics(report, ["scope"]).filter(wanted).withColumnRenamed("value", value)

    joined = side(a, "value_a").join(side(b, "value_b"), ["scope", "metric"], "full_outer")
    return joined.withColumns({
        "delta": F.col("value_b") - F.col("value_a"),
        "winner": winner(F.col("value_a"), F.col("value_b"), names),
    })


def rank_models(summary: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """Models by the better of their two values, best first."""
    best = F.greatest(F.col(f"{BASELINE}_{metric}"), F.col(f"{SPECIALIST}_{metric}"))
    scored = summary.select("model_key", "model_name", best.alias("best"))
    # one row per model: a table that fits in any task
    order = Window.orderBy(F.desc_nulls_last("best"), "model_key")
    return scored.withColumn("position", F.row_number().over(order))
