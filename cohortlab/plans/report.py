"""Results of the studies as nested rows and as report tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import asdict
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions.text import params_text
from cohortlab.operators.compare import BASELINE, SPECIALIST, compare_variants
from cohortlab.operators.importance import METHOD, FeatureChoice, choice_table, feature_text
from cohortlab.operators.metrics import COUNTS, METRICS
from cohortlab.operators.smote import SamplingInfo, info_table
from cohortlab.plans.pipeline import EMPTY_TEST, ModelInfo, Settings, model_info_table
from cohortlab.spec import OVERALL, TableSpec

if TYPE_CHECKING:
    from cohortlab.plans.studies import StrategyComparison, Variant

RECORD = (
    "train_rows_before_sampling bigint, train_rows_after_sampling bigint,"
    " sampling struct<applied:boolean,reason:string,minority_label:int,before_counts:map<int,bigint>,"
    "after_counts:map<int,bigint>,generated_samples:bigint,k_neighbors_used:int>,"
    " feature_selection struct<applied:boolean,reason:string,method:string,requested_top_k:int,"
    "selected_features:array<string>,selected_feature_importances:map<string,double>>,"
    " model_info struct<model_key:string,model_name:string,method:string,status:string,reason:string,"
    "label:string,params:map<string,string>>"
)
FIELDS = ("train_rows_before_sampling", "train_rows_after_sampling", "feature_selection", "sampling", "model_info")


def _record(choice: FeatureChoice | None, sampling: SamplingInfo, model: ModelInfo) -> tuple:
    """What one fit did, in the order of ``RECORD``."""
    chosen = choice and {
        "applied": choice.applied, "reason": choice.reason, "method": METHOD, "requested_top_k": choice.top_k,
        "selected_features": list(choice.selected), "selected_feature_importances": choice.importances,
    }
    info = {**asdict(model), "params": {k: str(v) for k, v in model.params.items()}}
    return sum(sampling.before_counts.values()), sum(sampling.after_counts.values()), asdict(sampling), chosen, info


def _metrics_struct():
    return F.struct(*METRICS, *COUNTS)


def _rows_in_scope():
    return sum((F.col(c) for c in COUNTS[1:]), F.col(COUNTS[0]))


def rules_table(spark: SparkSession, spec: TableSpec) -> DataFrame:
    return spark.createDataFrame(list(spec.rules.items()), "scope string, rule string")


def variant_document(variant: Variant, settings: Settings, key: str, outside: int) -> DataFrame:
    """A whole SMOTE study variant as one nested row.

    Cohorts without test rows are left out of the totals after sampling.
    """
    spec, run, spark = settings.spec, variant.run, variant.report.sparkSession
    after = {
        k: sum(i.after_counts[k] for i in run.sampling.values() if i.reason != EMPTY_TEST) for k in (0, 1)
    }
    rows = [(c, spec.rules[c], *_record(run.features[c], run.sampling[c], run.models[c])) for c in spec.cohorts]
    records = spark.createDataFrame(rows, f"scope string, rule string, {RECORD}")
    cells = variant.report.select(
        "position", "scope", _metrics_struct().alias("metrics"), _rows_in_scope().alias("test_rows")
    )
    per_cohort = cells.join(records, "scope").select(
        F.struct("position", "scope", "rule", "test_rows", *FIELDS, "metrics").alias("c")
    )
    in_order = F.array_sort(F.collect_list("c"), lambda a, b: a["position"] - b["position"])  # one per cohort
    cohorts = per_cohort.agg(in_order.alias("cohorts")).withColumn("scope", F.lit(OVERALL))
    whole = cells.withColumnRenamed("metrics", "overall_metrics").join(cohorts, "scope")
    filled = F.struct(
        F.lit(outside).cast("bigint").alias("rows_filled"), F.lit("training prevalence").alias("fallback")
    )
    return whole.select(
        F.lit(variant.name).alias("variant"),
        F.lit(settings.use_smote).alias("use_smote"),
        F.lit(key).alias("model_key"),
        F.struct(F.lit(METHOD).alias("method"), F.lit(settings.top_k).alias("top_k")).alias("feature_selection"),
        F.lit(sum(variant.train_before.values())).cast("bigint").alias("train_rows_before_sampling"),
        F.lit(sum(after.values())).cast("bigint").alias("train_rows_after_sampling"),
        "test_rows",
        _count_map(variant.train_before).alias("train_class_counts_before_sampling"),
        _count_map(after).alias("train_class_counts_after_sampling"),
        "cohorts",
        "overall_metrics",
        F.when(F.lit(outside > 0), filled).alias("missing_prediction_fallback"),
    )


def _count_map(counts: Mapping[int, int]):
    pairs = [F.lit(v).cast(t) for k, n in counts.items() for v, t in ((k, "int"), (n, "bigint"))]
    return F.create_map(*pairs)


def strategy_document(found: StrategyComparison) -> DataFrame:
    """One nested row per (model, strategy, scope): metrics and what was fitted there.

    Baseline cohorts and the specialist's whole have metrics only; they have
    no fit of their own.
    """
    spark, rows = found.report.sparkSession, []
    for at, model in found.models.items():
        key, scope = at.split("/", 1)
        strategy = BASELINE if scope == OVERALL else SPECIALIST
        rows.append((key, strategy, scope, *_record(found.features[at], found.sampling[at], model)))
    keys = ["model_key", "strategy", "scope"]
    records = spark.createDataFrame(rows, f"model_key string, strategy string, scope string, {RECORD}")
    cells = found.report.select(
        *keys, "model_name", _rows_in_scope().alias("test_rows"), _metrics_struct().alias("metrics")
    )
    return cells.join(records, keys, "left").select(*keys, "model_name", "test_rows", *FIELDS, "metrics")


def report_tables(without: Variant, with_smote: Variant, spec: TableSpec) -> dict[str, DataFrame]:
    """The content of a study report, one table per section."""
    variants = (without, with_smote)
    spark = without.report.sparkSession
    return {
        "rules": rules_table(spark, spec),
        "metrics": compare_variants(without.report, with_smote.report),
        "matrices": _tagged((v.name, v.report.select("scope", *COUNTS)) for v in variants),
        "sampling": _tagged((v.name, info_table(spark, v.run.sampling)) for v in variants),
        "features": _tagged(
            (v.name, feature_text(choice_table(spark, {s: c for s, c in v.run.features.items() if c}))) for v in variants
        ),
        "parameters": _tagged(
            (v.name, model_info_table(spark, v.run.models).select("scope", "status", "reason", params_text(F.col("params")).alias("params")))
            for v in variants
        ),
    }


def _tagged(parts: Iterable[tuple[str, DataFrame]]) -> DataFrame:
    tagged = [df.withColumn("variant", F.lit(name)) for name, df in parts]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out
