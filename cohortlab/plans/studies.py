"""The two studies: one model against one per cohort, and with against without SMOTE."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.models.attribution import attribution_long, attribution_summary, tree_attribution
from cohortlab.models.catalogue import CATALOGUE, entry, make_model
from cohortlab.operators.clean import cohort_slice
from cohortlab.operators.compare import BASELINE, SPECIALIST, compare_variants, cross_model_summary
from cohortlab.operators.importance import FeatureChoice
from cohortlab.operators.metrics import metrics, wilson_interval
from cohortlab.operators.smote import SamplingInfo
from cohortlab.plans.pipeline import (
    ModelInfo,
    Prepared,
    Settings,
    Specialists,
    fit_score,
    fit_score_full,
    outside,
    prevalence_scores,
    specialists,
)
from cohortlab.plans.report import variant_document
from cohortlab.session import side_by_side, stage
from cohortlab.spec import OVERALL, TableSpec


@dataclass(frozen=True)
class StrategyComparison:
    """Reports keyed by (model, strategy, scope), infos by (model, strategy, cohort)."""

    report: DataFrame
    summary: DataFrame
    scores: DataFrame
    features: Mapping[str, FeatureChoice | None]
    sampling: Mapping[str, SamplingInfo]
    models: Mapping[str, ModelInfo]
    unavailable: Mapping[str, str]


def _staged(df: DataFrame, spec: TableSpec, name: str) -> DataFrame:
    """A study reads its tables dozens of times, mostly one cohort at a time."""
    return stage(df.select(spec.row_id, *spec.features, spec.label, spec.cohort), name, by=spec.cohort)


def compare_strategies(train: DataFrame, test: DataFrame, keys: Sequence[str] | None, settings: Settings) -> StrategyComparison:
    """Every model once on all rows and once per cohort.

    Scores of all models go to one staged table; a single grouped report
    then covers all models, strategies and scopes. A model that cannot be
    built is left out with its reason.
    """
    spec = settings.spec
    train, test = _staged(train, spec, "study-train"), _staged(test, spec, "study-test")
    prepared, parts, features, sampling, models, unavailable = Prepared(), [], {}, {}, {}, {}
    for key in keys or CATALOGUE:
        name = entry(key).name
        try:
            make_model(key, settings.params.get(key), settings.seed)
        except ImportError as missing:
            unavailable[key] = str(missing)
            continue
        base = fit_score(train, test, key, settings, label=f"{name} Baseline Holdout", prepared=prepared)
        baseline = stage(base.scores, "scores")
        own = specialists(train, test, key, settings, baseline, name, prepared)
        for strategy, scores in ((BASELINE, baseline), (SPECIALIST, own.scores)):
            tags = {"model_key": key, "model_name": name, "strategy": strategy}
            parts.append(scores.withColumns({c: F.lit(v) for c, v in tags.items()}))
        features[f"{key}/{OVERALL}"], sampling[f"{key}/{OVERALL}"] = base.features, base.sampling
        models[f"{key}/{OVERALL}"] = base.model
        for cohort in spec.cohorts:
            scope = f"{key}/{cohort}"
            features[scope], sampling[scope], models[scope] = own.features[cohort], own.sampling[cohort], own.models[cohort]
    scores = stage(reduce(DataFrame.unionByName, parts), "scores")
    report = metrics(scores, spec.cohorts, spec.cohort, extra=["model_key", "model_name", "strategy"])
    summary = cross_model_summary(report.filter(F.col("scope") == OVERALL))
    return StrategyComparison(report, summary, scores, features, sampling, models, unavailable)


@dataclass(frozen=True)
class Variant:
    name: str
    report: DataFrame
    scores: DataFrame
    run: Specialists
    train_before: dict[int, int]


def run_variant(train: DataFrame, test: DataFrame, settings: Settings, name: str, key: str = "xgboost") -> Variant:
    """Specialists on a generated train table, scored on the real test rows.

    A cohort without usable training rows gets the training prevalence.
    """
    spec = settings.spec
    return _run_variant(_staged(train, spec, "study-train"), _staged(test, spec, "study-test"), settings, name, key, Prepared())


def _run_variant(train: DataFrame, test: DataFrame, settings: Settings, name: str, key: str, prepared: Prepared) -> Variant:
    spec = settings.spec
    totals = train.agg(
        F.count("*").alias("n"), F.avg(spec.label).alias("p"),
        F.count_if(F.col(spec.label) == 0).alias("n0"), F.count_if(F.col(spec.label) == 1).alias("n1"),
    ).first()
    run = specialists(train, test, key, settings, prevalence_scores(test, spec, totals["p"]), name, prepared)
    scores = stage(run.scores, "scores")
    report = metrics(scores, spec.cohorts, spec.cohort)
    return Variant(name, report, scores, run, {0: totals["n0"], 1: totals["n1"]})


def variant_result(variant: Variant, settings: Settings, key: str = "xgboost") -> DataFrame:
    """The variant as one nested row, with the rows outside all cohorts counted."""
    spec = settings.spec
    strangers = variant.scores.filter(outside(spec.cohort, spec.cohorts)).count()
    return variant_document(variant, settings, key, strangers)


def compare_smote(train: DataFrame, test: DataFrame, settings: Settings, key: str = "xgboost") -> tuple[Variant, Variant, DataFrame]:
    """The same study without and with SMOTE, and their metric table."""
    spec, runs, shared = settings.spec, [], Prepared()
    train, test = _staged(train, spec, "study-train"), _staged(test, spec, "study-test")
    for use_smote, name in ((False, "WITHOUT_SMOTE"), (True, "WITH_SMOTE")):
        # the selection does not depend on the variant, the balanced tables do
        own = replace(settings, use_smote=use_smote)
        runs.append(_run_variant(train, test, own, name, key, Prepared(choices=shared.choices)))
    return runs[0], runs[1], compare_variants(runs[0].report, runs[1].report)


@dataclass(frozen=True)
class CohortExplanation:
    cohort: str
    report: DataFrame
    interval: DataFrame
    attributions: DataFrame
    importance: DataFrame


def explain_cohorts(train: DataFrame, test: DataFrame, settings: Settings) -> dict[str, CohortExplanation]:
    """Per cohort: holdout metrics with an accuracy interval, then a model
    refitted on train and test together whose scores of the real rows are
    taken apart by feature. Cohorts that cannot be fitted are left out."""
    spec = settings.spec
    train, test = _staged(train, spec, "study-train"), _staged(test, spec, "study-test")

    def explain(cohort: str) -> CohortExplanation | None:
        own_train, own_test = cohort_slice(train, cohort, spec.cohort), cohort_slice(test, cohort, spec.cohort)
        classes = own_train.select(spec.label).distinct().limit(2).count()
        if own_test.isEmpty() or classes < 2:
            return None
        held = fit_score(own_train, own_test, "xgboost", settings, scope=cohort, label=f"{cohort} Holdout")
        scores = stage(held.scores, "scores")
        full = own_train.unionByName(own_test)
        final = fit_score_full(full, "xgboost", settings, f"{cohort} Final Explanation Model")
        explained = stage(tree_attribution(final.fitted, full, spec.row_id), "attributions")
        long = attribution_long(explained, spec.row_id, final.fitted.features)
        report = metrics(scores, [cohort], spec.cohort).filter(F.col("scope") == cohort)
        return CohortExplanation(cohort, report, wilson_interval(scores), explained, attribution_summary(long))

    return {e.cohort: e for e in side_by_side(train.sparkSession, explain, spec.cohorts) if e}
