"""Select features, balance, fit, score: one model or one per cohort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.models.base import Fitted
from cohortlab.models.catalogue import entry, make_model
from cohortlab.operators.clean import cohort_slice
from cohortlab.operators.importance import FeatureChoice, choose_features
from cohortlab.operators.smote import SamplingInfo, count_map, smote
from cohortlab.session import side_by_side, stage
from cohortlab.spec import TableSpec

TOP_K = 10
# Reasons in the results.
EMPTY_TEST, WEAK_TRAIN = "empty_test_cohort", "insufficient_train_cohort"
DEFAULT_MODEL, NO_SMOTE = "fixed_default_model", "smote_disabled"


@dataclass(frozen=True)
class ModelInfo:
    model_key: str
    model_name: str
    status: str
    reason: str
    label: str
    params: Mapping
    method: str = "default_model_params"

    @classmethod
    def of(cls, key: str, label: str, params: Mapping | None = None, status: str = "applied",
           reason: str = DEFAULT_MODEL) -> ModelInfo:
        known = entry(key)
        return cls(key, known.name, status, reason, label, dict(sorted({**known.defaults, **(params or {})}.items())))


MODEL_INFO_SCHEMA = (
    "scope string, model_key string, model_name string, status string, reason string, label string,"
    " params map<string,string>, method string"
)


def model_info_table(spark: SparkSession, infos: Mapping[str, ModelInfo]) -> DataFrame:
    rows = [
        (scope, i.model_key, i.model_name, i.status, i.reason, i.label, {k: str(v) for k, v in i.params.items()}, i.method)
        for scope, i in infos.items()
    ]
    return spark.createDataFrame(rows, MODEL_INFO_SCHEMA)


@dataclass(frozen=True)
class Run:
    """A fitted pipeline; ``score`` works on any table with the features."""

    fitted: Fitted
    features: FeatureChoice
    sampling: SamplingInfo
    model: ModelInfo
    scores: DataFrame


@dataclass(frozen=True)
class Settings:
    """What the runs of a study have in common. Holds nothing that was fitted."""

    spec: TableSpec
    top_k: int = TOP_K
    use_smote: bool = True
    seed: int = 42
    params: Mapping[str, Mapping] = field(default_factory=dict)


@dataclass
class Prepared:
    """Feature choices and balanced tables of one study call, by scope.

    They depend on the training tables, so a study makes its own, and a call
    without one prepares everything anew. Choices may be shared by the
    variants of a study, whose training tables are the same.
    """

    choices: dict[str, FeatureChoice] = field(default_factory=dict)
    balanced: dict[str, tuple[DataFrame, SamplingInfo]] = field(default_factory=dict)

    def choose(self, scope: str, train: DataFrame, settings: Settings) -> FeatureChoice:
        if scope not in self.choices:
            spec = settings.spec
            self.choices[scope] = choose_features(
                train, spec.features, spec.label, settings.top_k, settings.seed, settings.params.get("selector")
            )
        return self.choices[scope]

    def balance(self, scope: str, train: DataFrame, features: Sequence[str], settings: Settings) -> tuple[DataFrame, SamplingInfo]:
        if scope not in self.balanced:
            spec = settings.spec
            if settings.use_smote:
                grown, info = smote(
                    train, features, spec.label, spec.row_id, spec.dummy_groups.values(), spec.binary, seed=settings.seed
                )
                self.balanced[scope] = (stage(grown, "balanced") if info.applied else grown, info)
            else:
                info = SamplingInfo.untouched(count_map(train, spec.label), NO_SMOTE)
                self.balanced[scope] = (train.select(spec.row_id, *features, spec.label), info)
        return self.balanced[scope]


def scored_rows(fitted: Fitted, df: DataFrame, spec: TableSpec, features: Sequence[str]) -> DataFrame:
    """(row, label, cohort, prediction, probability)."""
    cohort = [spec.cohort] if spec.cohort in df.columns else []
    scored = fitted.score(df.select(spec.row_id, *features, spec.label, *cohort))
    return scored.select(
        spec.row_id, F.col(spec.label).alias("label"), *cohort, "prediction", "probability"
    )


def fit_score(train: DataFrame, test: DataFrame, key: str, settings: Settings, scope: str = "overall",
              label: str | None = None, prepared: Prepared | None = None) -> Run:
    """Features are chosen before balancing; neither sees the test side.

    ``prepared`` must stem from the same training tables."""
    prepared = Prepared() if prepared is None else prepared
    choice = prepared.choose(scope, train, settings)
    features = list(choice.selected)
    table, sampling = prepared.balance(scope, train, features, settings)
    spec, params = settings.spec, settings.params.get(key)
    fitted = make_model(key, params, settings.seed).fit(table, features, spec.label, spec.row_id)
    info = ModelInfo.of(key, label or f"{entry(key).name} Holdout", params)
    return Run(fitted, choice, sampling, info, scored_rows(fitted, test, spec, features))


def fit_score_full(full: DataFrame, key: str, settings: Settings, label: str, reference: DataFrame | None = None) -> Run:
    """Fit on all rows and score them (or ``reference``); for explanation, not evaluation."""
    return fit_score(full, full if reference is None else reference, key, settings, scope=f"full:{label}", label=label)


def outside(cohort: str, cohorts: Sequence[str]) -> Column:
    """Rows in none of the cohorts, those without a cohort included."""
    return ~F.coalesce(F.col(cohort).isin(list(cohorts)), F.lit(False))


@dataclass(frozen=True)
class Specialists:
    scores: DataFrame
    features: dict[str, FeatureChoice | None]
    sampling: dict[str, SamplingInfo]
    models: dict[str, ModelInfo]


def specialists(train: DataFrame, test: DataFrame, key: str, settings: Settings, fallback: DataFrame,
                label: str, prepared: Prepared | None = None) -> Specialists:
    """One model per cohort, scored on the cohort's test rows.

    ``fallback`` holds a score for every test row; it serves cohorts whose
    train side is empty or has one class, and rows outside all cohorts,
    those without a cohort included.
    Scoring is row-wise, so the parts are put together by union, not join.
    """
    spec, prepared = settings.spec, Prepared() if prepared is None else prepared
    sides = train.groupBy(spec.cohort).agg(
        F.count_if(F.col(spec.label) == 0).alias("n0"), F.count_if(F.col(spec.label) == 1).alias("n1")
    )
    before = {r[spec.cohort]: {0: r["n0"], 1: r["n1"]} for r in sides.filter(F.col(spec.cohort).isin(*spec.cohorts)).collect()}
    present = {r[0] for r in test.select(spec.cohort).distinct().filter(F.col(spec.cohort).isin(*spec.cohorts)).collect()}

    def serve(cohort: str) -> Run | tuple[SamplingInfo, ModelInfo]:
        counts = before.get(cohort, {0: 0, 1: 0})
        title = f"{label} {cohort} Holdout"
        if cohort not in present or min(counts.values()) == 0:
            reason = EMPTY_TEST if cohort not in present else WEAK_TRAIN
            return SamplingInfo.untouched(counts, reason), ModelInfo.of(key, title, status="skipped", reason=reason)
        sides = cohort_slice(train, cohort, spec.cohort), cohort_slice(test, cohort, spec.cohort)
        return fit_score(*sides, key, settings, scope=cohort, label=title, prepared=prepared)

    parts, features, sampling, models = {}, {}, {}, {}
    for cohort, served in zip(spec.cohorts, side_by_side(train.sparkSession, serve, spec.cohorts)):
        if isinstance(served, Run):
            parts[cohort], features[cohort] = served.scores, served.features
            sampling[cohort], models[cohort] = served.sampling, served.model
        else:
            features[cohort], (sampling[cohort], models[cohort]) = None, served
    scores = fallback.filter(outside(spec.cohort, list(parts)))
    for part in parts.values():
        scores = scores.unionByName(part)
    return Specialists(scores, features, sampling, models)


def prevalence_scores(test: DataFrame, spec: TableSpec, prevalence: float) -> DataFrame:
    """Every test row scored with the share of positives in training."""
    return test.select(
        spec.row_id, F.col(spec.label).alias("label"), spec.cohort,
        F.lit(int(prevalence >= 0.5)).alias("prediction"), F.lit(prevalence).alias("probability"),
    )


def fill_scores(scores: DataFrame, prevalence: float) -> DataFrame:
    """Replace missing scores by the prevalence and mark the rows."""
    missing = F.col("probability").isNull() | F.col("prediction").isNull()
    return scores.withColumns({
        "prediction": F.when(missing, int(prevalence >= 0.5)).otherwise(F.col("prediction")),
        "probability": F.when(missing, prevalence).otherwise(F.col("probability")),
        "filled": missing,
    })
