import json

import pytest
from pyspark.sql import functions as F

from cohortlab.operators.augment import resize
from cohortlab.operators.clean import assign_cohort
from cohortlab.operators.preprocess import prepare
from cohortlab.plans.pipeline import Settings, fill_scores, fit_score, fit_score_full, model_info_table, specialists
from cohortlab.plans.report import report_tables, strategy_document
from cohortlab.plans.studies import compare_smote, compare_strategies, explain_cohorts, run_variant, variant_result
from cohortlab.session import stage
from cohortlab.sources.tables import results_text
from cohortlab.spec import CLINICAL

FAST = {"selector": {"n_estimators": 4}, "xgboost": {"n_estimators": 4}}


@pytest.fixture(scope="module")
def prepared(clinical):
    return prepare(clinical, CLINICAL)


@pytest.fixture(scope="module")
def sides(prepared):
    return stage(prepared.train, "train"), stage(prepared.test, "test")


def by_scope(report):
    return {r["scope"]: r for r in report.collect()}


def test_pipeline_records_what_it_did(sides):
    run = fit_score(*sides, "naive_bayes", Settings(CLINICAL, top_k=10, params=FAST))
    assert len(run.features.selected) == 10 and run.sampling.applied and run.model.params == {"var_smoothing": 1e-9}
    assert run.scores.columns == ["row_id", "label", "age_group", "prediction", "probability"]
    assert run.scores.count() == 180
    off = fit_score(*sides, "naive_bayes", Settings(CLINICAL, top_k=15, use_smote=False))
    assert off.sampling.reason == "smote_disabled" and off.features.reason == "feature_count_within_limit"
    full = fit_score_full(sides[0], "naive_bayes", Settings(CLINICAL, top_k=15), "Final")
    assert full.scores.count() == 420 and full.model.label == "Final"


def test_specialists_fall_back(sides):
    train, test = sides
    train = train.filter("age_group <> 'Elderly' or target = 0")  # one class left
    test = test.filter("age_group <> 'Young'").withColumn(
        "age_group", F.when(F.col("row_id") % 10 == 0, "Unknown").otherwise(F.col("age_group"))
    )
    settings = Settings(CLINICAL, top_k=15, use_smote=False)
    base = fit_score(train, test, "naive_bayes", settings)
    own = specialists(train, test, "naive_bayes", settings, base.scores, "Naive Bayes")
    assert {c: i.reason for c, i in own.models.items()} == {
        "Young": "empty_test_cohort", "Middle": "fixed_default_model", "Elderly": "insufficient_train_cohort"}
    assert own.models["Young"].status == "skipped" and own.features["Elderly"] is None
    assert own.sampling["Elderly"].before_counts[1] == 0
    joined = own.scores.join(base.scores.select("row_id", F.col("probability").alias("b")), "row_id").cache()
    assert joined.count() == test.count()
    assert joined.filter("age_group in ('Elderly', 'Unknown') and probability <> b").count() == 0
    assert joined.filter("age_group = 'Middle' and probability <> b").count() > 0
    assert model_info_table(test.sparkSession, own.models).count() == 3


def test_strategies(sides):
    found = compare_strategies(*sides, ["naive_bayes", "decision_tree"], Settings(CLINICAL, params=FAST))
    assert found.report.count() == 2 * 2 * 4 and found.summary.count() == 2 and not found.unavailable
    whole = found.report.filter("scope = 'overall'").collect()
    assert all(r["tn"] + r["fp"] + r["fn"] + r["tp"] == 180 and r["roc_auc"] > 0.6 for r in whole)
    assert set(found.features) == {f"{k}/{s}" for k in ("naive_bayes", "decision_tree") for s in ("overall", *CLINICAL.cohorts)}
    document = strategy_document(found).collect()
    assert len(document) == 16 and sum(r["model_info"] is not None for r in document) == 8
    same = found.features["naive_bayes/Young"] is found.features["decision_tree/Young"]
    assert same  # chosen once per training table


@pytest.fixture(scope="module")
def generated(prepared, sides):
    grown = resize(sides[0], CLINICAL, 1500, prepared.cutoffs)
    cohort = lambda df: assign_cohort(df, "age", prepared.cutoffs, CLINICAL.cohorts, "age_group")
    return cohort(grown), cohort(sides[1])


def test_variant_document(generated):
    settings = Settings(CLINICAL, params=FAST)
    doc = json.loads(results_text(variant_result(run_variant(*generated, settings, "WITH_SMOTE"), settings)).first()["json"])
    assert [c["rule"] for c in doc["cohorts"]] == ["age < 45", "45 <= age <= 65", "age > 65"]
    assert doc["train_rows_before_sampling"] == 1500 and doc["test_rows"] == 180 and doc["use_smote"]
    assert [c["scope"] for c in doc["cohorts"]] == ["Young", "Middle", "Elderly"]
    assert sum(c["train_rows_after_sampling"] for c in doc["cohorts"]) == doc["train_rows_after_sampling"]
    assert sum(c["test_rows"] for c in doc["cohorts"]) == 180
    assert doc["missing_prediction_fallback"] is None and doc["overall_metrics"]["roc_auc"] > 0.6


def test_variant_uses_prevalence_for_weak_cohorts(generated):
    train, test = generated
    train = stage(train.filter("age_group <> 'Elderly'"), "weak")
    test = test.withColumn("age_group", F.when(F.col("row_id") % 10 == 0, "Unknown").otherwise(F.col("age_group")))
    settings = Settings(CLINICAL, top_k=15, use_smote=False)
    run = run_variant(train, test, settings, "WITHOUT_SMOTE", "naive_bayes")
    share = train.agg(F.avg("target")).first()[0]
    rest = run.scores.filter("age_group in ('Elderly', 'Unknown')")
    assert rest.filter(F.abs(F.col("probability") - share) > 1e-12).count() == 0
    doc = json.loads(results_text(variant_result(run, settings, "naive_bayes")).first()["json"])
    assert doc["missing_prediction_fallback"]["rows_filled"] == test.filter("age_group = 'Unknown'").count()
    assert doc["cohorts"][2]["model_info"]["reason"] == "insufficient_train_cohort"


def test_smote_comparison(generated):
    without, with_, table = compare_smote(*generated, Settings(CLINICAL, top_k=15), "naive_bayes")
    assert not any(i.applied for i in without.run.sampling.values()) and any(i.applied for i in with_.run.sampling.values())
    rows = table.collect()
    assert len(rows) == 6 + 3 * 5 and {r["winner"] for r in rows} <= {"With SMOTE", "Without SMOTE", "Tie", "N/A"}
    sections = report_tables(without, with_, CLINICAL)
    assert {k: t.count() for k, t in sections.items()} == {
        "rules": 3, "metrics": 21, "matrices": 8, "sampling": 6, "features": 6, "parameters": 6}
    assert sections["parameters"].first()["params"] == "var_smoothing=1e-09"
    assert all(r["delta"] == pytest.approx(r["value_b"] - r["value_a"]) for r in rows if r["delta"] is not None)


def test_explanations(sides):
    found = explain_cohorts(*sides, Settings(CLINICAL, top_k=5, use_smote=False, params=FAST))
    assert set(found) == set(CLINICAL.cohorts)
    middle = found["Middle"]
    rows = sum(s.filter("age_group = 'Middle'").count() for s in sides)
    assert middle.attributions.count() == rows  # the real rows, none made up
    assert middle.importance.count() == 5
    bounds = middle.interval.first()
    assert bounds["ci_low"] < bounds["correct"] / bounds["total"] < bounds["ci_high"]
    assert by_scope(middle.report)["Middle"]["roc_auc"] is not None


def test_fill(spark):
    df = spark.createDataFrame([(1, 0.9), (None, None)], "prediction int, probability double")
    assert [tuple(r) for r in fill_scores(df, 0.4).collect()] == [(1, 0.9, False), (0, 0.4, True)]


def test_row_wise_steps_accept_a_stream(spark, prepared, clinical, tmp_path):
    """Scaling, encoding, cohorts and scoring need no state."""
    from cohortlab.models.catalogue import make_model
    from cohortlab.operators.preprocess import transform

    clinical.write.parquet(str(tmp_path / "in"))
    model = make_model("naive_bayes").fit(prepared.train, CLINICAL.features, "target")
    stream = spark.readStream.schema(clinical.schema).parquet(str(tmp_path / "in"))
    scored = model.score(transform(stream, CLINICAL, prepared.scaler))
    query = scored.writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    batch = model.score(transform(clinical, CLINICAL, prepared.scaler)).select("row_id", "probability")
    assert sorted(map(tuple, spark.table("scored").select("row_id", "probability").collect())) == sorted(map(tuple, batch.collect()))
