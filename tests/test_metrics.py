import math

import pytest
from pyspark.sql import functions as F

from cohortlab.functions.keyed import uniform
from cohortlab.functions.text import delta_text, metric_text, names_text, params_text
from cohortlab.operators import compare, metrics, profile

SCHEMA = "label int, prediction int, probability double, age_group string"
GROUPS = ("Young", "Middle", "Elderly")


def matrix(spark, tn, fp, fn, tp):
    rows = [(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn + [(1, 1)] * tp
    return spark.createDataFrame([(y, p, float(p), "Young") for y, p in rows], SCHEMA)


@pytest.mark.parametrize(
    ("cells", "expected"),
    [((101, 22, 19, 134), (0.8514, 0.8590, 0.8758, 0.8673)), ((101, 22, 17, 136), (0.8587, 0.8608, 0.8889, 0.8746))],
)
def test_published_matrices(spark, cells, expected):
    row = metrics.basic_metrics(matrix(spark, *cells)).first()
    assert tuple(row[c] for c in metrics.COUNTS) == cells
    assert tuple(round(row[m], 4) for m in ("accuracy", "precision", "recall", "f1")) == expected


def test_no_positive_prediction_gives_zeros(spark):
    row = metrics.basic_metrics(matrix(spark, 3, 0, 2, 0)).first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0.0, 0.0, 0.0, 0.6)


def test_ranking_by_hand(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (1, 0.2), (0, 0.1)]
    df = spark.createDataFrame([(y, 0, p, "Young") for y, p in rows], SCHEMA)
    row = metrics.ranking_metrics(df).first()
    assert row["roc_auc"] == pytest.approx((3 + 2.5 + 1) / 9)  # negatives beaten, half for the tie
    assert row["pr_auc"] == pytest.approx((1 / 1 + 2 / 3 + 3 / 5) / 3)


def test_all_tied_and_one_class(spark):
    tied = spark.createDataFrame([(1, 1, 0.5, "Young")] + [(0, 1, 0.5, "Young")] * 3, SCHEMA)
    row = metrics.ranking_metrics(tied).first()
    assert (row["roc_auc"], row["pr_auc"]) == (0.5, 0.25)
    row = metrics.ranking_metrics(tied.filter("label = 0")).first()
    assert (row["roc_auc"], row["pr_auc"]) == (None, None)


@pytest.mark.parametrize("buckets", [2, 7, 50])
def test_buckets_do_not_change_the_result(spark, buckets):
    skewed = F.pow(uniform(3, "p", "id"), F.lit(9.0))  # most scores crowd at zero
    df = spark.range(3000).select(
        (uniform(3, "y", "id") < 0.3 + 0.4 * skewed).cast("int").alias("label"), skewed.alias("probability"),
        F.when(F.col("id") % 3 == 0, "Young").otherwise("Middle").alias("age_group"),
    )
    plain = metrics.ranking_metrics(df, ["age_group"], 1).orderBy("age_group").collect()
    cut = metrics.ranking_metrics(df, ["age_group"], buckets).orderBy("age_group").collect()
    for a, b in zip(plain, cut):
        assert a["roc_auc"] == pytest.approx(b["roc_auc"], abs=1e-12)
        assert a["pr_auc"] == pytest.approx(b["pr_auc"], abs=1e-12)


@pytest.mark.parametrize("buckets", [1, 4])
@pytest.mark.parametrize("bad", [None, math.nan])
def test_a_missing_score_voids_the_ranking(spark, buckets, bad):
    rows = [(i % 2, 0, i / 10, "Young") for i in range(10)] + [(1, 0, bad, "Middle"), (0, 0, 0.1, "Middle")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["age_group"]: r["roc_auc"] for r in metrics.ranking_metrics(df, ["age_group"], buckets).collect()}
    assert got["Young"] is not None and got["Middle"] is None


def test_report_has_every_scope(spark):
    df = spark.createDataFrame([(1, 1, 0.9, "Young"), (0, 1, 0.4, "Young"), (1, 0, 0.2, "Unknown")], SCHEMA)
    report = {r["scope"]: r for r in metrics.metrics(df, GROUPS).collect()}
    assert set(report) == {"overall", *GROUPS}
    assert report["overall"]["tp"] + report["overall"]["fp"] + report["overall"]["fn"] == 3
    assert report["Middle"]["accuracy"] is None and report["Middle"]["precision"] is None and report["Middle"]["tn"] == 0
    empty = metrics.metrics(df.limit(0), GROUPS).collect()
    assert len(empty) == 4 and all(r["accuracy"] is None and r["tp"] == 0 for r in empty)


def test_wilson(spark):
    df = spark.createDataFrame([(45, 55), (0, 0), (3, 3)], "c int, n int")
    low, high = metrics.wilson_bounds(F.col("c"), F.col("n"))
    rows = df.select(low, high).collect()
    assert rows[0][0] == pytest.approx(0.6969, abs=1e-3) and rows[0][1] == pytest.approx(0.8979, abs=1e-3)
    assert tuple(rows[1]) == (None, None) and rows[2][1] == pytest.approx(1.0)


def test_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 7.0, 5.0), (4.0, None, 5.0)], "a double, b double, c double")
    got = {(r["row_name"], r["column_name"]): r["correlation"] for r in profile.correlation_long(df, ["a", "b", "c"]).collect()}
    assert set(got) == {("b", "a"), ("c", "a"), ("c", "b")}
    assert got[("b", "a")] == pytest.approx(0.9933992677987828) and got[("c", "a")] is None


def test_counts_fill_the_grid(spark):
    df = spark.createDataFrame([(1, "Young"), (1, "Young"), (0, "Elderly")], "target int, age_group string")
    rows = profile.cohort_counts(df, GROUPS, "age_group", "target").orderBy("position", "target").collect()
    assert [r["n"] for r in rows] == [0, 2, 0, 0, 1, 0]


def summary_input(spark):
    rows = [("a", "A", "baseline", 0.8), ("a", "A", "age_specialist", 0.9), ("b", "B", "baseline", 0.7),
            ("b", "B", "age_specialist", None), ("c", "C", "baseline", 0.5), ("c", "C", "age_specialist", 0.5)]
    df = spark.createDataFrame(rows, "model_key string, model_name string, strategy string, v double")
    return df.select("model_key", "model_name", "strategy", *[F.col("v").alias(m) for m in metrics.METRICS])


def test_summary_and_winners(spark):
    summary = compare.cross_model_summary(summary_input(spark))
    assert len(summary.columns) == 17
    rows = {r["model_key"]: r for r in summary.collect()}
    assert rows["a"]["delta_f1"] == pytest.approx(0.1) and rows["b"]["delta_f1"] is None
    won = {(r["model_key"], r["metric"]): r["winner"] for r in compare.strategy_winners(summary).collect()}
    assert (won["a", "f1"], won["b", "f1"], won["c", "f1"]) == ("Age-Specialist", "N/A", "Tie")
    assert [r["model_key"] for r in compare.rank_models(summary).orderBy("position").collect()] == ["a", "b", "c"]
    assert compare.delta_matrix(summary).count() == 15


def test_texts(spark):
    df = spark.createDataFrame([(0.85144,), (None,), (math.nan,), (-0.05,)], "v double")
    rows = df.select(metric_text(F.col("v")), delta_text(F.col("v"))).collect()
    assert [tuple(r) for r in rows] == [("0.8514", "+0.8514"), ("N/A", "N/A"), ("N/A", "N/A"), ("-0.0500", "-0.0500")]
    names = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "n array<string>").select(names_text(F.col("n")))
    assert [r[0] for r in names.collect()] == ["a, b", "N/A", "N/A"]
    params = spark.createDataFrame([({"zeta": "1", "max_depth": "4", "n_estimators": "120"},), ({},)], "p map<string,string>")
    assert [r[0] for r in params.select(params_text(F.col("p"))).collect()] == ["n_estimators=120, max_depth=4, zeta=1", "N/A"]
