import pytest
from pyspark.sql import functions as F

from cohortlab.operators import preprocess
from cohortlab.operators.clean import assign_cohort
from cohortlab.operators.profile import require_match, frame_diff
from cohortlab.spec import CLINICAL


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    scaler = preprocess.fit_scaler(df, ["a", "b"])
    assert scaler.std == {"a": 1.0, "b": 1.0}
    assert [tuple(r) for r in preprocess.apply_scaler(df, scaler).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_unknown_category_gives_zeros(spark):
    df = spark.createDataFrame([(1,), (2,), (9,), (None,)], "c int")
    rows = preprocess.one_hot(df, {"c": (1, 2, 3)}).collect()
    assert [tuple(r) for r in rows] == [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]


def test_prepared_shape(clinical):
    found = preprocess.prepare(clinical, CLINICAL)
    assert found.train.columns == [
        "row_id", "age", "resting_bp_s", "cholesterol", "max_heart_rate", "oldpeak", "chest_pain_type_2",
        "chest_pain_type_3", "chest_pain_type_4", "resting_ecg_1", "resting_ecg_2", "st_slope_2", "st_slope_3", "sex",
        "fasting_blood_sugar", "exercise_angina", "target", "age_group",
    ]
    assert dict(found.train.dtypes)["sex"] == "double" and dict(found.train.dtypes)["target"] == "int"
    assert (found.train.count(), found.test.count()) == (420, 180)
    stats = found.train.agg(F.avg("age"), F.stddev_pop("age")).first()
    assert abs(stats[0]) < 1e-9 and abs(stats[1] - 1) < 1e-9


def test_scaler_does_not_see_the_test_side(clinical):
    one = preprocess.prepare(clinical, CLINICAL)
    held = one.test.select("row_id").withColumn("held", F.lit(1))
    changed = clinical.join(held, "row_id", "left").withColumn(
        "cholesterol", F.when(F.col("held") == 1, F.col("cholesterol") * 100).otherwise(F.col("cholesterol"))
    ).drop("held")
    assert preprocess.prepare(changed, CLINICAL).scaler == one.scaler


def test_raw_and_scaled_cohorts_agree(clinical):
    found = preprocess.prepare(clinical, CLINICAL)
    both = assign_cohort(found.train, "age", found.cutoffs, CLINICAL.cohorts, "scaled")
    off_border = both.join(found.train_raw.select("row_id", F.col("age").alias("raw")), "row_id").filter("raw not in (45, 65)")
    assert off_border.filter("scaled <> age_group").count() == 0
    low, high = found.cutoffs
    assert low == pytest.approx((45 - found.scaler.mean["age"]) / found.scaler.std["age"]) and low < high


def test_sentinel_and_copies_are_dropped(clinical):
    extra = clinical.withColumn("row_id", F.col("row_id") + 10_000)
    marked = clinical.filter("row_id < 5").withColumns({"row_id": F.col("row_id") + 50_000, "st_slope": F.lit(0)})
    cleaned = preprocess.clean(clinical.unionByName(extra).unionByName(marked), CLINICAL)
    assert cleaned.count() == 600 and cleaned.agg(F.max("row_id")).first()[0] == 599


def test_frame_differences(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, None, "y"), (3, 3.0, None)], "id int, v double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-10, "x"), (2, None, "z"), (4, 3.0, None)], "id int, v double, s string")
    assert {r["column"]: r["mismatches"] for r in frame_diff(a, b, "id").collect()} == {"v": 2, "s": 3}
    require_match(a, a, "id", "same")
    with pytest.raises(ValueError, match="t differs in s, v"):
        require_match(a, b, "id", "t")
    with pytest.raises(ValueError, match="columns"):
        frame_diff(a, b.drop("s"), "id")
