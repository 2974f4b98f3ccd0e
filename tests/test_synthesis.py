import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cohortlab.operators.augment import resize
from cohortlab.operators.preprocess import prepare
from cohortlab.operators.smote import (
    SamplingInfo,
    class_counts,
    column_kinds,
    generated_rows,
    info_table,
    smote,
    sum_sampling,
)
from cohortlab.session import stage
from cohortlab.spec import CLINICAL


@pytest.fixture(scope="module")
def prepared(clinical):
    return prepare(clinical, CLINICAL)


@pytest.fixture(scope="module")
def train(prepared):
    return stage(prepared.train, "train")


def grow(df, total, prepared):
    return resize(df, CLINICAL, total, prepared.cutoffs)


def test_resize_branches(train, prepared):
    assert grow(train, 420, prepared) is train
    empty = grow(train, 0, prepared)
    assert empty.count() == 0 and empty.columns == train.columns
    assert grow(train, 100, prepared).count() == 100
    with pytest.raises(ValueError, match="negative"):
        grow(train, -1, prepared)
    with pytest.raises(ValueError, match="bounds"):
        resize(train, CLINICAL, 10, None)
    with pytest.raises(ValueError, match="sex"):
        grow(train.drop("sex"), 500, prepared)


def test_augmented_rows_keep_their_promises(train, prepared):
    out = stage(grow(train, 3000, prepared), "grown")
    assert out.count() == 3000 and out.select("row_id").distinct().count() == 3000
    assert out.schema == train.schema
    made = out.filter("row_id >= 600")
    assert made.count() == 3000 - 420
    low, high = prepared.cutoffs
    expected = F.when(F.col("age") < low, "Young").when(F.col("age") <= high, "Middle").otherwise("Elderly")
    assert made.filter(expected != F.col("age_group")).count() == 0
    for group in CLINICAL.dummy_groups.values():
        assert made.filter(sum(F.col(c) for c in group) > 1).count() == 0
    for c in [*CLINICAL.dummies, *CLINICAL.binary]:
        assert made.filter(~F.col(c).isin(0.0, 1.0)).count() == 0
    for c in CLINICAL.numeric[1:]:
        limits = train.agg(F.min(c), F.max(c)).first()
        assert made.filter((F.col(c) < limits[0]) | (F.col(c) > limits[1])).count() == 0
    share = lambda df: df.agg(F.avg("target")).first()[0]
    assert abs(share(out) - share(train)) < 0.005


def test_augmentation_does_not_depend_on_partitions(train, prepared):
    one = sorted(map(tuple, grow(train.repartition(1), 900, prepared).collect()))
    many = sorted(map(tuple, grow(train.repartition(16), 900, prepared).collect()))
    assert one == many


def test_empty_strata_get_nothing_and_single_rows_borrow(train, prepared):
    thin = train.filter("not (target = 1 and age_group = 'Elderly')")
    one = train.filter("target = 1 and age_group = 'Elderly'").orderBy("row_id").limit(1)
    without = grow(thin, 2000, prepared)
    assert without.filter("target = 1 and age_group = 'Elderly'").count() == 0
    withone = stage(grow(thin.unionByName(one), 2000, prepared), "one")
    assert withone.count() == 2000
    borrowed = withone.filter("target = 1 and age_group = 'Elderly'")
    assert borrowed.count() >= 2 and borrowed.select("cholesterol").distinct().count() > 1


def run_smote(df, **kwargs):
    return smote(df, CLINICAL.features, "target", "row_id", CLINICAL.dummy_groups.values(), CLINICAL.binary, **kwargs)


def test_smote_balances(train):
    out, info = run_smote(train)
    out = stage(out, "smote")
    counts = {r["target"]: r["count"] for r in out.groupBy("target").count().collect()}
    assert counts[0] == counts[1] == max(info.before_counts.values()) and info.applied
    assert info.k_neighbors_used == 5 and info.generated_samples == abs(info.before_counts[0] - info.before_counts[1])
    made = out.filter("row_id >= 600")
    assert made.count() == info.generated_samples and made.filter(F.col("target") != info.minority_label).count() == 0
    for group in CLINICAL.dummy_groups.values():
        assert made.filter(sum(F.col(c) for c in group) > 1).count() == 0
    for c in CLINICAL.numeric:
        limits = train.filter(F.col("target") == info.minority_label).agg(F.min(c), F.max(c)).first()
        assert made.filter((F.col(c) < limits[0]) | (F.col(c) > limits[1])).count() == 0
    again = sorted(map(tuple, run_smote(train.repartition(9))[0].collect()))
    assert again == sorted(map(tuple, out.collect()))


def toy(spark, zeros, ones):
    rows = [(i, float(i), i % 2, 0) for i in range(zeros)] + [(100 + i, 50.0 + i, 1, 1) for i in range(ones)]
    return spark.createDataFrame(rows, "id int, x double, b int, y int")


@pytest.mark.parametrize(("zeros", "ones", "reason"), [(5, 0, "single_class_train_data"), (4, 4, "already_balanced")])
def test_smote_leaves_data_alone(spark, zeros, ones, reason):
    out, info = smote(toy(spark, zeros, ones), ["x", "b"], "y", "id")
    assert out.count() == zeros + ones and not info.applied and info.reason == reason
    assert info.before_counts == info.after_counts == {0: zeros, 1: ones}


def test_smote_with_tiny_minorities(spark):
    out, info = smote(toy(spark, 6, 1), ["x", "b"], "y", "id")
    made = out.filter("y = 1").collect()
    assert len(made) == 6 and {(r["x"], r["b"]) for r in made} == {(50.0, 1)} and info.k_neighbors_used == 0
    out, info = smote(toy(spark, 9, 3), ["x", "b"], "y", "id")
    assert info.k_neighbors_used == 2 and out.filter("y = 1 and x between 50 and 52").count() == 9
    assert len({r["id"] for r in out.collect()}) == 18


def test_text_keys_stay_unique(spark):
    df = toy(spark, 6, 2).withColumn("id", F.col("id").cast("string"))
    out, _ = smote(df, ["x"], "y", "id")
    assert out.select("id").distinct().count() == 12


def test_smote_copes_with_copies(spark):
    """A third of the minority are copies of one row."""
    base = toy(spark, 900, 200)
    copies = spark.range(100).select((F.col("id") + 5000).cast("int").alias("id"), F.lit(55.0).alias("x"), F.lit(1).alias("b"), F.lit(1).alias("y"))
    out, info = smote(base.unionByName(copies), ["x", "b"], "y", "id")
    assert info.generated_samples == 600 and out.count() == 1800


@pytest.mark.parametrize(
    ("before", "minority", "generated"),
    [({0: 12169, 1: 7020}, 1, 5149), ({0: 29485, 1: 41498}, 0, 12013), ({0: 3120, 1: 6708}, 1, 3588)],
)
def test_published_sample_counts(before, minority, generated):
    assert abs(before[0] - before[1]) == generated
    assert min(before, key=before.get) == (minority if before != {0: 3120, 1: 6708} else 0)


def test_kinds(spark):
    df = spark.createDataFrame([(0, 1.5, None, 1.0, math.nan, 1), (1, 2.0, None, 0.0, 1.0, 2)],
                               "g_2 int, x double, empty double, flag double, gap double, sex int")
    features = ["g_2", "x", "empty", "flag", "gap", "sex"]
    assert column_kinds(df, features, [["g_2", "g_3"], ["h_1"]], ["sex"]) == (["x", "empty"], ["flag", "gap", "sex"], [["g_2"]])


def test_info_tables(spark):
    infos = {
        "Young": SamplingInfo(True, None, 1, {0: 12169, 1: 7020}, {0: 12169, 1: 12169}, 5149, 5),
        "Middle": SamplingInfo(True, None, 0, {0: 29485, 1: 41498}, {0: 41498, 1: 41498}, 12013, 5),
        "Elderly": SamplingInfo(True, None, 0, {0: 3120, 1: 6708}, {0: 6708, 1: 6708}, 3588, 5),
    }
    table = info_table(spark, infos)
    assert sum_sampling(table).first().asDict() == {"before_0": 44774, "before_1": 55226, "after_0": 60375, "after_1": 60375}
    assert {r["scope"]: r["generated"] for r in generated_rows(table).collect()} == {
        "Young": 5149, "Middle": 12013, "Elderly": 3588, "overall": 20750}
    empty = spark.createDataFrame([], "y int")
    assert tuple(class_counts(empty, "y").first()) == (0, 0)


def test_cohort_spec_can_be_renamed(train, prepared):
    spec = replace(CLINICAL, cohorts=("a", "b", "c"))
    out = resize(train.drop("age_group"), spec, 500, prepared.cutoffs)
    assert out.count() == 500 and "age_group" not in out.columns
