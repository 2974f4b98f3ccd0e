import math

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import clean
from cohortlab.sources import tables

AGES = ("Young", "Middle", "Elderly")


def test_names_are_lowered_and_underscored(spark):
    df = spark.createDataFrame([(1, 2)], "`Chest Pain Type` int, AGE int")
    assert clean.normalize_columns(df).columns == ["chest_pain_type", "age"]


def test_equal_rows_merge_also_with_nulls(spark):
    df = spark.createDataFrame([(1, 5, None), (2, 5, None), (3, 6, 1), (4, 6, 1), (5, 6, None)], "id int, a int, b int")
    kept = clean.dedup_rows(df, "id")
    assert sorted(r["id"] for r in kept.collect()) == [1, 3, 5]
    assert kept.columns == ["id", "a", "b"]
    assert clean.dedup_rows(df.drop("id")).count() == 3


def test_content_key_is_stable_and_unique(spark):
    df = spark.range(50).select((F.col("id") * 2).alias("a"), F.lit(None).cast("int").alias("b"))
    one = {r["a"]: r["row_id"] for r in clean.with_content_key(df).collect()}
    two = {r["a"]: r["row_id"] for r in clean.with_content_key(df.repartition(7)).collect()}
    assert one == two and len(set(one.values())) == 50


def test_sentinel_goes_missing_stays(spark):
    df = spark.createDataFrame([(0,), (1,), (None,)], "st_slope int")
    assert {r[0] for r in clean.drop_sentinel(df, "st_slope", 0).collect()} == {1, None}


@pytest.mark.parametrize(
    ("age", "cohort"),
    [(44.0, "Young"), (44.999, "Young"), (45.0, "Middle"), (65.0, "Middle"), (65.5, "Elderly"), (None, "Unknown"),
     (math.nan, "Unknown")],
)
def test_cohort_borders(spark, age, cohort):
    df = spark.createDataFrame([(age,)], "age double")
    assert clean.assign_cohort(df, "age", (45, 65), AGES).first()["age_group"] == cohort


def test_numeric_columns_and_errors(spark):
    df = spark.createDataFrame([(1, "a", 2.0, 0)], "i int, s string, d double, target int")
    assert clean.numeric_columns(df, "target") == ["i", "d"]
    assert clean.feature_columns(df, ["target"]) == ["i", "s", "d"]
    with pytest.raises(ValueError, match="no numeric"):
        clean.numeric_columns(df.select("s"))
    with pytest.raises(ValueError, match=r"\['x', 'y'\]"):
        tables.require_columns(df, ["i", "y", "x"])


def test_csv_and_parquet_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1, "a"), (2, None, "b")], "id int, v double, s string")
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / f"t.{fmt}")
        tables.write_table(df, path, fmt)
        back = tables.read_table(spark, path, df.schema)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    inferred = tables.read_table(spark, str(tmp_path / "t.csv"))
    assert dict(inferred.dtypes) == {"id": "int", "v": "double", "s": "string"}


def test_one_folder_per_cohort(spark, tmp_path):
    df = spark.createDataFrame([(1, "Young"), (2, "Middle"), (3, "Young")], "id int, age_group string")
    path = str(tmp_path / "cohorts")
    tables.write_by_cohort(df, path)
    assert sorted(p.name for p in (tmp_path / "cohorts").iterdir() if p.is_dir()) == ["age_group=Middle", "age_group=Young"]
    assert spark.read.parquet(f"{path}/age_group=Young").count() == 2


def test_json_has_nulls_and_text_keys(spark, tmp_path):
    df = spark.createDataFrame([({0: 1.5, 1: math.nan}, [math.nan, 2.0], (math.nan, 3))],
                               "counts map<int,double>, list array<double>, nested struct<x:double,y:int>")
    text = tables.results_text(df).first()["json"]
    assert text == '{"counts":{"0":1.5,"1":null},"list":[null,2.0],"nested":{"x":null,"y":3}}'
    tables.write_results(df, str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part-*")).strip() == text



def test_shared_folder_comes_from_the_session(monkeypatch):
    """The named folder wins; without one only a local master may use a temporary folder."""
    from cohortlab import session

    class Context:
        master = "spark://host:7077"
        folder = None

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, path):
            self.folder = path

    class Session:
        def __init__(self, conf):
            self.sparkContext, self.conf = Context(), conf

    assert session.shared_dir(Session({"spark.checkpoint.dir": "hdfs:///shared"})) == "hdfs:///shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session({}))
