import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cohortlab.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=2, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def clinical(spark):
    """A made-up table in the clinical shape with a clear class signal."""
    from pyspark.sql import functions as F

    from cohortlab.functions.keyed import pick, uniform

    def u(name):
        return uniform(7, name, "id")

    rows = spark.range(600).select(
        F.col("id").alias("row_id"),
        (30 + pick(7, "age", 45, "id")).cast("double").alias("age"),
        (100 + 60 * u("bp")).alias("resting_bp_s"),
        (150 + 200 * u("ch")).alias("cholesterol"),
        (90 + 100 * u("hr")).alias("max_heart_rate"),
        (4 * u("op")).alias("oldpeak"),
        (1 + pick(7, "cp", 4, "id")).cast("int").alias("chest_pain_type"),
        pick(7, "ecg", 3, "id").cast("int").alias("resting_ecg"),
        (1 + pick(7, "sl", 3, "id")).cast("int").alias("st_slope"),
        pick(7, "sex", 2, "id").cast("int").alias("sex"),
        pick(7, "fbs", 2, "id").cast("int").alias("fasting_blood_sugar"),
        pick(7, "ang", 2, "id").cast("int").alias("exercise_angina"),
        u("noise").alias("noise"),
    )
    score = F.col("oldpeak") + 1.5 * F.col("exercise_angina") + (F.col("chest_pain_type") == 4).cast("int") + F.col("noise")
    return rows.withColumn("target", (score > 4.2).cast("int")).drop("noise").cache()
