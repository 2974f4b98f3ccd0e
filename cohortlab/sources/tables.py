"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read CSV (with header) or parquet, decided by the file ending.

    Give a schema for CSV in production: without one Spark reads the whole
    file an extra time to infer it.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        return reader.csv(path, header=True, inferSchema=schema is None)
    return reader.parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite ``path``; CSV gets a header and no index column."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(fmt).save(path)


def write_by_cohort(df: DataFrame, path: str, cohort: str = "age_group", fmt: str = "parquet") -> None:
    """One folder per cohort, written by the tasks that hold the rows.

    No repartition by cohort: three cohorts would leave three writers.
    """
    writer = df.write.mode("overwrite").partitionBy(cohort)
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(fmt).save(path)


def json_ready(df: DataFrame) -> DataFrame:
    """NaN to NULL in every double, also inside structs, arrays and maps."""
    return df.select(*[_clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def write_results(df: DataFrame, path: str) -> None:
    """Nested results as JSON lines; absent values stay visible as null."""
    json_ready(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def results_text(df: DataFrame, name: str = "json") -> DataFrame:
    """The same JSON as a one-column table."""
    ready = json_ready(df)
    return ready.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Fail before any job when a column is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def _clean(value, kind: T.DataType):
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.nanvl(value, F.lit(None).cast(kind))
    if isinstance(kind, T.StructType):
        fields = [_clean(value[f.name], f.dataType).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _clean(x, kind.elementType))
    if isinstance(kind, T.MapType):
        pairs = F.transform(
            F.map_entries(value),
            lambda e: F.struct(e["key"].cast("string").alias("key"), _clean(e["value"], kind.valueType).alias("value")),
        )
        return F.map_from_entries(pairs)
    return value
