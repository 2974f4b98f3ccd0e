"""Input tables of the registered queries, each over whole source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions.keyed import uniform
from cohortlab.operators.clean import assign_cohort
from cohortlab.sources.tables import read_table
from cohortlab.spec import TableSpec

SEED = 42
COHORTS = ("Low", "Middle", "High")

ORDERS = TableSpec(
    row_id="row_id",
    label="label",
    numeric=("acctbal", "totalprice", "order_days"),
    categorical={"prio": (1, 2, 3, 4)},  # priority 5 is an unknown category
    binary=("near",),
    cohort_by="acctbal",
    cutoffs=(2000.0, 7000.0),
    cohorts=COHORTS,
    cohort="cohort",
)

CUSTOMERS = TableSpec(
    row_id="row_id",
    label="label",
    numeric=("acctbal", "spend"),
    categorical={"zone": (0, 1, 2, 3)},
    binary=("near",),
    cohort_by="acctbal",
    cutoffs=(2.0, 7.0),
    cohorts=COHORTS,
    cohort="cohort",
)

MODELS = ("m1", "m2", "m3", "m4")
STRATEGIES = ("baseline", "age_specialist")
LINE_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


def source(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    joined = source(spark, sf, "orders").join(
        source(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    return joined.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("c_acctbal").alias("acctbal"),
        F.col("o_totalprice").alias("totalprice"),
        F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).alias("order_days"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("prio"),
        (F.col("c_nationkey") < 12).cast("int").alias("near"),
        (F.col("o_orderstatus") == "P").cast("int").alias("label"),
    )


CODES = ("bal", "price", "month", "prio", "near")


def order_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Every order in coarse steps, so that each feature has few values."""
    return orders(spark, sf).select(
        "row_id", F.floor(F.round("acctbal", 2) / 100).cast("double").alias("bal"), F.floor(F.round("totalprice", 2) / 4000).cast("double").alias("price"),
        F.floor(F.col("order_days") / 30).cast("double").alias("month"), F.col("prio").cast("double").alias("prio"),
        F.col("near").cast("double").alias("near"), "label",
    )


def orders_by_cohort(spark: SparkSession, sf: str) -> DataFrame:
    return assign_cohort(orders(spark, sf), "acctbal", ORDERS.cutoffs, COHORTS, "cohort")


def customers(spark: SparkSession, sf: str) -> DataFrame:
    """Processed-shaped customers: units chosen so that no column rules the distance."""
    spent = source(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    joined = source(spark, sf, "customer").join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
    zone = F.col("c_nationkey") % 4
    return joined.select(
        F.col("c_custkey").alias("row_id"),
        (F.round(F.col("c_acctbal"), 2) / 1000).alias("acctbal"),
        (F.round(F.round(F.coalesce(F.col("total"), F.lit(0.0)), 2), 0) / 1000000).alias("spend"),
        *[F.when(zone == k, 1.0).otherwise(0.0).alias(f"zone_{k}") for k in (1, 2, 3)],
        (F.col("c_nationkey") < 12).cast("double").alias("near"),
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("label"),
    )


def customers_by_cohort(spark: SparkSession, sf: str) -> DataFrame:
    return assign_cohort(customers(spark, sf), "acctbal", CUSTOMERS.cutoffs, COHORTS, "cohort")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return source(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), "embedding", (F.col("label") < 5).cast("int").alias("label"),
        F.col("label").alias("digit"),
    )


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents: low quality is the rare class."""
    return source(spark, sf, "labels").join(source(spark, sf, "documents"), "doc_id").select(
        F.col("doc_id").alias("row_id"), F.col("n_chars").cast("double").alias("n_chars"), "lang",
        (1 - F.col("quality")).alias("label"), "toxic",
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Every order with a made-up score of two decimals, so ties abound."""
    p = F.round(uniform(SEED, "score", "row_id"), 2)
    table = orders_by_cohort(spark, sf).select("row_id", "cohort", "label", p.alias("probability"))
    return table.withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))


def scored_variants(spark: SparkSession, sf: str) -> DataFrame:
    """The same for four models under two strategies."""
    runs = F.array(*[
        F.struct(F.lit(m).alias("model_key"), F.lit(m.upper()).alias("model_name"), F.lit(s).alias("strategy"))
        for m in MODELS for s in STRATEGIES
    ])
    table = orders_by_cohort(spark, sf).select("row_id", "cohort", "label", F.inline(runs))
    p = F.round(uniform(SEED, "score", "model_key", "strategy", "row_id"), 2)
    return table.withColumn("probability", p).withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))
