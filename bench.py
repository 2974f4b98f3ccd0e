"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cohortlab.models.catalogue import make_model  # noqa: E402
from cohortlab.operators import sampling  # noqa: E402
from cohortlab.operators.augment import resize  # noqa: E402
from cohortlab.operators.importance import choose_features  # noqa: E402
from cohortlab.operators.neighbors import nearest_neighbors  # noqa: E402
from cohortlab.operators.preprocess import prepare  # noqa: E402
from cohortlab.operators.smote import smote  # noqa: E402
from cohortlab.session import local_session, stage  # noqa: E402
from registry import fixtures as fx  # noqa: E402
from registry.queries import QUERIES, order_points  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def augment_100k(spark, sf):
    """The training table of the study: exactly 100,000 rows."""
    table = stage(fx.customers(spark, sf), "bench")
    return resize(table, fx.CUSTOMERS, 100_000, fx.CUSTOMERS.cutoffs)


def smote_orders(spark, sf):
    """Balance all orders: a third of them against two thirds."""
    table = stage(order_points(spark, sf), "bench")
    return smote(table, ["x", "y", "z"], "label", "row_id")[0]


def knn_orders(spark, sf):
    rare = stage(order_points(spark, sf).filter("label = 1"), "bench")
    return nearest_neighbors(rare, rare, ["x", "y", "z"], 5, "row_id", skip_self=True)


def downsample_third(spark, sf):
    table = fx.orders_by_cohort(spark, sf)
    order = [(y, c) for y in (0, 1) for c in fx.COHORTS]
    return sampling.downsample(table, "row_id", ["label", "cohort"], order, table.count() // 3)


def selector_default(spark, sf):
    """Feature selector with its full 120 rounds."""
    train = stage(prepare(fx.orders(spark, sf), fx.ORDERS).train, "bench")
    choice = choose_features(train, fx.ORDERS.features, "label", 5)
    return spark.createDataFrame(list(choice.importances.items()), "feature string, importance double")


def forest_default(spark, sf):
    """Random forest with its full 250 trees."""
    found = prepare(fx.orders(spark, sf), fx.ORDERS)
    return make_model("random_forest").fit(found.train, fx.ORDERS.features, "label").score(found.test)


HEADLINES = {
    **{name: QUERIES[name] for name in (
        "nb_report", "stratified_split", "preprocess_train", "dedup_keyed", "metrics_by_cohort", "roc_auc_bucketed",
        "correlation_matrix", "frame_diff", "cross_model_summary", "strategy_comparison_nb", "score_knn",
        "linear_attribution", "score_logreg",
    )},
    **{f.__name__: f for f in (
        augment_100k, smote_orders, knn_orders, downsample_third, selector_default, forest_default,
    )},
}


def main() -> None:
    spark = local_session(CPUS, partitions=int(CPUS), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name, run in HEADLINES.items():
        start = time.perf_counter()
        run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(SF_DIR).name.removeprefix("sf"), "cpus": CPUS,
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
