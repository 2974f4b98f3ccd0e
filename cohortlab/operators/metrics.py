"""Binary classification metrics, overall and per cohort.

A scored table has a 0/1 ``label`` and ``prediction``, a ``probability`` and,
for per-cohort rows, a cohort column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.session import stage
from cohortlab.spec import OVERALL

BUCKET_ROWS = 250_000
MAX_BUCKETS = 4096
COUNTS = ("tn", "fp", "fn", "tp")
METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")


def _cell(label: int, prediction: int) -> Column:
    return F.count_if((F.col("label") == label) & (F.col("prediction") == prediction))


def confusion(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The four cells, zero when nothing falls into one."""
    return df.groupBy(*by).agg(
        _cell(0, 0).alias("tn"), _cell(0, 1).alias("fp"), _cell(1, 0).alias("fn"), _cell(1, 1).alias("tp")
    )


def ratios(cells: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 from the four cells.

    A zero denominator gives 0; with no rows at all nothing is defined.
    """
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    total = tn + fp + fn + tp

    def share(part: Column, whole: Column) -> Column:
        return F.when(total > 0, F.coalesce(F.try_divide(part, whole), F.lit(0.0)))

    return cells.withColumns({
        "accuracy": F.try_divide(tn + tp, total),
        "precision": share(tp, tp + fp),
        "recall": share(tp, tp + fn),
        "f1": share(2 * tp, 2 * tp + fp + fn),
    })


def basic_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return ratios(confusion(df, by))


def wilson_bounds(correct: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a proportion; NULL without trials."""
    n = F.when(total > 0, total.cast("double"))
    p = correct / n
    shrink = 1 + z * z / n
    center = (p + z * z / (2 * n)) / shrink
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / shrink
    return center - margin, center + margin


def wilson_interval(df: DataFrame, by: Sequence[str] = (), z: float = 1.96) -> DataFrame:
    hits = df.groupBy(*by).agg(
        F.count_if(F.col("label") == F.col("prediction")).alias("correct"), F.count("*").alias("total")
    )
    low, high = wilson_bounds(F.col("correct"), F.col("total"), z)
    return hits.withColumns({"ci_low": low, "ci_high": high})


def _score_buckets(points: DataFrame, buckets: int | None) -> DataFrame:
    """Add ``bucket``, even ranges of the score in rising order.

    Running sums over a scope then need one task per bucket instead of one
    for the scope. Boundaries follow the data, so scores crowded into a
    narrow range are still cut evenly; equal scores are already one row.
    """
    if buckets is None:
        buckets = min(-(-points.count() // BUCKET_ROWS), MAX_BUCKETS)
    if buckets > 1:
        steps = [i / buckets for i in range(1, buckets)]
        inner = sorted(set(points.approxQuantile("probability", steps, 1 / (4 * buckets))))
        if inner:
            edges = [float("-inf"), *inner, float("inf")]
            binner = Bucketizer(splits=edges, inputCol="probability", outputCol="bucket", handleInvalid="keep")
            return binner.transform(points).withColumn("bucket", F.coalesce("bucket", F.lit(-1.0)))
    return points.withColumn("bucket", F.lit(0.0))


def _points(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct key and score: the only pass over the rows."""
    return stage(
        df.groupBy(*keys, "probability").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")),
        "score-points",
    )


def _ranking(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """ROC-AUC and average precision from bucketed points.

    A running sum inside each bucket continues from the totals of the
    buckets above it, scopes x buckets numbers. The frames are ranges, so
    equal scores count together whichever rows they come from.
    """
    totals = points.groupBy(*by, "bucket").agg(F.sum("pos").alias("bpos"), F.sum("neg").alias("bneg"))
    above = Window.partitionBy(*by).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *by, "bucket",
        F.coalesce(F.sum("bpos").over(above), F.lit(0)).alias("spos"),
        F.coalesce(F.sum("bneg").over(above), F.lit(0)).alias("sneg"),
    )
    inside = Window.partitionBy(*by, "bucket").orderBy(F.desc("probability"))
    down_to = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    at = inside.rangeBetween(Window.currentRow, Window.currentRow)
    tp = F.col("spos") + F.sum("pos").over(down_to)
    fp = F.col("sneg") + F.sum("neg").over(down_to)
    ranked = points.join(starts, [*by, "bucket"]).select(
        *by, "probability", "pos", "neg", tp.alias("tp"), fp.alias("fp"), F.sum("pos").over(at).alias("tied"),
    )
    sums = ranked.groupBy(*by).agg(
        F.sum("pos").alias("P"),
        F.sum("neg").alias("N"),
        # double: positives times negatives outgrow a bigint
        F.sum(F.col("neg").cast("double") * (F.col("tp").cast("double") - F.col("tied") / 2)).alias("area"),
        F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("steps"),
        F.count_if(F.col("probability").isNull() | F.isnan("probability")).alias("bad"),
    )
    ok = (F.col("bad") == 0) & (F.col("P") > 0) & (F.col("N") > 0)
    return sums.select(
        *by,
        F.when(ok, F.col("area") / (F.col("P").cast("double") * F.col("N"))).alias("roc_auc"),
        F.when(ok, F.col("steps") / F.col("P")).alias("pr_auc"),
    )


def ranking_metrics(df: DataFrame, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """ROC-AUC with half credit for ties, and average precision as a step
    sum (MLlib's area under PR interpolates and is another number).

    NULL when a scope has one class only or a row without a score.
    """
    keys = list(by) or ["_all"]
    source = df if by else df.withColumn("_all", F.lit(True))
    return _ranking(_score_buckets(_points(source, keys), buckets), keys).select(*by, "roc_auc", "pr_auc")


def roc_auc(df: DataFrame, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    return ranking_metrics(df, by, buckets).drop("pr_auc")


def average_precision(df: DataFrame, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    return ranking_metrics(df, by, buckets).drop("roc_auc")


def metrics(
    df: DataFrame, cohorts: Sequence[str], cohort: str = "age_group", extra: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """One full metric row for the whole table and one per listed cohort.

    Every scope has its row even without data: metrics NULL, counts 0. Rows
    of other cohorts count in the whole only. ``extra`` keys (model,
    strategy) repeat the report per key.
    """
    scopes = [OVERALL, *cohorts]
    points = _score_buckets(_points(df, [*extra, cohort, "prediction"]), buckets)
    scoped = points.withColumn("scope", F.explode(F.array(F.lit(OVERALL), F.col(cohort)))).filter(
        F.col("scope").isin(scopes)
    )
    keys = [*extra, "scope"]
    cell = lambda prediction, side: F.sum(F.when(F.col("prediction") == prediction, F.col(side)).otherwise(0))
    cells = ratios(scoped.groupBy(*keys).agg(
        cell(0, "neg").alias("tn"), cell(1, "neg").alias("fp"), cell(0, "pos").alias("fn"), cell(1, "pos").alias("tp")
    ))
    ranks = _ranking(scoped, keys)
    grid = df.sparkSession.createDataFrame([(i, s) for i, s in enumerate(scopes)], "position int, scope string")
    if extra:
        grid = points.select(*extra).distinct().select(
            *extra, F.inline(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(s).alias("scope"))
                                       for i, s in enumerate(scopes)]))
        )
    joined = grid.join(cells, keys, "left").join(ranks, keys, "left")
    return joined.select(
        *extra, "position", "scope", *METRICS,
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTS],
    )


def long_metrics(report: DataFrame, keys: Sequence[str], names: Sequence[str] = METRICS) -> DataFrame:
    """(keys..., metric, value); absent values stay as rows."""
    return report.unpivot(list(keys), list(names), "metric", "value")
