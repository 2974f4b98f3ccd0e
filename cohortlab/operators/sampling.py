"""Exact sampling by keyed hash: split, downsample, dense numbering."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.functions.keyed import keyed_hash
from cohortlab.operators.allocate import largest_remainder
from cohortlab.operators.numbering import numbered
from cohortlab.session import scratch, stage

STEP = 3  # hex digits per refinement: 4096 buckets
FULL = 32
MAX_POOLS = 256  # bounds the bucket totals that travel with every task


Quotas = Mapping[str, int] | Callable[[dict[str, int]], Mapping[str, int]]


def hash_cuts(df: DataFrame, group: Column, order: Column, quotas: Quotas, among: Sequence[str] | None = None) -> dict[str, str]:
    """For each group the bound below which exactly ``quota`` hashes lie.

    A histogram over hash prefixes finds the bucket holding the quota-th
    hash; the next round looks inside that bucket only. A histogram stays a
    table of at most 4096 counts per group; its running totals give one row
    per group, which is all that reaches the driver, as the quotas do. Keys
    and hashes are staged, so the rounds do not run the caller's plan again,
    and choosing rows afterwards is a plain filter. ``quotas`` may be a
    function of the sizes of the groups ``among`` which to choose. For groups that the caller
    can list; ``cut_table`` takes any number.
    """
    hashed = stage(df.select(group.alias("g"), order.alias("h")), "hashes")
    if callable(quotas):
        wanted = hashed if among is None else hashed.filter(F.col("g").isin(list(among)))
        quotas = quotas({r["g"]: r["count"] for r in wanted.groupBy("g").count().collect()})
    bounds = {g: "" for g, q in quotas.items() if q <= 0}
    searching = {g: (q, "") for g, q in quotas.items() if q > 0}
    for digits in range(STEP, FULL + STEP, STEP):
        if not searching:
            break
        for g, (prefix, rest) in _locate(hashed, searching, digits).items():
            if rest:
                searching[g] = rest, prefix
            else:
                bounds[g] = prefix + "g"  # sorts after every hash starting with the prefix
                del searching[g]
    if searching:
        raise ValueError("row keys are not unique")
    return bounds


def _locate(hashed: DataFrame, searching: Mapping[str, tuple[int, str]], digits: int) -> dict[str, tuple[str, int]]:
    """Per group the bucket in which the needed hash lies, and how many of its
    rows are needed; 0 when the bucket is taken whole."""
    asked = hashed.sparkSession.createDataFrame([(g, *x) for g, x in searching.items()], "g string, need long, p string")
    inside = hashed.join(F.broadcast(asked), "g").filter(F.col("h").startswith(F.col("p")))
    counts = inside.groupBy("g", "need", F.substring("h", 1, digits).alias("b")).count()
    upto = F.sum("count").over(Window.partitionBy("g").orderBy("b"))
    at = counts.withColumn("upto", upto).filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("count") < F.col("need")))
    rest = F.when(F.col("upto") > F.col("need"), F.col("need") - F.col("upto") + F.col("count")).otherwise(0)
    found = {r["g"]: (r["b"], r["rest"]) for r in at.select("g", "b", rest.alias("rest")).collect()}
    short = sorted(set(searching) - set(found))
    if short:
        raise ValueError(f"group {short[0]!r} has fewer rows than its quota")
    return found


def below(group: Column, order: Column, bounds: Mapping[str, str]) -> Column:
    """True for the rows inside their group's bound, false for all others."""
    bound = reduce(lambda c, g: c.when(group == g, bounds[g]), bounds, F.when(F.lit(False), ""))
    return F.coalesce(order < bound, F.lit(False))


def class_quotas(sizes: DataFrame, test_size: float) -> DataFrame:
    """Test rows per class: the train side is allocated by largest remainder, the test side is the rest. ``sizes``, result: g, n and g, quota.

    Shares are whole-number arithmetic on 38 digits. Which classes get one
    row more is found by placing all remainders in order, largest first and
    ties by the class's name (shorter ones first), which no single task does.
    The driver reads one row of totals, however many classes there are.
    """
    row = sizes.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.min("n").alias("least"), F.count_if(F.col("g").isNull()).alias("nameless")).first()
    if row["nameless"]:
        raise ValueError("the label has missing values")
    if not row["k"] or row["least"] < 2:
        raise ValueError("every class needs at least two rows")
    n_test = math.ceil(test_size * row["n"])
    n_train = row["n"] - n_test
    if min(n_test, n_train) < row["k"]:
        raise ValueError("both sides need at least one row per class")
    wide = "decimal(38,0)"
    mass = F.col("n").cast(wide) * F.lit(n_train).cast("decimal(19,0)")
    shares = sizes.select("g", "n", mass.cast(wide).alias("mass")).withColumn("whole", F.expr(f"mass div CAST({row['n']} AS {wide})"))
    shares = shares.withColumn("part", F.col("mass") - (F.col("whole").cast("decimal(19,0)") * F.lit(row["n"]).cast("decimal(19,0)")).cast(wide))
    order = [F.col("less"), F.length("g"), F.col("g")]
    placed = numbered(shares.withColumn("less", -F.col("part")).withColumn("all_", F.lit("")), "all_", order, "class-quotas")
    left = n_train - placed.agg(F.sum("whole")).first()[0]
    return placed.select("g", (F.col("n") - F.col("whole") - (F.col("idx") < left).cast("bigint")).alias("quota"))


def cut_table(hashed: DataFrame, quotas: DataFrame) -> DataFrame:
    """g, bound: as ``hash_cuts``, for any number of groups. ``hashed``: g, h. ``quotas``: g, quota.

    The same search by prefixes, with the state of all groups in a table: a
    round counts prefixes inside the groups' buckets, joined on g, and keeps one row per group.
    """
    bounds = quotas.filter("quota <= 0").select("g", F.lit("").alias("bound"))
    searching = stage(quotas.filter("quota > 0").select("g", F.col("quota").alias("need"), F.lit("").alias("p")), "cuts")
    for digits in range(STEP, FULL + STEP, STEP):
        inside = hashed.join(searching, "g").filter(F.col("h").startswith(F.col("p")))
        counts = inside.groupBy("g", "need", F.substring("h", 1, digits).alias("b")).count()
        upto = F.sum("count").over(Window.partitionBy("g").orderBy("b"))
        at = counts.withColumn("upto", upto).filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("count") < F.col("need")))
        rest = F.when(F.col("upto") > F.col("need"), F.col("need") - F.col("upto") + F.col("count")).otherwise(0)
        located = stage(at.select("g", F.col("b").alias("p"), rest.alias("need")), "cuts")
        short = searching.join(located, "g", "left_anti").select("g").first()
        if short:
            raise ValueError(f"group {short['g']!r} has fewer rows than its quota")
        bounds = bounds.unionByName(located.filter("need = 0").select("g", F.concat("p", F.lit("g")).alias("bound")))
        searching = located.filter("need > 0")
        if searching.isEmpty():
            return stage(bounds, "bounds", keep=True)
    raise ValueError("row keys are not unique")


def stratified_split(
    df: DataFrame, row_id: str, label: str, test_size: float = 0.3, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Exact stratified (train, test): ``ceil(test_size * n)`` test rows, for a label with any number of classes.

    Keys and hashes are staged, so the search does not run the caller's plan
    again. Rows meet their class's bound by a join with the small table of
    bounds, which is broadcast as long as its measured size allows.
    """
    with scratch(df.sparkSession):
        hashed = stage(df.select(F.col(label).cast("string").alias("g"), keyed_hash(seed, "split", row_id).alias("h")), "hashes")
        quotas = class_quotas(hashed.groupBy("g").agg(F.count("*").alias("n")), test_size)
        bounds = cut_table(hashed, stage(quotas, "quotas"))
    asked = df.withColumn("_g", F.col(label).cast("string")).join(bounds.select(F.col("g").alias("_g"), F.col("bound").alias("_bound")), "_g", "left")
    is_test = F.coalesce(keyed_hash(seed, "split", row_id) < F.col("_bound"), F.lit(False))
    return asked.filter(~is_test).select(*df.columns), asked.filter(is_test).select(*df.columns)


def stratum(keys: Sequence[str]) -> Column:
    return F.concat_ws("/", *[F.col(k).cast("string") for k in keys])


def downsample(
    df: DataFrame, row_id: str, keys: Sequence[str], order: Sequence[tuple], total: int, seed: int = 42,
    shuffle: bool = False,
) -> DataFrame:
    """``total`` rows without replacement, proportional over the listed strata.

    Rows of any other stratum are never drawn. ``shuffle`` sorts the result
    by another hash, which costs a range shuffle; tables have no order, so
    it is off by default.
    """
    names = ["/".join(map(str, k)) for k in order]

    def quotas(counts: dict) -> dict:
        weights = [counts.get(name, 0) for name in names]
        if total > sum(weights):
            raise ValueError(f"cannot draw {total} of {sum(weights)} rows without replacement")
        return dict(zip(names, largest_remainder(weights, total)))

    group, rank = stratum(keys), keyed_hash(seed, "downsample", row_id)
    drawn = df.filter(below(group, rank, hash_cuts(df, group, rank, quotas, names)))
    return drawn.orderBy(keyed_hash(seed, "shuffle", row_id)) if shuffle else drawn


def number_rows(df: DataFrame, row_id: str, pool: str, offsets: Mapping[str, int], seed: int, stream: str,
                output: str = "number") -> DataFrame:
    """Number the rows of each pool 0, 1, 2 ... in hash order, plus the pool's offset.

    A window over a whole pool would sort it in one task. The hash prefix
    cuts a pool into 4096 even buckets; their running totals (at most 4096
    rows for each pool in ``offsets``; more pools than ``MAX_POOLS`` are
    refused) say where each bucket starts. Rows of other pools get no number.
    """
    if len(offsets) > MAX_POOLS:
        raise ValueError(f"more than {MAX_POOLS} pools cannot be numbered")
    hashed = df.withColumn("_h", keyed_hash(seed, stream, row_id)).withColumn("_b", F.substring("_h", 1, STEP))
    sizes = hashed.filter(F.col(pool).isin(list(offsets))).groupBy(pool, "_b").count()
    before = Window.partitionBy(pool).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("count").over(before), F.lit(0))
    base = reduce(lambda c, p: c.when(F.col(pool) == p, offsets[p]), offsets, F.when(F.lit(False), 0))
    starts = sizes.select(pool, "_b", (start + base).alias("_start"))
    inside = Window.partitionBy(pool, "_b").orderBy("_h", row_id)
    return (
        hashed.withColumn("_r", F.row_number().over(inside))
        .join(F.broadcast(starts), [pool, "_b"], "left")
        .withColumn(output, (F.col("_start") + F.col("_r") - 1).cast("bigint"))
        .drop("_h", "_b", "_r", "_start")
    )
