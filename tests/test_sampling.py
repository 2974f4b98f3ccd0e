import pytest
from pyspark.sql import functions as F

from cohortlab.functions.keyed import keyed_hash, pick, uniform
from cohortlab.operators.allocate import allocate, largest_remainder
from cohortlab.operators.sampling import below, class_quotas, downsample, hash_cuts, number_rows, stratified_split


def test_remainder_ties_keep_order():
    assert largest_remainder([1, 1, 1], 10) == [4, 3, 3]
    assert largest_remainder([0, 5, 5], 3) == [0, 2, 1]
    assert sum(largest_remainder([10**17, 3, 10**18], 10**15)) == 10**15
    for bad in ([], [0, 0]):
        with pytest.raises(ValueError):
            largest_remainder(bad, 5)


def split_quotas(spark, counts, test_size):
    sizes = spark.createDataFrame([(str(g), n) for g, n in counts.items()], "g string, n bigint")
    return {int(r["g"]): r["quota"] for r in class_quotas(sizes, test_size).collect()}


def test_split_quotas(spark):
    assert split_quotas(spark, {0: 7, 1: 3}, 0.3) == {0: 2, 1: 1}
    published = split_quotas(spark, {0: 410, 1: 507}, 0.3)  # 917 rows
    assert sum(published.values()) == 276
    with pytest.raises(ValueError, match="two rows"):
        split_quotas(spark, {0: 5, 1: 1}, 0.3)
    with pytest.raises(ValueError, match="both sides"):
        split_quotas(spark, {0: 2, 1: 2}, 0.1)


def test_quotas_of_many_and_of_huge_classes(spark):
    """The same as one largest remainder on the driver, ties by name."""
    for counts in ({i: 2 + i * i % 37 for i in range(900)}, {0: 10**17, 1: 3 * 10**16 + 1, 2: 2}):
        names = sorted(counts, key=lambda c: (len(str(c)), str(c)))
        n = sum(counts.values())
        n_test = -(-3 * n // 10) if n < 10**15 else __import__("math").ceil(0.3 * n)
        train = largest_remainder([counts[c] for c in names], n - n_test)
        assert split_quotas(spark, counts, 0.3) == {c: counts[c] - t for c, t in zip(names, train)}


def test_split_by_a_label_of_very_many_classes(spark):
    df = spark.range(60_000).select("id", (F.col("id") % 20_000).cast("int").alias("y"))
    train, test = stratified_split(df, "id", "y", 0.4)
    assert test.count() == 24_000 and train.count() == 36_000
    sizes = test.groupBy("y").count().groupBy("count").count().collect()
    assert {r[0]: r[1] for r in sizes} == {1: 16_000, 2: 4_000}


def test_uniform_and_pick(spark):
    df = spark.range(20_000).select(uniform(1, "s", "id").alias("u"), pick(1, "s", 7, "id").alias("n"))
    row = df.agg(F.min("u"), F.max("u"), F.avg("u"), F.min("n"), F.max("n")).first()
    assert 0 <= row[0] < 0.01 and 0.99 < row[1] < 1 and abs(row[2] - 0.5) < 0.01
    assert (row[3], row[4]) == (0, 6)


def test_split_is_exact_complete_and_independent_of_partitions(spark):
    df = spark.range(1001).select("id", (F.col("id") % 5 == 0).cast("int").alias("y"))
    seen = set()
    for parts in (1, 4, 16):
        train, test = stratified_split(df.repartition(parts), "id", "y")
        a, b = {r["id"] for r in train.collect()}, {r["id"] for r in test.collect()}
        assert len(b) == 301 and not a & b and len(a | b) == 1001
        seen.add(frozenset(b))
    assert len(seen) == 1
    positives = test.filter("y = 1").count()
    assert abs(positives - 201 * 301 / 1001) < 1
    other = {r["id"] for r in stratified_split(df, "id", "y", seed=7)[1].collect()}
    assert other not in seen


def test_split_refuses_missing_labels_and_repeated_keys(spark):
    with pytest.raises(ValueError, match="missing"):
        stratified_split(spark.createDataFrame([(1, 0), (2, None)], "id int, y int"), "id", "y")
    same = spark.range(100).select(F.lit(1).alias("id"), (F.col("id") % 2).cast("int").alias("y"))
    with pytest.raises(ValueError, match="not unique"):
        stratified_split(same, "id", "y")


def test_hash_cut_equals_a_full_sort(spark):
    df = spark.range(5000).select("id", F.lit("g").alias("g"), keyed_hash(1, "x", "id").alias("h"))
    rows = sorted((r["h"], r["id"]) for r in df.collect())
    for quota in (0, 1, 17, 4999, 5000):
        bounds = hash_cuts(df, F.col("g"), F.col("h"), {"g": quota})
        picked = {r["id"] for r in df.filter(below(F.col("g"), F.col("h"), bounds)).collect()}
        assert picked == {i for _, i in rows[:quota]}
    with pytest.raises(ValueError, match="fewer"):
        hash_cuts(df, F.col("g"), F.col("h"), {"g": 5001})


def test_downsample_is_exact_and_skips_unknown(spark):
    df = spark.range(1000).select(
        "id", (F.col("id") % 2).cast("int").alias("y"),
        F.when(F.col("id") < 100, "Unknown").when(F.col("id") < 400, "A").otherwise("B").alias("c"),
    )
    order = [(y, c) for y in (0, 1) for c in ("A", "B")]
    out = downsample(df, "id", ["y", "c"], order, 100)
    counts = {(r["y"], r["c"]): r["count"] for r in out.groupBy("y", "c").count().collect()}
    assert counts == {(0, "A"): 17, (1, "A"): 17, (0, "B"): 33, (1, "B"): 33}
    assert out.select("id").distinct().count() == 100
    with pytest.raises(ValueError, match="without replacement"):
        downsample(df, "id", ["y", "c"], order, 901)
    shuffled = [r["id"] for r in downsample(df, "id", ["y", "c"], order, 100, shuffle=True).collect()]
    assert set(shuffled) == {r["id"] for r in out.collect()} and shuffled != sorted(shuffled)


def test_numbers_are_dense_per_pool(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("p"))
    out = number_rows(df, "id", "p", {"a": 0, "b": 1000}, 42, "n")
    a = sorted(r["number"] for r in out.filter("p = 'a'").collect())
    b = sorted(r["number"] for r in out.filter("p = 'b'").collect())
    assert a == list(range(1000)) and b == list(range(1000, 3000))


def test_allocate_table(spark):
    df = spark.createDataFrame([(0, "A")] * 3 + [(1, "A")] * 1, "y int, c string")
    rows = allocate(df, ["y", "c"], [(0, "A"), (0, "B"), (1, "A")], 10).collect()
    assert [tuple(r) for r in rows] == [(0, "A", 3, 8), (0, "B", 0, 0), (1, "A", 1, 2)]
