import hashlib
import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from twinline.operators import order
from twinline.operators.splits import random_split


def skewed(n=3000):
    """Rows of which a third share one group and one length."""
    rng = random.Random(5)
    return [(i, "hot" if i % 3 == 0 else f"g{rng.randrange(40)}", 7 if i % 3 == 0 else rng.randrange(50)) for i in range(n)]


@pytest.fixture(scope="module")
def frame(spark):
    rows = skewed()
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "k long, g string, n int").repartition(6)


def test_index_rows(frame, partitions):
    got = order.index_rows(frame, ["g", "k"]).orderBy("row_idx").collect()
    expected = sorted(skewed(), key=lambda r: (r[1], r[0]))
    assert [tuple(r) for r in got] == [(i, *r) for i, r in enumerate(expected)]


def test_index_rows_within(frame, partitions):
    got = order.index_rows(frame, ["k"], within="g", column="at").collect()
    seen = {}
    for k, g, _ in skewed():
        seen.setdefault(g, []).append(k)
    assert {(r.g, r.k): r["at"] for r in got} == {(g, k): i for g, ks in seen.items() for i, k in enumerate(ks)}


def test_prefix_sum(frame, partitions):
    got = {r.k: r.s for r in order.prefix_sum(frame, "k", F.col("n"), "s").collect()}
    sizes = [n for _, _, n in skewed()]
    assert got == dict(enumerate([0, *accumulate(sizes)][:-1]))


def test_prefix_sum_of_sparse_keys(frame):
    sparse = frame.withColumn("k", F.col("k") * F.col("k") * 1000)
    got = {r.k: r.s for r in order.prefix_sum(sparse, "k", F.col("n"), "s").collect()}
    sizes = [n for _, _, n in skewed()]
    assert got == {k * k * 1000: s for k, s in enumerate([0, *accumulate(sizes)][:-1])}
    assert order.prefix_sum(sparse, "k", F.col("n"), "s").columns == ["k", "g", "n", "s"]


def test_running_max_by_group(frame):
    got = {r.k: r.m for r in order.running_max(frame, "k", F.col("n"), "m", by="g").collect()}
    top, expected = {}, {}
    for k, g, n in skewed():
        top[g] = max(top.get(g, n), n)
        expected[k] = top[g]
    assert got == expected


@pytest.mark.parametrize("k", [0, 1, 2, 777, 2999, 3000, 3001])
def test_cap_rows(frame, k):
    kept = sorted(r.k for r in order.cap_rows(frame, k, "k").collect())
    assert kept == list(range(min(k, 3000)))


def test_key_at_rank_with_ties(frame):
    expected = sorted((n, k) for k, _, n in skewed())
    for rank in (1, 400, 1500, 3000):
        assert order.key_at_rank(frame, "n", lambda _: rank, ["k"]) == expected[rank - 1]


def test_key_at_rank_of_wide_keys(spark):
    keys = [random.Random(i).randrange(1 << 60) for i in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for rank in (1, 250, 500):
        assert order.key_at_rank(df, "k", lambda _: rank)[0] == sorted(keys)[rank - 1]


def test_key_at_rank_of_one_value(spark):
    df = spark.range(50_000).select(F.lit(7).alias("n"), "id")
    assert order.key_at_rank(df, "n", lambda total: total // 2, ["id"]) == (7, 24_999)
    assert order.key_at_rank(df, "n", lambda total: total)[0] == 7


def test_prefix_sum_of_negative_and_far_off_keys(spark, partitions):
    keys = [-(1 << 62), -5, -4, 0, 3, 10**6, 1 << 62, *range(100, 400)]
    df = spark.createDataFrame([(k, 1) for k in keys], "k long, n int")
    got = {r.k: r.s for r in order.prefix_sum(df, "k", F.col("n"), "s").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_rank_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "row_idx long")
    assert order.cap_rows(empty, 5).count() == 0
    assert order.prefix_sum(empty, "row_idx", F.lit(1), "s").count() == 0
    assert order.index_rows(empty.withColumnRenamed("row_idx", "k"), ["k"]).count() == 0


def test_length_rank(frame, partitions):
    got = {r.k: r["rank"] for r in order.length_rank(frame, "n", "k").collect()}
    expected = sorted((n, k) for k, _, n in skewed())
    assert got == {k: i for i, (_, k) in enumerate(expected)}


def test_length_rank_by(frame):
    got = {r.k: r["rank"] for r in order.length_rank(frame, "n", "k", by="g").collect()}
    seen = {}
    for k, g, n in skewed():
        seen.setdefault(g, []).append((n, k))
    assert got == {k: i for rows in seen.values() for i, (_, k) in enumerate(sorted(rows))}


def test_length_sort(frame):
    got = [(r.length, r.k) for r in order.length_sort(frame, F.col("n"), "k").collect()]
    assert got == sorted((n, k) for k, _, n in skewed())


@pytest.mark.parametrize("share", [-0.1, 1.5])
def test_random_split_wants_a_share(spark, share):
    with pytest.raises(ValueError):
        random_split(spark.range(3).select(F.col("id").cast("string").alias("id")), share)


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 999])
def test_random_split_is_exact_and_repeatable(spark, n):
    df = spark.range(n).select(F.col("id").cast("string").alias("id"))
    first, again, other = (random_split(df, 0.2, seed).filter("split = 'test'") for seed in (3, 3, 4))
    ids = {r.id for r in first.collect()}
    assert len(ids) == -(-n // 5)
    digests = sorted((hashlib.md5(f"3|{i}".encode()).hexdigest(), str(i)) for i in range(n))
    assert ids == {i for _, i in digests[: len(ids)]} == {r.id for r in again.collect()}
    assert n < 900 or ids != {r.id for r in other.collect()}


def test_no_task_scans_all_rows(frame):
    """Windows over rows are always cut by a cell."""
    plan = order.prefix_sum(frame, "k", F.col("n"), "s")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") == 1  # the table of cells
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
