import random

import pytest
from pyspark.sql import functions as F

from twinline.operators import order
from twinline.operators.pairing import zip_rows
from twinline.session import settle


def side(spark, n, name, parts):
    rows = [(None if i % 3 == 0 else i // 4, f"{name}{i}") for i in range(n)]
    return spark.createDataFrame(rows, f"{name}_id long, {name} string").repartitionByRange(parts, F.substr(name, F.lit(2)).cast("int"))


@pytest.mark.parametrize("n, m, parts", [(50, 50, (3, 5)), (40, 55, (1, 4)), (55, 40, (7, 2)), (0, 5, (1, 1)), (5, 0, (2, 1))])
def test_rows_meet_by_place(spark, n, m, parts):
    got = zip_rows(side(spark, n, "a", parts[0]), side(spark, m, "b", parts[1])).collect()
    assert sorted((r.a, r.b) for r in got) == sorted((f"a{i}", f"b{i}") for i in range(min(n, m)))
    assert all(r.a_id == r.b_id for r in got)


def test_lengths_can_be_asked_to_agree(spark):
    a, b = side(spark, 4, "a", 2), side(spark, 5, "b", 2)
    with pytest.raises(ValueError):
        zip_rows(a, b, ragged="error")
    with pytest.raises(ValueError):
        zip_rows(a, b, ragged="no such rule")
    with pytest.raises(ValueError):
        zip_rows(a, a)
    assert zip_rows(a, side(spark, 4, "b", 3), ragged="error").count() == 4


def test_by_key(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, s string")
    assert sorted(tuple(r) for r in zip_rows(a, a.withColumnRenamed("s", "t"), "id").collect()) == [(1, "x", "x"), (2, "y", "y")]


def test_files_are_numbered_in_name_order_without_a_sort(spark):
    rows = settle(spark.range(1000).repartitionByRange(9, "id").sortWithinPartitions("id"), "numbered")
    numbered = order.number_files(rows)
    assert {r.pos: r.id for r in numbered.collect()} == {i: i for i in range(1000)}
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan.replace("SortMergeJoin", "") and "SinglePartition" not in plan


def test_rows_lost_between_the_passes_stop_the_job(spark, tmp_path):
    path = str(tmp_path / "a")
    spark.range(20).select(F.col("id").cast("string").alias("a")).coalesce(1).write.text(path)
    a = spark.read.text(path).withColumnRenamed("value", "a")
    both = zip_rows(a, side(spark, 20, "b", 2), numbered=lambda df, c: order.number_files(df, c) if "a" in df.columns else order.number_rows(df, c))
    (file,) = (tmp_path / "a").glob("part-*")
    file.write_text("".join(f"{i}\n" for i in range(12)))
    (tmp_path / "a" / f".{file.name}.crc").unlink()
    with pytest.raises(Exception, match="lost rows|moved between"):
        both.collect()


@pytest.mark.parametrize("span", [3, 70_000, 1 << 40, 1 << 63])
def test_rank_of_whole_numbers(spark, span, monkeypatch):
    monkeypatch.setattr(order, "FEW", 5)
    rng = random.Random(span)
    keys = [rng.randrange(-span, span) for _ in range(400)] + [-span, span - 1] + [0] * 40
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i int").repartition(3)
    expected = sorted((k, i) for i, k in enumerate(keys))
    for rank in (1, 199, 222, 442):
        assert order.key_at_rank(df, "k", lambda _: rank, ["i"]) == expected[rank - 1]


def test_rank_of_strings(spark, monkeypatch):
    monkeypatch.setattr(order, "FEW", 3)
    rng = random.Random(4)
    keys = ["".join(rng.choices("ab é中", k=rng.randint(0, 6))) for _ in range(150)] + ["ab"] * 20 + [None]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i long")
    expected = sorted(((k, i) for i, k in enumerate(keys) if k is not None), key=lambda r: (r[0].encode(), r[1]))
    for rank in (1, 60, 100, 170):
        assert order.key_at_rank(df, "k", lambda _: rank, ["i"]) == expected[rank - 1]
    assert order.key_at_rank(df, "k", lambda _: 171, ["i"]) is None


def test_many_equal_keys_are_told_apart_by_the_next(spark):
    df = spark.range(50_000).select(F.lit("same").alias("k"), "id")
    assert order.key_at_rank(df, "k", lambda n: n // 2, ["id"]) == ("same", 24_999)


def test_other_keys_are_refused(spark, monkeypatch):
    monkeypatch.setattr(order, "FEW", 1)
    with pytest.raises(TypeError):
        order.key_at_rank(spark.createDataFrame([(1.5,), (2.5,)], "k double"), "k", lambda n: 1)


def test_nothing_is_sorted_to_find_a_rank(spark):
    df = spark.range(30_000)
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("rank", "rank")
    assert order.key_at_rank(df, "id", lambda n: 12_345) == (12_344,)
    jobs = len(tracker.getJobIdsForGroup("rank"))
    assert jobs <= 10, jobs
    context.setJobGroup("", "")
