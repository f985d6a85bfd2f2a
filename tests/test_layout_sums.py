import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from twinline.functions.tokens import token_count
from twinline.operators import batches, order
from twinline.session import settle

WEIGHTS = [random.Random(3).randrange(9) for _ in range(2000)]
SUMS = [0, *accumulate(WEIGHTS)][:-1]


def rows(spark):
    return spark.createDataFrame([(i, w, f"line {i}" * (i % 4)) for i, w in enumerate(WEIGHTS)], "k long, w int, text string")


def in_order(spark, parts):
    return settle(rows(spark).repartitionByRange(parts, "k").sortWithinPartitions("k"), "sorted")


@pytest.fixture(params=[100, 400, 1 << 20])
def batch_rows(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(request.param))
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("key", [(), ("k",), ("g", "k")])
@pytest.mark.parametrize("parts", [1, 9])
def test_sums_follow_the_layout_without_a_sort(spark, batch_rows, parts, key):
    df = in_order(spark, parts).withColumn("g", F.floor(F.col("k") / 77))
    summed = order.sum_files(df, F.col("w"), "s", key)
    assert {r.k: r.s for r in summed.collect()} == dict(enumerate(SUMS))
    assert summed.columns == ["k", "w", "text", "g", "s"]
    plan = summed._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Sort", "Exchange hash", "Exchange range", "Exchange Single"))


def test_a_file_of_several_splits(spark, tmp_path):
    df = spark.createDataFrame([(f"{i:06d}",) for i in range(4000)], "value string").coalesce(1)
    df.write.text(str(tmp_path / "a"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = spark.read.text(str(tmp_path / "a"))
        assert lines.rdd.getNumPartitions() > 5
        got = order.sum_files(lines, F.lit(2), "s", ["value"]).collect()
        assert {int(r.value): r.s for r in got} == {i: 2 * i for i in range(4000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_files_that_overlap_are_summed_by_key(spark, partitions):
    df = settle(rows(spark).repartition(5), "dealt")
    assert {r.k: r.s for r in order.sum_files(df, F.col("w"), "s", ["k"]).collect()} == dict(enumerate(SUMS))


def test_a_file_out_of_order_and_a_repeated_key_stop_the_job(spark):
    down = settle(rows(spark).coalesce(1).sortWithinPartitions(F.desc("k")), "down")
    twice = settle(rows(spark).withColumn("k", F.floor(F.col("k") / 2)).coalesce(1).sortWithinPartitions("k"), "twice")
    for df in (down, twice):
        with pytest.raises(Exception, match="not sorted"):
            order.sum_files(df, F.col("w"), "s", ["k"]).collect()


@pytest.mark.parametrize("left", [0, 12, 30])
def test_rows_lost_or_added_between_the_passes_stop_the_job(spark, tmp_path, left):
    path = str(tmp_path / "a")
    spark.range(20).select(F.col("id").cast("string").alias("a")).coalesce(1).write.text(path)
    summed = order.sum_files(spark.read.text(path), F.lit(1), "s")
    (file,) = (tmp_path / "a").glob("part-*")
    file.write_text("".join(f"{i}\n" for i in range(left)))
    (tmp_path / "a" / f".{file.name}.crc").unlink()
    if left:
        with pytest.raises(Exception, match="moved between"):
            summed.collect()
    else:
        assert summed.collect() == []


def test_empty_tables_and_null_weights(spark):
    empty = settle(rows(spark).filter("k < 0"), "none")
    assert order.sum_files(empty, F.col("w"), "s", ["k"]).count() == 0
    some = settle(spark.createDataFrame([(1, None), (2, 5), (3, 1)], "k long, w int").coalesce(1), "some")
    assert [r.s for r in order.sum_files(some, F.col("w"), "s", ["k"]).orderBy("k").collect()] == [0, 0, 5]


@pytest.mark.parametrize("block", [7, 1024])
def test_packing_by_layout_equals_packing_by_sort(spark, block):
    df = in_order(spark, 6)
    by_layout = batches.pack_sequences(df, "text", block, "k", False, in_files=True).orderBy("block_id").collect()
    assert by_layout == batches.pack_sequences(df, "text", block, "k", False).orderBy("block_id").collect()
    assert sum(len(r.input_ids) for r in by_layout) == df.agg(F.sum(token_count("text"))).first()[0]
