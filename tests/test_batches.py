import random

import pytest
from pyspark.sql import functions as F

from twinline.functions.tokens import token_count
from twinline.operators import batches, stats


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(9)
    rows = [(i, "한a "[: rng.randrange(4)] * rng.randrange(40)) for i in range(300)]
    rows[17] = (17, "x" * 5000)
    return rows, spark.createDataFrame(rows, "row_idx long, text string").repartition(5)


@pytest.mark.parametrize("block", [1, 7, 64, 1024])
def test_pack_sequences(texts, partitions, block):
    rows, df = texts
    stream = [x for _, t in rows for x in [b + 3 for b in t.encode()] + [1]]
    packed = batches.pack_sequences(df, "text", block).orderBy("block_id").collect()
    assert [r.block_id for r in packed] == list(range(len(stream) // block))
    assert [x for r in packed for x in r.input_ids] == stream[: len(stream) // block * block]


def test_pack_keeps_the_last_block_when_asked(texts):
    rows, df = texts
    packed = batches.pack_sequences(df, "text", 1000, drop_last=False).orderBy("block_id").collect()
    assert sum(len(r.input_ids) for r in packed) == sum(len(t.encode()) + 1 for _, t in rows)


def test_length_batches_waste_less_than_row_batches(texts):
    _, df = texts
    sized = df.withColumn("length", token_count("text"))
    fill = [
        batches.padding_report(b).agg(F.sum("fill"), F.sum("rows"), F.max("rows")).first()
        for b in (batches.length_batches(sized, 32), batches.micro_batches(sized, 32))
    ]
    assert fill[0][0] < fill[1][0]
    assert all(f[1] == 300 and f[2] == 32 for f in fill)


def test_pad_longest_and_fixed(spark):
    rows = [(i, "a" * (i % 7), "b" * (i % 5)) for i in range(40)]
    df = batches.micro_batches(spark.createDataFrame(rows, "row_idx long, s string, t string"), 8)
    for r in batches.pad_longest(df, "s", "t", 6).collect():
        mates = [x for x in rows if x[0] // 8 == r.batch_id]
        assert len(r.input_ids) == len(r.attention_mask) == min(6, max(len(x[1]) for x in mates) + 1)
        assert len(r.labels) == min(6, max(len(x[2]) for x in mates) + 1)
        assert sum(r.attention_mask) == min(6, len(rows[r.row_idx][1]) + 1)
        assert r.labels.count(-100) == len(r.labels) - min(6, len(rows[r.row_idx][2]) + 1)
    for r in batches.tokenize_fixed(df, F.col("s"), F.col("t"), 6).collect():
        assert len(r.input_ids) == len(r.labels) == 6 and r.labels.count(-100) == 0


def test_stats(spark):
    df = spark.createDataFrame([("a", "한국"), ("bbb", "c")], "src string, tgt string")
    assert tuple(stats.length_stats(df).first()) == (1, 3, 2.0, 1, 6, 3.5)
    assert tuple(stats.cut_share(df, 3).first()) == (2, 1, 1)
    assert tuple(stats.planned_batches(spark.range(70), 32, 10**7).first()) == (70, 2)
    assert tuple(stats.planned_batches(spark.range(70), 32, 40).first()) == (70, 1)
