import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinline.operators import shards


def greedy(weights, budget):
    """Shard of each batch, by the rule as it is told."""
    shard, filled, out = 0, 0, []
    for w in weights:
        out.append(shard)
        filled += w
        if filled >= budget:
            shard, filled = shard + 1, 0
    return out


def by_chunks(weights, budget, chunk):
    """The same through the steps that Spark distributes."""
    table = pd.DataFrame({"batch": np.arange(len(weights)), "weight": weights})
    table["chunk"] = table["batch"] // chunk
    pieces = pd.concat(shards._summarise(part, budget) for _, part in table.groupby("chunk"))
    rounds, fan = [pieces.assign(group=pieces["chunk"] // 3)], 3
    while rounds[-1]["chunk"].max() > 0:
        up = pd.concat(shards._composed(part, budget) for _, part in rounds[-1].groupby("group"))
        assert (up["upto"].groupby(up["chunk"]).is_monotonic_increasing).all()
        rounds.append(up.assign(group=up["chunk"] // fan))
    entries = pd.DataFrame([(0, 0, 0)], columns=["chunk", "shard_in", "carry_in"])
    for members in rounds[-2::-1]:
        given = members.merge(entries.rename(columns={"chunk": "group"}), on="group")
        entries = pd.concat(shards._chain(part, budget) for _, part in given.groupby("group"))
    runs = pd.concat(shards._cut(part, budget) for _, part in table.merge(entries, on="chunk").groupby("chunk"))
    out = np.full(len(weights), -1)
    for shard, first, last in runs.itertuples(index=False):
        assert (out[first : last + 1] == -1).all()
        out[first : last + 1] = shard
    return out.tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=60), st.integers(1, 200), st.integers(1, 61))
def test_chunks_give_the_greedy_rule(weights, budget, chunk):
    assert by_chunks(weights, budget, chunk) == greedy(weights, budget)


@pytest.mark.parametrize("chunk, budget", [(1 << 20, 100), (7, 100), (3, 1), (50, 10**6)])
def test_shard_by_weight(spark, partitions, chunk, budget):
    rng = random.Random(chunk)
    rows = [(i, i // 4, rng.choice([0, 3, 9, 50])) for i in range(600)]
    df = spark.createDataFrame(rows, "row_idx long, batch_id long, n int")
    got = shards.shard_by_weight(df, shards.batch_weights(df, F.col("n")), budget, chunk=chunk, fan=2, most=3)
    weights = [sum(n for _, b, n in rows if b == batch) for batch in range(150)]
    expected = greedy(weights, budget)
    assert {r.row_idx: r.shard_id for r in got.collect()} == {i: expected[b] for i, b, _ in rows}


def test_missing_batches_are_skipped(spark):
    df = spark.createDataFrame([(0, 0, 5), (1, 3, 5), (2, 9, 5)], "row_idx long, batch_id long, n int")
    got = shards.shard_by_weight(df, shards.batch_weights(df, F.col("n")), 10)
    assert {r.row_idx: r.shard_id for r in got.collect()} == {0: 0, 1: 0, 2: 1}


def test_summaries_stay_short():
    """A composed summary has no more rows than batches fit into a budget."""
    rng = np.random.default_rng(1)
    table = pd.DataFrame({"batch": np.arange(5_000), "weight": rng.integers(1, 9, 5_000)})
    table["chunk"] = table["batch"] // 50
    pieces = pd.concat(shards._summarise(part, 300) for _, part in table.groupby("chunk"))  # a budget above a chunk
    assert len(shards._composed(pieces.assign(group=0), 300)) <= 302


def test_no_key_of_the_lookup_is_crowded(spark, partitions):
    """All heavy batches lie in one region: their segments are single batches, the others are long."""
    runs = [(i, 10 * i, 10 * i + 9_999) if i == 0 else (i, 9_999 + i, 9_999 + i) for i in range(500)] + [(500, 10_499, 60_000)]
    segments = spark.createDataFrame(runs, shards.SEGMENT)
    heavy, span, lookup = shards.interval_index(segments, 8)
    assert heavy.count() > 0
    assert lookup.groupBy("_key").count().agg(F.max("count")).first()[0] <= 8
    assert lookup.count() <= 3 * 501 + 60_001 // 8 + span
    df = spark.range(60_001).withColumnRenamed("id", "batch_id")
    weights = df.select(F.col("batch_id").alias("batch"), F.when(F.col("batch_id").between(9_999, 10_497), 100).otherwise(1).cast("long").alias("weight"))
    got = {r.batch_id: r.shard_id for r in shards.shard_by_weight(df, weights, 100, chunk=5_000, fan=4, most=8).collect()}
    assert [got[i] for i in range(60_001)] == greedy([100 if 9_999 <= i <= 10_497 else 1 for i in range(60_001)], 100)


def test_no_stage_has_one_task_on_data(spark):
    df = spark.range(100).withColumnRenamed("id", "batch_id")
    plan = shards.shard_by_weight(df, shards.batch_weights(df, F.lit(1)), 7, chunk=5)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "RoundRobin" not in plan


def test_budget_must_be_positive(spark):
    with pytest.raises(ValueError):
        shards.shard_by_weight(spark.range(1), spark.range(1), 0)


@pytest.mark.parametrize("rows, batch", [(64, 32), (100, 32), (32, 32), (1, 32)])
def test_shard_by_rows_is_the_greedy_rule(spark, rows, batch):
    n = 500
    weights = [min(batch, n - b) for b in range(0, n, batch)]
    expected = greedy(weights, rows)
    got = shards.shard_by_rows(spark.range(n).withColumnRenamed("id", "row_idx"), rows, batch).collect()
    assert {r.row_idx: r.shard_id for r in got} == {i: expected[i // batch] for i in range(n)}


def test_a_small_corpus_is_all_val(spark):
    df = shards.split_by_shard(shards.shard_by_rows(spark.range(50).withColumnRenamed("id", "row_idx")))
    assert [tuple(r) for r in df.groupBy("split").count().collect()] == [("val", 50)]
