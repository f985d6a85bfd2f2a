from pyspark.sql import functions as F

from twinline.operators import filters, traces
from twinline.schemas import PAIRS, require, require_schema
from twinline.streaming.live_trace import live_alerts, live_peaks

import pytest


def test_drop_empty_and_quarantine(spark):
    df = spark.createDataFrame([(0, "a", "b"), (1, "", "b"), (2, "a", None), (3, None, "")], "i int, src string, tgt string")
    assert [r.i for r in filters.drop_empty(df).collect()] == [0]
    rules = {"src": ~filters.filled("src"), "tgt": ~filters.filled("tgt")}
    good, bad = filters.quarantine(df, rules)
    assert [r.i for r in good.collect()] == [0]
    assert {r.i: r.reasons for r in bad.collect()} == {1: ["src"], 2: ["tgt"], 3: ["src", "tgt"]}


def test_length_filter_counts_the_end_mark(spark):
    df = spark.createDataFrame([(0, "abc", "d"), (1, "abcd", "d"), (2, "a", "한국")], "i int, src string, tgt string")
    assert [r.i for r in filters.length_filter(df, 4).collect()] == [0]


def test_head_sample(spark):
    df = spark.range(100).repartition(7).withColumnRenamed("id", "row_idx")
    assert [r.row_idx for r in filters.head_sample(df).collect()] == [0, 1, 2]


def test_schema_checks(spark):
    df = spark.range(1).withColumn("id", F.col("id"))
    with pytest.raises(ValueError, match="missing"):
        require(df, "x")
    with pytest.raises(ValueError, match="wanted string"):
        require_schema(df.withColumn("translation", F.struct(F.lit("a").alias("src"), F.lit("b").alias("tgt"))), PAIRS)


def steps(spark):
    return [(run, i, float((i * 7919) % 1000)) for run in ("hot", "cold") for i in range(5000 if run == "hot" else 300)]


def test_peak_trace(spark):
    rows = steps(spark)
    df = spark.createDataFrame(rows, "run string, step long, value double").repartition(5)
    got = {(r.run, r.step): (r.peak, r.alert) for r in traces.peak_trace(df, 1000).collect()}
    top, expected = {}, {}
    for run, step, value in rows:
        if step % 100 == 0:
            top[run] = max(top.get(run, value), value)
            expected[run, step] = (top[run], value > 850)
    assert got == expected
    summary = {r.run: (r.steps, r.peak) for r in traces.peak_alerts(traces.peak_trace(df, 1000)).collect()}
    assert summary == {"hot": (50, top["hot"]), "cold": (3, top["cold"])}


def test_live_trace(spark, tmp_path):
    df = spark.createDataFrame(steps(spark), "run string, step long, value double")
    source = str(tmp_path / "steps")
    df.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    for name, out, mode in (("peaks", live_peaks(stream), "complete"), ("alerts", live_alerts(stream, 1000), "append")):
        query = (
            out.writeStream.format("memory").queryName(name).outputMode(mode)
            .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    trace = traces.peak_trace(df, 1000)
    assert sorted(map(tuple, spark.table("peaks").collect())) == sorted(
        map(tuple, trace.groupBy("run").agg(F.max("step"), F.max("peak")).collect())
    )
    assert spark.table("alerts").count() == trace.filter("alert").count()
