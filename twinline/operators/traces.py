"""Peaks and alerts of a metric that is logged step by step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinline.operators.filters import sample_steps
from twinline.operators.order import running_max
from twinline.session import settle

ALERT_SHARE = 0.85


def is_high(value: Column, capacity: Column | float) -> Column:
    """Whether a value is above the share of the capacity that calls for an alert."""
    return value > (F.lit(capacity) if isinstance(capacity, (int, float)) else capacity) * ALERT_SHARE


def peak_trace(
    df: DataFrame,
    capacity: float,
    run: str = "run",
    step: str = "step",
    value: str = "value",
    time: str | None = None,
    every: int = 100,
) -> DataFrame:
    """Every ``every``-th step of each run with its running peak, alert flag and, given ``time``, elapsed seconds.

    A long run is scanned in cells of its steps, so it does not fall to one task.
    """
    logged = sample_steps(df, step, every)
    trace = running_max(logged, step, F.col(value), "peak", by=run).withColumn("alert", is_high(F.col(value), capacity))
    if time is None:
        return trace
    begin = settle(df.groupBy(run).agg(F.min(time).alias("_begin")), "begin")
    seconds = (F.col(time) - F.col("_begin")).cast("interval second").cast("decimal(18,6)").cast("double")
    return trace.join(begin, run).withColumn("elapsed", seconds).drop("_begin")


def peak_alerts(trace: DataFrame, run: str = "run", value: str = "value") -> DataFrame:
    """Logged steps, alerts and the peak of each run."""
    return trace.groupBy(run).agg(
        F.count("*").alias("steps"), F.count_if("alert").alias("alerts"), F.max(value).alias("peak")
    )
