"""The step-metric trace on a stream, for runs that are still going on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.operators.filters import sample_steps
from twinline.operators.traces import is_high


def live_alerts(stream: DataFrame, capacity: float, step: str = "step", value: str = "value", every: int = 100) -> DataFrame:
    """Logged steps above the alert share. Stateless, so it runs in append mode."""
    return sample_steps(stream, step, every).filter(is_high(F.col(value), capacity))


def live_peaks(stream: DataFrame, run: str = "run", step: str = "step", value: str = "value", every: int = 100) -> DataFrame:
    """Latest logged step and peak per run. The state is one row per run; use update or complete mode."""
    return (
        sample_steps(stream, step, every)
        .groupBy(run)
        .agg(F.max(step).alias("last_step"), F.max(value).alias("peak"))
    )
