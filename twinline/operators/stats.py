"""Length statistics and progress totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinline.functions.tokens import token_count


def length_stats(df: DataFrame, src: str = "src", tgt: str = "tgt", by: str | None = None) -> DataFrame:
    """Smallest, largest and mean token count of both sides, end mark not counted."""
    aggs = []
    for side, column in (("src", src), ("tgt", tgt)):
        n = token_count(column, eos=False)
        aggs += [F.min(n).alias(f"{side}_min"), F.max(n).alias(f"{side}_max"), F.avg(n).alias(f"{side}_avg")]
    return df.groupBy(*([by] if by else [])).agg(*aggs)


def cut_share(df: DataFrame, max_length: int, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Pairs and how many of them a cut to ``max_length`` tokens shortens, per side."""
    return df.agg(
        F.count("*").alias("pairs"),
        _count_if(token_count(src) > max_length).alias("src_cut"),
        _count_if(token_count(tgt) > max_length).alias("tgt_cut"),
    )


def planned_batches(df: DataFrame, size: int, cap: int) -> DataFrame:
    """Pairs found and the number of full batches that will be cut from them."""
    pairs = F.count("*")
    full = F.least(F.floor(pairs / size), F.lit(cap // size))
    return df.agg(pairs.alias("pairs"), full.cast("long").alias("batches"))


def _count_if(c: Column) -> Column:
    return F.count_if(c)
