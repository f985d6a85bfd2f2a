"""Row filters, caps and samples."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinline.functions.tokens import token_count
from twinline.operators.order import cap_rows
from twinline.operators.pairing import within_budget


def drop_empty(df: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Keep pairs with text on both sides."""
    return df.filter(filled(src) & filled(tgt))


def filled(c: str) -> Column:
    """Whether a text is present and not empty."""
    return F.coalesce(F.col(c) != "", F.lit(False))


def length_filter(df: DataFrame, max_length: Column | int, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Keep pairs whose sides both have at most ``max_length`` tokens, end mark included."""
    return df.filter(within_budget(token_count(src), token_count(tgt), max_length))


def cap_pairs(df: DataFrame, max_pairs: int = 10**7, key: str = "row_idx") -> DataFrame:
    """Keep exactly the first ``max_pairs`` rows in row order."""
    return cap_rows(df, max_pairs, key)


def head_sample(df: DataFrame, n: int = 3, key: str = "row_idx") -> DataFrame:
    """The first ``n`` rows in row order, found without sorting the table."""
    return df.orderBy(key).limit(n)


def quarantine(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split into good rows and bad rows; bad rows carry the names of the rules they break."""
    broken = F.filter(
        F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), lambda r: r.isNotNull()
    )
    marked = df.withColumn("reasons", broken)
    good = marked.filter(F.size("reasons") == 0).drop("reasons")
    return good, marked.filter(F.size("reasons") > 0)


def sample_steps(df: DataFrame, step: str = "step", every: int = 100) -> DataFrame:
    """Keep every ``every``-th step."""
    return df.filter(F.col(step) % every == 0)
