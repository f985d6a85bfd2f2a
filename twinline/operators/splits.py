"""Exact, repeatable random splits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.operators.order import key_at_rank


def random_split(df: DataFrame, test_size: float = 0.2, seed: int = 0, key: str = "id") -> DataFrame:
    """Add ``split``: exactly ceil(test_size · n) rows are ``test``, the others ``train``.

    Rows are ranked by a hash of seed and key, a unique string. Only the hash at
    the border rank is looked up; the rows themselves are not moved.
    """
    if not 0 <= test_size <= 1:
        raise ValueError("test_size must be a share between 0 and 1")
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key)))
    ranked = df.select(digest.alias("digest"), F.col(key).alias("key"))
    border = key_at_rank(ranked, "digest", lambda n: math.ceil(test_size * n), ["key"])
    if border is None:
        return df.withColumn("split", F.lit("train"))
    last_digest, last_key = (F.lit(x) for x in border)
    inside = (digest < last_digest) | ((digest == last_digest) & (F.col(key) <= last_key))
    return df.withColumn("split", F.when(inside, "test").otherwise("train"))
