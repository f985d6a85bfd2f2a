"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.session import settle


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)`` but the roots; a root is the smallest node of its component.

    Every step is a minimum per node and a join; no component is gathered. The
    links are written after each round, which also cuts lineage.
    """
    kind = links.schema["a"].dataType
    links = settle(_ordered(links), "links")
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _ordered(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        new = settle(_ordered(small), "links")
        if _digest(new) == _digest(links):
            return new.select(F.col("a").cast(kind).alias("node"), F.col("b").cast(kind).alias("root"))
        links = new


def _ordered(links: DataFrame) -> DataFrame:
    ends = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return ends.filter("a <> b").distinct()


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())
