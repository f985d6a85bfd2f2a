"""Positional joins, concatenation and lookups by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinline.operators.order import number_rows
from twinline.session import settle

RAGGED = ("drop_batch", "truncate", "error")

BUDGET_SCHEMA = (
    "profile string, name string, memory_gb int, batch_size int, gradient_accumulation int, "
    "fp16 boolean, bf16 boolean, gradient_checkpointing boolean, max_length int, learning_rate double"
)
# The batch and length budgets that the named profiles stand for.
BUDGETS = [
    ("4090", "RTX 4090", 24, 24, 4, True, False, True, 128, 3e-4),
    ("A100_40", "A100 40GB", 40, 48, 2, False, True, True, 256, 3e-4),
    ("A100_80", "A100 80GB", 80, 96, 1, False, True, False, 512, 4e-4),
    ("H100", "H100", 80, 128, 1, False, True, False, 512, 5e-4),
]


def kept_lines(counts: DataFrame, ragged: str = "drop_batch", batch: int = 32) -> DataFrame:
    """Add ``kept``, the leading lines of a file pair with ``n_src`` and ``n_tgt`` lines that are paired.

    ``truncate`` keeps as many as both sides have. ``drop_batch`` also drops the
    short last batch when the sides differ. For ``error`` see :func:`check_even`.
    """
    if ragged not in RAGGED:
        raise ValueError(f"ragged must be one of {RAGGED}")
    both = F.least("n_src", "n_tgt")
    if ragged == "drop_batch":
        both = F.when(F.col("n_src") == F.col("n_tgt"), both).otherwise(both - both % batch)
    return counts.withColumn("kept", both)


def zip_numbered(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Join two numbered sides on ``(file_pair, line_no)``. Each key is unique, so no key is heavy."""
    return src.join(tgt, ["file_pair", "line_no"])


def zip_lines(src: DataFrame, tgt: DataFrame, ragged: str = "drop_batch", batch: int = 32) -> DataFrame:
    """Zip two sides ``(file_pair, line_no, text)`` to ``(file_pair, line_no, src, tgt)``.

    The kept length of each file pair comes from a small aggregate, and is
    applied before the join so that dropped lines are not shuffled.
    """
    src = src.select("file_pair", "line_no", F.col("text").alias("src"))
    tgt = tgt.select("file_pair", "line_no", F.col("text").alias("tgt"))
    if ragged == "truncate":
        return zip_numbered(src, tgt)
    lines = concat([side.select("file_pair", F.lit(n).alias("is_src")) for n, side in ((1, src), (0, tgt))])
    counts = lines.groupBy("file_pair").agg(
        F.sum("is_src").alias("n_src"), F.sum(1 - F.col("is_src")).alias("n_tgt")
    )
    kept = settle(kept_lines(counts, ragged, batch), "kept")
    check_even(kept, ragged)
    src = src.join(kept.select("file_pair", "kept"), "file_pair").filter(F.col("line_no") < F.col("kept"))
    return zip_numbered(src.drop("kept"), tgt)


def check_even(counts: DataFrame, ragged: str) -> None:
    """Raise under the ``error`` rule when some pair of files differs in length."""
    if ragged == "error" and not counts.filter("n_src <> n_tgt").isEmpty():
        raise ValueError("paired files differ in their number of lines")


def zip_rows(
    a: DataFrame, b: DataFrame, key: str | None = None, ragged: str = "truncate", numbered: Callable[[DataFrame, str], DataFrame] = number_rows
) -> DataFrame:
    """Put two datasets side by side: row by row, or by a key that both hold once.

    Without a key the i-th row of ``a`` meets the i-th row of ``b``, whatever they
    hold, so null and repeated ids are kept. ``truncate`` keeps as many rows as both
    have, ``error`` raises when their numbers differ. The order is that of the
    partitions, or of the files when ``numbered`` is ``number_files`` and both are scans of files.
    A row that is gone when the rows are read again stops the job. Columns of ``b`` must have other names than those of ``a``.
    """
    if key is not None:
        return a.join(b, key)
    if ragged not in ("truncate", "error"):
        raise ValueError("ragged must be truncate or error")
    clash = set(a.columns) & set(b.columns)
    if clash:
        raise ValueError(f"both datasets hold {sorted(clash)}")
    left, right = numbered(a, "_pos"), numbered(b, "_pos").withColumnRenamed("_pos", "_at")
    n, m = left.count(), right.count()
    if ragged == "error" and n != m:
        raise ValueError(f"the datasets hold {n} and {m} rows")
    kept = min(n, m)
    left, right = left.filter(F.col("_pos") < kept), right.filter(F.col("_at") < kept)
    both = left.join(right, F.col("_pos") == F.col("_at"), "full")
    lost = F.raise_error(F.lit("a dataset has lost rows between the passes")).cast("boolean")
    there = F.when(F.col("_pos").isNotNull() & F.col("_at").isNotNull(), True).otherwise(lost)
    return both.filter(there).select(*a.columns, *b.columns)


def concat(parts: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name; differing columns raise."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def budgets(spark: SparkSession) -> DataFrame:
    """The table of named budgets, four rows."""
    return spark.createDataFrame(BUDGETS, BUDGET_SCHEMA)


def budget_lookup(df: DataFrame, profile: str) -> DataFrame:
    """Add the budget that the column ``profile`` names; an unknown name stops the job."""
    table = budgets(df.sparkSession).withColumnRenamed("profile", profile)
    names = [b[0] for b in BUDGETS]
    known = F.when(F.col(profile).isin(names), F.col(profile)).otherwise(
        F.raise_error(F.concat(F.lit(f"unsupported profile, choose from {names}: "), F.col(profile)))
    )
    return df.withColumn(profile, known).join(F.broadcast(table), profile)


def budget(profile: str) -> dict:
    """One named budget; an unknown name raises."""
    names = [field.split()[0] for field in BUDGET_SCHEMA.split(", ")]
    for row in BUDGETS:
        if row[0] == profile:
            return dict(zip(names, row))
    raise ValueError(f"unsupported profile {profile}, choose from {[b[0] for b in BUDGETS]}")


def with_budget(df: DataFrame, profile: str) -> DataFrame:
    """Add one named budget's batch size and length as constants."""
    found = budget(profile)
    return df.withColumns({c: F.lit(found[c]) for c in ("batch_size", "max_length")})


def within_budget(src: Column, tgt: Column, max_length: Column | int) -> Column:
    """Whether both lengths fit."""
    limit = F.lit(max_length) if isinstance(max_length, int) else max_length
    return (src <= limit) & (tgt <= limit)
