"""Order on unordered data: numbering, prefix sums and selection by rank.

No function here sorts or scans all rows in one task. ``index_rows`` range-sorts
by any unique key: Spark samples the key, so a heavy leading value is spread over
many ranges by the columns behind it. The others number, sum or rank a narrow
table of keys in the same way, whatever its size or the spread of its keys, and join
the result back, so wide rows move once and are never sorted. The keys are written
before they are sorted: sampling for the sort then does not run the input again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from twinline.session import settle

DIGIT = 16  # bits that one pass of a selection counts
FEW = 10_000  # rows that a selection looks at themselves


def index_rows(
    df: DataFrame, order: Sequence[str], within: str | None = None, column: str = "row_idx"
) -> DataFrame:
    """Number rows 0, 1, 2, … by a unique key, per value of ``within`` when given.

    The sorted rows are written once, so that both the counting pass and the
    numbering pass see the same ranges; a second sort could sample others.
    """
    keys = [within, *order] if within else list(order)
    ranges = settle(
        df.sort(*keys).withColumns(
            {"_range": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}
        ),
        "sorted",
    )
    group = [within] if within else []
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        ranges.groupBy(*group, "_range")
        .agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    # Without groups there is one row per sort range, a number that Spark's own
    # settings bound. With groups the table may be long, so its size is measured.
    if within:
        starts = settle(starts, "starts")
    else:
        starts = F.broadcast(df.sparkSession.createDataFrame(starts.collect(), starts.schema))
    return (
        ranges.join(starts, [*group, "_range"])
        .withColumn(column, F.col("_start") + F.col("_seq") - F.col("_first"))
        .select(column, *df.columns)
    )


def int_div(c: Column | str, n: int) -> Column:
    """Whole-number division, exact for every 64-bit value."""
    return F.call_function("div", F.col(c) if isinstance(c, str) else c, F.lit(n))


def _running(
    df: DataFrame, key: str, value: Column, column: str, by: str | None, how: Callable, with_self: bool
) -> DataFrame:
    """Add ``how`` of ``value`` over the earlier rows of a group.

    The narrow table is sorted once and kept; its sort ranges are the cells whose
    totals are combined, so a sparse key or one far-off key makes no cell larger.
    """
    group = [by] if by else []
    narrow = settle(df.select(*group, F.col(key).alias("_key"), value.alias("_value")), "keys")
    ranges = settle(narrow.sort(*group, "_key").withColumn("_range", F.spark_partition_id()), "sorted")
    cells = ranges.groupBy(*group, "_range").agg(how("_value").alias("_total"))
    earlier = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(*group, "_range", how("_total").over(earlier).alias("_earlier"))
    # Without groups one row per sort range, a number that Spark's own settings bound; else the size is measured.
    cells = settle(cells, "cells") if by else F.broadcast(cells)
    inside = W.partitionBy(*group, "_range").orderBy("_key")
    inside = inside.rowsBetween(W.unboundedPreceding, W.currentRow if with_self else -1)
    both = ranges.join(cells, [*group, "_range"]).withColumn("_inside", how("_value").over(inside))
    if with_self:
        result = F.greatest("_earlier", "_inside")
    else:
        result = F.coalesce("_earlier", F.lit(0)) + F.coalesce("_inside", F.lit(0))
    both = both.select(*group, F.col("_key").alias(key), result.alias(column))
    return df.join(both, [*group, key]).select(*df.columns, column)


def prefix_sum(df: DataFrame, key: str, weight: Column, column: str, by: str | None = None) -> DataFrame:
    """Add the sum of ``weight`` over all rows with a smaller key, per ``by`` when given."""
    return _running(df, key, weight.cast("long"), column, by, F.sum, with_self=False)


def running_max(df: DataFrame, key: str, value: Column, column: str, by: str | None = None) -> DataFrame:
    """Add the largest ``value`` up to and including each row, per ``by`` when given."""
    return _running(df, key, value, column, by, F.max, with_self=True)


def key_at_rank(df: DataFrame, key: str, rank: Callable[[int], int], tie: Sequence[str] = ()) -> tuple | None:
    """The key, with its tie-breakers, of the row at a rank; None when there are fewer rows.

    ``rank`` tells the rank, counted from 1, for a given number of rows. The place is
    found digit by digit: rows are counted by ``DIGIT`` bits of their key at a time, the
    digit that the rank falls into is chosen, and the next pass counts only rows with it.
    Once at most ``FEW`` rows share all digits so far, they are looked at themselves.
    Nothing is sorted or shuffled but counts of digits. Keys are whole numbers or strings; rows without a key do not count.
    """
    columns = [key, *tie]
    rows = settle(df.select(*columns).dropna(subset=[key]), "keys")
    total = rows.count()
    k = rank(total)
    if not 1 <= k <= total:
        return None
    for digits in (_digits(rows, c) for c in columns):
        for digit in digits:
            if total <= FEW:
                break
            counts = rows.groupBy(digit.alias("digit")).count().orderBy("digit").collect()  # at most 2 ** DIGIT, and NULL
            for chosen, n in counts:
                if k <= n:
                    break
                k -= n
            rows, total = rows.filter(digit.eqNullSafe(F.lit(chosen))), n
    same = rows.orderBy(*columns).limit(k) if total > FEW else rows
    return sorted((tuple(r) for r in same.collect()), key=lambda r: [(v is not None, v.encode() if isinstance(v, str) else v) for v in r])[k - 1]


def _digits(rows: DataFrame, column: str) -> Iterator[Column]:
    """Expressions whose values, one after the other, order a column: its bits or bytes from the front."""
    if rows.schema[column].dataType.typeName() == "string":
        longest = rows.agg(F.max(F.octet_length(column))).first()[0] or 0
        inside = F.hex(F.encode(column, "UTF-8"))
        width = DIGIT // 4
        for at in range(0, 2 * longest, width):
            yield F.substr(inside, F.lit(at + 1), F.lit(width))
        return
    low, high = rows.agg(F.min(column), F.max(column)).first()
    if low is None:
        return
    if not isinstance(low, int):
        raise TypeError(f"{column} is neither a whole number nor a string")
    bits = (high - low).bit_length()
    above = F.col(column).cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")
    for shift in range(max(0, -(-bits // DIGIT) - 1) * DIGIT, -1, -DIGIT):
        yield F.floor(above / F.lit(2**shift).cast("decimal(20,0)")) if bits >= 63 else F.shiftright(F.col(column) - F.lit(low), shift)


def cap_rows(df: DataFrame, k: int, key: str = "row_idx") -> DataFrame:
    """Keep exactly the first ``k`` rows by ``key``, or all when there are fewer."""
    last = key_at_rank(df, key, lambda _: k)
    if last is None:
        return df.filter(F.lit(k > 0))
    return df.filter(F.col(key) <= F.lit(last[0]))


def length_rank(
    df: DataFrame, length: str = "length", key: str = "row_idx", by: str | None = None, column: str = "rank"
) -> DataFrame:
    """Add each row's position in the order (length, key), per ``by`` when given.

    Only lengths and keys are sorted; rows of one length are spread over many sort ranges by their keys.
    """
    group = [by] if by else []
    ranks = index_rows(settle(df.select(*group, length, key), "keys"), [length, key], by, column)
    return df.join(ranks.select(*group, key, column), [*group, key]).select(*df.columns, column)


def length_sort(df: DataFrame, length: Column, key: str = "row_idx") -> DataFrame:
    """Sort by length, shortest first, with the row order as the tie-break."""
    return df.withColumn("length", length).sort("length", key)


def part_order(path: str) -> Column:
    """Name order, but with the numbers of Spark's part files compared as numbers."""
    return F.regexp_replace(F.col(path), r"/part-(\d{5})-", "/part-0$1-")


def number_files(df: DataFrame, column: str = "pos") -> DataFrame:
    """Number the rows 0, 1, 2, … of a scan of files, by file name and place in the file.

    One pass counts the rows of every file split. A row's number is the count in
    earlier splits plus its place in its own, so no rows are sorted, moved or
    written. Both passes must see the same splits: a row outside its split stops the job.
    Rows that a split has lost since then are not seen here; :func:`zip_rows` finds them missing.
    """
    placed = df.select(
        *df.columns, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    splits = placed.groupBy("_path", "_block").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    # One row per file split: Spark's own listing holds as many.
    earlier = W.orderBy(part_order("_path"), "_block").rowsBetween(W.unboundedPreceding, -1)
    layout = settle(splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))), "layout")
    at = F.col("_seq") - F.col("_first")
    moved = F.raise_error(F.lit("file splits moved between the passes; fix spark.sql.files.minPartitionNum"))
    inside = F.col("_first").isNotNull() & at.between(0, F.col("_n") - 1)
    numbered = placed.join(layout, ["_path", "_block"], "left")
    return numbered.select(F.when(inside, F.col("_before") + at).otherwise(moved).alias(column), *df.columns)


def number_rows(df: DataFrame, column: str = "pos") -> DataFrame:
    """Number the rows 0, 1, 2, … of any dataset in its own order, that of its partitions; the rows are written once."""
    return number_files(settle(df, "rows"), column)


def sum_files(df: DataFrame, weight: Column, column: str, key: Sequence[str] = ()) -> DataFrame:
    """Add the sum of ``weight`` over all earlier rows of a scan of files.

    One pass sums the weights of every file split, the second keeps the running
    sum inside each split while the rows pass by: none is sorted, moved or joined back.
    Rows are in the order of file name and place, or in that of a unique ``key``
    by which the files are sorted. Where files overlap in their keys the sum is
    that of :func:`prefix_sum`; a file that is not sorted inside, and a split that
    has moved, grown or lost rows between the passes, stops the job. Null weights count as 0.
    """
    parts = df.select(
        *df.columns, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"), F.coalesce(weight.cast("long"), F.lit(0)).alias("_weight"),
    )
    totals = [F.count("*").alias("_n"), F.min("_seq").alias("_first"), F.sum("_weight").alias("_total")]
    keys = F.struct(*key) if key else F.lit(None)
    splits = parts.groupBy("_path", "_block").agg(*totals, F.min(keys).alias("_low"), F.max(keys).alias("_high"))
    # One row per file split: Spark's own listing holds as many.
    earlier = W.orderBy(*(["_low"] if key else [part_order("_path"), "_block"])).rowsBetween(W.unboundedPreceding, -1)
    layout = settle(
        splits.select(
            "_path", "_block", "_n", "_first", "_total", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"),
            (F.col("_low") <= F.max("_high").over(earlier)).alias("_overlaps"),
        ),
        "layout",
    )
    if key and not layout.filter("_overlaps").isEmpty():
        return prefix_sum(df.withColumn("_keys", F.struct(*key)), "_keys", weight, column).drop("_keys")
    # The hint keeps the rows where they are read; a shuffle would lose their order.
    placed = parts.join(F.broadcast(layout.drop("_overlaps")), ["_path", "_block"], "left").drop("_path", "_block")
    schema = StructType(list(df.schema.fields)).add(column, LongType())
    names, checked = df.columns, list(key)
    return placed.mapInArrow(lambda batches: _sums_inside(batches, names, checked, column), schema)


def _sums_inside(batches: Iterable[pa.RecordBatch], names: list[str], key: list[str], column: str) -> Iterator[pa.RecordBatch]:
    """The rows of a task with the sum of the weights before each, split after split."""
    moved = "file splits moved between the passes; fix spark.sql.files.minPartitionNum"
    before = left = 0  # the sum inside the split so far, and the rows that it still has
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch.select(key)]) if key else None
        if batch.column("_first").null_count:
            raise ValueError(moved)
        seq, first, n, total, start, weight = (
            batch.column(c).to_numpy(zero_copy_only=False) for c in ("_seq", "_first", "_n", "_total", "_before", "_weight")
        )
        at = seq - first
        opens, closes = at == 0, at == n - 1
        # Each row follows the one before it, or opens a split after one that was read to its end.
        follows = at == np.concatenate([[n[0] - left if left else 0], at[:-1] + 1])
        ended = np.concatenate([[left == 0], closes[:-1]])
        if not np.where(opens, ended, follows & ~ended).all():
            raise ValueError(moved)
        running = np.cumsum(weight) - weight
        opened = np.maximum.accumulate(np.where(opens, np.arange(len(at)), -1))
        inside = running - np.where(opened >= 0, running[opened], -before)
        if (inside + weight != total)[closes].any():
            raise ValueError(moved)
        if key:
            joined = pa.concat_tables([last, table]) if last is not None else table
            rises = _rises(joined.combine_chunks())
            if not (rises | opens[len(opens) - len(rises) :]).all() or any(c.null_count for c in table.columns):
                raise ValueError(f"the files are not sorted by {key}, or hold a key twice")
            last = table.slice(table.num_rows - 1)
        before, left = int(inside[-1] + weight[-1]), int(n[-1] - 1 - at[-1])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(start + inside)], names=[*names, column])
    if left:
        raise ValueError(moved)


def _rises(keys: pa.Table) -> np.ndarray:
    """Whether each row's keys are above those of the row before it."""
    above, tied = np.zeros(keys.num_rows - 1, bool), np.ones(keys.num_rows - 1, bool)
    for values in keys.columns:
        a, b = values.slice(0, keys.num_rows - 1), values.slice(1)
        more, same = (f(b, a).combine_chunks().fill_null(False).to_numpy(zero_copy_only=False) for f in (pc.greater, pc.equal))
        above, tied = above | tied & more, tied & same
    return above
