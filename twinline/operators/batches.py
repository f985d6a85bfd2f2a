"""Cut rows into batches, pad them together, and pack sequences into blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinline.functions.tokens import EOS, attention_mask, byte_ids, label_pad, pad_fixed, token_count, token_ids
from twinline.operators.order import int_div, length_rank, prefix_sum, sum_files


def micro_batches(df: DataFrame, size: int, key: str = "row_idx") -> DataFrame:
    """Every ``size`` consecutive rows form a batch. The batch follows from the row number alone."""
    return df.withColumn("batch_id", int_div(key, size))


def length_batches(df: DataFrame, size: int, length: str = "length", key: str = "row_idx") -> DataFrame:
    """Batches of rows of similar length: rank by (length, key), then cut."""
    ranked = length_rank(df, length, key)
    return ranked.withColumn("batch_id", int_div("rank", size)).drop("rank")


def padding_report(df: DataFrame, length: str = "length") -> DataFrame:
    """Rows, real tokens and fill tokens per batch when each batch is padded to its longest row."""
    return (
        df.groupBy("batch_id")
        .agg(F.count("*").alias("rows"), F.max(length).alias("width"), F.sum(length).cast("long").alias("tokens"))
        .withColumn("fill", F.col("rows") * F.col("width") - F.col("tokens"))
    )


def pad_longest(
    df: DataFrame, src: str, tgt: str, max_length: int, batch: Sequence[str] = ("batch_id",)
) -> DataFrame:
    """Tokenize both sides, cut to ``max_length`` and pad to the longest row of the batch.

    Widths come from byte counts, so the shuffle by batch moves texts and the
    arrays are built after it.
    """
    in_batch = W.partitionBy(*batch)
    width = {
        side: F.max(F.least(token_count(column), F.lit(max_length))).over(in_batch)
        for side, column in (("_src_width", src), ("_tgt_width", tgt))
    }
    ids = df.withColumns(width).withColumns(
        {"input_ids": token_ids(src, max_length), "labels": token_ids(tgt, max_length)}
    )
    return ids.withColumns(
        {
            "input_ids": label_pad("input_ids", F.col("_src_width"), 0),
            "attention_mask": attention_mask("input_ids", F.col("_src_width")),
            "labels": label_pad("labels", F.col("_tgt_width")),
        }
    ).drop("_src_width", "_tgt_width")


def tokenize_fixed(
    df: DataFrame, src: Column, tgt: Column, max_length: int = 128, label_fill: int = 0
) -> DataFrame:
    """Add ``input_ids``, ``attention_mask`` and ``labels``, all of width ``max_length``."""
    ids = df.withColumns({"input_ids": token_ids(src, max_length), "labels": token_ids(tgt, max_length)})
    return ids.withColumns(
        {
            "input_ids": pad_fixed("input_ids", max_length),
            "attention_mask": attention_mask("input_ids", max_length),
            "labels": label_pad("labels", max_length, label_fill),
        }
    )


def pack_sequences(
    df: DataFrame, text: str, block: int, key: str = "row_idx", drop_last: bool = True, in_files: bool = False
) -> DataFrame:
    """Join all token sequences in row order and cut the stream into blocks of ``block`` ids.

    Each row finds its place in the stream by a prefix sum of token counts. Its
    bytes are then cut where blocks end, and the pieces meet by block number;
    only there do they become ids. A piece has at least one token, so no group
    holds more than ``block`` pieces. With ``in_files`` the rows are a scan of files
    sorted by ``key``, and the sum follows their layout.
    """
    rows = df.select(key, text)
    if in_files:
        placed = sum_files(rows, token_count(text), "_at", [key])
    else:
        placed = prefix_sum(rows, key, token_count(text), "_at")
    placed = placed.select(
        "_at", F.encode(text, "UTF-8").alias("_raw"), token_count(text).cast("long").alias("_n")
    )
    start, n = F.col("_at"), F.col("_n")

    def piece(b: Column) -> Column:
        first = F.greatest(b * block - start, F.lit(0))
        end = F.least((b + 1) * block - start, n)
        return F.struct(
            b.alias("block_id"),
            (start + first).alias("at"),
            F.substring(F.col("_raw"), (first + 1).cast("int"), (end - first).cast("int")).alias("raw"),
            (end == n).alias("ends"),
            (end - first).alias("n"),
        )

    blocks = F.sequence(int_div(start, block), int_div(start + n - 1, block))
    packed = (
        placed.select(F.inline(F.transform(blocks, piece)))
        .groupBy("block_id")
        .agg(F.sort_array(F.collect_list(F.struct("at", "raw", "ends"))).alias("pieces"), F.sum("n").alias("n"))
    )
    if drop_last:
        packed = packed.filter(F.col("n") == block)
    end_mark = F.array(F.lit(EOS))
    ids = F.transform(
        "pieces", lambda p: F.when(p.ends, F.concat(byte_ids(p.raw), end_mark)).otherwise(byte_ids(p.raw))
    )
    return packed.select("block_id", F.flatten(ids).alias("input_ids"))
