"""The main data flows, from raw lines to shards, batches, blocks and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.functions.text import (
    blank_answer,
    extract_reference,
    make_pairs,
    prompt_prefix,
    sft_text,
    split_sides,
    strip_text,
)
from twinline.functions.tokens import PAD, VOCAB, clamp_ids, decode_ids, token_count, unmask_labels
from twinline.operators.batches import micro_batches, pack_sequences, pad_longest, tokenize_fixed
from twinline.operators.filters import cap_pairs, drop_empty, length_filter
from twinline.operators.order import int_div, length_rank
from twinline.operators.pairing import budget, zip_rows
from twinline.operators.scores import bleu_plain, bleu_sacre
from twinline.operators.shards import ROWS_PER_SHARD, TOKENS_PER_SHARD, batch_weights, shard_by_weight, split_by_shard
from twinline.operators.splits import random_split
from twinline.operators.traces import peak_alerts, peak_trace
from twinline.sources.parallel_text import ParallelText


def running_id(df: DataFrame, key: str = "row_idx") -> DataFrame:
    """The row number as a string id."""
    return df.withColumn("id", F.col(key).cast("string"))


def raw_shards(text: ParallelText, rows: int = ROWS_PER_SHARD) -> DataFrame:
    """Paired line files as numbered pairs with their row-sized shard and split."""
    pairs = shard_by_weight(text.pairs(), text.batch_rows(), rows)
    return split_by_shard(make_pairs(running_id(pairs))).select("split", "shard_id", "row_idx", "id", "translation")


def token_shards(
    pairs: DataFrame,
    batch: int = 1000,
    max_pairs: int = 10**7,
    max_length: int = 128,
    budget: int = TOKENS_PER_SHARD,
    src_name: str = "English",
    tgt_name: str = "Korean",
) -> DataFrame:
    """Numbered ``(row_idx, src, tgt)`` rows as padded token rows with their token-sized shard and split.

    Batches are cut before empty pairs are dropped, so they may hold fewer rows.
    """
    kept = cap_pairs(drop_empty(micro_batches(pairs, batch)), max_pairs)
    sharded = shard_by_weight(kept, batch_weights(kept, F.lit(max_length)), budget)
    prompts = split_by_shard(sharded).select(
        "split",
        "shard_id",
        "row_idx",
        prompt_prefix("src", src_name, tgt_name).alias("src_text"),
        F.col("tgt").alias("tgt_text"),
    )
    return tokenize_fixed(prompts, F.col("src_text"), F.col("tgt_text"), max_length)


def training_batches(
    pairs: DataFrame,
    test_size: float = 0.2,
    seed: int = 0,
    keep_length: int = 512,
    max_length: int = 128,
    batch: int = 1000,
    profile: str | None = None,
) -> DataFrame:
    """Numbered pairs as token rows, sorted by length inside each split and padded per batch.

    A named budget, when given, decides both lengths and the batch size.
    """
    if profile is not None:
        spec = budget(profile)
        keep_length = max_length = spec["max_length"]
        batch = spec["batch_size"]
    rows = split_sides(random_split(pairs, test_size, seed))
    rows = length_filter(rows, keep_length).withColumn("length", token_count("src"))
    ranked = length_rank(rows, by="split").withColumn("batch_id", int_div("rank", batch))
    return pad_longest(ranked, "src", "tgt", max_length, ["split", "batch_id"]).select(
        "split", "batch_id", "rank", "row_idx", "length", "input_ids", "attention_mask", "labels"
    )


def sft_rows(
    pairs: DataFrame, test_size: float = 0.2, seed: int = 0, src_name: str = "English", tgt_name: str = "Korean"
) -> DataFrame:
    """Numbered pairs as training texts with split, prompt without answer, and reference."""
    rows = split_sides(random_split(pairs, test_size, seed))
    rows = rows.withColumn("text", sft_text("src", "tgt", src_name, tgt_name))
    return rows.select(
        "split",
        "row_idx",
        "id",
        "text",
        blank_answer("text").alias("prompt"),
        extract_reference("text").alias("reference"),
    )


def score_ids(
    rows: DataFrame, preds: str = "preds", labels: str = "labels", key: str = "id", vocab: int = VOCAB, pad: int = PAD
) -> DataFrame:
    """BLEU from 0 to 100 of a model's output: arrays of predicted ids and of label ids in which -100 is ignored."""
    texts = rows.select(
        key,
        strip_text(decode_ids(clamp_ids(preds, vocab))).alias("hyp"),
        strip_text(decode_ids(unmask_labels(labels, pad))).alias("ref"),
    )
    return bleu_sacre(texts, key=key)


def score_sft(rows: DataFrame, predictions: DataFrame, prediction: str = "prediction", key: str = "id") -> DataFrame:
    """BLEU from 0 to 1 of the predictions for the test rows of :func:`sft_rows`."""
    test = rows.filter(F.col("split") == "test").select(key, F.col("reference").alias("ref"))
    texts = zip_rows(test, predictions.select(key, strip_text(prediction).alias("hyp")), key)
    return bleu_plain(texts, key=key)


def device_alerts(steps: DataFrame, profile: str, **columns: str) -> DataFrame:
    """Steps, alerts and peak per run, against the memory of a named budget."""
    return peak_alerts(peak_trace(steps, float(budget(profile)["memory_gb"]), **columns))


def sft_blocks(rows: DataFrame, block: int = 1024) -> DataFrame:
    """The training texts of :func:`sft_rows` packed into full blocks."""
    return pack_sequences(rows.filter(F.col("split") == "train"), "text", block)
