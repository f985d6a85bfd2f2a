"""Corpus BLEU with one reference per prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinline.functions.words13a import words_13a
from twinline.session import shuffle_width

ORDERS = (1, 2, 3, 4)


def bleu_counts(df: DataFrame, hyp: str = "hyp", ref: str = "ref", key: str = "id") -> DataFrame:
    """One row: clipped matches ``m1..m4``, totals ``t1..t4``, and both lengths in words.

    Texts are spread by their unique key. All n-grams of a text then meet in the
    task that made them, so only the eight partial sums are shuffled again.
    """
    words = df.repartition(shuffle_width(df.sparkSession), key).select(
        F.col(key).alias("key"), words_13a(F.col(hyp)).alias("hyp"), words_13a(F.col(ref)).alias("ref")
    )
    parts = [
        F.struct(
            F.lit(n).alias("n"),
            F.lit(int(side == "hyp")).alias("in_hyp"),
            F.lit(int(side == "ref")).alias("in_ref"),
            _ngrams(F.col(side), n).alias("grams"),
        )
        for side in ("hyp", "ref")
        for n in ORDERS
    ]
    clipped = (
        words.select("key", F.inline(F.array(*parts)))
        .select("key", "n", "in_hyp", "in_ref", F.explode("grams").alias("gram"))
        .groupBy("key", "n", "gram")
        .agg(F.sum("in_hyp").alias("in_hyp"), F.sum("in_ref").alias("in_ref"))
    )
    per_order = [
        F.coalesce(F.sum(F.when(F.col("n") == n, value)), F.lit(0)).cast("long").alias(f"{name}{n}")
        for name, value in (("m", F.least("in_hyp", "in_ref")), ("t", F.col("in_hyp")), ("r", F.col("in_ref")))
        for n in ORDERS
    ]
    return clipped.agg(*per_order).select(
        *[f"m{n}" for n in ORDERS],
        *[f"t{n}" for n in ORDERS],
        F.col("t1").alias("hyp_len"),
        F.col("r1").alias("ref_len"),
    )


def _ngrams(words: Column, n: int) -> Column:
    """The n-grams of a text; none when it has fewer than ``n`` words."""
    # Words are picked one by one: a slice inside a lambda would copy the whole array each time.
    grams = F.transform(words, lambda word, i: F.concat_ws(" ", word, *[F.get(words, i + k) for k in range(1, n)]))
    return F.slice(grams, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))


def brevity() -> Column:
    """Penalty for predictions that are shorter than their references in total."""
    hyp, ref = F.col("hyp_len"), F.col("ref_len")
    return F.when(hyp == 0, 0.0).when(hyp >= ref, 1.0).otherwise(F.exp(1 - ref / hyp))


def precision(n: int) -> Column:
    """Share of the predicted n-grams that are in the reference; 0 when there are none."""
    return F.when(F.col(f"t{n}") > 0, F.col(f"m{n}") / F.col(f"t{n}")).otherwise(0.0)


def _mean_log(values: list[Column]) -> Column:
    return sum((F.log(v) for v in values[1:]), F.log(values[0])) / len(values)


def bleu_plain(df: DataFrame, hyp: str = "hyp", ref: str = "ref", key: str = "id") -> DataFrame:
    """BLEU from 0 to 1 without smoothing, with its parts."""
    shares = [F.col(f"p{n}") for n in ORDERS]
    parts = bleu_counts(df, hyp, ref, key).withColumns(
        {
            **{f"p{n}": precision(n) for n in ORDERS},
            "brevity_penalty": brevity(),
            "length_ratio": F.when(F.col("ref_len") > 0, F.col("hyp_len") / F.col("ref_len")).otherwise(0.0),
        }
    )
    score = F.when(F.least(*shares) > 0, F.col("brevity_penalty") * F.exp(_mean_log(shares))).otherwise(0.0)
    return parts.select(
        score.alias("bleu"), *shares, "brevity_penalty", "length_ratio", "hyp_len", "ref_len"
    )


def bleu_sacre(df: DataFrame, hyp: str = "hyp", ref: str = "ref", key: str = "id") -> DataFrame:
    """BLEU from 0 to 100; the k-th order without a match counts 1 / (2^k · total)."""
    counts = bleu_counts(df, hyp, ref, key)
    zeros, smoothed = F.lit(0), []
    for n in ORDERS:
        none = F.col(f"m{n}") == 0
        zeros = zeros + none.cast("int")
        smoothed.append(
            F.when(none, 1 / (F.pow(F.lit(2.0), zeros) * F.col(f"t{n}"))).otherwise(F.col(f"m{n}") / F.col(f"t{n}"))
        )
    scored = (F.col("t4") > 0) & (F.col("m1") > 0)
    score = F.when(scored, 100 * brevity() * F.exp(_mean_log(smoothed))).otherwise(0.0)
    return counts.select(score.alias("bleu"), *counts.columns)
