"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w . x - t_k): one weight vector shared by all ordered
thresholds t_0 <= t_1 <= ... The features of a text are the terms of a bounded
vocabulary that occur in it, words and beginnings of words; a term enters the
vocabulary by its association with the higher grades among the labelled texts.

Fitting uses at most ``SAMPLE`` labelled rows, those with the smallest hashes of
their keys, and at most ``TERMS`` terms, so what reaches the driver is bounded.
Scoring covers every row and the whole text.

Rows: a null or empty text has no terms and gets the grade probabilities of the
thresholds alone; rows with a null key are scored but never fitted; repeated
rows are scored each; of several labels of one key the highest grade counts.
Where no row is labelled, or all in one grade, every score is that of grade 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinline.llm.words import plain_words
from twinline.session import settle

SAMPLE = 40_000  # labelled rows used to fit, at most
TERMS = 4_096  # terms of the vocabulary, at most
LEAST_ROWS = 3  # texts of a higher grade that a term must occur in
ODDS = 3.0  # log odds ratio against grade 0 above which a term enters
PREFIXES = (4,)  # lengths of word beginnings used as terms, beside whole words
SEVERE = 4  # different associated terms from which a toxic text is severe
RIDGE = 1e-4
REJECT = 0.2  # probability of any toxic grade from which a text is rejected
STEPS = 400
STRIDE = 256  # texts whose terms are handed on at a time


@dataclass(frozen=True)
class Model:
    """``weights`` of ``terms``, and one threshold per grade above the lowest, in order."""

    terms: tuple[str, ...]
    weights: np.ndarray
    thresholds: np.ndarray


def features(text: str | None, prefixes: Sequence[int] = PREFIXES) -> set[str]:
    words = set(plain_words(text))
    return words.union(w[:n] + "*" for n in prefixes for w in words if len(w) > n)


def _terms(rows: DataFrame, prefixes: Sequence[int]) -> DataFrame:
    """``(key, grade, terms)`` of labelled rows."""

    def terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STRIDE):  # terms take far more memory than their texts
                part = batch.slice(at, STRIDE)
                found = [sorted(features(text.as_py(), prefixes)) for text in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found, pa.list_(pa.string()))], names=["key", "grade", "terms"]
                )

    return rows.mapInArrow(terms, "key long, grade int, terms array<string>")


def labelled(docs: DataFrame, labels: DataFrame, grade: Column, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` labelled rows ``(key, grade, text)``, by the smallest hash of the key; ties by key."""
    graded = labels.select(F.col(key).cast("long").alias("key"), grade.cast("int").alias("grade")).dropna()
    graded = graded.groupBy("key").agg(F.max("grade").alias("grade"))
    chosen = graded.orderBy(F.xxhash64("key"), "key").limit(sample)
    # At most ``sample`` rows of two numbers by construction.
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "key").select("key", "grade", "text")


def _associated(rows: DataFrame, terms: int, least: int, odds: float) -> list[tuple[str, float]]:
    """Terms of higher grades with their log odds ratios against grade 0, strongest support first."""
    high = F.col("grade") > 0
    totals = rows.agg(F.count_if(high).alias("high"), F.count_if(~high).alias("low")).first()
    if not totals.high or not totals.low:
        return []
    seen = rows.select("grade", F.explode("terms").alias("term")).groupBy("term")
    seen = seen.agg(F.count_if(high).alias("a"), F.count_if(~high).alias("b")).filter(F.col("a") >= least)
    share = lambda n, total: (F.col(n) + 0.5) / (F.lit(total) - F.col(n) + 0.5)
    ratio = F.log(share("a", totals.high) / share("b", totals.low))
    best = seen.withColumn("odds", ratio).filter(F.col("odds") >= odds)
    return [(r.term, r.odds) for r in best.orderBy(F.desc(F.col("odds") * F.col("a")), "term").limit(terms).collect()]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    flag: Column,
    key: str = "doc_id",
    text: str = "text",
    sample: int = SAMPLE,
    terms: int = TERMS,
    severe: int = SEVERE,
) -> Model:
    """Learn the grades 0, 1, 2, … of the labels, with a threshold below each but the lowest.

    Labels of 0 and 1 tell only toxic from not; there a toxic text with at least
    ``severe`` different associated terms counts as severe, grade 2.
    """
    rows = settle(_terms(labelled(docs, labels, flag, key, text, sample), PREFIXES), "labelled")
    vocabulary = tuple(sorted(term for term, _ in _associated(rows, terms, LEAST_ROWS, ODDS)))
    kept = F.array_intersect("terms", F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>"))
    sparse = rows.select("key", "grade", kept.alias("terms")).orderBy("key").toArrow().to_pandas()
    index = {term: i for i, term in enumerate(vocabulary)}
    cells = [[index[t] for t in found] for found in sparse["terms"]]
    words = np.array([sum(not vocabulary[i].endswith("*") for i in c) for c in cells], dtype=int)
    grades = np.maximum(sparse["grade"].to_numpy(), 0).astype(int)
    if grades.max(initial=0) < 2:
        grades = np.where((grades > 0) & (words >= severe), 2, grades)
    return fit_ordinal(cells, grades, vocabulary, max(2, grades.max(initial=0)) + 1)


def fit_ordinal(cells: list[list[int]], grades: np.ndarray, vocabulary: tuple[str, ...], levels: int) -> Model:
    """Maximum likelihood of the cumulative-link model with a small ridge, by full-batch Adam.

    Thresholds are a first one and positive gaps, so their order holds all along.
    """
    n = len(grades)
    if n == 0 or len(set(grades)) < 2:
        return Model(vocabulary, np.zeros(len(vocabulary)), np.full(levels - 1, 30.0))
    rows = np.repeat(np.arange(n), [len(c) for c in cells])
    columns = np.array([i for c in cells for i in c], dtype=int)
    theta = np.zeros(len(vocabulary) + levels - 1)
    share = np.array([(grades > k).mean() for k in range(levels - 1)]).clip(0.5 / n, 1 - 0.5 / n)
    start = -np.log(share / (1 - share))
    theta[len(vocabulary) :] = [start[0], *np.log(np.maximum(np.diff(start), 0.1))]
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, STEPS + 1):
        weights, gaps = theta[: len(vocabulary)], np.exp(theta[len(vocabulary) + 1 :])
        thresholds = np.cumsum([theta[len(vocabulary)], *gaps])
        score = np.bincount(rows, weights[columns], n)
        above = np.column_stack([np.ones(n), *(sigmoid(score - t) for t in thresholds), np.zeros(n)])
        at = np.arange(n)
        upper, lower = above[at, grades], above[at, grades + 1]
        slope = above * (1 - above)
        inside = np.maximum(upper - lower, 1e-12)
        d_score = (slope[at, grades] - slope[at, grades + 1]) / inside
        d_thresholds = np.zeros(levels - 1)
        for k in range(levels - 1):
            d_thresholds[k] = (slope[:, k + 1] / inside * ((grades == k).astype(float) - (grades == k + 1))).sum()
        tails = np.cumsum(d_thresholds[::-1])[::-1]
        gradient = np.concatenate(
            [np.bincount(columns, d_score[rows], len(vocabulary)) / n - RIDGE * weights, [tails[0] / n], tails[1:] * gaps / n]
        )
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta = theta + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(theta[len(vocabulary) + 1 :])
    return Model(vocabulary, theta[: len(vocabulary)], np.cumsum([theta[len(vocabulary)], *gaps]))


def predict(docs: DataFrame, model: Model, text: str = "text", reject: float = REJECT) -> DataFrame:
    """All rows as ``(_row, p_toxic, severity, grade, rejected)``.

    ``_row`` is the row itself, so no column of it can clash; ``p_toxic`` is the
    probability of any grade above 0, ``severity`` the expected grade, ``grade`` the likeliest.
    """
    weights = dict(zip(model.terms, model.weights.tolist()))
    thresholds = model.thresholds
    lengths = sorted({len(t) - 1 for t in model.terms if t.endswith("*")})
    kind = "struct<p_toxic:double,severity:double,grade:int>"

    @F.pandas_udf(kind)
    def score(texts):
        import pandas as pd

        total = np.array([sum(weights.get(t, 0.0) for t in features(x, lengths)) for x in texts], dtype=float)
        above = 1 / (1 + np.exp(-np.clip(total[:, None] - thresholds[None, :], -40, 40)))
        each = -np.diff(np.column_stack([np.ones(len(total)), above, np.zeros(len(total))]), axis=1)
        return pd.DataFrame({"p_toxic": above[:, 0], "severity": above.sum(1), "grade": each.argmax(1).astype("int32")})

    scored = docs.select(F.struct("*").alias("_row"), score(F.col(text).cast("string")).alias("_scored"))
    return scored.select("_row", "_scored.*", (F.col("_scored.p_toxic") >= reject).alias("rejected"))
