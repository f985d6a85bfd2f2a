"""Assign rows to shards of a row or token budget, and shards to splits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinline.operators.order import int_div
from twinline.session import settle

CHUNK = 1 << 20  # batches that one task folds
FAN = 32  # summaries that one task composes
MOST = 64  # segments that one key of the lookup holds
ROWS_PER_SHARD = 100_000
TOKENS_PER_SHARD = 10**8
NEVER = np.iinfo(np.int64).max

SUMMARY = "chunk long, upto long, closed long, carry long"
ENTRY = "chunk long, shard_in long, carry_in long"
SEGMENT = "shard_id long, first_batch long, last_batch long"


def shard_by_rows(df: DataFrame, rows: int = ROWS_PER_SHARD, batch: int = 32, key: str = "row_idx") -> DataFrame:
    """Close a shard at the first batch that brings it to ``rows`` rows.

    With batches cut from the running row number every batch but the last is
    full, so each shard holds the same number of batches and no scan is needed.
    """
    full = -(-rows // batch) * batch
    return df.withColumn("shard_id", int_div(key, full))


def batch_weights(df: DataFrame, weight: Column, batch: str = "batch_id") -> DataFrame:
    """The table of batch weights that :func:`shard_by_weight` folds."""
    return df.groupBy(F.col(batch).cast("long").alias("batch")).agg(F.sum(weight.cast("long")).alias("weight"))


def shard_by_weight(
    df: DataFrame,
    weights: DataFrame,
    budget: int,
    batch: str = "batch_id",
    chunk: int = CHUNK,
    fan: int = FAN,
    most: int = MOST,
) -> DataFrame:
    """Close a shard at the first batch whose running weight reaches ``budget``, then restart at 0.

    The rule is sequential: the overshoot is dropped, so where one shard ends
    decides all later ends. Only the table of batch weights is folded. Each chunk
    of batches tells, for every way of entering it, how it is left; these
    functions are composed group by group, see :func:`_entries`; then all chunks are cut at once. Rows get their
    shard by a lookup of their batch, see :func:`interval_index`, without a shuffle while the shard table is
    small enough for Catalyst to broadcast.
    """
    if budget < 1:
        raise ValueError("budget must be positive")
    weights = settle(weights.withColumn("chunk", int_div("batch", chunk)), "weights")
    pieces = weights.groupBy("chunk").applyInPandas(lambda pdf: _summarise(pdf, budget), SUMMARY)
    entries = _entries(settle(pieces, "pieces"), budget, fan)
    segments = weights.join(entries, "chunk").groupBy("chunk").applyInPandas(lambda pdf: _cut(pdf, budget), SEGMENT)
    segments = settle(segments, "segments")
    heavy, span, lookup = interval_index(segments, most)
    cell, exact = int_div(F.col(batch).cast("long"), span), -1 - F.col(batch).cast("long")
    keyed = df.withColumn("_cell", cell).join(heavy, "_cell", "left")
    keyed = keyed.withColumn("_key", F.when(F.col("_heavy"), exact).otherwise(F.col("_cell")))
    here = F.col(batch).between(F.col("first_batch"), F.col("last_batch"))
    return keyed.join(lookup, "_key").filter(here).select(*df.columns, "shard_id")


def interval_index(segments: DataFrame, most: int) -> tuple[DataFrame, int, DataFrame]:
    """``(heavy, span, lookup)``: a table of disjoint segments in which no key has more than ``most`` of them.

    Batches are parted into cells of ``span`` batches, the segments' mean length. A cell met
    by more than ``most`` segments is ``heavy``, and its batches are keys of their own: ``-1 - batch``,
    with one segment each. There are at most segments / ``most`` such cells, so these are
    at most batches / ``most`` rows, however the segments crowd; and a segment meets few other cells.
    """
    n, last = segments.agg(F.count("*"), F.max("last_batch")).first()
    span = max(1, ((last or 0) + 1) // max(n, 1))
    first, end = int_div("first_batch", span), int_div("last_batch", span)
    celled = segments.withColumn("_cell", F.explode(F.sequence(first, end)))
    heavy = celled.groupBy("_cell").count().filter(F.col("count") > most)
    heavy = settle(heavy.select("_cell", F.lit(True).alias("_heavy")), "heavy-cells")
    marked = celled.join(heavy, "_cell", "left")
    own = F.sequence(F.greatest("first_batch", F.col("_cell") * span), F.least("last_batch", (F.col("_cell") + 1) * span - 1))
    keys = F.when(F.col("_heavy"), F.transform(own, lambda b: -1 - b)).otherwise(F.array("_cell"))
    lookup = marked.select(F.explode(keys).alias("_key"), "shard_id", "first_batch", "last_batch")
    return heavy, span, settle(lookup, "lookup")


def _entries(pieces: DataFrame, budget: int, fan: int) -> DataFrame:
    """How every chunk is entered: ``(chunk, shard_in, carry_in)``.

    The chunks' summaries are composed ``fan`` at a time, and the results again, until
    one is left. Then the way of entering a group is handed down to its members. Each
    task sees ``fan`` summaries, in a logarithmic number of rounds.
    """
    rounds = [pieces.withColumn("group", int_div("chunk", fan))]
    while not rounds[-1].filter(F.col("chunk") > 0).isEmpty():
        composed = rounds[-1].groupBy("group").applyInPandas(lambda pdf: _composed(pdf, budget), SUMMARY)
        rounds.append(settle(composed, "pieces").withColumn("group", int_div("chunk", fan)))
    entered = pieces.sparkSession.createDataFrame([(0, 0, 0)], ENTRY)
    for members in rounds[-2::-1]:
        whole = entered.withColumnRenamed("chunk", "group")
        entered = settle(members.join(whole, "group").groupBy("group").applyInPandas(lambda pdf: _chain(pdf, budget), ENTRY), "entries")
    return entered


def _summarise(pdf: pd.DataFrame, budget: int) -> pd.DataFrame:
    """How one chunk is left, for every weight still missing from the open shard."""
    pdf = pdf.sort_values("batch")
    weight = pdf["weight"].to_numpy(np.int64)
    total = np.cumsum(weight)
    n = len(total)
    # For a shard opened at batch i: the batch that closes it, or n for none here.
    closing = np.searchsorted(total, total - weight + budget, side="left")
    closed = np.zeros(n + 1, np.int64)
    carry = np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        j = closing[i]
        if j < n:
            closed[i], carry[i] = closed[j + 1] + 1, carry[j + 1]
        else:
            carry[i] = total[-1] - (total[i] - weight[i])
    # An open shard can be closed by batch j only if it misses more than the batches before j.
    reach = int(np.searchsorted(total, budget, side="left")) + 1
    upto, closed, carry = total[:reach], closed[1 : n + 1][:reach] + 1, carry[1 : n + 1][:reach]
    ends = np.append((np.diff(closed) != 0) | (np.diff(carry) != 0), True)
    return pd.DataFrame(
        {
            "chunk": pdf["chunk"].iloc[0],
            "upto": np.append(upto[ends], NEVER),
            "closed": np.append(closed[ends], 0),
            "carry": np.append(carry[ends], total[-1]),
        }
    )


def _composed(pdf: pd.DataFrame, budget: int) -> pd.DataFrame:
    """The summary of chunks that follow each other, as that of one chunk."""
    pdf = pdf.sort_values(["chunk", "upto"])
    parts = [part[["upto", "closed", "carry"]].to_numpy(np.int64).T for _, part in pdf.groupby("chunk")]
    whole = parts[0]
    for part in parts[1:]:
        whole = _after(whole, part, budget)
    return pd.DataFrame(dict(zip(("upto", "closed", "carry"), whole))).assign(chunk=pdf["group"].iloc[0])[["chunk", "upto", "closed", "carry"]]


def _after(first: np.ndarray, then: np.ndarray, budget: int) -> np.ndarray:
    """The summary of one run of batches and the next.

    A summary has a row per range of missing weight, up to ``upto``: the shards that
    close, and what is left in the open one; or, in the last row, where none closes,
    the weight of the whole run.
    """
    upto, closed, carry = first
    more_upto, more_closed, more_carry = then
    # Where the first run closes a shard, the second is entered with what that leaves.
    at = np.searchsorted(more_upto, budget - carry[:-1], side="left")
    on = more_closed[at] > 0
    head = np.stack([upto[:-1], closed[:-1] + more_closed[at], np.where(on, more_carry[at], carry[:-1] + more_carry[at])])
    # Where it closes none, the second misses what the first did not fill. No shard misses more than the budget.
    total = carry[-1]
    ends = more_closed > 0
    tail = np.stack([np.where(ends, more_upto + np.where(ends, total, 0), NEVER), more_closed, np.where(ends, more_carry, total + more_carry)])
    within = np.append(True, tail[0][:-1] < budget)
    within[-1] = True
    both = np.concatenate([head, tail[:, within]], axis=1)
    differ = np.append((np.diff(both[1]) != 0) | (np.diff(both[2]) != 0), True)
    if both.shape[1] > 1 and both[1, -1] == 0:
        differ[-2] = True
    return both[:, differ]


def _chain(pdf: pd.DataFrame, budget: int) -> pd.DataFrame:
    """How each chunk of a group is entered, when the group is entered with ``shard_in`` and ``carry_in``."""
    pdf = pdf.sort_values(["chunk", "upto"])
    shard, carry = int(pdf["shard_in"].iloc[0]), int(pdf["carry_in"].iloc[0])
    entries = []
    for chunk, part in pdf.groupby("chunk"):
        entries.append((chunk, shard, carry))
        at = int(np.searchsorted(part["upto"].to_numpy(np.int64), budget - carry, side="left"))
        closed, left = int(part["closed"].iloc[at]), int(part["carry"].iloc[at])
        shard, carry = shard + closed, left if closed else carry + left
    return pd.DataFrame(entries, columns=["chunk", "shard_in", "carry_in"])


def _cut(pdf: pd.DataFrame, budget: int) -> pd.DataFrame:
    """The runs of batches that belong to one shard, inside one chunk."""
    pdf = pdf.sort_values("batch")
    batch = pdf["batch"].to_numpy()
    total = np.cumsum(pdf["weight"].to_numpy(np.int64))
    shard, missing = int(pdf["shard_in"].iloc[0]), budget - int(pdf["carry_in"].iloc[0])
    start, done, runs = 0, 0, []
    while start < len(batch):
        end = min(int(np.searchsorted(total, done + missing, side="left")), len(batch) - 1)
        runs.append((shard, batch[start], batch[end]))
        start, done, missing, shard = end + 1, int(total[end]), budget, shard + 1
    return pd.DataFrame(runs, columns=["shard_id", "first_batch", "last_batch"])


def split_by_shard(df: DataFrame) -> DataFrame:
    """Shard 0 becomes ``val``, all others ``train``; a corpus of one shard is all ``val``."""
    return df.withColumn("split", F.when(F.col("shard_id") == 0, "val").otherwise("train"))


def shard_manifest(df: DataFrame, tokens: Column) -> DataFrame:
    """Pairs and tokens per split and shard."""
    return df.groupBy("split", "shard_id").agg(F.count("*").alias("pairs"), F.sum(tokens).cast("long").alias("tokens"))
