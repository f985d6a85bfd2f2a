"""Benchmark decontamination by spaced-seed hashing.

A mask is a fixed pattern of token positions, some of which are ignored. The
tokens under a mask are hashed at every position of the benchmark texts and of
the documents; equal hashes are hits, which substitutions at ignored positions
do not disturb. Around each hit the item is laid along the document and the
stretches that agree are found. Stretches of one item that follow each other on
neighbouring diagonals, between which words were added or left out, are chained, the
words between them counting as differences. A chain is an overlap when at
least ``SHARE`` of its words agree, it has ``LEAST`` words or the whole of a shorter item, and it
either covers ``COVER`` of the item or has ``ENOUGH`` agreeing words, however long the item.

The masks look at four tokens. Whatever tokens are substituted, a stretch of five or more in
which ``SHARE`` agree has a hit under one of them. Benchmark texts shorter than the longest
mask are hashed under all their positions as well.

Documents are searched where they lie. A bit table of fixed size, ``2 ** FILTER``
bits made from the benchmark's hashes, drops most positions first; what is left
joins the benchmark's hashes on equality, and only documents with hits are laid
out again. There is no bound on hits, items or documents.

Rows: a null or empty text or item has no tokens and is never reported; a null
key of a document with hits is kept; repeated document rows are judged each by their
text; repeated items are reported under each id, an id with several texts with the best overlap of any, and items with a
null id under a null id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinline.llm.words import Hashes, plain_words
from twinline.session import settle

#: Masks over token positions: 1 is looked at, 0 ignored.
MASKS = ("1111", "11101", "11011", "10111")
FILTER = 24
LEAST = 8  # tokens an overlap must have, or the whole of a shorter item
SHARE = 0.8  # share of agreeing positions in an overlap
COVER = 0.5  # share of the item's tokens that must lie in the overlap,
ENOUGH = 13  # unless so many tokens agree
TOGETHER = 64  # items that are laid along a document at a time
STRETCH = 4  # agreeing tokens of a stretch that may be chained, or the whole of a shorter item


def _offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def seeds(hashes: np.ndarray, offsets: Sequence[int], span: int, salt: int) -> np.ndarray:
    """One hash of the tokens under a mask at every position of a text."""
    n = len(hashes) - span + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, salt, np.uint64)
    for i in offsets:
        total = (total ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total


def _masks(masks: Sequence[str], lengths: Iterable[int]) -> list[tuple[int, list[int], int]]:
    """``(salt, offsets, span)`` of the masks, and of those that items shorter than a mask need."""
    made = [(k + 1, _offsets(m), len(m)) for k, m in enumerate(masks)]
    longest = max(len(m) for m in masks)
    for n in sorted({x for x in lengths if 0 < x < longest}):
        made.append((1000 + n, list(range(n)), n))
    return made


def _hit_table(batches, masks, table: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """``(key, at, seed)`` of every position, or of those that the bit table lets pass."""
    known = Hashes()
    for batch in batches:
        keys, at, seed = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            hashes = known.of(plain_words(text.as_py()))
            for salt, offsets, span in masks:
                values = seeds(hashes, offsets, span, salt)
                places = np.arange(len(values))
                if table is not None:
                    low = (values & np.uint64((1 << FILTER) - 1)).astype(np.int64)
                    places = np.flatnonzero(table[low >> 3] >> (low & 7).astype(np.uint8) & 1)
                keys.append(np.full(len(places), key))
                at.append(places)
                seed.append(values[places])
        if keys:
            columns = [np.concatenate(c) for c in (keys, at, seed)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int32)), pa.array(columns[2].astype(np.int64))],
                names=["row", "at", "seed"],
            )


_HITS = "row long, at int, seed long"


def _overlaps(batches, least: int, share: float, cover: float, enough: int) -> Iterator[pa.RecordBatch]:
    """Verified overlaps of documents with the items laid at their diagonals."""
    known = Hashes()
    for batch in batches:
        out = []
        for key, check, text, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            doc = known.of(plain_words(text.as_py()))
            best: dict[int, tuple] = {}
            for item in items.as_py():
                words = known.of(plain_words(item["text"]))
                stretches = []
                for diagonal in item["diagonals"]:
                    first, last = max(0, -diagonal), min(len(words), len(doc) - diagonal)
                    if last <= first:
                        continue
                    same = doc[first + diagonal : last + diagonal] == words[first:last]
                    if last - first == len(words) and same.sum() >= share * len(words):  # the stretches may leave out its ends
                        stretches.append((diagonal, 0, len(words), int(same.sum())))
                    for a, b in _runs(same, share, min(STRETCH, len(words))):
                        stretches.append((first + diagonal + a, first + a, b - a, int(same[a:b].sum())))
                for start, length, matches, span in _chains(stretches, len(words), share):
                    whole = length >= min(least, len(words)) and matches >= share * span
                    if whole and (length >= cover * len(words) or matches >= enough):
                        found = matches, -start, length
                        if found > best.get(item["item_id"], (-1,)):
                            best[item["item_id"]] = found
            for item_id, (matches, start, length) in best.items():
                out.append((key, check, item_id, -start, length, matches, matches / length))
        columns = list(zip(*out)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "check", "item_id", "start", "length", "matches", "share"]
        )


def _best_run(same: np.ndarray, share: float) -> tuple[int, int]:
    """The stretch with the largest excess of agreements over the share that is asked for."""
    gain = np.where(same, 1.0 - share, -share)
    total = np.concatenate([[0.0], np.cumsum(gain)])
    lowest = np.minimum.accumulate(total)
    end = int(np.argmax(total - lowest))
    start = int(np.flatnonzero(total[: end + 1] == lowest[end])[-1])
    return start, end


def _runs(same: np.ndarray, share: float, least: int) -> Iterator[tuple[int, int]]:
    """The best stretch, then the best of what is left on either side, with ``least`` agreements or more."""
    left = [(0, len(same))]
    while left:
        low, high = left.pop()
        if high - low < least or np.count_nonzero(same[low:high]) < least:
            continue
        a, b = _best_run(same[low:high], share)
        a, b = low + a, low + b
        if np.count_nonzero(same[a:b]) >= least:
            yield a, b
        if b > a:
            left += [(low, a), (b, high)]


def _chains(stretches: list[tuple[int, int, int, int]], size: int, share: float) -> Iterator[tuple[int, int, int, int]]:
    """``(start, length, matches, span)`` of the best chain that ends with each of the ``(start, item start, length, matches)``.

    ``start`` and ``length`` are the document's; ``span`` counts the words of the stretches and the longer side of each gap.
    """
    made: list[tuple] = []
    first, reach = 0, size * (1 - share) / share  # a longer gap costs more than an item can gain
    stretches = sorted(stretches)
    for start, at, length, matches in stretches:
        while stretches[first][0] + size + reach < start:
            first += 1
        best, before = matches - share * length, None
        for k in range(first, len(made)):
            low, end, end_at, m, n = made[k]
            if not (stretches[k][0] < start and stretches[k][1] < at and end < start + length and end_at < at + length):
                continue
            common = max(end - start, end_at - at, 0)
            gap = max(start - end, at - end_at, 0)
            if common >= matches:
                continue
            score = (m + matches - common) - share * (n + length - common + gap)
            if score > best and m - share * n > share * gap:
                best, before = score, (low, m + matches - common, n + length - common + gap)
        low, m, n = before or (start, matches, length)
        made.append((low, start + length, at + length, m, n))
        yield low, start + length - low, m, n


def overlaps(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    masks: Sequence[str] = MASKS,
    least: int = LEAST,
    share: float = SHARE,
    cover: float = COVER,
    enough: int = ENOUGH,
) -> DataFrame:
    """Contaminated pairs ``(<key>, check, item_id, start, length, matches, share)``, the best overlap of each.

    ``start`` and ``length`` count the document's words; ``check`` is a hash of
    its text. Repeated document rows give one pair.
    """
    spark = docs.sparkSession
    bench = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    # An id may have several texts, and a text no id: each is a row of its own.
    bench = bench.filter("text is not null").distinct().withColumn("row", F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text"))
    longest = max(len(m) for m in masks)

    @F.pandas_udf("int")
    def length(texts):
        return texts.map(lambda x: len(plain_words(x)))

    # At most one row per length below the longest mask.
    short = bench.select(length("text").alias("n")).filter(F.col("n") < longest).distinct().collect()
    used = _masks(masks, (r.n for r in short))
    bench_hits = bench.select("row", "text").mapInArrow(lambda batches: _hit_table(batches, used, None), _HITS)
    bench_hits = settle(bench_hits.select(F.col("row").alias("item_id"), F.col("at").alias("item_at"), "seed").distinct(), "seeds")
    # A table of 2 ** FILTER bits, whatever the benchmark's size: bytes are gathered, never hashes.
    low = F.col("seed").bitwiseAND((1 << FILTER) - 1)
    bit = F.call_function("shiftleft", F.lit(1), low.bitwiseAND(7).cast("int"))
    cells = bench_hits.groupBy(F.shiftright(low, 3).alias("cell")).agg(F.bit_or(bit).alias("bits"))
    table = np.zeros(1 << (FILTER - 3), np.uint8)
    cells = cells.toArrow().to_pandas()
    table[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.uint8)
    shared = spark.sparkContext.broadcast(table)
    body = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    body = body.withColumn("check", F.xxhash64("text")).withColumn("row", F.xxhash64("key", "check"))
    hits = body.select("row", "text").mapInArrow(lambda batches: _hit_table(batches, used, shared.value), _HITS)
    laid = hits.join(bench_hits, "seed").select("row", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    laid = laid.groupBy("row", "item_id").agg(F.collect_set("diagonal").alias("diagonals"))
    # A document meets its items some at a time, however many a common phrase hits; texts come after the cut.
    place = F.row_number().over(W.partitionBy("row").orderBy("item_id"))
    laid = laid.withColumn("part", F.floor((place - 1) / TOGETHER))
    laid = laid.join(bench.select(F.col("row").alias("item_id"), "text"), "item_id")
    laid = settle(laid.groupBy("row", "part").agg(F.collect_list(F.struct("item_id", "text", "diagonals")).alias("items")), "laid")
    found = body.join(laid, "row").dropDuplicates(["row", "part"]).select("key", "check", "text", "items")
    pairs = found.mapInArrow(
        lambda batches: _overlaps(batches, least, share, cover, enough),
        "key long, check long, item_id long, start int, length int, matches int, share double",
    )
    named = settle(bench.select(F.col("row").alias("item_id"), F.col("item_id").alias("named")), "items")
    best = F.max_by(F.struct("start", "length", "matches", "share"), F.struct("matches", -F.col("start"), "length")).alias("best")
    pairs = pairs.join(named, "item_id").groupBy("key", "check", F.col("named").alias("item_id")).agg(best)
    return pairs.select(F.col("key").alias(key), "check", "item_id", "best.*")


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that overlap with no item, with all their columns.

    What goes is written first: where it is few, Catalyst moves no document.
    """
    dirty = settle(overlaps(docs, items, key, text, **options).select(F.col(key).alias("_key"), "check").distinct(), "dirty")
    own, check = F.col(key).cast("long").alias("_own"), F.xxhash64(F.col(text).cast("string")).alias("_hash")
    rows = docs.select(F.struct("*").alias("_row"), own, check)
    kept = rows.join(dirty, F.col("_own").eqNullSafe(F.col("_key")) & (F.col("_hash") == F.col("check")), "left_anti")
    return kept.select("_row.*")
