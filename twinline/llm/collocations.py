"""Phrases that stand together, by vertically partitioned suffix trees.

The suffixes of a text, one for each word and cut after ``LONGEST`` words or at the
end of its piece, are dealt out by their first words. A prefix with more
suffixes than ``BUDGET`` / 4 is made longer by a word, again and again, so that no
prefix of a group is large; the prefixes are then put into as many groups as the
budget asks for. A group's suffixes are sorted into a subtree, which no other group
knows of, and the number of leaves below a node is the count of its phrase. Nodes
above a lengthened prefix lie in several groups, and their parts are added.

Suffixes move in blocks: a task sorts those of ``CHUNK`` words at a time, counts equal
ones together and writes each group's share as numbers beside a list of its words. So a suffix
that is repeated everywhere costs a row per chunk, and it is never one group's load.
Words, and pairs of words, rarer than ``LEAST`` end a suffix, since no phrase that counts can hold
them. Which words are frequent and which prefixes are large, every task learns from tables of
``BITS`` bits, and which pairs may be frequent from ``PAIRS`` cells that count them by their hashes: sizes that
do not depend on the input. What only seems to be frequent or large does no harm, as
all counts are of the words themselves; in a very large corpus every cell is full and only words are sieved.

A phrase with at least ``LEAST`` occurrences is a candidate. Each cut into a first
part and a rest is scored by joins with the counts, exactly, and the lowest counts.
A candidate goes when a candidate with one more word, in front or behind, occurs as often;
counts never rise with length, so longer ones need not be looked at.

Rows: a null text is empty, a null language is ``und`` together with rows that say so;
repeated rows count each; empty tables give no rows. Ties are broken by phrase, in the order of UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinline.session import settle

LONGEST = 5
LEAST = 100
FIRST = 2_000  # reported of each language
UNKNOWN = "und"
CHUNK = 1 << 20  # words whose suffixes a task sorts at once
BUDGET = 1 << 20  # suffixes of a group
BITS = 1 << 23
PAIRS = 1 << 22  # cells that count word pairs
SLICE = 1 << 16  # cells that are added up together
_MIX = np.uint64(0x9E3779B97F4A7C15)
# Pieces end at these characters, words at spaces and tabs.
_BREAK = b"."
_TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _BREAK * 10)


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case, and ``_BREAK`` between pieces."""
    if not text:
        return []
    return text.encode("utf-8", "replace").lower().translate(_TABLE).replace(_BREAK, b" . ").split()


class _Numbers(dict):
    """Numbers of words in the order they are met; 0 is a break."""

    def __init__(self):
        self[_BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _chunks(batches: Iterable[pa.RecordBatch], chunk: int) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """``(language, words, numbers)``: numbers index the words; a break stands at both ends and between texts."""
    held: dict[str, tuple[_Numbers, list[int]]] = {}
    size = 0

    def given() -> Iterator[tuple[str, list[bytes], np.ndarray]]:
        for lang, (numbers, found) in held.items():
            yield lang, list(numbers), np.array([0, *found, 0], np.int64)
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            words = words_of(text.as_py())
            numbers, found = held.setdefault(lang.as_py(), (_Numbers(), []))
            for at in range(0, len(words), chunk):  # a text longer than a chunk is still one sequence
                found.extend(map(numbers.__getitem__, words[at : at + chunk]))
            found.append(0)
            size += len(words)
            if size >= chunk:
                yield from given()
                size = 0
    yield from given()


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """As Spark's ``xxhash64(lang, word)``."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _further(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of prefixes that are one word longer."""
    mixed = (prefix ^ (prefix >> np.uint64(29))) * _MIX + word
    return mixed ^ (mixed >> np.uint64(32))


def _bit_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bit for each hash of the column ``h``, ``bits`` a power of two; at most ``bits`` / 64 rows come to the driver."""
    at = F.pmod(F.col("h"), F.lit(bits))
    words = hashes.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {bits}) & 63 as int))")).alias("word"))
    found = words.toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[found["at"].to_numpy()] = found["word"].to_numpy()
    return table


def _has(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes % np.uint64(len(table) * 64)).astype(np.int64)
    return (table[at >> 6] >> (at & 63) & 1).astype(bool)


def _counted(batches: Iterable[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """``(lang, word, n)`` of each chunk."""
    for lang, words, numbers in _chunks(batches, chunk):
        counts = np.bincount(numbers, minlength=len(words))[1:]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(counts), pa.string()), pa.array(words[1:], pa.binary()), pa.array(counts, pa.int64())], ["lang", "word", "n"]
        )


def _suffixes(
    numbers: np.ndarray, frequent: np.ndarray, longest: int, hashes: np.ndarray | None = None, pairs: np.ndarray | None = None
) -> np.ndarray:
    """A row of word numbers for each suffix of two words or more, 0 behind its end; they end at rare words and rare ``pairs``."""
    numbers = np.where(frequent[numbers], numbers, 0)
    padded = np.concatenate([numbers, np.zeros(longest, np.int64)])
    joined = np.append((padded[:-1] > 0) & (padded[1:] > 0), False)
    if pairs is not None:
        at = np.flatnonzero(joined)
        joined[at] = _has(pairs, _further(hashes[padded[at]], hashes[padded[at + 1]]))
    starts = np.flatnonzero(joined)
    rows = np.empty((len(starts), longest), np.int64)
    rows[:, 0], rows[:, 1] = padded[starts], padded[starts + 1]
    for d in range(2, longest):
        on = (rows[:, d - 1] > 0) & joined[np.minimum(starts + d - 1, len(joined) - 1)]
        rows[:, d] = np.where(on, padded[np.minimum(starts + d, len(padded) - 1)], 0)
    return rows


def _distinct(rows: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different rows in order, with their weights added up."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    bits = max(1, int(rows.max()).bit_length())
    keys, per = [], max(1, 63 // bits)  # a key holds as many columns as fit
    for d in range(0, rows.shape[1], per):
        key = np.zeros(len(rows), np.int64)
        for e in range(d, min(d + per, rows.shape[1])):
            key = key << bits | rows[:, e]
        keys.append(key)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(rows), bool)
    new[0] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    at = np.flatnonzero(new)
    total = np.diff(np.append(at, len(rows))) if weights is None else np.add.reduceat(weights[order], at)
    return rows[order[at]], total


def _prefixes(rows: np.ndarray, hashes: np.ndarray, large: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each row's prefix, and the prefix's hash: the shortest that is not ``large``.

    A row that ends within a large prefix stays with it, and counts as if it had one more word.
    """
    length, found = np.ones(len(rows), np.int64), hashes[rows[:, 0]]
    left = np.arange(len(rows))
    for d, table in enumerate(large, 1):
        left = left[_has(table, found[left])]
        length[left] = d + 1
        left = left[rows[left, d] > 0]
        found[left] = _further(found[left], hashes[rows[left, d]])
    return length, found


_SURVEY = "level int, h long, n long, cells binary"


def _survey(
    batches: Iterable[pa.RecordBatch], chunk: int, longest: int, least: int, pairs: int, frequent: np.ndarray, large: np.ndarray, share: float
) -> Iterator[pa.RecordBatch]:
    """What decides how suffixes are cut and dealt out.

    ``(d, h, n)`` counts prefixes of ``d`` > 1 words by their hashes, below ``large`` first words. Those under
    ``share`` of a chunk's suffixes are left out, so no count is short by more than that share of all.
    ``(0, slice, task, cells)`` are this task's counts of word pairs in ``pairs`` cells, up to ``least`` each.
    """
    from pyspark import TaskContext

    schema = pa.schema([("level", pa.int32()), ("h", pa.int64()), ("n", pa.int64()), ("cells", pa.binary())])
    cells = np.zeros(pairs, np.uint32)
    for lang, words, numbers in _chunks(batches, chunk):
        hashes = _hashes(lang, words)
        rows = _suffixes(numbers, _has(frequent, hashes), longest)
        found = _further(hashes[rows[:, 0]], hashes[rows[:, 1]])
        np.add.at(cells, (found % np.uint64(pairs)).astype(np.int64), 1)
        few = share * len(rows)
        heavy = _has(large, hashes[rows[:, 0]])
        rows, found = rows[heavy], found[heavy]
        for d in range(2, longest):
            keys, at, counts = np.unique(found.view(np.int64), return_inverse=True, return_counts=True)
            some = counts >= few
            n = int(some.sum())
            levels = pa.array(np.full(n, d), pa.int32())
            yield pa.RecordBatch.from_arrays([levels, pa.array(keys[some]), pa.array(counts[some], pa.int64()), pa.nulls(n, pa.binary())], schema=schema)
            on = some[at] & (rows[:, d] > 0)
            rows, found = rows[on], _further(found[on], hashes[rows[on, d]])
    task = TaskContext.get().partitionId()
    kind = _cell_kind(least)
    cells = np.minimum(cells, least).astype(kind)
    for i, part in enumerate(np.split(cells, max(1, pairs // SLICE))):
        if part.any():
            yield pa.RecordBatch.from_pylist([{"level": 0, "h": i, "n": task, "cells": part.tobytes()}], schema)


def _cell_kind(least: int) -> np.dtype:
    return np.min_scalar_type(least)


def _frequent_pairs(survey: DataFrame, pairs: int, least: int) -> np.ndarray:
    """A bit for each cell that counts ``least`` pairs or more."""
    kind, size = _cell_kind(least), min(SLICE, pairs)

    def added(group: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for part in group.column("cells"):
            total += np.frombuffer(part.as_buffer(), kind)
        cells = np.minimum(total, least).astype(kind).tobytes()
        return pa.table({"h": group.column("h")[:1], "part": pa.array([0], pa.int64()), "cells": pa.array([cells], pa.binary())})

    parts = survey.filter("level = 0").select("h", F.floor(F.col("n") / 512).alias("part"), "cells")
    form = "h long, part long, cells binary"
    parts = parts.groupBy("h", "part").applyInArrow(added, form).groupBy("h").applyInArrow(added, form)
    table = np.zeros(pairs, bool)
    for row in parts.collect():  # as many bytes as there are cells
        table[row.h * size : (row.h + 1) * size] = np.frombuffer(row.cells, kind) >= least
    return np.packbits(table, bitorder="little").view(np.int64)


_BLOCK = "group long, lang string, size int, words binary, rows binary, counts binary, lengths binary"


def _blocks(
    batches: Iterable[pa.RecordBatch], chunk: int, longest: int, frequent: np.ndarray, pairs: np.ndarray, large: list[np.ndarray], groups: int
) -> Iterator[pa.RecordBatch]:
    """Each group's different suffixes of a chunk, with their counts and the lengths of their prefixes."""
    for lang, words, numbers in _chunks(batches, chunk):
        hashes = _hashes(lang, words)
        rows, counts = _distinct(_suffixes(numbers, _has(frequent, hashes), longest, hashes, pairs))
        length, found = _prefixes(rows, hashes, large)
        group = (found % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0]) if len(order) else []
        out = []
        for a, b in zip(starts, [*starts[1:], len(order)]):
            at = order[a:b]
            used, small = np.unique(np.append(rows[at].ravel(), 0), return_inverse=True)
            kind = "<u2" if len(used) < 1 << 16 else "<u4"
            some = b" ".join([words[i] for i in used[1:].tolist()])
            counted = counts[at].astype("<u4").tobytes()
            out.append((int(group[at[0]]), lang, len(used), some, small[:-1].astype(kind).tobytes(), counted, length[at].astype("u1").tobytes()))
        columns = list(zip(*out)) or [[]] * 7
        kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.binary()] * 4]
        names = ["group", "lang", "size", "words", "rows", "counts", "lengths"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def _subtree(blocks: list[dict], longest: int, least: int) -> Iterator[tuple[bytes, int, int, bool]]:
    """``(phrase, words, count, whole)`` of the nodes that count, or that other groups hold parts of."""
    numbers = _Numbers()
    parts, weights, lengths = [], [], []
    for block in blocks:
        own = block["words"].split(b" ") if block["words"] else []
        place = np.array([0, *map(numbers.__getitem__, own)], np.int64)
        rows = np.frombuffer(block["rows"], "<u2" if block["size"] < 1 << 16 else "<u4").reshape(-1, longest)
        parts.append(place[rows])
        weights.append(np.frombuffer(block["counts"], "<u4").astype(np.int64))
        lengths.append(np.frombuffer(block["lengths"], "u1").astype(np.int64))
    # A suffix has one prefix, whose length stands before its words while rows are sorted and counted.
    rows, total = _distinct(np.column_stack([np.concatenate(parts), np.concatenate(lengths)]), np.concatenate(weights))
    names, prefix, rows = list(numbers), rows[:, -1], rows[:, :-1]
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for d in range(longest):
        new[1:] |= rows[1:, d] != rows[:-1, d]
        at = np.flatnonzero(new)
        if d == 0:
            continue
        count = np.add.reduceat(total, at)
        whole = prefix[at] <= d + 1
        keep = (rows[at, d] > 0) & ((count >= least) | ~whole)
        for i, n, w in zip(at[keep].tolist(), count[keep].tolist(), whole[keep].tolist()):
            yield b" ".join([names[j] for j in rows[i, : d + 1].tolist()]), d + 1, n, w


def counts(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    longest: int = LONGEST,
    least: int = LEAST,
    chunk: int = CHUNK,
    budget: int = BUDGET,
    bits: int = BITS,
    pairs: int = PAIRS,
) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, words, n)`` of all phrases of one to ``longest`` words with ``least`` occurrences, and ``(lang, n)``, all words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    words = rows.mapInArrow(lambda batches: _counted(batches, chunk), "lang string, word binary, n long")
    words = settle(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    totals = settle(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    single = words.filter(F.col("n") >= least).withColumn("h", F.xxhash64("lang", "word"))
    frequent = _bit_table(single, bits)
    suffixes = single.agg(F.sum("n")).first()[0] or 0
    groups, limit = max(1, -(-2 * suffixes // budget)), budget // 4
    # Short by half the limit at most: every prefix above the limit is seen to be above its half.
    large = [_bit_table(single.filter(F.col("n") > limit), bits)]
    known = spark.sparkContext.broadcast((frequent, large[0], limit / 2 / max(suffixes, 1)))
    survey = rows.mapInArrow(lambda batches: _survey(batches, chunk, longest, least, pairs, *known.value), _SURVEY)
    survey = settle(survey, "survey")
    seen = survey.filter("level > 0").groupBy("level", "h").agg(F.sum("n").alias("n")).filter(F.col("n") > limit / 2)
    seen = settle(seen, "prefixes")
    large += [_bit_table(seen.filter(F.col("level") == d), bits) for d in range(2, longest)]
    known = spark.sparkContext.broadcast((frequent, _frequent_pairs(survey, pairs, least), large))
    blocks = rows.mapInArrow(lambda batches: _blocks(batches, chunk, longest, *known.value, groups), _BLOCK)

    def counted(group: pa.Table) -> pa.Table:
        by_lang: dict[str, list[dict]] = {}
        for block in group.to_pylist():
            by_lang.setdefault(block["lang"], []).append(block)
        out = [(name, *node) for name, some in by_lang.items() for node in _subtree(some, longest, least)]
        columns = list(zip(*out)) or [[]] * 5
        kinds = [pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.bool_()]
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["lang", "phrase", "words", "n", "whole"])

    nodes = blocks.groupBy("group").applyInArrow(counted, "lang string, phrase binary, words int, n long, whole boolean")
    phrases = nodes.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    singles = single.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "n")
    every = singles.unionByName(phrases).withColumn("phrase", F.decode("phrase", "UTF-8"))
    return settle(every, "phrases"), totals


def _ratio(a: str, n: str, first: str, rest: str) -> Column:
    """floor(1000 a n / (l r)), exact up to counts of sixteen digits."""
    wide = lambda name: f"cast({name} as decimal(16,0))"
    return F.expr(f"(cast(1000 as decimal(4,0)) * ({wide(a)} * {wide(n)})) div ({wide(first)} * {wide(rest)})")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", first: int = FIRST, **options) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best ``first`` phrases of each language."""
    known, totals = counts(docs, lang, text, **options)
    candidates = known.filter("words > 1").withColumnRenamed("n", "a")
    parts = F.split("phrase", " ")
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.withColumn("head", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " "))
    cut = cut.withColumn("tail", F.array_join(F.slice(parts, F.col("k") + 1, F.col("words") - F.col("k")), " "))
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = known.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    cut = settle(cut.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]), "cuts")
    # One word less, and as frequent: its words lie inside a candidate that occurs as often.
    inner = cut.filter("k = words - 1 and l = a").select("lang", F.col("head").alias("phrase"))
    inner = inner.union(cut.filter("k = 1 and r = a").select("lang", F.col("tail").alias("phrase")))
    scored = cut.join(totals, "lang").withColumn("score", _ratio("a", "n", "l", "r"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    kept = best.join(settle(inner.distinct(), "inner"), ["lang", "phrase"], "left_anti")
    order = W.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "best.l", "best.r", "n", "best.score")
