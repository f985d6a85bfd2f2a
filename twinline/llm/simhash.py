"""Near-duplicates by SimHash, with pigeonring filtering.

The bits of a fingerprint are cut into ``m`` segments on a ring. If two
fingerprints differ in at most ``t`` bits, some segment starts a chain in which
every first ``l`` segments differ in at most ``l * t / m`` bits. Candidates are
therefore joined on the first segments of such chains, longer chains are tested
on the candidates, and only what is left meets the full Hamming check.

With ``m = t + 1`` a chain starts with an equal segment, followed by one that
differs in one bit at most; joining on both, with one bit flipped on one side,
finds every pair.

Fingerprints that occur often are joined once. A bucket is linked by a spanning
forest, not by all its pairs; a bucket with more than ``PIECE`` fingerprints is cut
into pieces that meet pairwise in different tasks. No row is dropped for its bucket.

Rows: a null text has no words and the fingerprint zero, which links like any
other, and all texts without words are alike; a text of fewer words than a shingle is one shingle; repeated rows share a
fingerprint; a component of null keys alone has a null id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.llm.components import components
from twinline.llm.words import ascii_words
from twinline.session import settle

SEED = 42
PIECE = 8_192
SMALL = 48  # rows of a bucket up to which its pairs are laid out together
PAIRS = 1 << 20  # pairs tested at once
STRIDE = 1 << 13  # shingles whose bits are counted at once


@dataclass(frozen=True)
class Ring:
    """64 bits cut into ``segments``, one more than the ``threshold`` of bits in which links differ.

    ``chain`` is the length up to which chains are tested.
    """

    segments: int
    threshold: int
    chain: int

    def __post_init__(self):
        if self.segments != self.threshold + 1:
            raise ValueError("the join finds every link only with one segment more than bits may differ")

    @property
    def cuts(self) -> list[tuple[int, int]]:
        """Offset and width of each segment."""
        at = [64 * i // self.segments for i in range(self.segments + 1)]
        return [(a, b - a) for a, b in zip(at, at[1:])]


RING = Ring(segments=5, threshold=4, chain=4)


def shingles(words: list[bytes], shingle: int) -> np.ndarray:
    """Hashes of the shingles in their order, repeats included."""
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> bytes:
    """The fingerprint, most significant byte first."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, STRIDE):
        some = hashes[at : at + STRIDE].astype(">u8")
        bits = np.unpackbits(some.view(np.uint8).reshape(len(some), 8), axis=1)
        counts += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return np.packbits(2 * counts > n).tobytes()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """``(key, fp, check)`` of every row; ``check`` is a hash of the text that tells rows of one key apart."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingles(ascii_words(x.as_py()), shingle)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], names=["key", "fp", "check"])

    text_column = F.col(text).cast("string")
    rows = docs.select(F.col(key).cast("long").alias("key"), text_column.alias("text"), F.xxhash64(text_column).alias("check"))
    return rows.mapInArrow(hashed, "key long, fp binary, check long")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 8)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])
    return fixed.cast(pa.binary())


def _segments(rows: np.ndarray, ring: Ring) -> np.ndarray:
    """Values of the segments, counted from the most significant bit: one row per fingerprint."""
    values = rows.view(">u8").astype(np.uint64)[:, 0]
    return np.stack([(values >> np.uint64(64 - a - w)) & np.uint64((1 << w) - 1) for a, w in ring.cuts], axis=1)


def _keys(batches: Iterable[pa.RecordBatch], ring: Ring) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, n = _matrix(batch.column(0)), ring.segments
        values = _segments(rows, ring)
        for i in range(n):
            following = (i + 1) % n
            width = ring.cuts[following][1]
            head = np.uint64(i) << np.uint64(56) | values[:, i] << np.uint64(width) | values[:, following]
            for number, keys in enumerate([head, *(head ^ np.uint64(1 << bit) for bit in range(width))]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.astype(np.int64)), pa.array(np.full(len(rows), number == 0)), _binary(rows)],
                    names=["bucket", "exact", "fp"],
                )


def _close(a: np.ndarray, b: np.ndarray, ring: Ring) -> np.ndarray:
    """Which pairs of rows are links: some chain keeps its budgets, then the full check."""
    differ = np.bitwise_count(_segments(a, ring) ^ _segments(b, ring)).astype(np.int16)
    viable = np.ones(differ.shape, bool)
    total = np.zeros(differ.shape, np.int16)
    for length in range(1, ring.chain + 1):
        total += np.roll(differ, 1 - length, axis=1)
        viable &= total <= length * ring.threshold / ring.segments
    found = np.flatnonzero(viable.any(axis=1))
    return found[differ[found].sum(axis=1) <= ring.threshold]


def _distance(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(rows.view(np.uint64) ^ one.view(np.uint64)).sum(axis=1)


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _spanning(rows: np.ndarray, ring: Ring) -> list[tuple[int, int]]:
    """Links that connect a large bucket as all its links would.

    Each leader is compared with all rows, and the rows within the threshold
    need no leader of their own. Rows of different components that no leader
    connects are compared only where the distance from a leader allows a link.
    """
    forest, links, near, n = _Forest(len(rows)), [], {}, len(rows)
    rows = np.ascontiguousarray(rows)
    open_rows = np.ones(n, bool)
    for leader in range(n):
        if not open_rows[leader]:
            continue
        far = _distance(rows, rows[leader : leader + 1])
        within = np.flatnonzero(far <= ring.threshold)
        links += [(leader, int(j)) for j in within if forest.join(leader, int(j))]
        open_rows[within] = False
        fringe = np.flatnonzero((far > ring.threshold) & (far <= 2 * ring.threshold))
        if len(within) > 1 and len(fringe):
            near[leader] = within, fringe
    # All rows near a leader are one component by now; only fringes of another may still link to them.
    labels = np.array([forest.root(i) for i in range(n)])
    for leader, (within, fringe) in near.items():
        for i in fringe[labels[fringe] != labels[leader]].tolist():
            if labels[i] == labels[leader]:
                continue
            hits = within[_distance(rows[within], rows[i : i + 1]) <= ring.threshold]
            if len(hits):
                links.append((i, int(hits[0])))
                labels[labels == labels[i]] = labels[leader]
    return links


def _pairs(rows: np.ndarray, exact: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ring: Ring) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]).tolist():
        first, second = np.triu_indices(size, 1)
        at = starts[sizes == size]
        each = max(1, PAIRS // len(first))
        for k in range(0, len(at), each):
            a = (at[k : k + each, None] + first).ravel()
            b = (at[k : k + each, None] + second).ravel()
            some = exact[a] | exact[b]
            a, b = a[some], b[some]
            found = _close(rows[a], rows[b], ring)
            yield a[found], b[found]
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        links = _spanning(rows[start : start + size], ring)
        if links:
            yield tuple(np.array(links).T + start)


def _forest_of(rows: np.ndarray, exact: np.ndarray, runs: np.ndarray, ring: Ring) -> pa.RecordBatch:
    """Star links ``(a, b)`` with the components of all runs of the rows."""
    starts = np.concatenate([[0], np.flatnonzero(runs[1:] != runs[:-1]) + 1])
    sizes = np.diff(np.append(starts, len(runs)))
    found = list(_pairs(rows, exact, starts, sizes, ring))
    a = np.concatenate([np.empty(0, int), *(x for x, _ in found)])
    b = np.concatenate([np.empty(0, int), *(x for _, x in found)])
    used, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    kept = np.ascontiguousarray(rows[used]).view(f"V{rows.shape[1]}").ravel()
    names, same = np.unique(kept, return_inverse=True)
    a, b = same[places[: len(a)]], same[places[len(a) :]]
    labels = np.arange(len(names))
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == labels).all():
            break
        labels = new
    linked = np.flatnonzero(labels != np.arange(len(names)))
    table = names.view(np.uint8).reshape(len(names), rows.shape[1])
    return pa.RecordBatch.from_arrays([_binary(table[linked]), _binary(table[labels[linked]])], names=["a", "b"])


def _scan(batches: Iterable[pa.RecordBatch], ring: Ring) -> Iterator[pa.RecordBatch]:
    held = (np.empty((0, 8), np.uint8), np.empty(0, bool), np.empty(0, np.int64))
    for batch in batches:
        runs = np.concatenate([held[2], batch.column(0).to_numpy(zero_copy_only=False)])
        exact = np.concatenate([held[1], batch.column(1).to_numpy(zero_copy_only=False)])
        rows = np.concatenate([held[0], _matrix(batch.column(2))])
        if not len(runs):
            continue
        last = np.searchsorted(runs, runs[-1])
        if last:
            yield _forest_of(rows[:last], exact[:last], runs[:last], ring)
        held = rows[last:], exact[last:], runs[last:]
    if len(held[2]):
        yield _forest_of(*held, ring)


def links(distinct: DataFrame, ring: Ring, piece: int = PIECE) -> DataFrame:
    """Links ``(a, b)`` that connect different fingerprints ``(fp)`` as all links would."""
    rows = distinct.select("fp").mapInArrow(lambda batches: _keys(batches, ring), "bucket long, exact boolean, fp binary")
    hot = settle(rows.groupBy("bucket").count().filter(F.col("count") > piece), "buckets")
    if not hot.isEmpty():
        pieces = F.ceil(F.col("count") / piece).cast("int")
        rows = rows.join(hot, "bucket", "left").withColumn("pieces", F.coalesce(pieces, F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("pieces"))
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        pair = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
        rows = rows.select(F.when(F.col("pieces") > 1, pair).otherwise(F.col("bucket")).alias("bucket"), "exact", "fp")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(lambda batches: _scan(batches, ring), "a binary, b binary")


def _rooted(rows: DataFrame, ring: Ring) -> DataFrame:
    """``(fp, low, root)`` of every different fingerprint; ``low`` is its smallest key, ``root`` the smallest fingerprint links lead to."""
    distinct = settle(rows.groupBy("fp").agg(F.min("key").alias("low")), "distinct")
    linked = components(links(distinct, ring)).withColumnRenamed("node", "fp")
    return settle(distinct.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")


def group(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, ring: Ring = RING) -> DataFrame:
    """``(<key>, fp, check, root, component)`` of every row.

    ``component`` is the smallest key that links lead to, ``root`` its smallest fingerprint.
    """
    rows = settle(fingerprints(docs, key, text, shingle), "fingerprints")
    rooted = _rooted(rows, ring)
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    named = rooted.join(lowest, "root").select("fp", "root", "component")
    return rows.join(named, "fp").select(F.col("key").alias(key), "fp", "check", "root", "component")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, ring: Ring = RING) -> DataFrame:
    """One row of each component of :func:`group`, the one with the smallest key; the columns of ``docs``.

    Nulls come after all keys; of texts with one key that with the smaller hash stays, and of equal rows one. Rows are
    dropped by a table of the keys and text hashes that go, so where it is small no document is moved.
    """
    rows = settle(group(docs, key, text, shingle, ring).select(F.col(key).alias("key"), "check", "root"), "grouped")
    first = F.struct(F.col("key").isNull().alias("none"), "key", "check")
    kept = rows.groupBy("root").agg(F.min(first).alias("first"))
    kept = kept.select(F.col("first.key").alias("_key"), F.col("first.check").alias("_check"))
    found = rows.groupBy("key", "check").agg(F.count("*").alias("n"))
    named = F.col("key").eqNullSafe(F.col("_key")) & (F.col("check") == F.col("_check"))
    found = found.join(kept.withColumn("stays", F.lit(True)), named, "left").select("key", "check", "n", F.col("stays").isNotNull().alias("stays"))
    marked = settle(found.filter("n > 1 or not stays"), "marked")
    own = docs.select(F.struct("*").alias("_row"), F.col(key).cast("long").alias("_key"), F.xxhash64(F.col(text).cast("string")).alias("_check"))
    single = own.join(marked, named, "left_anti").select("_row.*")
    repeated = marked.filter("stays")
    if repeated.isEmpty():
        return single
    return single.union(own.join(repeated, named, "left_semi").dropDuplicates(["_key", "_check"]).select("_row.*"))
