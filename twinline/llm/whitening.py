"""Whitening by QDWH spectral divide and conquer.

A vector's entries, times ``SCALE`` and rounded down, become whole numbers. The
different vectors are the fit list; its size and sums are exact, and its covariance
is summed from centred rows, a block of rows at a time. The eigenvectors come from
polar decompositions alone: the orthogonal polar factor of the covariance less a
shift is the matrix sign, whose positive part projects on the eigenvectors above the
shift. Each side of that split is a smaller covariance of its own, split again until
a side is a single component. Sides below the wanted components are left alone. The
polar factor is reached by dynamically weighted Halley steps, by QR while the matrix
is ill conditioned and by Cholesky after that.

The fit list, its sums and its covariance are made by Spark; only the sums and the
covariance, as large as a vector's length and its square, come to the driver, and only the
mean and the few components go to the tasks.

Rows: vectors that are null or hold null or non-finite entries, or entries that are
no longs when scaled, take no part; a null key is kept. Repeated rows are each
returned and are fitted once. Vectors of each length are whitened among their own
kind. Components without variance are left out, so a length with a single different
vector, an empty vector and an empty table give no rows. Equal eigenvalues share a
space; any orthonormal basis of it is an answer, the same for all rows. A deviation
that is no long is null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.session import settle

SCALE = 256
COMPONENTS = 4
SEED = 11
LONG = 1 << 63


# Eigenvectors from polar factors


def polar(a: np.ndarray, steps: int = 60) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by dynamically weighted Halley steps."""
    size, one = len(a), np.eye(len(a))
    high = np.abs(a).sum(axis=0).max()
    x = a / high
    smallest = 1 / np.abs(np.linalg.pinv(x, rcond=1e-15)).sum(axis=0).max()
    low = float(np.clip(0.9 * smallest / np.sqrt(size), np.finfo(float).eps, 1))
    for _ in range(steps):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + d)
        w = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * root), 0))
        b = (w - 1) ** 2 / 4
        c = w + b - 1
        if c > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, one]))
            more = (w - b / c) / np.sqrt(c) * q[:size] @ q[size:].T
        else:
            factor = np.linalg.cholesky(one + c * x.T @ x)
            more = (w - b / c) * np.linalg.solve(factor.T, np.linalg.solve(factor, x.T)).T
        new = b / c * x + more
        new = (new + new.T) / 2
        low = min(1.0, low * (w + b * square) / (1 + c * square))
        moved, x = np.linalg.norm(new - x), new
        if moved < 1e-10 * np.sqrt(size) and 1 - low < 1e-10:
            break
    return x


def split(a: np.ndarray, shift: float) -> tuple[np.ndarray, int]:
    """An orthonormal basis whose first columns, as many as the number says, span the eigenvectors above ``shift``."""
    size = len(a)
    projector = (polar(a - shift * np.eye(size)) + np.eye(size)) / 2
    above = int(np.rint(np.trace(projector)))
    mixed = np.random.default_rng(SEED).standard_normal((size, size))
    basis, _ = np.linalg.qr(projector @ mixed)
    basis, _ = np.linalg.qr(np.hstack([projector @ basis[:, :above], basis[:, above:] - projector @ basis[:, above:]]))
    return basis, above


def components(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and their eigenvectors as columns."""
    size = len(a)
    scale = np.abs(a).max(initial=0.0)
    middle = np.trace(a) / max(size, 1)
    if size <= 1 or np.abs(a - middle * np.eye(size)).max() <= 4 * np.finfo(float).eps * scale:
        return np.diag(a)[:wanted].copy(), np.eye(size)[:, :wanted]
    spread = np.linalg.norm(a - middle * np.eye(size)) / size
    # The mean of the eigenvalues always parts them; the median parts them evenly.
    shifts = [np.median(np.diag(a)), middle, *(middle + spread * x for x in (0.07, -0.07, 0.31, -0.31, 0.003, -0.003))]
    best = None
    for shift in shifts:
        basis, above = split(a, float(shift))
        if not 0 < above < size:
            continue
        rest = np.linalg.norm(basis[:, :above].T @ a @ basis[:, above:])
        if best is None or rest < best[0]:
            best = rest, basis, above
        if rest <= 1e-13 * scale * size:
            break
    if best is None:  # nothing parts them: they are equal up to rounding
        return np.diag(a)[:wanted].copy(), np.eye(size)[:, :wanted]
    _, basis, above = best
    found = []
    for part, left in ((basis[:, :above], wanted), (basis[:, above:], wanted - above)):
        if left > 0:
            inner = part.T @ a @ part
            values, vectors = components((inner + inner.T) / 2, left)
            found.append((values, part @ vectors))
    vectors = np.hstack([v for _, v in found])
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# Sums over the fit list


def _stacked(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, places, rows)`` of a batch's vectors."""
    column = batch.column(name)
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        yield length, at, values[offsets[at][:, None] + np.arange(length)]


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(length, pos, n, total)`` of this task's vectors."""
    held: dict[int, list] = {}
    for batch in batches:
        for length, _, rows in _stacked(batch, "x"):
            n, total = held.get(length, (0, 0))
            held[length] = n + len(rows), total + rows.astype(object).sum(axis=0)
    for length, (n, total) in held.items():
        yield pa.RecordBatch.from_pylist(
            [{"length": length, "pos": i, "n": n, "total": str(t)} for i, t in enumerate(total)],
            pa.schema([("length", pa.int32()), ("pos", pa.int32()), ("n", pa.int64()), ("total", pa.string())]),
        )


@dataclass(frozen=True)
class Kind:
    """What is known of the vectors of one length."""

    n: int
    sums: list[int]
    vectors: np.ndarray | None = None
    values: np.ndarray | None = None
    trace: float = 0.0
    error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def white(self, rows: np.ndarray) -> np.ndarray:
        """Projections of centred rows, with unit variance."""
        return (rows - self.mean) @ self.vectors / np.sqrt(self.values)


def _moments(batches: Iterable[pa.RecordBatch], kinds: dict[int, Kind], white: bool) -> Iterator[pa.RecordBatch]:
    """``(length, pos, task, products)``: rows of this task's sums of products of centred, or whitened, vectors."""
    from pyspark import TaskContext

    task, held = TaskContext.get().partitionId(), {}
    for batch in batches:
        for length, _, rows in _stacked(batch, "x"):
            kind = kinds[length]
            centred = kind.white(rows) if white else rows - kind.mean
            held[length] = held.get(length, 0) + centred.T @ centred
    schema = pa.schema([("length", pa.int32()), ("pos", pa.int32()), ("task", pa.int32()), ("products", pa.list_(pa.float64()))])
    for length, products in held.items():
        rows = [{"length": length, "pos": i, "task": task, "products": p.tolist()} for i, p in enumerate(products)]
        yield pa.RecordBatch.from_pylist(rows, schema)


def _covariances(fit: DataFrame, kinds: dict[int, Kind], white: bool = False) -> dict[int, np.ndarray]:
    """Covariance by length; each row of a matrix is added up by a task of its own, in the order of the partial sums."""

    def added(parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("task")
        products = sum(np.array(p) for p in parts.column("products").to_pylist())
        return pa.table({"length": parts.column("length")[:1], "pos": parts.column("pos")[:1], "products": [products.tolist()]})

    known = {length: kind for length, kind in kinds.items() if not white or len(kind.values)}
    few = fit.filter(F.size("x").isin(list(known))) if known else fit.limit(0)
    parts = few.mapInArrow(lambda batches: _moments(batches, known, white), "length int, pos int, task int, products array<double>")
    rows = parts.groupBy("length", "pos").applyInArrow(added, "length int, pos int, products array<double>").collect()
    found: dict[int, np.ndarray] = {}
    for row in sorted(rows, key=lambda r: (r.length, r.pos)):
        found.setdefault(row.length, []).append(row.products)
    return {length: np.array(m) / kinds[length].n for length, m in found.items()}


def whole(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(key, x)``: the usable vectors as whole numbers."""
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    fine = F.forall("v", lambda c: F.coalesce((F.abs(c) < LONG / 2 / scale) & ~F.isnan(c), F.lit(False)))
    return rows.filter(fine).select("key", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))


def fit(rows: DataFrame, wanted: int = COMPONENTS) -> dict[int, Kind]:
    """What whitens the vectors ``x`` of each length."""
    different = settle(rows.select("x").filter(F.size("x") > 0).distinct(), "fit-list")
    sums = different.mapInArrow(_sums, "length int, pos int, n long, total string")
    sums = sums.groupBy("length", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    kinds: dict[int, Kind] = {}
    for row in sorted(sums.collect(), key=lambda r: (r.length, r.pos)):
        kinds.setdefault(row.length, Kind(row.n, [])).sums.append(int(row.total))
    for length, covariance in _covariances(different, kinds).items():
        values, found = components(covariance, wanted)
        some = values > max(values.max(initial=0.0), 0) * length * np.finfo(float).eps
        kinds[length] = Kind(kinds[length].n, kinds[length].sums, found[:, some], values[some], float(np.trace(covariance)))
    for length, white in _covariances(different, kinds, white=True).items():
        kind, error = kinds[length], float(np.abs(white - np.eye(len(white))).max())
        kinds[length] = Kind(kind.n, kind.sums, kind.vectors, kind.values, kind.trace, error)
    return kinds


def _deviations(rows: np.ndarray, kind: Kind) -> list[int | None]:
    widest = kind.n * int(np.abs(rows).max(initial=0)) + max(map(abs, kind.sums))
    if len(kind.sums) * widest**2 < LONG:
        return ((kind.n * rows - np.array(kind.sums)) ** 2).sum(axis=1).tolist()
    exact = ((kind.n * rows.astype(object) - np.array(kind.sums, object)) ** 2).sum(axis=1)
    return [d if d < LONG else None for d in exact.tolist()]


_WHITE = "n long, deviation long, whitened array<double>, explained array<double>, identity_error double"


def whiten(rows: DataFrame, kinds: dict[int, Kind]) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)`` of all rows ``(key, x)``."""
    shared = rows.sparkSession.sparkContext.broadcast(kinds)

    @F.pandas_udf(_WHITE)
    def made(column):
        import pandas as pd

        known, out = shared.value, [(0, None, [], [], 0.0)] * len(column)
        by_length: dict[int, list[int]] = {}
        for i, x in enumerate(column):
            by_length.setdefault(len(x), []).append(i)
        for length, at in by_length.items():
            kind = known.get(length)
            if kind is None or kind.values is None:
                continue
            block = np.stack([column.iloc[i] for i in at]).astype(np.int64)
            explained = (kind.values / kind.trace).tolist() if len(kind.values) else []
            for i, d, w in zip(at, _deviations(block, kind), kind.white(block).tolist()):
                out[i] = kind.n, d, w, explained, kind.error
        return pd.DataFrame(out, columns=["n", "deviation", "whitened", "explained", "identity_error"])

    found = rows.select("key", made("x").alias("m")).select("key", "m.*")
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "w")
    found = found.select("key", "n", F.col("deviation").cast("long").alias("deviation"), "identity_error", each)
    return found.select(
        "key", (F.col("at") + 1).alias("component"), "n", "deviation", "w.whitened", "w.explained", "identity_error"
    )
