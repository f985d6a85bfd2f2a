"""Approximate nearest neighbours by stable projections and kd-trees.

Vectors are projected on a few Gaussian directions. For any pair, the squared
projected distance over the squared true distance follows a chi-square law with
as many degrees of freedom. Neighbours of a query are taken in the order of their
projected distance and verified on the full vectors, until the test holds: with the
k-th best true distance d, a point whose projected distance is above
``d * sqrt(quantile)`` is nearer than d only with probability ``1 - SURE``.

Projected space is cut into cells by a kd-tree whose cuts come from a bounded
sample; every vector is assigned to its cell, and a cell has a kd-tree of its own.
A query first searches its own cell. The distance found there bounds its search: it
then visits exactly the cells whose boxes come nearer than that distance allows.

Equal vectors are searched once: each is kept with its ``k + 1`` smallest ids, more
than any answer can use. A cell with more than ``PIECE`` vectors is searched in pieces, and queries in
blocks, so no task holds more than a piece and a block.

Rows: vectors that are null, zero, or hold null or non-finite components take no
part; vectors of each length are searched among their own kind, each kind by a search of its own; rows with a null id are
no candidates; a query id that occurs twice has the answers of each of its vectors together.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinline.session import settle

DIRECTIONS = 8
SEED = 7
SURE = 0.99
SAMPLE = 1 << 15  # vectors that place the cuts, at most
PER_CELL = 4_096
CELLS = 1_024  # at most
PIECE = 16_384
BLOCK = 4_096  # queries
LEAF = 32


def directions(size: int, count: int = DIRECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, count))


def chi_square_quantile(p: float, freedom: int) -> float:
    """Value that a chi-square variable with an even number of degrees stays below with probability ``p``, by bisection."""
    if freedom % 2:
        raise ValueError("an even number of directions is needed")
    low, high = 0.0, 10.0 * freedom + 100
    for _ in range(200):
        middle = (low + high) / 2
        terms = np.cumprod([1.0, *(middle / 2 / i for i in range(1, freedom // 2))])
        low, high = (middle, high) if 1 - np.exp(-middle / 2) * terms.sum() < p else (low, middle)
    return high


@dataclass(frozen=True)
class Cuts:
    """A complete kd-tree of ``depth`` levels: axis and value of each inner node, box of each leaf."""

    depth: int
    axes: np.ndarray
    values: np.ndarray
    lows: np.ndarray
    highs: np.ndarray

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axes[node]] > self.values[node]
            node = 2 * node + 1 + right
        return node - (2**self.depth - 1)

    def near(self, point: np.ndarray, radius: float) -> np.ndarray:
        """Leaves whose boxes come as near as ``radius``."""
        gap = np.maximum(np.maximum(self.lows - point, point - self.highs), 0)
        return np.flatnonzero((gap**2).sum(axis=1) <= radius**2)


def cut(points: np.ndarray, depth: int) -> Cuts:
    """Cuts at the medians of the widest axes."""
    size = points.shape[1]
    axes, values = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
    lows, highs = np.full((2 ** (depth + 1) - 1, size), -np.inf), np.full((2 ** (depth + 1) - 1, size), np.inf)
    parts = {0: points}
    for node in range(2**depth - 1):
        part = parts.pop(node)
        axis = int(np.ptp(part, axis=0).argmax()) if len(part) else 0
        value = float(np.median(part[:, axis])) if len(part) else 0.0
        axes[node], values[node] = axis, value
        right = part[:, axis] > value
        for child, some in ((2 * node + 1, part[~right]), (2 * node + 2, part[right])):
            parts[child] = some
            lows[child], highs[child] = lows[node], highs[node]
        highs[2 * node + 1, axis], lows[2 * node + 2, axis] = value, value
    first = 2**depth - 1
    return Cuts(depth, axes, values, lows[first:], highs[first:])


class LocalTree:
    """Vectors of a piece in the leaves of a kd-tree over their projections."""

    def __init__(self, vectors: np.ndarray, projected: np.ndarray):
        depth = max(0, int(np.ceil(np.log2(max(1, len(vectors)) / LEAF))))
        leaves = cut(projected, depth).cell(projected)
        order = np.argsort(leaves, kind="stable")
        self.order, self.vectors, self.projected = order, vectors[order], projected[order]
        self.starts = np.flatnonzero(np.r_[True, np.diff(leaves[order]) > 0])
        self.ends = np.append(self.starts[1:], len(order))
        self.lows = np.minimum.reduceat(self.projected, self.starts)
        self.highs = np.maximum.reduceat(self.projected, self.starts)

    def search(self, vector: np.ndarray, point: np.ndarray, bound: float, quantile: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and squared distances of up to ``k`` nearest verified, nearest first; ``bound`` is a squared distance already reached.

        Leaves come by their distance; all places that tie with the last are returned.
        """
        gap = np.maximum(np.maximum(self.lows - point, point - self.highs), 0)
        reach = (gap**2).sum(axis=1)
        found, best = np.empty(0, np.int64), np.empty(0)
        for leaf in np.argsort(reach, kind="stable").tolist():
            if reach[leaf] > quantile * bound:
                break
            span = slice(self.starts[leaf], self.ends[leaf])
            far = ((self.projected[span] - point) ** 2).sum(axis=1)
            near = np.flatnonzero(far <= quantile * bound) + span.start
            if len(near):
                true = ((self.vectors[near] - vector) ** 2).sum(axis=1)
                found, best = np.concatenate([found, near]), np.concatenate([best, true])
                if len(best) > k:
                    last = np.partition(best, k - 1)[k - 1]
                    bound = min(bound, last)
                    found, best = found[best <= last], best[best <= last]
        order = np.argsort(best, kind="stable")
        return self.order[found[order]], best[order]


_FOUND = "query long, id long, distance double"


def _search(index: pd.DataFrame, queries: pd.DataFrame, spread: np.ndarray, quantile: float, k: int) -> pd.DataFrame:
    rows: list[tuple[int, int, float]] = []
    if len(index) and len(queries):
        vectors = np.stack(index["vector"].to_numpy()).astype(np.float64)
        tree, ids = LocalTree(vectors, vectors @ spread), index["ids"].to_numpy()
        sought = np.stack(queries["vector"].to_numpy()).astype(np.float64)
        points = sought @ spread
        own = queries["query"].tolist()
        for query, vector, point, bound in zip(own, sought, points, queries["bound"].tolist()):
            places, squares = tree.search(vector, point, bound, quantile, k)
            rows += [(query, i, float(np.sqrt(s))) for p, s in zip(places.tolist(), squares.tolist()) for i in ids[p].tolist()]
    return pd.DataFrame(rows, columns=["query", "id", "distance"]).astype({"query": "int64", "id": "int64", "distance": "float64"})


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest per query, ties to the smaller id, with their ranks."""
    return found.selectExpr(
        "*", "row_number() over (partition by query order by distance, id) as rank"
    ).filter(F.col("rank") <= k)


def _usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    value = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), value.alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter("id is not null and vector is not null").filter(fine & F.exists("vector", lambda x: x != 0))


def neighbours(
    vectors: DataFrame, wanted: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", sure: float = SURE
) -> DataFrame:
    """``(query, rank, id, distance)``: the ``k`` nearest other rows of each row whose id fulfils ``wanted``, a condition on ``id``."""
    rows = _usable(vectors, key, vector)
    kinds = rows.groupBy(F.size("vector").alias("size")).agg(F.bool_or(wanted).alias("asked")).filter("asked")
    sizes = [r["size"] for r in kinds.orderBy("size").collect()]
    found = [_neighbours(rows.filter(F.size("vector") == size), wanted, k, size, sure) for size in sizes]
    return reduce(DataFrame.union, found) if found else vectors.sparkSession.createDataFrame([], "query long, rank int, id long, distance double")


def _neighbours(rows: DataFrame, wanted: Column, k: int, size: int, sure: float) -> DataFrame:
    """:func:`neighbours` of usable vectors of one length."""
    rank = "row_number() over (partition by vector order by id) as place"
    # Only the k + 1 smallest ids of a vector leave a task; a group never holds more.
    kept = rows.distinct().selectExpr("*", rank).filter(F.col("place") <= k + 1)
    index = kept.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    index = settle(index.withColumn("no", F.xxhash64("vector")), "vectors")
    spread = directions(size)
    total = index.count()
    depth = 0
    while 2**depth < min(CELLS, total / PER_CELL):
        depth += 1
    sample = index.orderBy("no").limit(SAMPLE).select("vector").toArrow().to_pandas() if depth else None
    points = np.stack(sample["vector"].to_numpy()).astype(float) @ spread if depth else np.zeros((0, spread.shape[1]))
    cuts, quantile = cut(points, depth), chi_square_quantile(sure, spread.shape[1])

    @F.pandas_udf("long")
    def cell(values):
        return pd.Series(cuts.cell(np.stack(values.to_numpy()).astype(float) @ spread) if len(values) else [], dtype="int64")

    celled = index.withColumn("cell", cell("vector"))
    sizes = celled.groupBy("cell").count()  # at most CELLS rows
    pieces = sizes.select("cell", F.ceil(F.col("count") / PIECE).cast("int").alias("pieces"))
    celled = celled.join(F.broadcast(pieces), "cell").withColumn("piece", F.pmod("no", F.col("pieces")).cast("int"))
    celled = settle(celled.select("vector", "ids", "cell", "piece"), "cells")
    asked = rows.filter(wanted).select(F.col("id").alias("query"), "vector").distinct().withColumn("no", F.xxhash64("vector"))
    asked = asked.withColumn("query_row", F.xxhash64("query", "vector"))
    blocks = max(1, -(-asked.count() // BLOCK))
    asked = asked.withColumn("block", F.pmod("query_row", F.lit(blocks)).cast("int")).withColumn("home", cell("vector"))
    asked = settle(asked, "queries")

    def visit(visits: DataFrame) -> DataFrame:
        """Search ``visits (query, vector, bound, cell, block)`` in all pieces of their cells."""
        visits = visits.join(F.broadcast(pieces), "cell").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        places = visits.select("cell", "piece", "block").distinct().toDF("cell", "piece", "block")
        held = celled.join(places, ["cell", "piece"]).toDF("cell", "piece", "vector", "ids", "block")
        by = ["cell", "piece", "block"]
        return held.groupBy(*by).cogroup(visits.groupBy(*by)).applyInPandas(
            lambda left, right: _search(left, right, spread, quantile, k + 1), _FOUND
        ).filter("id <> query")

    own = settle(visit(asked.select("query", "vector", F.lit(float("inf")).alias("bound"), F.col("home").alias("cell"), "block")), "own")
    bound = _best(own, k).groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
    bound = bound.select("query", F.when(F.col("n") >= k, F.col("far") * F.col("far")).otherwise(float("inf")).alias("bound"))
    asked = asked.join(bound, "query", "left").fillna(float("inf"), ["bound"])

    @F.pandas_udf("array<long>")
    def others(values, bounds, homes):
        found = []
        for value, limit, home in zip(values, bounds, homes):
            near = cuts.near(np.asarray(value, float) @ spread, float(np.sqrt(limit * quantile)))
            found.append(near[near != home].tolist())
        return pd.Series(found)

    rest = asked.withColumn("cell", F.explode(others("vector", "bound", "home")))
    found = own.union(visit(rest.select("query", "vector", "bound", "cell", "block"))).distinct()
    return _best(found, k).select("query", "rank", "id", "distance")
