import numpy as np
import pytest
from pyspark.sql import functions as F

from twinline.llm import projected_tree as pt


def rows_of(seed=0, n=1200, size=24):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, size))
    points = (centres[rng.integers(0, 8, n)] + 0.4 * rng.standard_normal((n, size))).astype("f4")
    points[100:200] = points[100]
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    bad = [None, [0.0] * size, [float("nan")] * size, [float("inf")] + [1.0] * (size - 1), [None] + [1.0] * (size - 1), [1.0, 2.0], []]
    return rows, [(5000 + 10 * i, b) for i, b in enumerate(bad)] + [(None, points[3].tolist()), rows[5]]


def exact(rows, k, step):
    ids, points = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    answer = {}
    for q in ids[ids % step == 0].tolist():
        far = np.sqrt(((points - points[ids == q][0]) ** 2).sum(1))
        others = ids != q
        order = np.lexsort((ids[others], far[others]))[:k]
        answer[q] = list(zip(ids[others][order].tolist(), far[others][order].tolist()))
    return answer


@pytest.mark.parametrize("sizes", [{}, {"PER_CELL": 64, "PIECE": 100, "BLOCK": 16}])
def test_recall(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(pt, name, value)
    good, odd = rows_of()
    frame = spark.createDataFrame(good + odd, "vec_id long, embedding array<float>").withColumn("cell", F.lit(1)).withColumn("id", F.lit("x"))
    found = pt.neighbours(frame, F.col("id") % 10 == 0, 10).collect()
    wanted, hits = exact(good, 10, 10), 0
    assert len(found) == 10 * len(wanted)
    for q, expected in wanted.items():
        mine = sorted((r.rank, r.id, r.distance) for r in found if r.query == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert mine == sorted(mine, key=lambda m: (m[2], m[1]))
        hits += len({m[1] for m in mine} & {e[0] for e in expected})
    assert hits >= 0.95 * len(found)
    same = [(r.id, r.distance) for r in sorted(found, key=lambda r: r.rank) if r.query == 150]
    assert same == [(i, 0.0) for i in range(100, 110)]


def test_few_and_no_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    found = pt.neighbours(frame, F.col("id") == 0, 10).collect()
    assert sorted((r.rank, r.id) for r in found) == [(1, 2), (2, 1)]
    assert pt.neighbours(frame.limit(0), F.col("id") == 0).count() == 0
    assert pt.neighbours(frame, F.col("id") == 77).count() == 0


def test_each_length_among_its_own_kind(spark):
    """An odd row loses only itself."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(200)]
    other = [(1000 + i, rng.standard_normal(3).tolist()) for i in range(0, 40, 4)]
    frame = spark.createDataFrame(rows + other + [(900, [1.0] * 9)], "vec_id long, embedding array<float>")
    found = pt.neighbours(frame, F.col("id") % 100 == 0, 10).collect()
    by_query = {}
    for r in found:
        by_query.setdefault(r.query, []).append(r.id)
    assert {q: len(ids) for q, ids in by_query.items()} == {0: 10, 100: 10, 1000: 9}
    assert set(by_query[1000]) == {i for i, _ in other[1:]}


def test_quantile():
    assert pt.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    assert pt.chi_square_quantile(0.5, 2) == pytest.approx(1.386, abs=1e-3)
