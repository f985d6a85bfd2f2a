import numpy as np
import pytest
from pyspark.sql import functions as F

from twinline.llm import whitening

ROWS = "vec_id long, embedding array<float>, component string, x string, n string, deviation string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, *"abcd") for i, v in rows], ROWS)


def answers(df):
    rows = whitening.whole(df)
    return whitening.whiten(rows, whitening.fit(rows)).collect()


def expected(vectors, wanted=4):
    """Exact sums, and numpy's eigenvectors."""
    x = [tuple(int(np.floor(256 * float(np.float32(c)))) for c in v) for v in vectors]
    different = np.array(sorted(set(x)), object)
    n, total = len(different), different.sum(axis=0)
    centred = (different - total / n).astype(float)
    values, found = np.linalg.eigh(centred.T @ centred / n)
    values, found = values[::-1][:wanted], found[:, ::-1][:, :wanted]
    deviations = [int(((n * np.array(v, object) - total) ** 2).sum()) for v in x]
    white = (np.array(x, float) - (total / n).astype(float)) @ found / np.sqrt(values)
    return n, deviations, white, values / np.trace(centred.T @ centred / n)


def test_whitens_as_numpy_does(spark, partitions):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((400, 12)) @ rng.standard_normal((12, 12)) + 5).tolist()
    vectors += vectors[:150] + [vectors[0]] * 100  # copies are fitted once
    got = answers(table(spark, list(enumerate(vectors))).repartition(partitions))
    n, deviations, white, explained = expected(vectors)
    assert len(got) == 4 * len(vectors) and {r.n for r in got} == {n}
    signs = {}
    for r in sorted(got, key=lambda r: r.key):
        want = white[r.key, r.component - 1]
        sign = signs.setdefault(r.component, np.sign(r.whitened * want))
        assert r.deviation == deviations[r.key]
        assert r.whitened == pytest.approx(sign * want, rel=1e-9, abs=1e-9)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9


def test_odd_vectors(spark):
    fine = [(i, [float(i % 3), float(i % 5)]) for i in range(30)]
    odd = [(100, None), (101, [None, 1.0]), (102, [float("nan"), 1.0]), (103, [float("inf"), 1.0]), (104, []), (105, [1e30, 1.0])]
    other = [(200 + i, [float(i), float(i * i), -1.0]) for i in range(6)] + [(300, [1.0] * 5), (None, [1.0, 2.0])]
    got = answers(table(spark, fine + odd + other))
    by_key = {}
    for r in got:
        by_key.setdefault(r.key, []).append(r)
    assert set(by_key) == {i for i, _ in fine} | set(range(200, 206)) | {None}  # a single vector of a length has no variance
    assert {len(by_key[i]) for i in range(30)} == {2} and {len(by_key[i]) for i in range(200, 206)} == {2}  # the third entry is constant
    assert {r.n for r in by_key[200]} == {6} and {r.n for r in by_key[0]} == {15}


def test_long_deviations(spark):
    big = 2.0**45
    got = answers(table(spark, [(1, [big]), (2, [0.0]), (3, [1.0])]))
    assert {r.key: r.deviation for r in got}[1] is None  # no long
    n, deviations, _, _ = expected([[2.0**20], [0.0], [1.0]], 1)
    assert {r.key: r.deviation for r in answers(table(spark, [(1, [2.0**20]), (2, [0.0]), (3, [1.0])]))} == dict(zip((1, 2, 3), deviations))


def test_empty_table(spark):
    assert answers(table(spark, [])) == []
    assert answers(table(spark, [(1, None)])) == []


@pytest.mark.parametrize("size", [1, 2, 7, 64])
def test_components_of_hard_matrices(size):
    rng = np.random.default_rng(size)
    q, _ = np.linalg.qr(rng.standard_normal((size, size)))
    for values in (np.ones(size), np.zeros(size), np.logspace(0, -14, size), np.repeat([3.0, 1.0], size)[:size], 1 + 1e-13 * np.arange(size)):
        a = (q * values) @ q.T
        a = (a + a.T) / 2
        found, vectors = whitening.components(a, 4)
        want = np.sort(values)[::-1][:4]
        assert np.abs(found - want).max() <= 1e-12 * max(values.max(), 1e-300)
        assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-12
        assert np.abs(a @ vectors - vectors * found).max() <= 1e-12 * max(values.max(), 1e-300)


def test_polar_factor():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((40, 40))
    a = a + a.T
    values, vectors = np.linalg.eigh(a)
    assert np.abs(whitening.polar(a) - (vectors * np.sign(values)) @ vectors.T).max() < 1e-12


def test_only_aggregates_reach_the_driver(spark, partitions):
    rows = whitening.whole(table(spark, [(i, [float(i), 1.0]) for i in range(9)]))
    kinds = whitening.fit(rows)
    assert list(kinds) == [2] and kinds[2].n == 9
    assert whitening.whiten(rows, kinds).agg(F.count("*")).first()[0] == 9
