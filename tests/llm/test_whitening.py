import numpy as np
import pytest

from corpusloom.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, whitened string, n int"


def whole(vectors):
    return np.floor(np.array(vectors, np.float32).astype(float) * 64).astype(np.int64) + 1_000_000


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], "x", 1) for i, v in zip(ids, vectors)], SCHEMA)


def digest(spark, vectors, ids=None):
    docs = table(spark, vectors, ids)
    model = w.fit(docs)
    return w.whitening_digest(w.whiten(docs, model), model).collect()


def compare(rows, vectors, ids):
    """A plain reading: all in one matrix, eigenvectors from the library, signs by the larger agreement."""
    x = whole(vectors)
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, found = np.linalg.eigh(centred.T @ centred / n)
    values, found = values[::-1], found[:, ::-1]
    held = [k for k in range(min(32, x.shape[1])) if values[k] > 1e-12 * values.sum()]
    assert len(rows) == n * len(held)
    exact = {i: sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for i, row in zip(ids, x)}
    at = {i: k for k, i in enumerate(ids)}
    for k in held:
        part = [r for r in rows if r.component == k + 1]
        want = centred @ found[:, k] / np.sqrt(values[k])
        got = np.zeros(n)
        for r in part:
            got[at[r.vec_id]] = r.whitened
            assert (r.n, r.deviation) == (n, exact[r.vec_id])
            assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-9) and r.identity_error < 1e-9
        assert min(abs(got - want).max(), abs(got + want).max()) < 1e-8


@pytest.mark.parametrize("dimension,count", [(1, 9), (3, 40), (64, 200), (40, 30)])
def test_equals_a_plain_reading(spark, dimension, count):
    rng = np.random.default_rng(dimension)
    vectors = (rng.standard_normal((count, dimension)) * np.linspace(3, 0.3, dimension)).tolist()
    compare(digest(spark, vectors), vectors, range(count))


def test_unusable_rows_are_left_out(spark):
    rng = np.random.default_rng(4)
    good = rng.standard_normal((30, 5)).tolist()
    bad = [None, [1.0, None, 1, 1, 1], [float("nan")] * 5, [float("inf")] * 5, [], [1.0] * 4]
    compare(digest(spark, bad[:3] + good + bad[3:], [None, 91, 92, *range(30), 93, 94, 95]), good, range(30))


def test_rows_without_variance_and_empty_tables(spark):
    assert digest(spark, []) == [] and digest(spark, [[1.0, 2.0]]) == [] and digest(spark, [[1.0, 2.0]] * 4) == []
    assert digest(spark, [None, []]) == []


def test_equal_rows_and_null_ids_count_each(spark):
    rows = digest(spark, [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.5, 0.25]], [None, None, 3, 3])
    assert sorted((r.vec_id or 0, r.component) for r in rows) == [(0, 1), (0, 1), (0, 2), (0, 2), (3, 1), (3, 1), (3, 2), (3, 2)]
    assert {r.n for r in rows} == {4}


def test_large_entries_keep_exact_deviations():
    whole_numbers = np.array([[w.LARGEST, -5.0], [3.0, 7.0]])
    sums = (w.LARGEST + 3, 2)
    exact = [sum((2 * int(x) - s) ** 2 for x, s in zip(row, sums)) for row in whole_numbers.tolist()]
    assert w.exact_deviation(whole_numbers, 2, sums) == [v if v < 1 << 63 else None for v in exact]
    assert w.exact_deviation(np.array([[4.0, 1.0]]), 10**9, (10**9, 5)) == [(4 * 10**9 - 10**9) ** 2 + (10**9 - 5) ** 2 if (4 * 10**9 - 10**9) ** 2 + (10**9 - 5) ** 2 < 1 << 63 else None]


def test_too_long_vectors_are_refused(spark, monkeypatch):
    monkeypatch.setattr(w, "MAX_DIMENSION", 2)
    with pytest.raises(ValueError, match="at most 2"):
        w.fit(table(spark, [[1.0, 2.0, 3.0]]))


@pytest.mark.parametrize("kind", ["random", "graded", "flat", "clustered", "double"])
def test_division_finds_eigenvectors(kind):
    rng = np.random.default_rng(len(kind))
    q, _ = np.linalg.qr(rng.standard_normal((60, 60)))
    values = {
        "random": rng.random(60), "graded": np.logspace(0, -12, 60), "flat": np.r_[np.ones(30), np.zeros(30)],
        "clustered": 1 + 1e-10 * rng.random(60), "double": np.repeat(rng.random(30), 2),
    }[kind]
    a = q * values @ q.T
    got, vectors = w.spectral_components(a)
    assert abs(got - np.sort(values)[::-1]).max() < 1e-13
    assert abs(vectors.T @ vectors - np.eye(60)).max() < 1e-13
    assert np.linalg.norm(a @ vectors - vectors * got) < 1e-12


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(8)
    q, _ = np.linalg.qr(rng.standard_normal((30, 30)))
    values = np.r_[np.logspace(0, -9, 15), -np.logspace(0, -9, 15)]
    assert abs(w.polar_factor(q * values @ q.T) - q * np.sign(values) @ q.T).max() < 1e-6
