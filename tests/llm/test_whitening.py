import numpy as np
import pytest

from scoreloop.llm import whitening
from scoreloop.llm.queries import op12_chebyshev_whitening

SCHEMA = "vec_id long, embedding array<double>, component int, key string, x int"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 7, "k", 8) for k, v in rows], SCHEMA)


def brute(rows, k=4):
    """Exact integers and NumPy's eigenpairs of the fit list."""
    fine = [(key, v) for key, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max((len(v) for _, v in fine), default=0)
    ints = [[int(np.floor(256 * c)) for c in v] + [0] * (width - len(v)) for _, v in fine]
    fit = sorted(set(map(tuple, ints)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    x = np.array(fit, float) - np.array(sums) / max(n, 1)
    values, vectors = np.linalg.eigh(x.T @ x / max(n, 1))
    values, vectors = values[::-1], vectors[:, ::-1]
    z = (np.array(ints, float) - np.array(sums) / max(n, 1)) @ vectors / np.sqrt(np.maximum(values, 1e-30))
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in ints]
    return n, [key for key, _ in fine], deviation, z[:, :k], values[:k] / values.sum()


def compare(rows, found, k):
    n, keys, deviation, z, explained = brute(rows, k)
    want = sorted((str(key), c + 1, d) for key, d in zip(keys, deviation) for c in range(k))
    assert sorted((str(r.vec_id), r.component, int(r.deviation)) for r in found) == want
    assert {r.n for r in found} == {n} and all(r.identity_error <= 1e-8 and r.residual < 1e-10 for r in found)
    for c in range(k):
        own = sorted((str(r.vec_id), r.whitened) for r in found if r.component == c + 1)
        other = sorted((str(key), v) for key, v in zip(keys, z[:, c]))
        a, b = np.array([v for _, v in own]), np.array([v for _, v in other])
        sign = np.sign(a @ b)
        if len(set(keys)) == len(keys):
            assert np.allclose(a, sign * b, atol=1e-6)
        assert all(abs(r.explained - explained[c]) < 1e-9 for r in found if r.component == c + 1)


def some_rows(n=400, width=40, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * np.linspace(1, 3, width) + rng.normal(size=width) * 5
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_equals_eigenpairs(spark):
    rows = some_rows() + [(1000 + i, [0.1] * 40) for i in range(300)]  # one vector very often: once in the fit
    compare(rows, whitening.whiten(frame(spark, rows), 4).collect(), 4)


def test_close_eigenvalues_and_few_dimensions(spark):
    rng = np.random.default_rng(2)
    flat = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 30)))]
    compare(flat, whitening.whiten(frame(spark, flat), 4).collect(), 4)
    few = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(50, 3)))]
    compare(few, whitening.whiten(frame(spark, few), 4).collect(), 3)


def test_the_recurrence_is_used_and_certified(spark):
    rows = some_rows(1500, 64)
    ints = frame(spark, rows).select(whitening.integers("embedding", 256).alias("x"))
    model, _ = whitening.fit(ints, 4)
    assert model.passes > whitening.DEGREE and (model.residuals <= whitening.LOOSE * model.values[0]).all()
    assert np.allclose(model.vectors.T @ model.vectors, np.eye(4), atol=1e-13)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = some_rows(60, 6) + [(None, None), (None, [1.0] * 6), (3, [1.0] * 5 + [float("nan")]), (4, [float("inf")] * 6), (5, [None] + [1.0] * 5), (7, [2.0] * 6), (7, [2.0] * 6), (8, [-0.0, 1.0])]
    found = whitening.whiten(frame(spark, rows), 4)
    assert found.columns[:3] == ["vec_id", "component", "n"]
    compare(rows, found.collect(), 4)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [0.5]), (2, [0.5])], [(1, [])]])
def test_without_variance_there_is_no_component(spark, rows):
    assert whitening.whiten(frame(spark, rows), 4).collect() == []


def test_as_many_components_as_directions(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0]) for i in range(20)]
    found = whitening.whiten(frame(spark, rows), 4).collect()
    assert {r.component for r in found} == {1} and abs(found[0].explained - 1) < 1e-12


def test_sums_beyond_long_stay_exact(spark):
    rows = [(i, [1e14 * i, float(i % 3)]) for i in range(12)]
    found = whitening.whiten(frame(spark, rows), 1).collect()
    assert min(int(r.deviation) for r in found) > 2**63
    assert sorted((str(r.vec_id), int(r.deviation)) for r in found) == sorted((str(k), d) for k, d in zip(brute(rows)[1], brute(rows)[2]))


def test_sums_beyond_38_digits_are_null(spark):
    rows = [(i, [1e15 * i]) for i in range(12)]
    assert None in {r.deviation for r in whitening.whiten(frame(spark, rows), 1).collect()}


def test_query_covers_the_table(spark, sf_small):
    table = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    found = op12_chebyshev_whitening(spark, sf_small)
    assert dict(found.dtypes)["deviation"] == "bigint"
    compare(rows, found.collect(), 4)
