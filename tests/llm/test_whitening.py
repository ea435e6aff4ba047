"""Whitening against a dense eigensolver and exact integers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.llm import whitening
from labelloom.llm.queries import op11_embedding_whitening


def covariance(seed, size, values=None):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.standard_normal((size, size)))
    values = rng.random(size) * 10 if values is None else np.array(values, dtype=float)
    v = q * values @ q.T
    return (v + v.T) / 2


@pytest.mark.parametrize("seed", range(4))
def test_counts_equal_the_eigenvalues_above(seed):
    v = covariance(seed, 30)
    values = np.linalg.eigvalsh(v)
    for shift in [*(values[:-1] + values[1:]) / 2, -1.0, 99.0]:
        assert whitening.eigenvalues_above(v, shift) == (values > shift).sum()
    swap = np.array([[0.0, 1.0], [1.0, 0.0]])
    assert [whitening.eigenvalues_above(swap, s) for s in (-2.0, 0.0, 2.0)] == [2, 1, 0]


CASES = [None, [9, 9, 9, 5, 5, 1, 0, 0, 0, 0], [1e6, 1e6 - 1e-3, 3, 2, 1, 1e-3, 0, 0, 0, 0], [7] * 10, [4, 0, 0, 0, 0, 0, 0, 0, 0, 0], [2, 1] + [1e-9] * 8]


@pytest.mark.parametrize("case", CASES)
def test_leading_components_equal_a_dense_solver(case):
    v = covariance(5, 10, case)
    values, vectors = whitening.leading_components(v, 8)
    expected = np.linalg.eigvalsh(v)[::-1][:8]
    expected = expected[expected > 1e-12 * np.trace(v)]
    assert len(values) == len(expected) and np.allclose(values, expected, rtol=1e-9, atol=1e-13 * np.trace(v))
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) < 1e-9
    assert np.linalg.norm(v @ vectors - vectors * values) < 1e-11 * np.trace(v)


def test_no_variance_no_components():
    assert len(whitening.leading_components(np.zeros((3, 3)))[0]) == 0
    assert len(whitening.leading_components(np.zeros((0, 0)))[0]) == 0


def test_query_equals_plain_whitening(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/embeddings.parquet").collect()
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in r["embedding"]] for r in rows])
    n, sums = len(x), x.sum(axis=0)
    v = np.cov(x.T, bias=True)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    z = (x - sums / n) @ vectors / np.sqrt(values)
    exact = {r["vec_id"]: sum((n * int(a) - int(s)) ** 2 for a, s in zip(xi, sums)) for r, xi in zip(rows, x)}
    found = op11_embedding_whitening(spark, small_dir).collect()
    assert len(found) == 8 * n
    place = {r["vec_id"]: i for i, r in enumerate(rows)}
    got = np.zeros_like(z)
    for r in found:
        got[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == exact[r["vec_id"]] and r["identity_error"] < 1e-9
        assert abs(r["explained"] - values[r["component"] - 1] / np.trace(v)) < 1e-12
    sign = np.sign((got * z).sum(axis=0))
    assert np.abs(got * sign - z).max() < 1e-7


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, None]), (6, [0.5]), (7, []), (None, [3.0, -1.0]), (8, [1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", F.lit("x").alias("whitened"), F.lit(1).alias("n"), F.lit(2).alias("__y"))
    model = whitening.fit_whitening(df)
    assert model.n == 5 and len(model.values) == 2 and whitening.identity_error(df, model) < 1e-9
    made = whitening.whiten(df, model)
    assert made.columns == ["vec_id", "embedding", "n", "__y", "whitened", "deviation"]
    got = made.collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["1", "1", "6", "7", "None"]
    x = np.array([[1024, 2048], [1024, 2048], [512, 0], [0, 0], [3072, -1024]]) + 100_000
    exact = sorted(int(((5 * r - x.sum(axis=0)) ** 2).sum()) for r in x)
    assert sorted(int(r["deviation"]) for r in got) == exact
    one = df.where("vec_id = 6")
    same = whitening.whiten(one, whitening.fit_whitening(one)).collect()
    assert [(r["whitened"], int(r["deviation"])) for r in same] == [([], 0)]
    none = df.where("false")
    assert whitening.whiten(none, whitening.fit_whitening(none)).count() == 0


def test_large_entries_keep_exact_deviations(spark):
    rows = [(i, [float(2**40 * (i % 3)), float(-(2**41) + i)]) for i in range(7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit_whitening(df)
    x = [[int(1024 * c) + 100_000 for c in v] for _, v in rows]
    sums = [sum(r[j] for r in x) for j in range(2)]
    exact = {i: sum((7 * a - s) ** 2 for a, s in zip(r, sums)) for i, r in enumerate(x)}
    assert {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(df, model).collect()} == exact
