"""Sparse vectors against dense ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeweave.operators import models, sparse, text


@pytest.fixture(scope="module")
def weights(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(80, 6)) @ (rng.normal(size=(6, 300)) * np.linspace(3, 1, 6)[:, None])
    m = np.where(rng.random((80, 300)) < 0.2, base + rng.normal(size=(80, 300)) * 0.1, 0.0)
    m[7] = 0
    rows = [(i, f"t{j:03d}", float(m[i, j])) for i in range(80) for j in range(300) if m[i, j]]
    return spark.createDataFrame(rows, "id int, term string, weight double").repartition(5), m


def test_products_of_pairs(spark, weights):
    long, m = weights
    pairs = spark.createDataFrame([(i, (i * 7 + 3) % 85) for i in range(80)] + [(1, 10), (1, 10), (None, 1)], "a int, b int")
    rows = sparse.packed(long, "id")
    got = {(r.a, r.b): r.cosine for r in sparse.pair_products(pairs, rows, "id", "a", "b").collect()}
    assert len(got) == len({*((i, (i * 7 + 3) % 85) for i in range(80)), (1, 10), (None, 1)})
    assert all(abs(v - (m[a] @ m[b] if a is not None and b < 80 else 0.0)) < 1e-9 for (a, b), v in got.items())
    assert got[1, 10] == got[10, 1] if (10, 1) in got else True
    none = rows.limit(0)
    assert {r.cosine for r in sparse.pair_products(pairs, none, "id", "a", "b").collect()} == {0.0} and sparse.pair_products(pairs.limit(0), rows, "id", "a", "b").count() == 0


def test_every_cell_of_the_pair_matrix(spark, weights):
    long, m = weights
    pairs = spark.createDataFrame([(3, 5, 2.5, "x"), (3, 7, None, "y"), (7, 7, 0.0, "z"), (9, 99, 1.0, "w")], "a int, b int, year double, split string")
    got = sparse.pair_matrix(pairs, long, long.select("term").distinct(), "id", "a", "b", ["year"])
    for r in got.collect():
        row = np.zeros(r["size"])
        row[r.indices] = r["values"]
        a, b = m[r.a], m[r.b] if r.b < 80 else np.zeros(300)
        assert r["size"] == 602 and np.allclose(row, np.r_[r.year or 0.0, a, b, a @ b]) and r.indices == sorted(r.indices)
        assert len(r.indices) == np.count_nonzero(row)
    ready = sparse.vectors(got)
    assert ready.columns == [*pairs.columns, "cosine", "features"] and ready.first().features.size == 602


def test_svd_within_a_hundredth_in_fixed_passes(spark, weights, monkeypatch):
    long, m = weights
    index, terms = sparse.indexed(long, long.select("term").distinct())
    rows = sparse.packed(index, "id", "i").cache()
    calls = []
    real = sparse._gram_product
    monkeypatch.setattr(sparse, "_gram_product", lambda *a: (calls.append(1), real(*a))[1])
    monkeypatch.setattr(sparse, "HELD", 2000)
    values, v = sparse.truncated_svd(rows, len(terms), 5)
    want, right = np.linalg.svd(m)[1:]
    assert len(calls) == 4 and np.abs(values / want[:5] - 1).max() < 0.01
    assert np.allclose(v.T @ v, np.eye(5), atol=1e-9) and np.linalg.norm(right[:5] @ v, 2) > 0.99
    again = sparse.truncated_svd(rows.repartition(3), len(terms), 5)[0]
    assert np.allclose(values, again, rtol=1e-9)
    loads = text.fit_svd(long, long.select("term").distinct(), "id", 5, gram_terms=10)
    assert loads.count() == 300
    x = np.random.default_rng(0).normal(size=(50, 4))
    q = sparse.orthonormal(x, tile=7)
    assert np.allclose(q.T @ q, np.eye(4)) and np.allclose(q @ (q.T @ x), x)
    assert np.allclose(sparse._gram_product(rows.limit(0), np.ones((300, 2))), 0)


def test_sparse_vectors_train_a_model(spark, weights):
    long, m = weights
    pairs = spark.createDataFrame([(i, (i + 1) % 80, int(m[i].sum() > 0)) for i in range(80)], "a int, b int, y int")
    ready = sparse.vectors(sparse.pair_matrix(pairs, long, long.select("term").distinct(), "id", "a", "b"))
    fitted = models.LogisticRegression(labelCol="y", maxIter=20).fit(ready)
    assert fitted.transform(ready).where("prediction = y").count() > 70


def test_weights_come_without_shuffle(spark, data):
    """Counts and weights are made where a text is read; rows of one key are one text."""
    from citeweave.plans import queries_features
    from citeweave.plans.fixtures import Inputs

    weights, terms = queries_features._weights(Inputs(spark, data))
    assert "Exchange" not in weights._jdf.queryExecution().executedPlan().toString() and len(terms) <= 2000
    rows = spark.createDataFrame([(1, "cat hat cat"), (2, "hat"), (1, "dog cat"), (3, None), (None, "cat")], "id int, text string")
    counts = {r.id: dict(zip(r.terms, r.counts)) for r in text.counted(rows, "id", "text").collect()}
    assert counts == {1: {"cat": 3, "hat": 1, "dog": 1}, 2: {"hat": 1}, None: {"cat": 1}}


def test_gram_of_packed_rows(spark, weights, monkeypatch):
    long, m = weights
    index, terms = sparse.indexed(long, long.select("term").distinct())
    monkeypatch.setattr(sparse, "HELD", 3000)
    rows = sparse.packed(index, "id", "i")
    assert np.allclose(sparse.gram(rows, len(terms)), m.T @ m) and not sparse.gram(rows.limit(0), 4).any()
