"""Leaf-wise boosting against a plain grower; Shapley values of trees and of any model against all subsets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeweave.operators import boosting, models, shapley

NAMES = [f"f{i}" for i in range(6)]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(600, 6)), 3)
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 0.7)).astype(int)
    rows = spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))], "id int, " + ", ".join(f"{f} double" for f in NAMES) + ", is_reference_valid int")
    return rows.repartition(5).cache(), x, y


def plain_boosting(x, y, edges, rounds, leaves, rate, least, penalty):
    """One split after another, the best gain first; the log-odds of all rows."""
    unit = 1 << 28
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    margin = np.zeros(len(x))
    start = math.log(y.mean() / (1 - y.mean()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(start + margin)))
        g, h = np.rint((p - y) * unit) / unit, np.rint(p * (1 - p) * unit) / unit
        score = lambda own: g[own].sum() ** 2 / (h[own].sum() + penalty)  # noqa: E731,B023

        def best(own):
            found = None
            for f in range(x.shape[1]):
                for b in range(len(edges[f])):
                    left = own & (bins[:, f] <= b)
                    right = own & ~(bins[:, f] <= b)
                    if left.sum() >= least and right.sum() >= least:
                        gain = score(left) + score(right) - score(own)
                        if gain > 1e-9 and (found is None or gain > found[0] + 1e-12):
                            found = gain, f, b, left, right
            return found

        held = [(np.ones(len(x), bool), best(np.ones(len(x), bool)))]
        while len(held) < leaves and any(s for _, s in held):
            k = max((i for i, (_, s) in enumerate(held) if s), key=lambda i: held[i][1][0])
            _, s = held.pop(k)
            held += [(s[3], best(s[3])), (s[4], best(s[4]))]
        for own, _ in held:
            margin[own] -= rate * g[own].sum() / (h[own].sum() + penalty)
    return start + margin


def test_leafwise_matches_plain_growth_and_any_partitioning(spark, table, tmp_path):
    rows, x, y = table
    params = dict(rounds=3, leaves=6, rate=0.3, least_rows=10, penalty=0.5, bins=16, key="id")
    model = boosting.LeafwiseBoosting("leafwise", NAMES, **params).train(rows)
    edges = model.edges(rows)
    want = plain_boosting(x, y, edges, 3, 6, 0.3, 10, 0.5)
    got = np.array([r.margin for r in model.predict(rows).orderBy("id").collect()])
    assert np.abs(got - want).max() < 1e-9
    other = boosting.LeafwiseBoosting("leafwise", NAMES, **params).train(rows.repartition(2, "id"))
    assert all(np.array_equal(a, b) for s, t in zip(model.trees, other.trees) for a, b in zip(s, t))
    again = boosting.LeafwiseBoosting("leafwise", NAMES).load(model.save(f"file://{tmp_path}"))
    assert [r.margin for r in again.predict(rows).orderBy("id").collect()] == got.tolist()
    strong = boosting.LeafwiseBoosting("leafwise", NAMES, rounds=30, leaves=8, rate=0.3, bins=32, key="id").train(rows)
    assert strong.evaluate(rows).first().accuracy > 0.93 and max(len(t.value) for t in strong.trees) <= 15


def test_leafwise_edges_of_input(spark, table):
    rows, _, _ = table
    for own in (rows.limit(0), rows.where("is_reference_valid = 1"), rows.limit(3), rows.select(*(F.lit(None).cast("double").alias(f) for f in NAMES), "id", "is_reference_valid")):
        model = boosting.LeafwiseBoosting("m", NAMES, rounds=2, key="id").train(own)
        assert model.predict(rows).where("margin is null or isnan(margin)").count() == 0
    unlabelled = rows.withColumn("is_reference_valid", F.when(F.col("id") % 2 == 0, F.col("is_reference_valid")))
    small = dict(rounds=1, leaves=3, bins=8, key="id")
    a = boosting.LeafwiseBoosting("m", NAMES, **small).train(unlabelled)
    b = boosting.LeafwiseBoosting("m", NAMES, **small).train(unlabelled.where("is_reference_valid is not null"))
    assert all(np.array_equal(s, t) for s, t in zip(a.trees[0], b.trees[0]))


def brute(score, n):
    """Shapley values of a game over subsets."""
    out = np.zeros(n)
    for j in range(n):
        rest = [i for i in range(n) if i != j]
        for k in range(n):
            for s in itertools.combinations(rest, k):
                out[j] += math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n) * (score({*s, j}) - score({*s}))
    return out


def expected(tree, x, known, at=0):
    """The tree's value where only some features are known: the others go both ways by cover."""
    f = tree.feature[at]
    if f < 0:
        return tree.value[at]
    l, r = tree.left[at], tree.right[at]  # noqa: E741
    if f in known:
        return expected(tree, x, known, l if x[f] <= tree.threshold[at] else r)
    return (tree.cover[l] * expected(tree, x, known, l) + tree.cover[r] * expected(tree, x, known, r)) / tree.cover[at]


def test_tree_values_equal_all_subsets(table):
    rows, x, _ = table
    model = boosting.LeafwiseBoosting("m", NAMES, rounds=3, leaves=12, rate=0.5, least_rows=5, bins=16, key="id").train(rows)
    got = shapley.tree_values(rows, model, ["id"]).orderBy("id").collect()
    for r in got[::97]:
        want = sum(brute(lambda s: expected(t, x[r.id], s), 6) for t in model.trees)  # noqa: B023
        assert np.abs(np.array(r.shap) - want).max() < 1e-9
    margin = {r.id: r.margin for r in model.predict(rows).collect()}
    assert max(abs(sum(r.shap) + r.base - r.raw) for r in got) < 1e-9 and max(abs(r.raw - margin[r.id]) for r in got) < 1e-9
    mean = {r.feature: r.mean_abs for r in shapley.summary(shapley.tree_values(rows, model, ["id"]), NAMES).collect()}
    assert all(abs(mean[f] - np.mean([abs(r.shap[i]) for r in got])) < 1e-9 for i, f in enumerate(NAMES))
    assert min(mean["f0"], mean["f1"], mean["f2"]) > max(mean["f3"], mean["f4"], mean["f5"])
    empty = rows.limit(0)
    assert shapley.tree_values(empty, model, ["id"]).count() == 0 and shapley.summary(shapley.tree_values(empty, model, ["id"]), NAMES).count() == 0


@pytest.mark.parametrize("kind,params", [(models.BoostedTrees, {"maxIter": 3, "maxDepth": 4}), (models.Forest, {"numTrees": 4, "maxDepth": 4})])
def test_tree_values_of_mllib_models(table, kind, params):
    rows, _, _ = table
    model = kind("m", NAMES, **params).train(rows)
    got = shapley.tree_values(rows, model, ["id"]).collect()
    assert max(abs(sum(r.shap) + r.base - r.raw) for r in got) < 1e-9
    p = {r.id: r.probability for r in model.predict(rows).collect()}
    if kind is models.Forest:
        assert max(abs(r.raw - p[r.id]) for r in got) < 1e-9
    else:
        assert max(abs(1 / (1 + math.exp(-2 * r.raw)) - p[r.id]) for r in got) < 1e-9
    with pytest.raises(ValueError):
        shapley.ensemble_of(models.Logistic("l", NAMES, maxIter=2).train(rows))


def test_kernel_values_of_a_linear_model(table):
    rows, x, _ = table
    weights = [2.0, -1.0, 0.5, 0.0, 3.0, 1.0]
    linear = lambda d: d.withColumn("p", sum((F.col(f) * w for f, w in zip(NAMES, weights)), F.lit(1.0)))
    asked = rows.where("id % 100 = 0").unionByName(rows.where("id = 0"))
    for budget in (None, 20):  # all coalitions, and drawn ones
        got = shapley.kernel_values(asked, "id", NAMES, linear, rows, "id", "p", budget=budget, background_rows=25).collect()
        sample = [r.id for r in shapley.sampling.bounded_sample(rows, 25, 42, "id").collect()]
        assert len(got) == 7
        for r in got:
            want = np.array(weights) * (x[r.id] - x[sample].mean(axis=0))
            assert np.abs(np.array(r.shap) - want).max() < 1e-8 and abs(sum(r.shap) + r.base - r.raw) < 1e-9


def test_kernel_values_equal_all_subsets(table):
    rows, x, _ = table
    curved = lambda d: d.withColumn("p", F.col("f0") * F.col("f1") + F.sin("f2") * F.col("f3") + F.greatest("f4", "f5"))
    plain = lambda m: m[..., 0] * m[..., 1] + np.sin(m[..., 2]) * m[..., 3] + np.maximum(m[..., 4], m[..., 5])
    ids = [r.id for r in shapley.sampling.bounded_sample(rows, 10, 42, "id").collect()]
    for r in shapley.kernel_values(rows.where("id in (1, 2)"), "id", NAMES, curved, rows, "id", "p", background_rows=10).collect():
        want = brute(lambda s: plain(np.where(np.isin(np.arange(6), list(s)), x[r.id], x[ids])).mean(), 6)  # noqa: B023
        assert np.abs(np.array(r.shap) - want).max() < 1e-9
    masks, weights = shapley.coalitions(12, 100)
    assert len(masks) == 100 and abs(weights.sum() - sum(11 / (s * (12 - s)) for s in range(1, 12))) < 1e-9
    with pytest.raises(ValueError):
        shapley.coalitions(12, 6)
    with pytest.raises(ValueError):
        shapley.kernel_values(rows, "id", NAMES, curved, rows.limit(0), "id", "p")


def test_summary_of_models(table):
    rows, _, _ = table
    fitted = {"trees": models.BoostedTrees("t", NAMES, maxIter=2).train(rows), "linear": models.Logistic("l", NAMES, maxIter=5).train(rows)}
    got = shapley.explained_summary(fitted, rows, rows, "id", rows=3, budget=40, background_rows=5).collect()
    assert {(r.model, r.method) for r in got} == {("trees", "tree"), ("linear", "kernel")} and len(got) == 12
    assert shapley.explained_summary({}, rows, rows, "id").count() == 0
