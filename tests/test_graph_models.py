"""Graph metrics against plain NumPy, encoders, models, metrics on small inputs."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeweave.operators import encoding, explain, graph, metrics, models, sampling, text


@pytest.fixture(scope="module")
def small(spark):
    edges = [(1, 2), (1, 3), (2, 3), (4, 3), (5, 4), (5, 1)]
    return spark.createDataFrame([(i,) for i in range(1, 8)], "id long"), spark.createDataFrame(edges, "src long, dst long"), edges


def test_pagerank_converges_to_numpy(small):
    vertices, edges, pairs = small
    a = np.zeros((7, 7))
    for s, d in pairs:
        a[d - 1, s - 1] = 1
    out = a.sum(axis=0)
    p = np.where(out > 0, a / np.maximum(out, 1), 1 / 7)
    r = np.full(7, 1 / 7)
    for _ in range(200):
        r = 0.85 * p @ r + 0.15 / 7
    got = {x.id: x["rank"] for x in graph.pagerank(vertices, edges).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9
    assert max(abs(got[i + 1] - r[i]) for i in range(7)) < 1e-5
    with pytest.raises(RuntimeError):
        graph.pagerank(vertices, edges, max_iter=1)


def test_katz_matches_numpy(small):
    vertices, edges, pairs = small
    a = np.zeros((7, 7))
    for s, d in pairs:
        a[d - 1, s - 1] = 1
    x = np.linalg.solve(np.eye(7) - 0.1 * a, np.ones(7))
    x /= np.linalg.norm(x)
    got = {r.id: r.katz for r in graph.katz(vertices, edges).collect()}
    assert max(abs(got[i + 1] - x[i]) for i in range(7)) < 1e-6
    loop = edges.sparkSession.createDataFrame([(i, j) for i in range(12) for j in range(12)], "src long, dst long")
    with pytest.raises(RuntimeError):
        graph.katz(graph.vertices_of(loop), loop, max_iter=5)


def test_isolated_vertices(small):
    vertices, edges, _ = small
    assert {r.id: (r.in_degree, r.out_degree) for r in graph.degrees(vertices, edges).collect()}[7] == (0, 0)
    assert {r.id: r.avg_neigh_degree for r in graph.average_neighbour_degree(vertices, edges).collect()}[7] == 0.0


def test_neighbourhoods_brute_force(spark, small):
    _, edges, pairs = small
    near = {}
    for s, d in pairs:
        near.setdefault(s, set()).add(d)
        near.setdefault(d, set()).add(s)
    asked = [(u, v) for u in range(1, 8) for v in range(1, 8) if u != v]
    got = {(r.u, r.v): (r.common_neighbors, round(r.jaccard_coeff, 9)) for r in graph.neighbourhoods(spark.createDataFrame(asked, "u long, v long"), edges).collect()}
    for u, v in asked:
        a, b = near.get(u, set()), near.get(v, set())
        assert got[u, v] == (len(a & b), round(len(a & b) / len(a | b), 9) if a | b else 0.0)


def test_components_with_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (200, 200)], "src long, dst long")
    got = {r.id: r.component for r in graph.components(graph.vertices_of(edges), edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[103] == 100 and got[200] == 200
    assert graph.connectivity(graph.components(graph.vertices_of(edges), edges)).first().largest == 61
    assert graph.components(graph.vertices_of(edges.limit(0)), edges.limit(0)).count() == 0


def test_scored_edge_can_be_left_out(spark):
    pairs = spark.createDataFrame([("a", "b", 1), ("a", "c", 0)], "article_id string, ref_id string, is_reference_valid int")
    own = {r.ref_id: (r.out_article, r.in_ref) for r in graph.pair_features(pairs, rounds=2, exclude_scored_edge=True).collect()}
    assert own == {"b": (0, 0), "c": (1, 0)}


def test_unseen_categories_are_zero(spark):
    train = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    test = spark.createDataFrame([("z",), ("a",), (None,)], "c string")
    assert [tuple(r) for r in encoding.one_hot(test, "c", train).collect()] == [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]
    with pytest.raises(ValueError):
        encoding.one_hot(train, "c", limit=1)
    assert [r.c for r in encoding.fold_top(test, "c", train, n=1).collect()] == ["Other", "a", "Other"]


def test_zero_range_scales_by_one(spark):
    rows = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "a double, b double")
    assert encoding.robust_statistics(rows, ["a", "b"]) == {"a": (2.0, 1.0), "b": (2.0, 1.0)}


def test_murmur_vectors():
    known = {b"": 0, b"hello": 0x248BFA47, b"hello, world": 0x149BBB7F, b"The quick brown fox jumps over the lazy dog": 0x2E4FF723}
    assert all(encoding.murmur3_32(k) % (1 << 32) == v for k, v in known.items())


def test_hash_tokens_keep_sum_of_signs(spark):
    rows = spark.createDataFrame([(["a", "b", "a"],), (None,), ([],)], "k array<string>")
    for f in (encoding.hash_tokens, encoding.hash_tokens_murmur):
        got = [sum(abs(v) for v in r[1:]) for r in f(rows, "k").collect()]
        assert got[0] in (1.0, 3.0) and got[1:] == [0.0, 0.0]


def test_tokens_keep_accents(spark):
    rows = spark.createDataFrame([(1, "Étude THE x of_2 état"), (2, None), (3, "")], "id int, t string")
    assert sorted(r.term for r in text.tokens(rows, "id", "t").collect()) == sorted(["of_2", "étude", "état"])
    assert sorted(r.term for r in text.tokens(rows, "id", "t", n_grams=(1, 2)).collect()) == sorted(["of_2", "of_2 état", "étude", "étude of_2", "état"])


def test_n_grams_split_a_text_once(spark):
    words = [f"w{i % 701}" for i in range(20_000)]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, "one"), (3, "one two"), (4, None), (5, "")], "id int, t string")
    pairs = text.tokens(rows, "id", "t", n_grams=(2, 2))
    plan = pairs._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("regexp_extract_all") == 1
    assert Counter((r.id, r.term) for r in pairs.collect()) == Counter([(3, "one two"), *((1, f"{a} {b}") for a, b in zip(words, words[1:]))])
    lists = {r.id: r.terms for r in text.term_lists(rows.where("id > 1"), "id", "t", n_grams=(2, 3)).collect()}
    assert lists == {2: [], 3: ["one two"]}


def test_svd_spans_numpy_subspace(spark):
    rng = np.random.default_rng(0)
    m = np.abs(rng.normal(size=(30, 8)))
    weights = spark.createDataFrame([(i, f"t{j}", float(m[i, j])) for i in range(30) for j in range(8)], "id int, term string, weight double")
    vocab = weights.select("term").distinct()
    got = np.array([r.embedding for r in text.svd(weights, vocab, "id", 3).orderBy("id").collect()])
    v = np.linalg.svd(m)[2][:3]
    assert np.allclose(np.linalg.norm(got, axis=1), np.linalg.norm(m @ v.T, axis=1), atol=1e-4)
    by_passes = text.project(weights, text.fit_svd(weights, vocab, "id", 3, gram_terms=0), "id")
    assert np.allclose(got, np.array([r.embedding for r in by_passes.orderBy("id").collect()]), atol=1e-4)
    with pytest.raises(ValueError):
        text.svd(weights, vocab, "id", 8)


def test_perfect_and_one_sided_scores(spark):
    rows = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, prediction int")
    assert {(r.label, r.prediction): r.n for r in metrics.confusion(rows).collect()} == {(0, 0): 2, (0, 1): 0, (1, 0): 1, (1, 1): 0}
    s = metrics.weighted_scores(rows).first()
    assert abs(s.accuracy - 2 / 3) < 1e-12 and s.precision < s.recall
    auc = metrics.roc_auc(spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, p double"), "y", "p").first().auc
    assert auc == 0.875


def test_models_learn_save_and_load(spark, tmp_path):
    rows = spark.range(400).select(F.col("id"), ((F.col("id") % 7) / 7).alias("a"), ((F.col("id") % 5) / 5).alias("b")).withColumn("is_reference_valid", (F.col("a") + F.col("b") > 0.8).cast("int"))
    for kind, params in ((models.BoostedTrees, {"maxIter": 5}), (models.Logistic, {"maxIter": 50}), (models.Forest, {"numTrees": 5}), (models.Perceptron, {"hidden": (4,), "maxIter": 100})):
        assert kind("m", ["a", "b"], **params).train(rows).evaluate(rows).first().accuracy > 0.85
    m = models.Logistic("logistic", ["a", "b"], maxIter=50).train(rows)
    at = m.save(f"file://{tmp_path}")
    assert models.latest(spark, f"file://{tmp_path}", "logistic").rsplit("/", 1)[1] == at.rsplit("/", 1)[1] and models.latest(spark, f"file://{tmp_path}/none", "x") is None
    again = models.Logistic("logistic", ["a", "b"]).load(at)
    assert again.evaluate(rows).first() == m.evaluate(rows).first()
    tuned = models.Logistic("logistic", ["a", "b"])
    assert tuned.tune(rows, rows, {"maxIter": [1, 40]}, draws=4)[0][1] > 0.85
    drops = {r.feature: r.drop for r in explain.permutation_importance(rows, "id", ["a", "b"], "is_reference_valid", m.predict).collect()}
    assert min(drops.values()) > 0.05
    local = {r.feature: r.weight for r in explain.local_linear({"a": 0.4, "b": 0.4}, {"a": 0.3, "b": 0.3}, m.predict, spark, samples=300).collect()}
    assert min(local.values()) > 0
    shap = {r.feature: r.value for r in explain.sampled_shapley({"a": 0.8, "b": 0.8}, {"a": 0.0, "b": 0.0}, m.predict, spark, orders=6).collect()}
    assert min(shap.values()) > 0
    trees = models.BoostedTrees("g", ["a", "b"], maxIter=3).train(rows)
    assert explain.tree_importances(trees.model.stages[-1], ["a", "b"], spark).count() == 2


def test_permutation_importance_matches_plain(spark):
    rows = spark.createDataFrame([(i, (i * 7) % 11 / 11, (i * 5) % 13 / 13, None if i == 3 else int(i % 3 == 0)) for i in range(50)], "id int, a double, b double, y int")
    rule = lambda t: t.withColumn("prediction", (F.col("a") + 2 * F.col("b") > 1.2).cast("int"))
    dealt = explain.dealt_anew(rows, "id", ["a", "b"]).collect()
    assert sorted((r._new_0, r._new_1) for r in dealt) == sorted((r.a, r.b) for r in dealt) and len({r.id for r in dealt}) == 50
    assert any(r._new_0 != r.a for r in dealt)
    known = [r for r in dealt if r.y is not None]
    right = lambda a, b: np.mean([(x + 2 * z > 1.2) == r.y for r, x, z in zip(known, a, b)])
    a, b, a2, b2 = ([r[c] for r in known] for c in ("a", "b", "_new_0", "_new_1"))
    got = {r.feature: r["drop"] for r in explain.permutation_importance(rows, "id", ["a", "b"], "y", rule).collect()}
    assert abs(got["a"] - (right(a, b) - right(a2, b))) < 1e-9 and abs(got["b"] - (right(a, b) - right(a, b2))) < 1e-9


def test_explained_rows_of_each_model(spark):
    rows = spark.range(200).select("id", ((F.col("id") % 7) / 7).alias("a"), F.when(F.col("id") > 0, (F.col("id") % 5) / 5).alias("b")).withColumn("is_reference_valid", (F.col("a") + F.coalesce("b", F.lit(0.0)) > 0.8).cast("int"))
    trees = models.BoostedTrees("trees", ["a", "b"], maxIter=2).train(rows)
    got = explain.explained({"trees": trees}, rows, rows, "id", "is_reference_valid", samples=50, orders=2).collect()
    kinds = {(r.row, r.method) for r in got}
    assert kinds == {(None, "importance")} | {(k, m) for k in ("valid", "invalid") for m in ("local linear", "shapley")} and len(got) == 10
    median = encoding.robust_statistics(rows, ["a", "b"])["b"][0]
    asked = spark.createDataFrame([("middle", encoding.robust_statistics(rows, ["a", "b"])["a"][0], median), ("valid", 3 / 7, 0.6), ("invalid", 0.0, median)], "row string, a double, b double")
    odds = {r.row: r.probability for r in trees.predict(asked).collect()}
    for kind in ("valid", "invalid"):  # rows 3 and 0; the values add up to the difference from the medians' answer
        assert abs(sum(r.value for r in got if r.row == kind and r.method == "shapley") - (odds[kind] - odds["middle"])) < 1e-9
    one_sided = explain.explained({"trees": trees}, rows, rows.where("is_reference_valid = 1"), "id", "is_reference_valid", samples=50, orders=2)
    assert {r.row for r in one_sided.select("row").distinct().collect()} == {None, "valid"} and explain.explained({}, rows, rows, "id", "is_reference_valid").count() == 0


def test_tuning_rows(spark):
    rows = spark.range(100)
    got = sampling.tuning_rows(rows.where("id < 70"), rows.where("id >= 70"), 1, "id", n=50).collect()
    assert sorted(r.fold for r in got) == [-1] * 40 + [0] * 10 and all((r.id < 70) == (r.fold == -1) for r in got)
    assert sampling.tuning_rows(rows, rows.limit(0), 1, "id").count() == 100


def test_knn_ties_and_self(spark):
    rows = spark.createDataFrame([(i, [float(i // 3), 0.0], i // 3) for i in range(9)], "id int, v array<double>, label int")
    got = {r.query: r.prediction for r in models.knn_classify(rows, rows, "id", "v", "label", 2).collect()}
    assert got == {i: i // 3 for i in range(9)}
    near = text.nearest(rows.where("id = 0"), rows, "id", "v", 3)
    assert near.count() == 3 and text.nearest(rows.limit(0), rows, "id", "v", 3).count() == 0


def test_queries_take_all_features(spark, data):
    from citeweave.plans import catalog

    queries = catalog.queries()
    assert queries["i02_permutation_importance"](spark, data).count() == 64
    assert {r.n_features for r in queries["t09_classic_matrix"](spark, data).select("n_features").distinct().collect()} == {2 * 256 + 1}
    assert [c for c in queries["t08_svd_embedding"](spark, data).columns if c.startswith("article_emb")] == [f"article_emb_{i:03d}" for i in range(64)]


def test_neighbours_by_lists_and_by_edges(spark):
    """Hubs are looked up by edge, other ends meet as lists; counts are those of sets either way."""
    edges = {(i, (i * 7 + 3) % 40) for i in range(40)} | {(0, i) for i in range(1, 30)} | {(1, i) for i in range(20, 40)}
    edges = {e for e in edges if e[0] != e[1]}
    near = {i: {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in range(41)}
    pairs = [*sorted(edges), (1, 0), (0, 1), (5, 40)]
    frames = spark.createDataFrame(pairs, "u long, v long"), spark.createDataFrame(sorted(edges), "src long, dst long")
    for listed in (1000, 8, 0):
        got = {(r.u, r.v): (r.common_neighbors, r.jaccard_coeff) for r in graph.neighbourhoods(*frames, listed=listed).collect()}
        assert len(got) == len(set(pairs))
        for (u, v), (c, j) in got.items():
            assert c == len(near[u] & near[v]) and abs(j - c / len(near[u] | near[v])) < 1e-12


def test_ranks_and_katz_in_one_iteration(spark, monkeypatch):
    monkeypatch.setattr(graph, "LISTED", 3)
    e = spark.createDataFrame(sorted({(i, (i * 7 + j) % 20) for i in range(20) for j in range(i % 6)}), "src long, dst long")
    v = spark.range(21).toDF("id")
    got = graph.rank_and_katz(v, e, 4).join(graph.pagerank(v, e, max_iter=4, tol=None).withColumnRenamed("rank", "r"), "id").join(graph.katz(v, e, max_iter=4, tol=None).withColumnRenamed("katz", "k"), "id")
    assert got.count() == 21 and got.where("abs(rank - r) > 1e-12 or abs(katz - k) > 1e-12").isEmpty()
