"""Queries of models, metrics and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.functions import columns as C
from citeweave.operators import attention, explain, metrics, models, ordering, sampling
from citeweave.plans.fixtures import Inputs
from citeweave.plans.registry import query
from citeweave.session import written

#: Predictions to evaluate: quality against a keyed guess.
_PRED = "pr AS (SELECT doc_id, quality AS label, CAST(CAST('0x' || substr(md5('9|' || doc_id), 1, 8) AS BIGINT) % 1000 AS DOUBLE) / 1000 * 0.6 + quality * 0.3 AS p FROM labels), pp AS (SELECT *, CAST(p >= 0.5 AS INTEGER) AS prediction FROM pr)"
_SCORES = """cls AS (SELECT label AS class FROM pp UNION SELECT prediction FROM pp), sc AS (SELECT class, (SELECT count(*) FROM pp WHERE label = class AND prediction = class) AS tp, (SELECT count(*) FROM pp WHERE label = class) AS support, (SELECT count(*) FROM pp WHERE prediction = class) AS predicted FROM cls),
pr2 AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM sc), s AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr2)"""


def predictions(t: Inputs) -> DataFrame:
    p = C.keyed_number(1000, 9, F.col("doc_id")).cast("double") / 1000 * 0.6 + F.col("quality") * 0.3
    return metrics.at_threshold(t.table("labels").select("doc_id", F.col("quality").alias("label"), p.alias("p")), "p")


def rounded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.round(n, 6) for n in names})


@query(f"WITH {_PRED}, cls AS (SELECT label AS c FROM pp UNION SELECT prediction FROM pp) SELECT a.c AS label, b.c AS prediction, (SELECT count(*) FROM pp WHERE label = a.c AND prediction = b.c) AS n FROM cls a, cls b")
def v01_confusion(t: Inputs) -> DataFrame:
    return metrics.confusion(predictions(t))


@query(f"WITH {_PRED}, {_SCORES} SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM s")
def v02_weighted_scores(t: Inputs) -> DataFrame:
    return rounded(metrics.weighted_scores(predictions(t)), "accuracy", "precision", "recall", "f1")


@query(f"WITH {_PRED}, {_SCORES} SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM s WHERE class = 1")
def v03_binary_scores(t: Inputs) -> DataFrame:
    return rounded(metrics.binary_scores(predictions(t).drop("prediction"), "label", "p"), "precision", "recall", "f1")


@query(f"""WITH {_PRED}, {_SCORES} SELECT CAST(class AS VARCHAR) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM s
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM s UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM s""")
def v04_classification_report(t: Inputs) -> DataFrame:
    return rounded(metrics.report(predictions(t)), "precision", "recall", "f1")


@query(f"WITH {_PRED} SELECT round(sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) / count(*), 6) AS auc FROM pr a, pr b WHERE a.label = 1 AND b.label = 0")
def v05_roc_auc(t: Inputs) -> DataFrame:
    return rounded(metrics.roc_auc(predictions(t), "label", "p"), "auc")


@query(f"""WITH {_PRED}, n AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM pp), st AS (SELECT k, CAST('0x' || substr(md5('42|' || k), 1, 8) AS BIGINT) % greatest((SELECT count(*) FROM pp) - 50 + 1, 1) AS start FROM range(50) t(k))
SELECT k, start, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM st JOIN n ON idx >= start AND idx < start + 50 GROUP BY 1, 2""")
def v06_block_accuracy(t: Inputs) -> DataFrame:
    rows = predictions(t)
    index, total = ordering.dense_index(rows, "doc_id")
    return rounded(metrics.block_accuracy(rows.join(index, "doc_id"), "label", "prediction", "idx", total, block=50), "accuracy")


@query(f"WITH {_PRED} SELECT 'guess' AS model, s AS \"set\", round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS s FROM pp) GROUP BY 2")
def v07_model_comparison(t: Inputs) -> DataFrame:
    rows = predictions(t)
    sets = {"even": rows.where("doc_id % 2 = 0"), "odd": rows.where("doc_id % 2 <> 0")}
    return rounded(metrics.compare({"guess": sets}), "accuracy").select("model", "set", "accuracy")


@query(f"WITH {_PRED} SELECT doc_id, round(1 / (1 + exp(-(p * 8 - 4))), 6) AS probability FROM pr")
def v08_sigmoid_scores(t: Inputs) -> DataFrame:
    return predictions(t).select("doc_id", F.round(C.sigmoid(F.col("p") * 8 - 4), 6).alias("probability"))


@query("SELECT round(sum(1 - toxic) / greatest(sum(toxic), 1), 6) AS pos_weight FROM labels")
def a22_positive_weight(t: Inputs) -> DataFrame:
    return rounded(metrics.positive_weight(t.table("labels"), "toxic"), "pos_weight")


@query("SELECT toxic, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels), 6) AS share FROM labels GROUP BY 1")
def a21_label_shares(t: Inputs) -> DataFrame:
    return rounded(metrics.label_shares(t.table("labels"), "toxic"), "share")


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT q.vec_id AS query, e.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9), e.vec_id) AS r FROM q, embeddings e WHERE q.vec_id <> e.vec_id)
SELECT query, prediction FROM (SELECT query, label AS prediction, row_number() OVER (PARTITION BY query ORDER BY count(*) DESC, label) AS k FROM d WHERE r <= 5 GROUP BY 1, 2) WHERE k = 1""")
def l02_knn_classify(t: Inputs) -> DataFrame:
    e = t.table("embeddings")
    return models.knn_classify(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", "label", 5)


def embedding_features(t: Inputs, n: int = 64) -> tuple[DataFrame, list[str]]:
    """The embeddings' first ``n`` of 64 dimensions as columns, with a binary label."""
    names = [f"e{i:02d}" for i in range(n)]
    rows = t.table("embeddings").select("vec_id", (F.col("label") < 5).cast("int").alias("is_reference_valid"), *(F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)))
    return rows, names


def _scored(t: Inputs, kind, **params) -> DataFrame:
    rows, names = embedding_features(t)
    split = sampling.random_split(rows, 1, "vec_id")
    model = kind(kind.__name__.lower(), names, **params).train(split.where("split = 'train'"))
    return model.predict(split.where("split = 'test'")).select("vec_id", "is_reference_valid", "prediction", F.round("probability", 4).alias("probability"))


@query()
def l03_boosted_trees(t: Inputs) -> DataFrame:
    return _scored(t, models.BoostedTrees, maxIter=5, maxDepth=3)


@query()
def l04_forest(t: Inputs) -> DataFrame:
    return _scored(t, models.Forest, numTrees=10, maxDepth=4)


@query()
def l05_perceptron(t: Inputs) -> DataFrame:
    return _scored(t, models.Perceptron, hidden=(8,), maxIter=30)


@query()
def l05_pair_attention(t: Inputs) -> DataFrame:
    """Whether two vectors in a row have one label."""
    e = t.table("embeddings").select("vec_id", "label", "embedding")
    ref = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("_label"), F.col("embedding").alias("ref"))
    pairs = e.withColumnRenamed("embedding", "article").join(ref, "vec_id").withColumn("is_reference_valid", (F.col("label") == F.col("_label")).cast("int"))
    return _attended(written(pairs.drop("label", "_label"), "pairs"), ["article", "ref"], size=64)


@query()
def l06_feature_attention(t: Inputs) -> DataFrame:
    rows, names = embedding_features(t)
    return _attended(written(rows, "features"), names)


def _attended(rows: DataFrame, tokens: list[str], **params) -> DataFrame:
    split = sampling.random_split(rows, 1, "vec_id")
    model = attention.Attention("attention", tokens, width=16, heads=2, layers=1, batch=64, **params).train(split.where("split = 'train'"), rounds=2)
    return model.predict(split.where("split = 'test'")).select("vec_id", "is_reference_valid", "prediction", F.round("probability", 4).alias("probability"))


@query()
def l08_logistic(t: Inputs) -> DataFrame:
    return _scored(t, models.Logistic, maxIter=50)


@query()
def i02_permutation_importance(t: Inputs) -> DataFrame:
    rows, names = embedding_features(t)
    rows = written(rows.select("vec_id", "is_reference_valid", *names), "features")
    model = models.Logistic("logistic", names, maxIter=20).train(rows)
    return explain.permutation_importance(rows, "vec_id", names, "is_reference_valid", model.predict)


@query()
def i04_explained(t: Inputs) -> DataFrame:
    rows, names = embedding_features(t)
    split = sampling.random_split(written(rows, "features"), 1, "vec_id")
    train, test = (split.where(F.col("split") == s).drop("split") for s in ("train", "test"))
    fitted = {"logistic": models.Logistic("logistic", names, maxIter=20).train(train)}
    return explain.explained(fitted, train, test, "vec_id", "is_reference_valid", samples=500, orders=4)


@query(f"WITH {_PRED} SELECT 'guess' AS model, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pp WHERE doc_id % 2 <> 0")
def a25_test_scores(t: Inputs) -> DataFrame:
    rows = predictions(t)
    table = metrics.compare({"guess": {"train": rows.where("doc_id % 2 = 0"), "test": rows.where("doc_id % 2 <> 0")}})
    return rounded(table.where(F.col("set") == "test"), "accuracy").select("model", "accuracy")


@query(f"WITH {_PRED} SELECT doc_id, CAST(p > 0.5 AS INTEGER) AS prediction, CASE WHEN p > 0.85 THEN 'Excellent' WHEN p > 0.65 THEN 'Good' WHEN p > 0.40 THEN 'Weak' ELSE 'Poor' END AS grade FROM pr")
def l10_predict_with_grade(t: Inputs) -> DataFrame:
    rows = metrics.at_threshold(predictions(t).drop("prediction"), "p", 0.5, strict=True)
    return rows.select("doc_id", "prediction", C.grade(F.col("p")).alias("grade"))
