"""Queries of leaf-wise boosting and of Shapley values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.operators import boosting, models, sampling, shapley
from citeweave.plans.fixtures import Inputs
from citeweave.plans.queries_models import embedding_features
from citeweave.plans.registry import query
from citeweave.session import written

_UNIT = 1 << 28
#: The best split of all rows over 16 bins of each feature, and what its two leaves say.
_STUMP = f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y FROM embeddings),
k AS (SELECT ln(avg(y) / (1 - avg(y))) AS start, 1 / (1 + exp(-ln(avg(y) / (1 - avg(y))))) AS p FROM e),
r AS (
  SELECT vec_id, x, round_even((p - y) * {_UNIT}, 0)::BIGINT AS g, round_even(p * (1 - p) * {_UNIT}, 0)::BIGINT AS h FROM e, k),
v AS (SELECT vec_id, g, h, f, x[f + 1] AS v FROM r, range(64) t(f)),
q AS (SELECT f, unnest(quantile_cont(v, [{", ".join(f"{i}/16" for i in range(1, 16))}])) AS edge FROM v GROUP BY 1),
s AS (
  SELECT f, edge, sum(g) / {_UNIT} AS gl, sum(h) / {_UNIT} AS hl, count(*) AS nl FROM v JOIN (SELECT DISTINCT f, edge FROM q) USING (f) WHERE v <= edge GROUP BY 1, 2),
a AS (SELECT sum(g) / {_UNIT} AS ga, sum(h) / {_UNIT} AS ha, count(*) AS na FROM r),
b AS (
  SELECT *, -0.1 * gl / hl AS low, -0.1 * (ga - gl) / (ha - hl) AS high
  FROM s, a WHERE nl >= 20 AND na - nl >= 20 ORDER BY gl * gl / hl + (ga - gl) * (ga - gl) / (ha - hl) DESC, f, edge LIMIT 1),
l AS (SELECT vec_id, f, start, CASE WHEN x[f + 1] <= edge THEN low ELSE high END AS leaf, (low * nl + high * (na - nl)) / na AS mean FROM r, b, k)
SELECT vec_id, format('e{{:02d}}', f) AS feature, round(start + leaf, 6) AS margin, round(start + mean, 6) AS base, round(leaf - mean, 6) AS value FROM l"""


def _split(t: Inputs) -> tuple[DataFrame, DataFrame, list[str]]:
    rows, names = embedding_features(t)
    split = sampling.random_split(written(rows, "features"), 1, "vec_id")
    return *(split.where(F.col("split") == s).drop("split") for s in ("train", "test")), names


@query()
def l03_leafwise_boosting(t: Inputs) -> DataFrame:
    train, test, names = _split(t)
    model = boosting.LeafwiseBoosting("leafwise", names, key="vec_id", rounds=10).train(train)
    return model.predict(test).select("vec_id", "is_reference_valid", "prediction", F.round("probability", 4).alias("probability"))


@query(_STUMP)
def i02_stump_values(t: Inputs) -> DataFrame:
    """One split of all rows: its leaves and its feature's Shapley value for each row."""
    rows, names = embedding_features(t)
    rows = written(rows, "features")
    model = boosting.LeafwiseBoosting("stump", names, key="vec_id", rounds=1, leaves=2, bins=16).train(rows)
    feature = int(model.trees[0].feature[0])
    values = shapley.tree_values(rows, model, ["vec_id"])
    return values.select("vec_id", F.lit(names[feature]).alias("feature"), F.round("raw", 6).alias("margin"), F.round("base", 6).alias("base"), F.round(F.get("shap", F.lit(feature)), 6).alias("value"))


@query()
def i02_tree_shap(t: Inputs) -> DataFrame:
    train, test, names = _split(t)
    model = boosting.LeafwiseBoosting("leafwise", names, key="vec_id", rounds=10).train(train)
    return shapley.summary(shapley.tree_values(test, model, ["vec_id"]), names)


@query()
def i03_kernel_shap(t: Inputs) -> DataFrame:
    """50 keyed rows against 100 of the training rows, as explanations of any model usually take."""
    train, test, names = _split(t)
    model = models.Logistic("logistic", names, maxIter=50).train(train)
    asked = sampling.bounded_sample(test, 50, 42, "vec_id")
    return shapley.kernel_values(asked, "vec_id", names, model.predict, train, "vec_id", "ln(probability / (1 - probability))", budget=256).select("vec_id", "base", "raw", "shap")
