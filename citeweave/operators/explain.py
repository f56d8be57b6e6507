"""Explanations of predictions: feature importances, permutation importance, local linear surrogates."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.functions import columns as C
from citeweave.operators import encoding
from citeweave.operators.models import Classifier
from citeweave.operators.ordering import dense_index
from citeweave.session import written


def tree_importances(model, features: Sequence[str], spark) -> DataFrame:
    """(feature, importance) of a fitted tree ensemble."""
    values = model.featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")


def dealt_anew(rows: DataFrame, key: str, features: Sequence[str], seed: object = 42) -> DataFrame:
    """The rows with the features of a partner as ``_new_0``, ``_new_1``, ...: row i of one keyed order gets the values
    of row i of another, so each feature keeps its values and loses its row. Keys must be unique; a null key is one key.
    """
    keyed = rows.withColumns({f"_{s}": F.concat_ws("|", C.keyed(f"{seed}{s}", F.col(key)), F.col(key)) for s in "ab"})
    a, _ = dense_index(keyed, "_a")
    b, _ = dense_index(keyed, "_b")
    partners = keyed.select("_b", *(F.col(f).alias(f"_new_{i}") for i, f in enumerate(features))).join(b, "_b").drop("_b")
    return keyed.drop("_b").join(a, "_a").join(partners, "idx").drop("_a", "idx")


def permutation_importance(rows: DataFrame, key: str, features: Sequence[str], label: str, predict: Callable[[DataFrame], DataFrame], seed: object = 42) -> DataFrame:
    """(feature, drop): accuracy lost when a feature's values are dealt anew; for any model.

    One deal serves all features, which take a partner's value one at a time: rows are joined once, then scored once
    for each feature and once as they are, in a single pass. Rows without a label don't count.
    """
    dealt = written(dealt_anew(rows, key, features, seed), "dealt")
    turns = dealt.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    changed = {f: F.when(F.col("_turn") == i + 1, F.col(f"_new_{i}")).otherwise(F.col(f)) for i, f in enumerate(features)}
    scored = predict(turns.withColumns(changed).drop(*(f"_new_{i}" for i in range(len(features)))))
    right = scored.groupBy("_turn").agg(F.avg((F.col(label) == F.col("prediction")).cast("double")).alias("accuracy"))
    right = written(right, "accuracies")  # one row a feature
    base = right.where("_turn = 0").select(F.col("accuracy").alias("base"))
    names = F.array(*(F.lit(f) for f in features))
    return right.where("_turn > 0").crossJoin(base).select(F.get(names, F.col("_turn") - 1).alias("feature"), (F.col("base") - F.col("accuracy")).alias("drop"))


def local_linear(row: dict[str, float], spread: dict[str, float], predict: Callable[[DataFrame], DataFrame], spark, samples: int = 2000, seed: int = 42) -> DataFrame:
    """(feature, weight): a weighted linear model of the probability around one row, over scaled offsets."""
    names = sorted(row)
    base = spark.range(samples).select("id", *(F.randn(seed + i).alias(f"_z{i}") for i in range(len(names))))
    near = base.select("id", *(F.col(f"_z{i}") for i in range(len(names))), *((F.lit(float(row[n])) + F.col(f"_z{i}") * float(spread[n])).alias(n) for i, n in enumerate(names)))
    distance = sum(F.col(f"_z{i}") ** 2 for i in range(len(names)))
    scored = predict(near).withColumn("_w", F.exp(-distance / F.lit(0.75**2 * len(names))))
    data = VectorAssembler(inputCols=[f"_z{i}" for i in range(len(names))], outputCol="_x").transform(scored).select("_x", "_w", "probability")
    model = LinearRegression(featuresCol="_x", labelCol="probability", weightCol="_w").fit(data)
    return spark.createDataFrame([(n, float(w)) for n, w in zip(names, model.coefficients)], "feature string, weight double")


def sampled_shapley(row: dict[str, float], background: dict[str, float], predict: Callable[[DataFrame], DataFrame], spark, orders: int = 100, seed: int = 42) -> DataFrame:
    """(feature, value): Shapley values of one row against a background row, over random orders of the features."""
    import random

    names, rng, plan = sorted(row), random.Random(seed), []
    for o in range(orders):
        order = rng.sample(names, len(names))
        current = dict(background)
        plan.append((o, 0, "", *(float(current[n]) for n in names)))
        for step, n in enumerate(order, 1):
            current[n] = row[n]
            plan.append((o, step, n, *(float(current[m]) for m in names)))
    from pyspark.sql import Window

    rows = spark.createDataFrame(plan, "_o int, _s int, _f string, " + ", ".join(f"`{n}` double" for n in names))
    gain = F.col("probability") - F.lag("probability").over(Window.partitionBy("_o").orderBy("_s"))
    return predict(rows).withColumn("gain", gain).where("_s > 0").groupBy(F.col("_f").alias("feature")).agg(F.avg("gain").alias("value"))


def explained(models: dict[str, Classifier], train: DataFrame, test: DataFrame, key: str, label: str, samples: int = 2000, orders: int = 20, seed: int = 42) -> DataFrame:
    """(model, row, method, feature, value): what weighs in each fitted classifier's answers.

    Of each label (valid: 1, invalid: 0) the test row of the least key is explained by a local linear model and by
    sampled Shapley values against the training rows' medians; a tree ensemble's importances come with row null.
    Missing values of a row are the medians. A label that no test row has is left out. The driver holds one row of
    each label and the features' statistics.
    """
    parts = []
    for name, model in sorted(models.items()):
        fields, spark = model.features, test.sparkSession

        def tagged(found: DataFrame, row: str | None, method: str, value: str, name: str = name) -> DataFrame:
            return found.select(F.lit(name).alias("model"), F.lit(row).cast("string").alias("row"), F.lit(method).alias("method"), "feature", F.col(value).alias("value"))

        statistics = encoding.robust_statistics(train, fields)
        medians, spread = ({f: statistics[f][i] for f in fields} for i in (0, 1))
        if hasattr(fitted := model.model.stages[-1], "featureImportances"):
            parts.append(tagged(tree_importances(fitted, fields, spark), None, "importance", "importance"))
        for kind, wanted in (("valid", 1), ("invalid", 0)):
            one = test.where(F.col(label) == wanted).orderBy(key).select(*(F.col(f).cast("double").alias(f) for f in fields)).first()
            if one is None:
                continue
            row = {f: medians[f] if one[f] is None else one[f] for f in fields}
            parts.append(tagged(local_linear(row, spread, model.predict, spark, samples, seed), kind, "local linear", "weight"))
            parts.append(tagged(sampled_shapley(row, medians, model.predict, spark, orders, seed), kind, "shapley", "value"))
    if not parts:
        return test.sparkSession.createDataFrame([], "model string, row string, method string, feature string, value double")
    return functools.reduce(DataFrame.unionByName, parts)
