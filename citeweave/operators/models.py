"""Classifiers on feature tables: a common contract over MLlib estimators, nearest neighbours, search, persistence."""

from __future__ import annotations

import random
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.functions import columns as C
from citeweave.operators import encoding, metrics, neighbours


class Classifier:
    """preprocess, train, tune, predict and evaluate over a feature table with a 0/1 label."""

    def __init__(self, name: str, features: Sequence[str], label: str = "is_reference_valid", **params) -> None:
        self.name, self.features, self.label, self.params = name, list(features), label, params
        self.statistics: dict[str, tuple[float, float]] | None = None
        self.model: PipelineModel | None = None

    def estimator(self, **params):
        raise NotImplementedError

    def preprocess(self, rows: DataFrame, fit: bool = False) -> DataFrame:
        """Robust scaling by the training rows' statistics."""
        if fit or self.statistics is None:
            self.statistics = encoding.robust_statistics(rows, self.features)
        return encoding.robust_scale(rows, self.statistics)

    def _fit(self, rows: DataFrame, params: dict) -> PipelineModel:
        return Pipeline(stages=[VectorAssembler(inputCols=self.features, outputCol="features"), *self._stages(params)]).fit(rows)

    def _stages(self, params: dict) -> list:
        return [self.estimator(**params)]

    def train(self, rows: DataFrame) -> Classifier:
        self.model = self._fit(self.preprocess(rows, fit=True), self.params)
        return self

    def tune(self, train: DataFrame, validation: DataFrame, grid: dict[str, list], draws: int = 20, seed: int = 42) -> list[tuple[dict, float]]:
        """Random draws of a grid, fitted on train and ranked by weighted F1 on validation; the best is kept."""
        rng = random.Random(seed)
        tried, results = set(), []
        scaled, held = self.preprocess(train, fit=True), self.preprocess(validation)
        for _ in range(draws):
            params = {k: rng.choice(v) for k, v in sorted(grid.items())}
            if (key := tuple(sorted(params.items()))) in tried:
                continue
            tried.add(key)
            model = self._fit(scaled, self.params | params)
            score = metrics.weighted_scores(model.transform(held), self.label).first()["f1"]
            results.append((params, score))
            if score == max(s for _, s in results):
                self.model, best = model, params
        self.params |= best
        return sorted(results, key=lambda r: -r[1])

    def predict(self, rows: DataFrame, threshold: float | None = None) -> DataFrame:
        """Adds probability (of class 1) and prediction."""
        out = self.model.transform(self.preprocess(rows)).withColumn("probability", vector_to_array("probability")[1])
        out = metrics.at_threshold(out, "probability", threshold) if threshold is not None else out.withColumn("prediction", F.col("prediction").cast("int"))
        return out.drop("features", "rawPrediction", "scaled")

    def evaluate(self, rows: DataFrame) -> DataFrame:
        return metrics.weighted_scores(self.predict(rows), self.label)

    def new_folder(self, path: str) -> str:
        return f"{path}/{self.name}_{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}"

    def save(self, path: str) -> str:
        """Write the fitted pipeline and the scaler's statistics under a new time-stamped folder."""
        at = self.new_folder(path)
        self.model.write().overwrite().save(f"{at}/model")
        spark = SparkSession.active()
        rows = [(c, m, r) for c, (m, r) in self.statistics.items()]
        spark.createDataFrame(rows, "feature string, median double, range double").coalesce(1).write.parquet(f"{at}/scaler")
        return at

    def load(self, at: str) -> Classifier:
        self.model = PipelineModel.load(f"{at}/model")
        self.statistics = {r["feature"]: (r["median"], r["range"]) for r in SparkSession.active().read.parquet(f"{at}/scaler").collect()}
        return self


def latest(spark: SparkSession, path: str, name: str) -> str | None:
    """The newest saved folder of a model, by name."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return None
    own = [s.getPath().toString() for s in files.listStatus(root) if s.getPath().getName().startswith(name + "_")]
    return max(own, default=None)


class BoostedTrees(Classifier):
    def estimator(self, **params):
        return GBTClassifier(labelCol=self.label, featuresCol="features", seed=42, **params)


class Forest(Classifier):
    def estimator(self, **params):
        return RandomForestClassifier(labelCol=self.label, featuresCol="features", seed=42, **params)


class Logistic(Classifier):
    """With a penalty of 1 for all rows together, as is usual: half the squared weights beside the sum of losses."""

    def _fit(self, rows: DataFrame, params: dict) -> PipelineModel:
        return super()._fit(rows, params if "regParam" in params else params | {"regParam": 1 / max(1, rows.count())})

    def estimator(self, **params):
        return LogisticRegression(labelCol=self.label, featuresCol="features", **({"maxIter": 300, "standardization": False} | params))


class Perceptron(Classifier):
    """The nearest native form of the attention models over embeddings: layers over the concatenated vectors."""

    def _stages(self, params: dict) -> list:
        layers = [len(self.features), *params.get("hidden", (64, 32)), 2]
        rest = {k: v for k, v in params.items() if k != "hidden"}
        return [StandardScaler(inputCol="features", outputCol="scaled", withMean=True), MultilayerPerceptronClassifier(labelCol=self.label, featuresCol="scaled", layers=layers, seed=42, **rest)]


def knn_classify(queries: DataFrame, base: DataFrame, key: str, vector: str, label: str, k: int = 5, exclude_self: bool = True, weights: str = "uniform", power: float = 2.0) -> DataFrame:
    """(query, prediction): the label with most votes of the k nearest rows (Minkowski distance of ``power``), ties by label.

    Votes count alike (uniform), or by the inverse of the distance; then rows at distance 0, if any, decide alone.
    """
    if weights not in ("uniform", "distance"):
        raise ValueError(f"unknown weights {weights}")
    near = neighbours.best_by_distance(queries, base, key, vector, k, exclude_self, keep=[label], power=power)
    vote = F.lit(1.0)
    if weights == "distance":
        near = near.withColumn("_least", F.min("distance").over(Window.partitionBy("query")))
        vote = F.when(F.col("_least") == 0, (F.col("distance") == 0).cast("double")).otherwise(1 / F.col("distance"))
    votes = near.groupBy("query", label).agg(F.round(F.sum(vote), 9).alias("n"))
    return votes.groupBy("query").agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("prediction"))


def sgd_step(rows: DataFrame, features: Sequence[str], label: str, start: Sequence[float] | None = None, rate: float = 0.01, penalty: float = 1e-4, batch: int = 64) -> list[float]:
    """One more pass of logistic regression by gradient descent: the new weights, intercept last.

    Each partition goes once through its rows in small batches from the ``start`` weights (zeros at first), and the
    partitions' weights are averaged by rows. Null features are 0; rows without a label don't count. What reaches the
    driver is one vector.
    """
    import numpy as np

    begin = np.zeros(len(features) + 1) if start is None else np.array(start, dtype=float)
    if len(begin) != len(features) + 1:
        raise ValueError("start needs a weight for each feature and the intercept")

    def walked(batches):
        import pyarrow as pa

        w, n = begin.copy(), 0
        for found in batches:
            x = np.column_stack([*(c.to_numpy(zero_copy_only=False) for c in found.columns[:-1]), np.ones(found.num_rows)])
            y = found.columns[-1].to_numpy(zero_copy_only=False)
            for at in range(0, len(y), batch):
                part = x[at : at + batch]
                p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
                shrink = np.append(penalty * w[:-1], 0.0)
                w -= rate * (part.T @ (p - y[at : at + batch]) + shrink * len(part))
            n += len(y)
        if n:
            yield pa.RecordBatch.from_pydict({"w": pa.array([w.tolist()], pa.list_(pa.float64())), "n": pa.array([n], pa.int64())})

    known = rows.where(F.col(label).isNotNull()).select(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"_{i}") for i, f in enumerate(features)), F.col(label).cast("double").alias("_y"))
    parts = known.mapInArrow(walked, "w array<double>, n long").select(F.posexplode("w").alias("i", "w"), "n")
    means = parts.groupBy("i").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w")).orderBy("i").collect()
    return [r["w"] for r in means] or begin.tolist()


def sgd_probability(features: Sequence[str], weights: Sequence[float]):
    """The probability of class 1 as a column, by ``sgd_step``'s weights."""
    total = F.lit(float(weights[-1]))
    for f, w in zip(features, weights):
        total = total + F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * float(w)
    return C.sigmoid(total)
