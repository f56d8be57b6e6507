"""Evaluation of predictions: all from grouped counts, so any number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions import columns as C


def confusion(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n) for all pairs of classes that occur, 0 where none."""
    counts = rows.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))
    classes = counts.select(F.explode(F.array("label", "prediction")).alias("c")).distinct()
    # a row for each class; the grid is the square of the number of classes
    grid = classes.select(F.col("c").alias("label")).crossJoin(classes.select(F.col("c").alias("prediction")))
    return grid.join(counts, ["label", "prediction"], "left").na.fill(0, ["n"])


def class_scores(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(class, precision, recall, f1, support); 0 where a denominator is 0."""
    m = confusion(rows, label, prediction)
    sides = m.select(F.explode(F.array(F.struct(F.col("label").alias("class"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")), F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")))).alias("s")).select("s.*")
    sums = sides.groupBy("class").agg(*(F.sum(c).alias(c) for c in ("tp", "support", "predicted")))
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    scored = sums.withColumn("precision", p).withColumn("recall", r)
    return scored.select("class", "precision", "recall", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0).alias("f1"), "support", "tp")


def weighted_scores(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy and the support-weighted precision, recall and F1."""
    total = F.sum("support")
    return class_scores(rows, label, prediction).agg((F.sum("tp") / total).alias("accuracy"), *((F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in ("precision", "recall", "f1")))


def report(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Scores of each class, then their plain and weighted means."""
    scores = class_scores(rows, label, prediction)
    total = F.sum("support")
    names = ("precision", "recall", "f1")
    macro = scores.agg(F.lit("macro avg").alias("class"), *(F.avg(c).alias(c) for c in names), total.alias("support"))
    weighted = scores.agg(F.lit("weighted avg").alias("class"), *((F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in names), total.alias("support"))
    return scores.select(F.col("class").cast("string").alias("class"), *names, "support").unionByName(macro).unionByName(weighted)


def at_threshold(rows: DataFrame, probability: str, threshold: float = 0.5, strict: bool = False) -> DataFrame:
    p = F.col(probability)
    return rows.withColumn("prediction", ((p > threshold) if strict else (p >= threshold)).cast("int"))


def binary_scores(rows: DataFrame, label: str, probability: str, threshold: float = 0.5) -> DataFrame:
    """One row: precision, recall and F1 of class 1."""
    return class_scores(at_threshold(rows, probability, threshold), label).where("class = 1").select("precision", "recall", "f1")


def roc_auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve, one row: of pairs of a positive and a negative, those in order, ties half.

    Rows are counted by score first; running counts are over ranges of scores, each by itself plus the sum of those before.
    """
    counts = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum((1 - F.col(label)).cast("long")).alias("n"))
    ranged = counts.repartitionByRange("s").withColumn("_part", F.spark_partition_id())
    from citeweave.session import written

    ranged = written(ranged, "score-ranges")
    parts = ranged.groupBy("_part").agg(F.sum("n").alias("pn"))
    before = parts.select("_part", (F.sum("pn").over(Window.orderBy("_part")) - F.col("pn")).alias("n_before"))
    inner = F.sum("n").over(Window.partitionBy("_part").orderBy("s")) - F.col("n")
    joined = ranged.withColumn("inner", inner).join(before, "_part")
    area = F.sum(F.col("p") * (F.col("inner") + F.col("n_before") + F.col("n") / 2))
    return joined.agg((area / (F.sum("p") * F.sum("n"))).alias("auc"))


def positive_weight(rows: DataFrame, label: str) -> DataFrame:
    return rows.agg((F.sum(1 - F.col(label)) / F.greatest(F.sum(label), F.lit(1))).alias("pos_weight"))


def label_shares(rows: DataFrame, label: str) -> DataFrame:
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(label, "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def block_accuracy(rows: DataFrame, label: str, prediction: str, order: str, n_rows: int, block: int = 100, samples: int = 50, seed: object = 42) -> DataFrame:
    """(start, accuracy) of contiguous blocks at keyed starts; ``order`` is a dense position 0..n_rows - 1."""
    last = max(0, n_rows - block)
    starts = rows.sparkSession.range(samples).select(F.col("id").alias("k"), C.keyed_number(last + 1, seed, F.col("id")).alias("start"))
    # each start names its rows, so that the join is on equality
    spans = starts.select("k", "start", F.explode(F.sequence(F.col("start"), F.col("start") + min(block, n_rows) - 1)).alias(order))
    return spans.join(rows, order).groupBy("k", "start").agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def compare(models: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """(model, set, accuracy, precision, recall, f1) of each model on each set of predictions."""
    out = None
    for model, sets in models.items():
        for name, rows in sets.items():
            one = weighted_scores(rows).select(F.lit(model).alias("model"), F.lit(name).alias("set"), "accuracy", "precision", "recall", "f1")
            out = one if out is None else out.unionByName(one)
    return out
