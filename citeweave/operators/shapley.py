"""Shapley values of predictions: exact ones of tree ensembles by their paths, and weighted regression for any model.

Trees. A feature that isn't known is averaged over: a split on it sends a row both ways, in proportion to the training
rows (cover) on each side. A leaf's value is then a game of the features on its path alone: with o = 1 where the row meets
all of a feature's splits on the path (else 0) and z the product of their shares of cover, coalition S reaches the leaf with
weight prod(o in S) * prod(z not in S). The products of all coalitions of one size are the coefficients of
prod(z + o x), which is extended feature by feature; a feature is taken out again by dividing by its factor, and the
rest, weighed by k! (d - 1 - k)! / d!, is its value. Values and base add up to the ensemble's raw score.

Any model. Coalitions of features take the row's values, the others those of a background sample; the mean score is the
coalition's worth. A linear model of the worths, weighed by the Shapley kernel and bound to add up to the row's score less
the base, has the Shapley values as its weights. The coalitions are the same for all rows, so the regression is one matrix.

Nulls and NaN count as 0, as in the classifiers. An empty table gives an empty result; a tree of one leaf has values of 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.functions import columns as C
from citeweave.operators import sampling
from citeweave.operators.boosting import LeafwiseBoosting, Tree
from citeweave.operators.models import Classifier
from citeweave.session import written


class Leaf(NamedTuple):
    """A leaf's weighted value, and for each feature on its path the range (low, high] and the share of cover."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


class Ensemble(NamedTuple):
    start: float
    leaves: list[Leaf]

    @property
    def base(self) -> float:
        """The expected raw score: every leaf by its share of cover."""
        return self.start + sum(x.value * float(np.prod(x.share)) for x in self.leaves)


def leaves_of(tree: Tree, weight: float = 1.0) -> list[Leaf]:
    out, todo = [], [(0, {})]
    while todo:
        at, path = todo.pop()
        if (f := int(tree.feature[at])) < 0:
            ranges = list(path.values())
            out.append(Leaf(weight * float(tree.value[at]), np.array(list(path), np.int64), *(np.array([r[i] for r in ranges], float) for i in range(3))))
            continue
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        cut = float(tree.threshold[at])
        for side, own in ((int(tree.left[at]), (low, min(high, cut))), (int(tree.right[at]), (max(low, cut), high))):
            todo.append((side, path | {f: (*own, share * float(tree.cover[side] / tree.cover[at]))}))
    return out


def _mllib_tree(model, value: Callable[[list[float], float], float]) -> Tree:
    """The nodes of a fitted MLlib tree; ``value`` of a leaf from its statistics and its prediction."""
    rows: list[list[float]] = []

    def put(node) -> int:
        at = len(rows)
        stats = node.impurityStats()
        rows.append([-1, 0.0, 0, 0, 0.0, float(stats.count())])
        if node.subtreeDepth() == 0:
            rows[at][4] = value(list(stats.stats()), float(node.prediction()))
            return at
        split = node.split()
        if split.getClass().getSimpleName() != "ContinuousSplit":
            raise ValueError("only numeric splits have an order of values")
        rows[at][:4] = [split.featureIndex(), float(split.threshold()), put(node.leftChild()), put(node.rightChild())]
        return at

    put(model._java_obj.rootNode())
    f, t, left, right, v, cover = (np.array(c, float) for c in zip(*rows))
    return Tree(f.astype(np.int64), t, left.astype(np.int64), right.astype(np.int64), v, cover)


def ensemble_of(model: Classifier) -> Ensemble:
    """The trees behind a fitted classifier: log-odds of leaf-wise boosting, margins of boosted trees, votes of a forest."""
    if isinstance(model, LeafwiseBoosting):
        return Ensemble(model.start, [x for t in model.trees for x in leaves_of(t)])
    fitted = model.model.stages[-1]
    kind = type(fitted).__name__
    if kind == "GBTClassificationModel":
        return Ensemble(0.0, [x for t, w in zip(fitted.trees, fitted.treeWeights) for x in leaves_of(_mllib_tree(t, lambda _, p: p), float(w))])
    if kind == "RandomForestClassificationModel":
        return Ensemble(0.0, [x for t in fitted.trees for x in leaves_of(_mllib_tree(t, lambda s, _: s[1] / sum(s)), 1 / fitted.getNumTrees)])
    raise ValueError(f"{kind} has no trees")


def path_values(ensemble: Ensemble, x: np.ndarray, at_once: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Shapley values (rows x features) and raw scores of the rows of ``x``."""
    out, raw = np.zeros(x.shape), np.full(len(x), ensemble.start)
    for begin in range(0, len(x), at_once):
        part, values, scores = x[begin : begin + at_once], out[begin : begin + at_once], raw[begin : begin + at_once]
        for leaf in ensemble.leaves:
            d = len(leaf.features)
            own = part[:, leaf.features]
            met = ((own > leaf.low) & (own <= leaf.high)).T.astype(float)
            scores += leaf.value * met.prod(axis=0)
            if d == 0:
                continue
            sums = np.zeros((d + 1, len(part)))
            sums[0] = 1.0
            for j in range(d):  # extend by the factor z + o x
                sums[1 : j + 2] = leaf.share[j] * sums[1 : j + 2] + met[j] * sums[: j + 1]
                sums[0] *= leaf.share[j]
            weights = [math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)]
            for j in range(d):
                z, there = leaf.share[j], met[j] > 0
                rest, total = sums[d], np.zeros(len(part))
                for k in range(d - 1, -1, -1):  # divide by z + x from the top where it is met, by z elsewhere
                    total += weights[k] * np.where(there, rest, sums[k] / z if z > 0 else 0.0)
                    rest = sums[k] - z * rest
                values[:, leaf.features[j]] += leaf.value * (met[j] - z) * total
    return out, raw


def tree_values(rows: DataFrame, model: Classifier, keep: Sequence[str]) -> DataFrame:
    """The columns of ``keep``, ``base``, ``raw`` (the ensemble's score) and ``shap``, the values in order of the features."""
    ensemble, n_features = ensemble_of(model), len(model.features)
    base = ensemble.base
    packed = model.preprocess(rows).select(*keep, F.array(*(C.finite(F.col(f).cast("double")) for f in model.features)).alias("_x"))
    schema = T.StructType([*packed.drop("_x").schema.fields, *(T.StructField(c, T.DoubleType()) for c in ("base", "raw")), T.StructField("shap", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, raw = path_values(ensemble, _rows(b.column(b.num_columns - 1), n_features))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.full(b.num_rows, base)), pa.array(raw), _lists(values)], [*b.schema.names[:-1], "base", "raw", "shap"])

    return packed.mapInArrow(run, schema)


def _rows(lists: pa.Array, length: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), length)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def summary(values: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mean_abs, mean) of the ``shap`` columns: each task sums its rows, so no row is ever exploded by feature."""
    n_features = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((2, n_features)), 0
        for b in batches:
            x = _rows(b.column(0), n_features)
            total, n = total + [np.abs(x).sum(axis=0), x.sum(axis=0)], n + len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"sizes": pa.array([total[0].tolist()], pa.list_(pa.float64())), "sums": pa.array([total[1].tolist()], pa.list_(pa.float64())), "n": pa.array([n], pa.int64())})

    parts = values.select("shap").mapInArrow(run, "sizes array<double>, sums array<double>, n long")
    each = parts.select(F.posexplode(F.arrays_zip("sizes", "sums")).alias("i", "x"), "n").groupBy("i").agg(F.sum("x.sizes").alias("sizes"), F.sum("x.sums").alias("sums"), F.sum("n").alias("n"))
    return each.select(F.get(F.array(*map(F.lit, features)), F.col("i")).alias("feature"), (F.col("sizes") / F.col("n")).alias("mean_abs"), (F.col("sums") / F.col("n")).alias("mean"))


def coalitions(n: int, budget: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions of n features (rows of 0/1, neither none nor all) and their weights by the Shapley kernel.

    All of them, if ``budget`` allows; else all of the smallest and largest sizes that fit, which weigh most, and from the
    sizes between them keyed draws with their complements, which share those sizes' weight.
    """
    mass = np.array([0.0, *((n - 1) / (s * (n - s)) for s in range(1, n)), 0.0])
    rows, weights = [], []
    low = 1
    while 2 * low <= n:
        sizes = {low, n - low}
        count = len(sizes) * math.comb(n, low)
        if len(rows) + count > budget:
            break
        for s in sorted(sizes):
            for own in combinations(range(n), s):
                rows.append(np.isin(np.arange(n), own))
                weights.append(mass[s] / math.comb(n, s))
        low += 1
    left = range(low, n - low + 1)
    pairs = (budget - len(rows)) // 2
    if len(left) and pairs > 0:
        rng = np.random.default_rng(seed)
        share = mass[low : n - low + 1]
        for s in rng.choice(np.array(left), pairs, p=share / share.sum()):
            own = np.zeros(n, bool)
            own[rng.choice(n, s, replace=False)] = True
            rows += [own, ~own]
        weights += [share.sum() / (2 * pairs)] * (2 * pairs)
    if len(rows) < n:
        raise ValueError("the budget must allow a coalition for each feature")
    return np.array(rows, float), np.array(weights)


def kernel_values(rows: DataFrame, key: str, features: Sequence[str], predict: Callable[[DataFrame], DataFrame], background: DataFrame, background_key: str, score: str = "probability", budget: int | None = None, background_rows: int = 100, seed: int = 42) -> DataFrame:
    """(key, base, raw, shap) of ``rows`` for any model: ``predict`` adds the number ``score`` (an SQL expression of its columns).

    The background is a keyed sample of at most ``background_rows`` rows (its bound, as it goes to every task). A row is
    scored ``budget`` x background times (2 x features + 2,048 coalitions by default): made in its task, averaged by a
    grouped mean. Keys may repeat or be null; a row is told apart by its number.
    """
    n = len(features)
    names = list(features)
    if n < 2:
        raise ValueError("two features at least")
    plain = lambda d: [C.finite(F.col(f).cast("double")).alias(f) for f in names]
    masks, weights = coalitions(n, min(budget or 2 * n + 2048, (1 << min(n, 40)) - 2), seed)
    sample = written(sampling.bounded_sample(background, background_rows, seed, background_key).select(*plain(background)), "background")
    against = np.array([list(r) for r in sample.collect()], float).reshape(-1, n)  # background_rows at most
    if not len(against):
        raise ValueError("no background rows")
    base = float(predict(sample).agg(F.avg(F.expr(score))).first()[0])
    asked = written(rows.select(F.monotonically_increasing_id().alias("_row"), F.col(key), *plain(rows)), "asked")
    # the last feature's value is what the others leave of raw - base
    others = masks[:, :-1] - masks[:, -1:]
    weighed = others.T * weights
    solve = np.linalg.lstsq(weighed @ others, weighed, rcond=None)[0]
    in_last = masks[:, -1]

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_once = max(1, 20_000 // len(against))
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]], axis=1)
            for row, own in zip(b.column(0).to_pylist(), x):
                for begin in range(0, len(masks), at_once):
                    part = masks[begin : begin + at_once, None, :] > 0
                    made = np.where(part, own, against[None, :, :]).reshape(-1, n)
                    which = np.repeat(np.arange(begin, begin + len(part), dtype=np.int32), len(against))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(made), row)), pa.array(which), *(pa.array(made[:, i]) for i in range(n))], ["_row", "_coalition", *names])

    schema = "_row long, _coalition int, " + ", ".join(f"`{f}` double" for f in names)
    worth = predict(asked.select("_row", *names).mapInArrow(changed, schema)).groupBy("_row", "_coalition").agg(F.avg(F.expr(score)).alias("y"))
    worths = worth.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("_coalition", "y"))), lambda s: s["y"]).alias("y"))  # ``budget`` numbers
    raw = predict(asked).select("_row", key, F.expr(score).cast("double").alias("raw"))

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, total = _rows(b.column(2), len(masks)), b.column(1).to_numpy(zero_copy_only=False) - base
            first = (y - base - np.outer(total, in_last)) @ solve.T
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, base)), b.column(1), _lists(np.column_stack([first, total - first.sum(axis=1)]))], [key, "base", "raw", "shap"])

    kind = rows.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), *(T.StructField(c, T.DoubleType()) for c in ("base", "raw")), T.StructField("shap", T.ArrayType(T.DoubleType()))])
    return raw.join(worths, "_row").select(key, "raw", "y").mapInArrow(solved, out)


def explained_summary(models: dict[str, Classifier], train: DataFrame, test: DataFrame, key: str, rows: int = 50, seed: int = 42, **params) -> DataFrame:
    """(model, method, feature, mean_abs, mean) of each fitted model: exact tree values over all of ``test`` where it has
    trees, else kernel values of its probability for ``rows`` keyed rows of ``test`` against ``train``."""
    out = None
    for name, model in sorted(models.items()):
        try:
            ensemble_of(model)
            method, values = "tree", tree_values(test, model, [key])
        except (ValueError, AttributeError):
            method, values = "kernel", kernel_values(sampling.bounded_sample(test, rows, seed, key), key, model.features, model.predict, train, key, seed=seed, **params)
        found = summary(values, model.features).select(F.lit(name).alias("model"), F.lit(method).alias("method"), "feature", "mean_abs", "mean")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return test.sparkSession.createDataFrame([], "model string, method string, feature string, mean_abs double, mean double")
    return out
