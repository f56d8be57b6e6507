"""Gradient boosting on histograms, grown leaf by leaf: the split of the largest gain first.

Features are cut into bins once, by exact quantiles of all rows (of a keyed sample, if ``edge_rows`` is given), which takes a
few passes for all features together; all rows are trained on, as
one byte a feature beside label and log-odds. A pass over the rows sums gradients and Hessians by (node, feature, bin);
sums are whole numbers (units of 2^-28), so the trees are the same however rows are partitioned. Of two children only
the smaller one is summed, its sibling is the parent less that.

Best-first growth needs the children of a leaf before it can go on. A pass therefore sums the children of every open leaf
at once; then splits are taken in order of gain as far as children are known. The tree is that of one split after
another, in about as many passes as it is deep. Only sums (nodes x features x bins) reach the driver. The table of bins
is written anew after each tree and the one before it is deleted, so disk doesn't grow with the trees.

Nulls and NaN are 0, as in the other classifiers; features aren't scaled, as trees don't need it. Rows without a label don't
count; no rows, or labels of one kind, give a constant; fewer rows than two leaves need leave a tree of one leaf. Up to
2^35 rows fit the sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.functions import columns as C
from citeweave.operators import metrics, profiling, sampling
from citeweave.operators.models import Classifier
from citeweave.session import delete, shared_path

UNIT = float(1 << 28)


class Tree(NamedTuple):
    """Nodes in order from the root; ``feature`` is -1 in leaves; rows at or below ``threshold`` go left; ``cover`` counts rows."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row of ``x``."""
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        inner = tree.feature[at] >= 0
        if not inner.any():
            return at
        f = np.where(inner, tree.feature[at], 0)
        at = np.where(inner, np.where(x[rows, f] <= tree.threshold[at], tree.left[at], tree.right[at]), at)


class _Node:
    def __init__(self, path: tuple[int, ...], sums: np.ndarray) -> None:
        self.path, self.sums, self.children = path, sums, None
        self.totals = sums[0].sum(axis=0)  # gradient, Hessian, rows
        self.split: tuple[float, int, int] | None = None


def best_split(sums: np.ndarray, least_rows: int, penalty: float) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best split of a node's sums (features x bins x 3); ties by feature, then bin."""
    left = np.cumsum(sums, axis=1)[:, :-1]
    total = sums.sum(axis=1, keepdims=True)
    right = total - left
    ok = (left[..., 2] >= least_rows) & (right[..., 2] >= least_rows)

    def score(s: np.ndarray) -> np.ndarray:
        return np.divide((s[..., 0] / UNIT) ** 2, s[..., 1] / UNIT + penalty, out=np.zeros(s.shape[:-1]), where=s[..., 1] / UNIT + penalty > 0)

    gain = np.where(ok, score(left) + score(right) - score(total), -np.inf)
    if not gain.size or not (best := gain.max()) > 1e-9:
        return None
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(best), int(f), int(b)


class LeafwiseBoosting(Classifier):
    def __init__(self, name: str, features: Sequence[str], label: str = "is_reference_valid", key: str | None = None, rounds: int = 100, leaves: int = 31, rate: float = 0.1, least_rows: int = 20, penalty: float = 0.0, bins: int = 255, edge_rows: int | None = None, seed: object = 42) -> None:
        super().__init__(name, features, label, rounds=rounds, leaves=leaves, rate=rate, least_rows=least_rows, penalty=penalty, bins=bins)
        if not 2 <= bins <= 256:
            raise ValueError("2 to 256 bins, as a bin is a byte")
        if edge_rows is not None and edge_rows > 100_000:
            raise ValueError("a sample for bin edges has 100,000 rows at most; None takes all rows")
        self.key, self.edge_rows, self.seed = key, edge_rows, seed
        self.start, self.trees = 0.0, []

    def preprocess(self, rows: DataFrame, fit: bool = False) -> DataFrame:
        return rows.withColumns({f: C.finite(F.col(f).cast("double")) for f in self.features})

    def edges(self, rows: DataFrame) -> list[np.ndarray]:
        """Ascending bin edges of each feature: distinct quantiles of all rows (or of the sample)."""
        bins = self.params["bins"]
        found = profiling.quantiles(sampling.bounded_sample(rows, self.edge_rows, self.seed, self.key or self.features[0]), self.features, [i / bins for i in range(1, bins)])
        return [np.unique(np.array(found[f] or [], float)) for f in self.features]

    def train(self, rows: DataFrame) -> LeafwiseBoosting:
        spark, params = rows.sparkSession, self.params
        known = self.preprocess(rows.where(F.col(self.label).isNotNull()))
        edges = self.edges(known)
        state, path = self._state(known, edges)
        n, positive = state.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
        self.start, self.trees = 0.0, []
        if n and 0 < positive < n:
            self.start = float(np.log(positive / (n - positive)))
            for _ in range(params["rounds"]):
                nodes = self._grown(state)
                tree, cut = self._tree(nodes, edges)
                self.trees.append(tree)
                if len(tree.value) == 1:  # nothing is left to split, and later trees would be the same
                    break
                state, before = self._moved(state, tree, cut), path
                path = shared_path(spark, "boosting")
                state.write.parquet(path)
                state = spark.read.schema(state.schema).parquet(path)
                delete(spark, before)
        elif n:
            self.start = 30.0 if positive else -30.0
        delete(spark, path)
        return self

    def _state(self, known: DataFrame, edges: list[np.ndarray]) -> tuple[DataFrame, str]:
        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = [np.searchsorted(e, c.to_numpy(zero_copy_only=False), side="left").astype(np.uint8) for e, c in zip(edges, b.columns)]
                packed = np.stack(x, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in packed], pa.binary()), b.column(len(edges))], ["bins", "y"])

        path = shared_path(known.sparkSession, "boosting")
        packed = known.select(*self.features, F.col(self.label).cast("double").alias("y")).mapInArrow(binned, "bins binary, y double")
        packed.withColumn("moved", F.lit(0.0)).write.parquet(path)
        return known.sparkSession.read.schema("bins binary, y double, moved double").parquet(path), path

    def _sums(self, state: DataFrame, tree: Tree, wanted: list[int]) -> np.ndarray:
        """Sums (wanted nodes x features x bins x (gradient, Hessian, rows)) of one pass; ``tree`` tells rows' nodes by bin."""
        n_features, bins, start = len(self.features), self.params["bins"], self.start
        unit = UNIT
        slot = np.full(len(tree.feature), -1)
        slot[wanted] = np.arange(len(wanted))
        shape = (len(wanted), n_features, bins)

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((*shape, 3), np.int64)
            for b in batches:
                x = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, n_features)
                own = slot[leaf_of(tree, x)]
                held = np.flatnonzero(own >= 0)
                if len(held) == 0:
                    continue
                y, margin = (b.column(i).to_numpy(zero_copy_only=False)[held] for i in (1, 2))
                p = 1 / (1 + np.exp(-(start + margin)))
                at = ((own[held, None] * n_features + np.arange(n_features)) * bins + x[held]).ravel()
                for i, v in enumerate((np.rint((p - y) * unit), np.rint(p * (1 - p) * unit), np.ones(len(p)))):
                    # a batch's sums are below 2^53, so these floats are exact
                    total[..., i] += np.bincount(at, np.repeat(v, n_features), minlength=total[..., i].size).reshape(shape).astype(np.int64)
            s, f = (a.ravel() for a in np.meshgrid(*map(np.arange, shape[:2]), indexing="ij"))
            yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(f.astype(np.int32)), pa.array([total[i, j].tobytes() for i, j in zip(s, f)], pa.binary())], ["slot", "feature", "sums"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                for s, f, raw in zip(*(c.to_pylist() for c in b.columns)):
                    one = np.frombuffer(raw, np.int64)
                    held[s, f] = held[s, f] + one if (s, f) in held else one
            if held:
                keys = list(held)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([held[k].tobytes() for k in keys], pa.binary())], ["slot", "feature", "sums"])

        schema = "slot int, feature int, sums binary"
        out = np.zeros((*shape, 3), np.int64)
        # each task's sums are added by (node, feature); what is collected is one row for each
        for r in state.mapInArrow(summed, schema).repartition("slot", "feature").mapInArrow(added, schema).collect():
            out[r["slot"], r["feature"]] = np.frombuffer(r["sums"], np.int64).reshape(bins, 3)
        return out

    def _grown(self, state: DataFrame) -> _Node:
        params = self.params

        def node(path: tuple[int, ...], sums: np.ndarray) -> _Node:
            made = _Node(path, sums)
            made.split = best_split(sums, params["least_rows"], params["penalty"])
            return made

        root = node((), self._sums(state, Tree(np.array([-1]), np.zeros(1), *(np.zeros(1, np.int64) for _ in range(2)), np.zeros(1), np.zeros(1)), [0])[0])
        while True:
            leaves, taken, waiting = [root], [], False
            while len(leaves) < params["leaves"]:
                best = min((x for x in leaves if x.split), key=lambda x: (-x.split[0], x.path), default=None)
                if best is None:
                    break
                if best.children is None:
                    waiting = True
                    break
                taken.append(best)
                leaves.remove(best)
                leaves += best.children
            if not waiting:
                for x in leaves:
                    x.children = None
                return root
            # what hasn't been taken may be later: children once known are kept
            ready = [x for x in leaves if x.split and x.children is None]
            tree, index = self._plan(root, {x.path for x in ready})
            wanted = []
            for x in ready:
                rows = x.sums[x.split[1], : x.split[2] + 1, 2].sum()
                wanted.append((x, 0 if 2 * rows <= x.totals[2] else 1))
            found = self._sums(state, tree, [index[(*x.path, side)] for x, side in wanted])
            for (x, side), sums in zip(wanted, found):
                both = [sums, x.sums - sums]
                x.children = [node((*x.path, s), both[s != side]) for s in (0, 1)]

    def _plan(self, root: _Node, ready: set[tuple[int, ...]]) -> tuple[Tree, dict[tuple[int, ...], int]]:
        """The tree by bins with the nodes of ``ready`` split, and the number of each path."""
        rows: list[list[float]] = []
        index: dict[tuple[int, ...], int] = {}

        def put(x: _Node | None, path: tuple[int, ...]) -> int:
            at = index[path] = len(rows)
            rows.append([-1, 0, 0, 0])
            if x is not None and (x.children is not None or path in ready):
                kids = x.children or [None, None]
                rows[at] = [x.split[1], x.split[2], put(kids[0], (*path, 0)), put(kids[1], (*path, 1))]
            return at

        put(root, ())
        f, b, left, right = (np.array(c) for c in zip(*rows))
        return Tree(f.astype(np.int64), b, left.astype(np.int64), right.astype(np.int64), np.zeros(len(f)), np.zeros(len(f))), index

    def _tree(self, root: _Node, edges: list[np.ndarray]) -> tuple[Tree, np.ndarray]:
        """The grown tree with thresholds and values, and its cuts by bin."""
        rows: list[list[float]] = []

        def put(x: _Node) -> int:
            at = len(rows)
            g, h, n = x.totals
            value = -self.params["rate"] * (g / UNIT) / (h / UNIT + self.params["penalty"]) if h / UNIT + self.params["penalty"] > 0 else 0.0
            rows.append([-1, 0.0, 0, 0, value, float(n), 0])
            if x.children is not None:
                f, b = x.split[1:]
                rows[at][:4] = [f, float(edges[f][b]), put(x.children[0]), put(x.children[1])]
                rows[at][6] = b
            return at

        put(root)
        f, t, left, right, value, cover, cut = (np.array(c, float) for c in zip(*rows))
        return Tree(f.astype(np.int64), t, left.astype(np.int64), right.astype(np.int64), value, cover), cut

    def _moved(self, state: DataFrame, tree: Tree, cut: np.ndarray) -> DataFrame:
        """Log-odds after one more tree."""
        by_bin, n_features = tree._replace(threshold=cut), len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, n_features)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(b.column(2).to_numpy(zero_copy_only=False) + by_bin.value[leaf_of(by_bin, x)])], ["bins", "y", "moved"])

        return state.mapInArrow(run, state.schema)

    def predict(self, rows: DataFrame, threshold: float | None = None) -> DataFrame:
        """Adds margin (log-odds), probability (of class 1) and prediction."""
        trees, start, n_features = self.trees, self.start, len(self.features)
        schema = T.StructType([*rows.schema.fields, T.StructField("margin", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                flat = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
                x = flat.reshape(b.num_rows, n_features)
                out = np.full(b.num_rows, start)
                for t in trees:
                    out += t.value[leaf_of(t, x)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out)], [*b.schema.names[:-1], "margin"])

        packed = rows.withColumn("_x", F.array(*(C.finite(F.col(f).cast("double")) for f in self.features)))
        out = packed.mapInArrow(run, schema).withColumn("probability", C.sigmoid(F.col("margin")))
        return metrics.at_threshold(out, "probability", 0.5 if threshold is None else threshold)

    def _written(self, at: str) -> None:
        spark = SparkSession.active()
        rows = [(i, n, int(t.feature[n]), float(t.threshold[n]), int(t.left[n]), int(t.right[n]), float(t.value[n]), float(t.cover[n])) for i, t in enumerate(self.trees) for n in range(len(t.value))]
        spark.createDataFrame([(-1, 0, -1, 0.0, 0, 0, self.start, 0.0), *rows], "tree int, node int, feature int, threshold double, left int, right int, value double, cover double").coalesce(1).write.parquet(f"{at}/trees")

    def save(self, path: str) -> str:
        at = self.new_folder(path)
        self._written(at)
        return at

    def load(self, at: str) -> LeafwiseBoosting:
        rows = SparkSession.active().read.parquet(f"{at}/trees").orderBy("tree", "node").collect()
        self.start, self.trees = rows[0]["value"], []
        for i in range(max(r["tree"] for r in rows) + 1):
            own = [r for r in rows if r["tree"] == i]
            self.trees.append(Tree(*(np.array([r[c] for r in own], kind) for c, kind in zip(Tree._fields, (np.int64, float, np.int64, np.int64, float, float)))))
        return self
