"""Toxicity by a classifier chain of linear models.

The chain predicts its categories in order. Each model is a logistic regression over the presence of character n-grams
of a text's words (the words' ends are marked, so prefixes, suffixes and whole words, up to 64 characters with their
marks, are among them), plus the log-odds
that the chain has given so far. When a later model is trained, the log-odds of the earlier categories are out of fold:
each labelled document is scored by a model that didn't see it, neither for its weights nor in choosing the n-grams that
it may use: each fold has candidates of its own. When texts are scored, the models fitted on all labelled
rows pass on their own log-odds. The verdict on the last category is its probability against a threshold that is chosen
on the out-of-fold probabilities.

Fitting uses at most ``max_labelled`` labelled rows (default MAX_LABELLED), those that a keyed hash of the id ranks first:
a bounded sample, as are the n-gram candidates (``pool``). Everything else, scoring above all, covers all rows, whole
texts, in one pass without a shuffle.

Edge cases: a null or empty text has no n-grams and gets the models' intercepts; labels that are null don't train their
category; labels of unknown ids and ids with several labels (the largest counts) are fine; of documents that share a labelled id
the smallest text is fitted on; the marks' own characters count as white space in texts; without labelled rows of both
classes a category's probability is its smoothed rate and no document is rejected; only named columns are used, so
others can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import Shipped, pieces, written

MAX_LABELLED, POOL, FEATURES, FOLDS = 8_000, 2_000, 1_000, 4
GRAMS = (3, 4, 5, 6)
_LONG = 64
#: Bytes in lower case, the marks as white space.
_CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\x02\x03", b"abcdefghijklmnopqrstuvwxyz  ")


def grams(word: str) -> set[str]:
    """N-grams of a word between marks, and the word as a whole up to 64 characters."""
    w = f"\x02{word}\x03"
    out = {w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)}
    if len(w) <= _LONG:
        out.add(w)
    return out


class _Presence:
    """Indices of the features that are present in a text (UTF-8), found in one pass over its distinct words."""

    def __init__(self, index: dict[str, int]) -> None:
        self.find = ahocorasick.Automaton()
        for gram, i in index.items():
            self.find.add_word(gram, i)
        if index:
            self.find.make_automaton()
        self.any = bool(index)

    def __call__(self, text: bytes | None) -> list[int]:
        words = set(text.translate(_CLEAN).split()) if text and self.any else None  # of bytes: ASCII letters, ASCII white space
        if not words:
            return []
        # the marks around words keep n-grams, which hold none inside, within one word
        marked = b"\x02" + b"\x03\x02".join(words) + b"\x03"
        return sorted({i for _, i in self.find.iter(marked.decode())})


class _Rows:
    """A sparse 0/1 matrix: for each row the columns that are 1, and dense extra columns."""

    def __init__(self, rows: list[list[int]], width: int, extra: np.ndarray) -> None:
        self.n, self.width, self.extra = len(rows), width, extra
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.fromiter((c for r in rows for c in r), np.int64, len(self.row))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n) + self.extra @ w[self.width :]

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.r_[np.bincount(self.col, v[self.row], self.width), self.extra.T @ v]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: _Rows, y: np.ndarray, penalty: float = 1.0, rounds: int = 80, memory: int = 8) -> np.ndarray:
    """Weights (the last is the unpenalised intercept) of an L2 logistic regression, by L-BFGS with backtracking."""
    ridge = np.r_[np.full(x.width + x.extra.shape[1] - 1, penalty), 0.0]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.dot(w)
        value = np.logaddexp(0, z).sum() - y @ z + 0.5 * (ridge * w) @ w
        return float(value), x.back(_sigmoid(z) - y) + ridge * w

    w = np.zeros(len(ridge))
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    value, g = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    first = max(1e-12, float(np.abs(g).max()))
    for _ in range(rounds):
        if np.abs(g).max() <= 1e-3 * first:
            break
        d, alphas = -g, []
        for s, t, r in reversed(steps):
            alphas.append(a := r * (s @ d))
            d = d - a * t
        if steps:
            s, t, r = steps[-1]
            d = d / (r * (t @ t))
        else:
            d = d / max(1.0, float(np.abs(g).sum()))
        for (s, t, r), a in zip(steps, reversed(alphas)):
            d = d + (a - r * (t @ d)) * s
        slope, size = float(g @ d), 1.0
        while True:
            new, new_g = loss(w + size * d)
            if new <= value + 1e-4 * size * slope or size < 1e-10:
                break
            size /= 2
        s, t = size * d, new_g - g
        w, value, g = w + s, new, new_g
        if s @ t > 1e-12:
            steps = [*steps, (s, t, 1 / (s @ t))][-memory:]
    return w


def _association(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """Likelihood-ratio statistic of a feature's counts in two classes."""
    total, share = pos + neg, n_pos / max(n_pos + n_neg, 1)
    expected = np.maximum(total * share, 1e-9), np.maximum(total * (1 - share), 1e-9)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (np.where(pos > 0, pos * np.log(pos / expected[0]), 0) + np.where(neg > 0, neg * np.log(neg / expected[1]), 0))


class Chain:
    """The fitted chain; ``score`` gives the probability of each category."""

    def __init__(self, names: list[str], vocabulary: list[str], models: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> None:
        self.names, self.vocabulary, self.models, self.threshold = names, vocabulary, models, threshold
        self._presence: _Presence | None = None
        self.out_of_fold: dict = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_presence": None, "out_of_fold": {}}

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if self._presence is None:
            self._presence = _Presence({g: i for i, g in enumerate(self.vocabulary)})
        rows = [self._presence(t) for t in texts]
        logits = np.zeros((len(texts), len(self.models)))
        for k, (dense, tail) in enumerate(self.models):
            x = _Rows(rows, len(dense), np.c_[logits[:, :k], np.ones(len(texts))])
            logits[:, k] = np.clip(x.dot(np.r_[dense, tail]), -12, 12)
        return _sigmoid(logits)


def _choose(statistic: np.ndarray, count: int) -> np.ndarray:
    return np.sort(np.argsort(-statistic, kind="stable")[:count])


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, pool: int = POOL, features: int = FEATURES, folds: int = FOLDS, seed: str = "chain") -> Chain:
    """Fit a chain on the labelled rows; ``categories`` maps names, in the chain's order, to SQL over ``labels`` (0, 1 or null)."""
    names = list(categories)
    ranked = F.md5(F.concat_ws("|", F.lit(seed), F.col("_id").cast("string")))
    chosen = labels.select(F.col(id_col).alias("_id"), *(F.expr(sql).cast("int").alias(f"y{k}") for k, sql in enumerate(categories.values())))
    chosen = chosen.where(F.col("_id").isNotNull()).groupBy("_id").agg(*(F.max(f"y{k}").alias(f"y{k}") for k in range(len(names))))
    chosen = written(chosen.withColumn("rank", ranked).orderBy("rank", "_id").limit(max_labelled), "labelled")
    # at most max_labelled rows of a few bytes
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_id").isNotNull()).join(F.broadcast(chosen), "_id")
    # one text for each id, so no more rows than labels
    rows = rows.groupBy("_id", *(f"y{k}" for k in range(len(names)))).agg(F.min(F.coalesce("_text", F.lit(""))).alias("_text"))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("_id"), F.lit(folds)).cast("int"))
    rows = written(rows, "training")
    tokens = rows.select("fold", *(f"y{k}" for k in range(len(names))), F.explode(F.array_distinct(F.split(F.translate("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ\x02\x03", "abcdefghijklmnopqrstuvwxyz  "), r"[\x20\x09-\x0D]+"))).alias("word")).where("word <> ''")
    columns = [F.count(F.when((F.col("fold") == f) & (F.col(f"y{k}") == v), 1)).alias(f"c{k}_{f}_{v}") for k in range(len(names)) for f in range(folds) for v in (0, 1)]
    words = tokens.groupBy("word").agg(*columns)
    cells = [c for c in words.columns if c != "word"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                own = [sorted(grams(w)) for w in batch.column("word").to_pylist()]
                index = pa.array(np.repeat(np.arange(batch.num_rows), [len(o) for o in own]))
                yield pa.RecordBatch.from_arrays([pa.array([g for o in own for g in o], pa.string()), *(batch.column(c).take(index) for c in cells)], ["gram", *cells])

    counts = words.mapInArrow(spread, ", ".join(["gram string", *(f"{c} long" for c in cells)])).groupBy("gram").agg(*(F.sum(c).alias(c) for c in cells))
    totals = rows.agg(*(F.count(F.when((F.col("fold") == f) & (F.col(f"y{k}") == v), 1)).alias(f"c{k}_{f}_{v}") for k in range(len(names)) for f in range(folds) for v in (0, 1))).first().asDict()
    candidates: dict[tuple[int, int | None], set[str]] = {}
    best: dict[str, list[int]] = {}
    counts = written(counts.where(sum(F.col(c) for c in cells[: 2 * folds]) >= 3), "grams")
    for k in range(len(names)):
        for out in (None, *range(folds)):
            if out is not None and not any(totals[f"c{k}_{out}_{v}"] for v in (0, 1)):
                continue
            used = [f for f in range(folds) if f != out]
            pos, neg = (sum((F.col(f"c{k}_{f}_{v}") for f in used), F.lit(0)).cast("double") for v in (1, 0))
            n = [sum(totals[f"c{k}_{f}_{v}"] for f in used) for v in (0, 1)]
            share = n[1] / max(1, sum(n))
            lift = lambda c, s: F.when(c > 0, c * F.log(c / ((pos + neg) * F.lit(max(s, 1e-9))))).otherwise(0.0)
            stat = lift(pos, share) + lift(neg, 1 - share)
            often = sum((F.col(f"c0_{f}_{v}") for f in used for v in (0, 1)), F.lit(0)) >= 3
            for row in counts.where(often).orderBy(stat.desc(), "gram").limit(pool).collect():  # at most ``pool`` rows
                best[row["gram"]] = [row[c] for c in cells]
                candidates.setdefault((k, out), set()).add(row["gram"])
    vocabulary = sorted(best)
    allowed = {key: np.array([g in own for g in vocabulary], bool) for key, own in candidates.items()}
    stats = np.array([best[g] for g in vocabulary], np.float64).reshape(len(vocabulary), len(names), folds, 2)
    sent = Shipped(docs.sparkSession, vocabulary)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = _Presence({g: i for i, g in enumerate(sent.value)})
        for batch in pieces(batches, "_text", 2 << 20):
            own = [presence(t.as_py()) for t in batch.column("_text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("fold"), *(batch.column(f"y{k}") for k in range(len(names))), pa.array(own, pa.list_(pa.int32()))], ["_id", "fold", *(f"y{k}" for k in range(len(names))), "own"])

    schema = ", ".join([f"_id {dict(rows.dtypes)['_id']}", "fold int", *(f"y{k} int" for k in range(len(names))), "own array<int>"])
    sample = rows.mapInArrow(present, schema).toArrow().sort_by("_id")  # feature numbers of at most max_labelled documents
    own = [sorted(x) for x in sample["own"].to_pylist()]
    fold = sample["fold"].to_numpy()
    logits = np.zeros((len(own), len(names)))
    models, threshold = [], 1.1
    for k in range(len(names)):
        y = np.array([-1 if v is None else v for v in sample[f"y{k}"].to_pylist()], np.int64)

        def fitted(use: np.ndarray, fold_out: int | None) -> np.ndarray:
            part = stats[:, k].sum(axis=1) - (stats[:, k, fold_out] if fold_out is not None else 0)
            known = use & (y >= 0)
            pos, neg = int((y[known] == 1).sum()), int((y[known] == 0).sum())
            w = np.zeros(len(vocabulary) + k + 1)
            if not pos or not neg:
                w[-1] = math.log((pos + 0.5) / (neg + 0.5)) if pos + neg else -4.0
                return w
            mine = allowed.get((k, fold_out), np.zeros(len(vocabulary), bool))
            chosen = _choose(np.where(mine, _association(part[:, 1], part[:, 0], pos, neg), -1.0), min(features, int(mine.sum())))
            place = np.full(len(vocabulary), -1)
            place[chosen] = np.arange(len(chosen))
            at = np.flatnonzero(known)
            compact = _Rows([[int(place[c]) for c in own[i] if place[c] >= 0] for i in at], len(chosen), np.c_[logits[at, :k], np.ones(len(at))])
            small = fit_logistic(compact, y[at].astype(float))
            w[chosen], w[len(vocabulary) :] = small[: len(chosen)], small[len(chosen) :]
            return w

        out = np.zeros(len(own))
        for f in range(folds):
            held = fold == f
            if held.any():
                w, at = fitted(~held, f), np.flatnonzero(held)
                out[at] = _Rows([own[i] for i in at], len(vocabulary), np.c_[logits[at, :k], np.ones(len(at))]).dot(w)
        w = fitted(np.ones(len(own), bool), None)
        models.append((w[: len(vocabulary)], w[len(vocabulary) :]))
        logits[:, k] = np.clip(out, -12, 12)
        if k == len(names) - 1:
            threshold = _threshold(_sigmoid(logits[:, k]), y)
    chain = Chain(names, vocabulary, models, threshold)
    chain.out_of_fold = dict(zip(sample["_id"].to_pylist(), logits.tolist()))  # for tests; not sent to executors
    return chain


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut of the out-of-fold probabilities with the best F1; the middle of the gap it lies in; above 1 without positives."""
    p, y = p[y >= 0], y[y >= 0]
    if not (y == 1).any() or not (y == 0).any():
        return 1.1
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order] == 1)
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + hit[-1])
    ends = np.r_[p[order][1:] < p[order][:-1], True]
    best = int(np.argmax(np.where(ends, f1, -1)))
    below = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float((p[order][best] + below) / 2)


def scored(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, p_<category> for each category of the chain, and <last category> as 0 or 1; one row per row."""
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    sent = Shipped(docs.sparkSession, chain)  # at most pool n-grams a category
    names = [f"p_{c}" for c in chain.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text", 2 << 20):
            p = sent.value.score(batch.column("_text").cast(pa.binary()).to_pylist())
            verdict = (p[:, -1] > sent.value.threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array(p[:, k]) for k in range(len(names))), pa.array(verdict)], [id_col, *names, chain.names[-1]])

    return source.mapInArrow(run, f"{id_col} {dict(source.dtypes)['_id']}, " + ", ".join(f"{c} double" for c in names) + f", {chain.names[-1]} int")


def without_toxic(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows that the chain doesn't reject; all columns, no shuffle."""
    sent = Shipped(docs.sparkSession, chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, 2 << 20):
            p = sent.value.score(batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist())
            yield batch.filter(pa.array(p[:, -1] <= sent.value.threshold))

    return docs.mapInArrow(run, docs.schema)
