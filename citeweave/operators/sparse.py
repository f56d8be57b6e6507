"""Sparse text vectors: one row with sorted (term, weight) arrays for each text, counted and weighed where the text is
read; products of pairs, pair matrices, Gram matrices, a truncated SVD by random projection. No row is ever as long as
the vocabulary.

An SVD takes ``passes`` + 1 passes over the rows, whatever they are: a seeded Gaussian block of k + ``extra`` columns is
multiplied by the rows and by their transpose (each task adds its rows' part, parts are added by ranges of terms), made
orthonormal by tiles, and multiplied again; the last product gives the singular values and right vectors. On the
driver: blocks of vocabulary x (k + extra) numbers.

A text without a known term has no row; its products are 0. Equal terms of a text add up; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.session import written

#: Terms in a range whose parts are added by one task, and products held at once.
RANGE, HELD = 4096, 1 << 22


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists, and the row of each."""
    return lists.flatten(), np.repeat(np.arange(len(lists)), _lengths(lists))


def _listed(rows: np.ndarray, n: int, *values: pa.Array) -> list[pa.Array]:
    """Values in order of their rows as columns of ``n`` lists."""
    ends = pa.array(np.r_[0, np.cumsum(np.bincount(rows, minlength=n))].astype(np.int32))
    return [pa.ListArray.from_arrays(ends, v) for v in values]


def counted(lists: DataFrame, key: str) -> DataFrame:
    """(key, terms, counts) of rows (key, terms): distinct terms and their numbers, in the rows' own tasks.

    Rows that share a key are one text: they are found by their keys alone, and only they are merged.
    """
    kind = lists.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                flat, rows = _flat(b.column(1))
                codes = flat.dictionary_encode()
                size = max(1, len(codes.dictionary))
                found, counts = np.unique(rows * size + codes.indices.to_numpy(zero_copy_only=False), return_counts=True)
                terms = codes.dictionary.take(pa.array(found % size))
                yield pa.RecordBatch.from_arrays([b.column(0), *_listed(found // size, b.num_rows, terms, pa.array(counts.astype(np.int64)))], [key, "terms", "counts"])

    found = written(lists.select(key, "terms").mapInArrow(run, f"`{key}` {kind}, terms array<string>, counts array<long>"), "counts")
    again = found.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(key)
    if again.isEmpty():
        return found
    again = written(again.select(F.col(key).alias("_again")), "repeated")
    same = found[key].eqNullSafe(again["_again"])
    each = found.join(again, same, "left_semi").select(key, F.explode(F.arrays_zip("terms", "counts")).alias("t"))
    sums = each.groupBy(key, F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("n"))
    merged = sums.groupBy(key).agg(F.collect_list(F.struct("term", "n")).alias("_v")).select(key, F.col("_v.term").alias("terms"), F.col("_v.n").alias("counts"))
    return found.join(again, same, "left_anti").unionByName(merged)


def vocabulary_of(statistics: DataFrame) -> tuple[list[str], np.ndarray]:
    """The terms in order and their idf, on the driver: as many as the vocabulary's size allows."""
    found = statistics.select("term", "idf").orderBy("term").collect()
    return [r["term"] for r in found], np.array([r["idf"] for r in found], float)


def tfidf(counts: DataFrame, key: str, terms: Sequence[str], idf: np.ndarray, names: bool = False) -> DataFrame:
    """(key, terms, weights) of ``counted`` rows, each of unit length; ``terms`` are places in the vocabulary, or its
    ``names``. A row without a known term is left out."""
    sent = counts.sparkSession.sparkContext.broadcast((list(terms), idf))  # its size is the vocabulary's
    kind = counts.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        vocab, weight = pa.array(sent.value[0], pa.string()), sent.value[1]
        for b in batches:
            flat, rows = _flat(b.column(1))
            places = pc.index_in(flat, value_set=vocab).to_numpy(zero_copy_only=False).astype(float)
            known = np.flatnonzero(~np.isnan(places))
            i, rows = places[known].astype(np.int32), rows[known]
            raw = b.column(2).flatten().to_numpy(zero_copy_only=False)[known] * weight[i]
            order = np.lexsort((i, rows))
            i, rows, raw = i[order], rows[order], raw[order]
            raw = raw / np.sqrt(np.bincount(rows, raw * raw, minlength=b.num_rows))[rows]
            there = np.unique(rows)
            own = vocab.take(pa.array(i)) if names else pa.array(i)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(there)), *_listed(np.searchsorted(there, rows), len(there), own, pa.array(raw))], [key, "terms", "weights"])

    return counts.select(key, "terms", "counts").mapInArrow(run, f"`{key}` {kind}, terms array<{'string' if names else 'int'}>, weights array<double>")


def projected(rows: DataFrame, loadings: dict[str, DataFrame]) -> DataFrame:
    """The packed rows with a column of floats for each table of (term, load): the row's weights times the loadings.

    Terms are the loadings' terms, or their places in order. The loadings go to every task.
    """
    found = {name: table.orderBy("term").collect() for name, table in loadings.items()}  # vocabulary x k
    blocks = {name: np.array([r["load"] for r in own], float) for name, own in found.items()}
    vocab = [[r["term"] for r in own] for own in found.values()]
    sent = rows.sparkSession.sparkContext.broadcast((vocab, list(blocks.values())))
    by_name = dict(rows.dtypes)["terms"] == "array<string>"
    at_terms, at_weights = rows.columns.index("terms"), rows.columns.index("weights")
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.ArrayType(T.FloatType())) for n in blocks)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        names, loads = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b, out = whole.slice(at, 256), []
                flat, row = _flat(b.column(at_terms))
                w = b.column(at_weights).flatten().to_numpy(zero_copy_only=False)
                for own, load in zip(names, loads):
                    places = pc.index_in(flat, value_set=pa.array(own, pa.string())) if by_name else flat
                    i = places.to_numpy(zero_copy_only=False).astype(float)
                    known = np.flatnonzero(~np.isnan(i))
                    sums, there = np.zeros((b.num_rows, load.shape[1])), row[known]
                    for to in range(0, len(known), max(1, HELD // load.shape[1])):  # a few products at a time
                        part = known[to : to + max(1, HELD // load.shape[1])]
                        firsts = np.flatnonzero(np.r_[True, np.diff(row[part]) > 0])
                        sums[row[part][firsts]] += np.add.reduceat(w[part, None] * load[i[part].astype(np.int64)], firsts, axis=0)
                    out.append(pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * load.shape[1]), pa.array(sums.astype(np.float32).ravel())))
                yield pa.RecordBatch.from_arrays([*b.columns, *out], [*b.schema.names, *blocks])

    return rows.mapInArrow(run, schema)


def gram(rows: DataFrame, n: int) -> np.ndarray:
    """rows^T rows (n x n) of ``packed`` rows by index, in one pass: each task adds its rows' pairs of terms, and the
    tasks' parts are added by ranges of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            lengths = _lengths(b.column(0)).astype(np.int64)
            ends = np.cumsum(lengths)
            i = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            w = b.column(1).flatten().to_numpy(zero_copy_only=False)
            left = np.repeat(ends, lengths) - np.arange(len(i))  # the row's entries from this one on
            sums = np.r_[0, np.cumsum(left)]
            at = 0
            while at < len(i):  # a few products at a time
                to = max(at + 1, int(np.searchsorted(sums, sums[at] + HELD, side="right")) - 1)
                first = np.repeat(np.arange(at, to), left[at:to])
                second = np.arange(len(first)) - np.repeat(sums[at:to] - sums[at], left[at:to]) + first
                low, high = np.minimum(i[first], i[second]), np.maximum(i[first], i[second])
                total = np.zeros(n * n) if total is None else total
                total += np.bincount(low * n + high, w[first] * w[second], minlength=n * n)
                at = to
        if total is not None:
            step = max(1, RANGE // 64)
            for r in range(0, n, step):
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([total[r * n : (r + step) * n].tobytes()], pa.binary())], ["range", "sums"])

    out = np.zeros(n * n)
    for r in _added(rows.select("terms", "weights").mapInArrow(run, "range int, sums binary")):
        own = np.frombuffer(r["sums"])
        out[r["range"] * n : r["range"] * n + len(own)] = own
    out = out.reshape(n, n)
    return out + np.triu(out, 1).T


def _added(parts: DataFrame) -> list:
    """Tasks' parts (range, sums) added by range, on the driver."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for r, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[r] = held[r] + np.frombuffer(raw) if r in held else np.frombuffer(raw)
        for r, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["range", "sums"])

    return parts.repartition("range").mapInArrow(added, "range int, sums binary").collect()


def packed(weights: DataFrame, key: str, term: str = "term") -> DataFrame:
    """(key, terms, weights): each row's terms in order, with their weights."""
    one = weights.where(F.col("weight") != 0).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(term, "weight"))).alias("_v"))
    return one.select(key, F.col(f"_v.{term}").alias("terms"), F.col("_v.weight").alias("weights"))


def indexed(weights: DataFrame, vocab: DataFrame) -> tuple[DataFrame, list[str]]:
    """The weights with ``i``, the term's place in the sorted vocabulary, and that vocabulary (on the driver: its terms)."""
    terms = [r["term"] for r in vocab.select("term").orderBy("term").collect()]
    index = weights.sparkSession.createDataFrame(list(enumerate(terms)), "i int, term string")
    return weights.join(index, "term"), terms


def _lengths(lists: pa.Array) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy())


def _products(a_terms: pa.Array, a: pa.Array, b_terms: pa.Array, b: pa.Array) -> np.ndarray:
    """The dot product of each row's two sparse vectors: both sides' (row, term) keys are merged."""
    n = len(a_terms)
    codes = pa.concat_arrays([a_terms.flatten(), b_terms.flatten()]).dictionary_encode()
    size = max(1, len(codes.dictionary))
    rows = [np.repeat(np.arange(n), _lengths(x)) for x in (a_terms, b_terms)]
    keys = np.concatenate(rows) * size + codes.indices.to_numpy(zero_copy_only=False)
    left, right = keys[: len(rows[0])], keys[len(rows[0]) :]
    values = [x.flatten().to_numpy(zero_copy_only=False) for x in (a, b)]
    if not len(left) or not len(right):
        return np.zeros(n)
    order = np.argsort(right, kind="stable")
    right, theirs = right[order], values[1][order]
    at = np.minimum(np.searchsorted(right, left), len(right) - 1)
    return np.bincount(rows[0], np.where(right[at] == left, values[0] * theirs[at], 0.0), minlength=n)


def multiplied(pairs: DataFrame, rows: DataFrame, key: str, left: str, right: str, name: str, keep: bool = False) -> DataFrame:
    """The pairs with the product of their ``packed`` rows as ``name``; with ``keep`` both rows' arrays stay (_ta, _wa, _tb, _wb)."""
    sides = [rows.select(F.col(key).alias(c), F.col("terms").alias(f"_t{s}"), F.col("weights").alias(f"_w{s}")) for c, s in ((left, "a"), (right, "b"))]
    both = pairs.join(sides[0], left, "left").join(sides[1], right, "left")
    kind = dict(rows.dtypes)["terms"]
    empty = [F.coalesce(f"_{x}{s}", F.array().cast(kind if x == "t" else "array<double>")).alias(f"_{x}{s}") for s in "ab" for x in "tw"]
    both = both.select(*pairs.columns, *empty)
    m = len(pairs.columns)
    stay = both.columns if keep else pairs.columns
    schema = T.StructType([*(both.schema[c] for c in stay), T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(stay)], pa.array(_products(*b.columns[m : m + 4]))], [*stay, name])

    return both.mapInArrow(run, schema)


def pair_products(pairs: DataFrame, rows: DataFrame, key: str, left: str, right: str, name: str = "cosine") -> DataFrame:
    """Distinct pairs (left, right) with the product of their ``packed`` rows; 0 if either has none."""
    return multiplied(pairs.select(left, right).distinct(), rows, key, left, right, name)


def pair_matrix(pairs: DataFrame, weights: DataFrame, vocab: DataFrame, key: str, left: str, right: str, numeric: Sequence[str] = ()) -> DataFrame:
    """``matrix_of`` weights in long form (key, term, weight)."""
    long, terms = indexed(weights, vocab)
    return matrix_of(pairs, written(packed(long, key, "i"), "packed"), len(terms), key, left, right, numeric)


def matrix_of(pairs: DataFrame, rows: DataFrame, n: int, key: str, left: str, right: str, numeric: Sequence[str] = ()) -> DataFrame:
    """The pairs with ``cosine``, and ``size``, ``indices`` and ``values`` of a sparse row: the numeric columns, the left and
    the right text's weights over the sorted vocabulary, and the cosine in the last place. Null numbers count as 0.

    ``rows`` are packed by index; each side is joined once, for the product and for the cells."""
    m = len(numeric)
    out = multiplied(pairs, rows, key, left, right, "cosine", True)
    cells = [F.array(F.struct(F.lit(i).alias("i"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("v"))) for i, c in enumerate(numeric)]

    def placed(name: str, first: int):
        return F.zip_with(f"_t{name}", f"_w{name}", lambda t, w: F.struct((t + first).cast("int").alias("i"), w.alias("v")))

    cells += [placed("a", m), placed("b", m + n)]
    cells.append(F.array(F.struct(F.lit(m + 2 * n).alias("i"), F.col("cosine").alias("v"))))
    out = out.withColumn("_cells", F.filter(F.concat(*cells), lambda c: c["v"] != 0))
    return out.select(*pairs.columns, "cosine", F.lit(m + 2 * n + 1).alias("size"), F.col("_cells.i").alias("indices"), F.col("_cells.v").alias("values"))


def vectors(rows: DataFrame, column: str = "features") -> DataFrame:
    """``pair_matrix`` rows with a sparse MLlib vector in place of size, indices and values, for MLlib's estimators."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    made = F.udf(lambda n, i, v: SparseVector(n, i, v), VectorUDT())
    return rows.withColumn(column, made("size", "indices", "values")).drop("size", "indices", "values")


def orthonormal(x: np.ndarray, tile: int = 8192) -> np.ndarray:
    """An orthonormal basis of a tall matrix's columns: QR of each tile of rows, then of the stacked triangles."""
    tiles = [np.linalg.qr(x[at : at + tile]) for at in range(0, len(x), tile)]
    top = np.linalg.qr(np.concatenate([r for _, r in tiles]))[0]
    ends = np.cumsum([len(r) for _, r in tiles])[:-1]
    return np.concatenate([q @ t for (q, _), t in zip(tiles, np.split(top, ends))])


def _gram_product(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """rows^T (rows block), in one pass; ``rows`` has indices (terms) and weights."""
    sent = rows.sparkSession.sparkContext.broadcast(block)  # its size is set by the vocabulary's and k
    n, width = block.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, total = sent.value, None
        for whole in batches:
            ends = whole.column(0).offsets.to_numpy()
            at = 0
            while at < whole.num_rows:  # a few products at a time
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + max(1, HELD // width), side="right")) - 1)
                part = whole.slice(at, to - at)
                at = to
                lengths = _lengths(part.column(0))
                i, w = part.column(0).flatten().to_numpy(zero_copy_only=False), part.column(1).flatten().to_numpy(zero_copy_only=False)
                if not len(i):
                    continue
                there = np.flatnonzero(lengths)
                starts = np.r_[0, np.cumsum(lengths[there])[:-1]]
                own = np.add.reduceat(w[:, None] * x[i], starts, axis=0)
                order = np.argsort(i, kind="stable")
                back = np.repeat(own, lengths[there], axis=0)[order] * w[order, None]
                firsts = np.flatnonzero(np.r_[True, np.diff(i[order]) > 0])
                total = np.zeros((n, width)) if total is None else total
                total[i[order][firsts]] += np.add.reduceat(back, firsts, axis=0)
        if total is not None:
            for r in range(0, n, RANGE):
                yield pa.RecordBatch.from_arrays([pa.array([r // RANGE], pa.int32()), pa.array([total[r : r + RANGE].tobytes()], pa.binary())], ["range", "sums"])

    out = np.zeros((n, width))
    for r in _added(rows.select("terms", "weights").mapInArrow(run, "range int, sums binary")):
        own = np.frombuffer(r["sums"]).reshape(-1, width)
        out[r["range"] * RANGE : r["range"] * RANGE + len(own)] = own
    return out


def truncated_svd(rows: DataFrame, n_terms: int, k: int, extra: int = 20, passes: int = 3, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors (terms x k) of ``packed`` rows by index; each vector's largest entry is positive."""
    width = min(k + extra, n_terms)
    basis = np.random.default_rng(seed).normal(size=(n_terms, width))
    for _ in range(passes):
        basis = orthonormal(_gram_product(rows, basis))
    values, turn = np.linalg.eigh(basis.T @ _gram_product(rows, basis))
    v = basis @ turn[:, ::-1][:, :k]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return np.sqrt(np.maximum(values[::-1][:k], 0)), v
