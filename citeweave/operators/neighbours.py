"""Exact nearest neighbours of any number of queries among any number of rows.

Up to DIRECT queries (counted first) go to every task, and one pass over the rows keeps each query's best. More queries
are joined by pivots: rows are dealt to the cell of their nearest pivot (a keyed sample), and each cell tells its
least and greatest distance to the pivot and its k + 1 least ones. By the triangle inequality those bound a query's k-th
distance from above and its distance to every row of a cell from below, so a query is sent only to cells that may hold
one of its neighbours. Small cells beside each other share a tile, and tiles beside each other a block. Rows and queries
travel by block (BLOCK rows, or a part in PARTS of fewer), and inside a block a query meets only the tiles it must: where
the bounds prune nothing, each row still travels about PARTS times until PARTS blocks are full. Larger cells, and many
queries, are cut by counted sizes, so a cell that holds most rows is many tasks; a task holds one block of rows while its
queries stream past. Both ways give the same rows.

Cosines are searched as distances of unit vectors; a zero vector has cosine 0 to all. Scores are rounded to 9 digits, ties
go by key. Rows without key or vector don't take part. On the driver: DIRECT queries at most, or the pivots and their cells'
summaries (MAX_PIVOTS rows of k + 1 numbers at most).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.operators import sampling
from citeweave.session import written

DIRECT, MAX_PIVOTS, TILE = 20_000, 1024, 4096
#: Rows that a task holds at most, and into how many parts fewer rows are cut.
BLOCK, PARTS = 1 << 16, 12


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _scores(q: np.ndarray, x: np.ndarray, power: float) -> np.ndarray:
    """Queries x rows, the larger the nearer; term by term, so that no score depends on a batch."""
    return np.round(-(sum(np.abs(q[:, None, d] - x[None, :, d]) ** power for d in range(x.shape[1])) ** (1 / power)), 9)


def _pair_scores(q: np.ndarray, x: np.ndarray, rows: np.ndarray, cols: np.ndarray, power: float | None) -> np.ndarray:
    """The scores of some pairs, by the same sums."""
    if power is not None:
        apart = sum(np.abs(q[rows, d] - x[cols, d]) ** power if power != 2 else (q[rows, d] - x[cols, d]) ** 2 for d in range(x.shape[1]))
        return np.round(-(np.sqrt(apart) if power == 2 else apart ** (1 / power)), 9)
    dot = sum(q[rows, d] * x[cols, d] for d in range(x.shape[1]))
    size = np.linalg.norm(q, axis=1)[rows] * np.linalg.norm(x, axis=1)[cols]
    return np.round(np.divide(dot, size, out=np.zeros_like(dot), where=size > 0), 9)


def _rough(q: np.ndarray, x: np.ndarray, power: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in order of the scores, but for an error below a part of ``slack``: by a matrix product."""
    if power is None:
        q, x = _unit(q, None), _unit(x, None)
        return q @ x.T, np.full((len(q), 1), 1e-8)
    sizes = (q**2).sum(axis=1)[:, None], (x**2).sum(axis=1)[None, :]
    far = 2 * q @ x.T - sizes[0] - sizes[1]
    return far, 1e-7 * (1 + sizes[0] + sizes[1].max())


def _nearest(q_codes: np.ndarray, q: np.ndarray, codes: np.ndarray, x: np.ndarray, k: int, power: float | None, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) indices of the k best rows of each query; ``codes`` are in order of the keys, and equal for equal keys.

    Where a matrix product can tell, it picks the rows that may be among them; those alone are scored.
    """
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(q), 128):
        part = q[at : at + 128]
        s, slack = _rough(part, x, power) if power in (None, 2) else (_scores(part, x, power), 0.0)
        if exclude_self:
            s = np.where(q_codes[at : at + 128, None] == codes[None, :], -np.inf, s)
        least = np.partition(s, s.shape[1] - k, axis=1)[:, -k][:, None] - slack if s.shape[1] > k else np.full((len(s), 1), -np.inf)
        rows, cols = np.nonzero((s >= least) & (s > -np.inf))  # those that tie for the last place too
        score = _pair_scores(part, x, rows, cols, power) if power in (None, 2) else s[rows, cols]
        order = np.lexsort((codes[cols], -score, rows))
        rows, cols, score = rows[order], cols[order], score[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        rows, cols, score = rows[place < k], cols[place < k], score[place < k]
        out.append((rows + at, cols, score))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _codes(*keys: pa.Array) -> list[np.ndarray]:
    """Numbers of the keys of several arrays, in their common order."""
    every = pa.concat_arrays(keys)
    ranked = np.unique(np.array(every.to_pylist(), dtype=object), return_inverse=True)[1]
    return np.split(ranked, np.cumsum([len(k) for k in keys])[:-1])


def _found(q_keys: pa.Array, keys: pa.Array, kept: Sequence[pa.Array], keep: Sequence[str], picked: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    query, row, score = picked
    return pa.RecordBatch.from_arrays([q_keys.take(pa.array(query)), keys.take(pa.array(row)), pa.array(score), *(c.take(pa.array(row)) for c in kept)], ["query", "neighbour", "score", *keep])


def _cut(rows: pa.Table, k: int) -> pa.Table:
    """The k best of each query."""
    rows = rows.sort_by([("query", "ascending"), ("score", "descending"), ("neighbour", "ascending")]).combine_chunks()
    q = np.array(rows["query"].to_pylist(), dtype=object)
    first = np.r_[True, q[1:] != q[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return rows.filter(pa.array(np.arange(len(q)) - start < k))


def _schema(base: DataFrame, key: str, keep: Sequence[str]) -> T.StructType:
    kind = base.schema[key].dataType
    return T.StructType([T.StructField("query", kind), T.StructField("neighbour", kind), T.StructField("score", T.DoubleType()), *(base.schema[c] for c in keep)])


def _direct(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, power: float | None, exclude_self: bool, keep: Sequence[str]) -> DataFrame:
    """The best of each task for each query; the queries (DIRECT at most) go to every task."""
    asked = queries.select(key, vector).toArrow().combine_chunks()
    if not asked.num_rows:
        return base.sparkSession.createDataFrame([], _schema(base, key, keep))
    sent = base.sparkSession.sparkContext.broadcast((asked[0].chunk(0), _vectors(asked[1].chunk(0))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_keys, q = sent.value
        held: pa.Table | None = None
        for batch in batches:
            if batch.num_rows:
                q_codes, codes = _codes(q_keys, batch.column(0).cast(q_keys.type))
                rows = pa.Table.from_batches([_found(q_keys, batch.column(0).cast(q_keys.type), batch.columns[2:], keep, _nearest(q_codes, q, codes, _vectors(batch.column(1)), k, power, exclude_self))])
                held = rows if held is None else pa.concat_tables([held, rows])
                if held.num_rows > 4 * k * len(q):
                    held = _cut(held, k)
        if held is not None and held.num_rows:
            yield from _cut(held, k).to_batches()

    return base.select(key, vector, *keep).mapInArrow(run, _schema(base, key, keep))


def _unit(x: np.ndarray, power: float | None) -> np.ndarray:
    if power is not None:
        return x
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _distances(x: np.ndarray, pivots: np.ndarray, power: float | None) -> np.ndarray:
    """Rows x pivots, a few rows at a time."""
    if power in (None, 2):  # right to 1e-7 of the vectors' sizes, which the bounds allow for
        square = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T
        return np.sqrt(np.maximum(square, 0))
    out = np.zeros((len(x), len(pivots)))
    for at in range(0, len(x), 64):
        apart = np.abs(x[at : at + 64, None, :] - pivots[None, :, :])
        out[at : at + 64] = (apart**power).sum(axis=2) ** (1 / power)
    return out


def _by_pivots(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, power: float | None, exclude_self: bool, keep: Sequence[str], tile: int = TILE, max_pivots: int = MAX_PIVOTS, block: int | None = None) -> DataFrame:
    spark = base.sparkSession
    schema = _schema(base, key, keep)
    n = base.count()
    if n == 0:
        return spark.createDataFrame([], schema)
    block = block or max(tile, min(BLOCK, -(-n // PARTS)))
    # a zero vector has no direction: its cell, the last one, is at cosine 0 of all
    wanted = max(1, min(max_pivots, math.isqrt(n) // 2))
    sample = sampling.bounded_sample(base.select(key, vector), wanted, 42, key).toArrow().combine_chunks()
    pivots = np.unique(_unit(_vectors(sample[1].chunk(0)), power), axis=0)
    if power is None:
        pivots = pivots[np.abs(pivots).sum(axis=1) > 0]
    zero_cell = len(pivots)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unit(_vectors(b.column(1)), power)
            apart = _distances(x, pivots, power) if len(pivots) else np.full((len(x), 1), np.inf)
            cell, near = apart.argmin(axis=1), apart.min(axis=1)
            if power is None:
                zero = np.abs(x).sum(axis=1) == 0
                cell, near = np.where(zero | (zero_cell == 0), zero_cell, cell), np.where(zero, 0.0, np.where(np.isfinite(near), near, 0.0))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(near), *b.columns], ["_cell", "_near", "_key", "_vector", *(f"_k{i}" for i in range(len(keep)))])

    read = base.select(F.col(key).alias("_key"), F.col(vector).alias("_vector"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)))
    cells = written(read.mapInArrow(dealt, T.StructType([T.StructField("_cell", T.IntegerType()), T.StructField("_near", T.DoubleType()), *read.schema.fields])), "cells")
    least = cells.select("_cell", "_near", F.row_number().over(Window.partitionBy("_cell").orderBy("_near")).alias("_r")).where(F.col("_r") <= k + 1)
    least = least.groupBy("_cell").agg(F.sort_array(F.collect_list("_near")).alias("least"))  # k + 1 numbers
    about = cells.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.min("_near").alias("low"), F.max("_near").alias("high")).join(least, "_cell").collect()  # a row a cell
    number, low, high = np.zeros(zero_cell + 1, np.int64), np.zeros(zero_cell + 1), np.zeros(zero_cell + 1)
    nearest = np.full((zero_cell + 1, k + 1), np.inf)
    for r in about:
        c = r["_cell"]
        number[c], low[c], high[c] = r["n"], r["low"], r["high"]
        nearest[c, : len(r["least"])] = r["least"]
    between = _distances(pivots, pivots, 2) if power in (None, 2) and len(pivots) else None
    # small cells go together, neighbours first, so that a query isn't sent to each of them
    along = np.r_[np.argsort((pivots - pivots.mean(axis=0)) @ np.linalg.svd(pivots - pivots.mean(axis=0), full_matrices=False)[2][0], kind="stable"), zero_cell] if len(pivots) > 1 else np.arange(zero_cell + 1)
    group, held = np.zeros(zero_cell + 1, np.int64), 0
    for before, c in zip(along, along[1:]):
        held += number[before]
        new = held + number[c] > tile
        group[c], held = group[before] + new, 0 if new else held
    n_groups = int(group.max()) + 1
    member = np.zeros((zero_cell + 1, n_groups), bool)
    member[np.arange(zero_cell + 1), group] = True
    in_group = np.bincount(group, weights=number, minlength=n_groups).astype(np.int64)
    blocks, held = np.zeros(n_groups, np.int64), 0
    for g in range(1, n_groups):
        held += in_group[g - 1]
        new = held + in_group[g] > block
        blocks[g], held = blocks[g - 1] + new, 0 if new else held
    in_block = np.bincount(blocks, weights=in_group).astype(np.int64)

    def reach(x: np.ndarray) -> np.ndarray:
        """Rows x cells: whether a cell may hold one of a query's neighbours."""
        apart = np.zeros((len(x), zero_cell + 1))
        if len(pivots):
            apart[:, :zero_cell] = _distances(x, pivots, power)
        apart[:, zero_cell] = math.sqrt(2)
        bounds = (apart[:, :, None] + nearest[None]).reshape(len(x), -1)
        most = np.partition(bounds, k, axis=1)[:, k] if bounds.shape[1] > k else np.full(len(x), np.inf)
        under = np.maximum(np.maximum(apart - high, low - apart), 0)
        under[:, zero_cell] = math.sqrt(2) if power is None else 0
        if between is not None:  # rows of a cell are nearer to its pivot than to the query's own
            own = apart[:, :zero_cell].argmin(axis=1)
            gap = between[own]
            side = np.divide(apart[:, :zero_cell] ** 2 - apart[np.arange(len(x)), own][:, None] ** 2, 2 * gap, out=np.zeros_like(gap), where=gap > 0)
            under[:, :zero_cell] = np.maximum(under[:, :zero_cell], side)
        if power is not None and power < 1:  # no triangle inequality
            under[:] = 0
        # scores are compared with 9 digits; a cosine's digits are those of the squared distance
        if power is None:
            near = under**2 <= most[:, None] ** 2 + 1e-5
        else:
            sizes = 1 + np.linalg.norm(x, axis=1) + np.linalg.norm(pivots, axis=1).max() + high.max()
            near = under <= most[:, None] + 1e-6 * sizes[:, None]
        if power is None:
            near[np.abs(x).sum(axis=1) == 0] = True
        return near & (number > 0)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                groups = reach(_unit(_vectors(part.column(1)), power)) @ member
                to = pa.array([np.unique(blocks[g]).astype(np.int32) for g in groups], pa.list_(pa.int32()))
                bits = pa.array([b.tobytes() for b in np.packbits(groups, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([to, bits, part.column(0), part.column(1)], ["_blocks", "_reach", "_key", "_vector"])

    asked = queries.select(F.col(key).alias("_key"), F.col(vector).alias("_vector"))
    asked = written(asked.mapInArrow(sent, T.StructType([T.StructField("_blocks", T.ArrayType(T.IntegerType())), T.StructField("_reach", T.BinaryType()), *asked.schema.fields])), "sent-queries")
    counts = {r["_block"]: r["n"] for r in asked.select(F.explode("_blocks").alias("_block")).groupBy("_block").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a block
    if not counts:
        return spark.createDataFrame([], schema)
    sizes = spark.createDataFrame([(g, -(-int(in_block[g]) // block), -(-int(q) // block)) for g, q in counts.items()], "_block int, _tiles int, _slices int")
    places = spark.createDataFrame([(c, int(g), int(blocks[g])) for c, g in enumerate(group)], "_cell int, _group int, _block int")
    placed = F.xxhash64(F.monotonically_increasing_id())

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    rows = cells.drop("_near").withColumn("_at", placed).join(places, "_cell").join(sizes, "_block").withColumn("_tile", F.pmod("_at", F.col("_tiles")).cast("int")).withColumn("_slice", every("_slices"))
    asks = asked.withColumn("_at", placed).withColumn("_block", F.explode("_blocks")).join(sizes, "_block").withColumn("_slice", F.pmod("_at", F.col("_slices")).cast("int")).withColumn("_tile", every("_tiles"))
    place, columns = ["_block", "_tile", "_slice"], ["_key", "_vector", *(f"_k{i}" for i in range(len(keep)))]
    # a task's rows come before its queries, in order of their groups
    rows = rows.select(*place, F.lit(False).alias("_asks"), "_group", F.lit(None).cast("binary").alias("_reach"), *columns)
    asks = asks.select(*place, F.lit(True).alias("_asks"), F.lit(-1).alias("_group"), "_reach", "_key", "_vector")
    both = rows.unionByName(asks, allowMissingColumns=True)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for whole in batches:
            if whole.num_rows == 0:
                continue
            heads = np.stack([whole.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            starts = np.r_[0, np.flatnonzero((heads[1:] != heads[:-1]).any(axis=1)) + 1, len(heads)]
            for a, b in zip(starts[:-1], starts[1:]):
                part = whole.slice(a, b - a)
                if now != (own := tuple(heads[a, :3])):
                    now, held, ready = own, [], None
                if not heads[a, 3]:
                    held.append(part)
                    continue
                if ready is None:
                    table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    own_groups = table.column(4).to_numpy()
                    firsts = np.flatnonzero(np.r_[True, own_groups[1:] != own_groups[:-1]])
                    ready = table, _vectors(table.column(7)), list(zip(own_groups[firsts], firsts, np.r_[firsts[1:], len(own_groups)]))
                table, x, ranges = ready
                q_codes, codes = _codes(part.column(6), table.column(6))
                q = _vectors(part.column(7))
                reached = np.unpackbits(np.frombuffer(b"".join(part.column(5).to_pylist()), np.uint8).reshape(part.num_rows, -1), axis=1)
                picked = []
                for g, low_, high_ in ranges:
                    to = np.flatnonzero(reached[:, g])
                    if len(to):
                        query, row, score = _nearest(q_codes[to], q[to], codes[low_:high_], x[low_:high_], k, power, exclude_self)
                        picked.append((to[query], row + low_, score))
                if picked:
                    query, row, score = (np.concatenate(c) for c in zip(*picked))
                    order = np.lexsort((codes[row], -score, query))
                    query, row, score = query[order], row[order], score[order]
                    best = np.arange(len(query)) - np.searchsorted(query, query, side="left") < k
                    yield _found(part.column(6), table.column(6), table.columns[8:], keep, (query[best], row[best], score[best]))

    return both.repartition(*place).sortWithinPartitions(*place, "_asks", "_group").mapInArrow(compared, schema)


def _best(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, power: float | None, exclude_self: bool, keep: Sequence[str], direct: int) -> DataFrame:
    there = F.col(key).isNotNull() & F.col(vector).isNotNull()
    queries, base = queries.where(there), base.where(there)
    few = queries.limit(direct + 1).count() <= direct
    found = (_direct if few else _by_pivots)(queries, base, key, vector, k, power, exclude_self, keep)
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_by_cosine(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, exclude_self: bool = False, keep: Sequence[str] = (), direct: int = DIRECT) -> DataFrame:
    return _best(queries, base, key, vector, k, None, exclude_self, keep, direct).withColumnRenamed("score", "cosine")


def best_by_distance(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, exclude_self: bool = False, keep: Sequence[str] = (), power: float = 2.0, direct: int = DIRECT) -> DataFrame:
    """By Minkowski distance of ``power``: 2 Euclidean, 1 Manhattan."""
    return _best(queries, base, key, vector, k, power, exclude_self, keep, direct).withColumn("distance", -F.col("score")).drop("score")
