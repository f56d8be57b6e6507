"""Encoders that are fitted on the training rows: folding, one-hot, hashing, robust scaling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.functions import columns as C
from citeweave.operators.ordering import top_values
from citeweave.operators.profiling import quantiles


KNOWN_TOKENS = 200_000


def fold_top(rows: DataFrame, column: str, train: DataFrame | None = None, n: int = 5, other: str = "Other") -> DataFrame:
    """The n most frequent training values stay, all else, null too, becomes ``other``. Reads n values to the driver."""
    top = [r[column] for r in top_values(train if train is not None else rows, column, n).collect()]
    return rows.withColumn(column, F.when(F.col(column).isin(top), F.col(column)).otherwise(other))


def one_hot(rows: DataFrame, column: str, train: DataFrame | None = None, limit: int = 1000) -> DataFrame:
    """A 0/1 column for each training value, in order of the values; unknown and null are all 0. At most ``limit`` values."""
    values = [r[0] for r in (train if train is not None else rows).select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(limit + 1).collect()]
    if len(values) > limit:
        raise ValueError(f"{column} has more than {limit} values")
    hot = [F.when(F.col(column) == v, 1.0).otherwise(0.0).alias(f"{column}_{v}") for v in values]
    return rows.select(*(c for c in rows.columns if c != column), *hot)


def hash_tokens(rows: DataFrame, column: str, n: int = 16) -> DataFrame:
    """Signed counts of a token list in n buckets, by MD5: bucket from the first digits, sign from the next."""
    slots = F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda t: F.struct((F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % n).alias("b"), F.when(F.conv(F.substring(F.md5(t), 9, 1), 16, 10).cast("int") < 8, 1.0).otherwise(-1.0).alias("s")))

    def bucket(i: int):
        return F.aggregate(F.filter("_slots", lambda s: s["b"] == i), F.lit(0.0), lambda a, s: a + s["s"]).alias(f"{column}_hash_{i}")

    return rows.withColumn("_slots", slots).select(*rows.columns, *(bucket(i) for i in range(n)))


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """Signed MurmurHash3 (x86, 32 bits)."""
    h, mask = seed, 0xFFFFFFFF
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & mask
    mix = lambda k: (rot((k * 0xCC9E2D51) & mask, 15) * 0x1B873593) & mask
    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = (rot(h ^ mix(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & mask
    if tail := data[whole:]:
        h ^= mix(int.from_bytes(tail, "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = ((h ^ (h >> shift)) * factor) & mask
    return h - (1 << 32) if h >> 31 else h


def hash_tokens_murmur(rows: DataFrame, column: str, n: int = 16) -> DataFrame:
    """The same with MurmurHash3, seed 0: bucket |h| mod n, sign of h; an Arrow function, as the built-in hash differs."""
    schema = T.StructType([*rows.schema.fields, *(T.StructField(f"{column}_hash_{i}", T.DoubleType()) for i in range(n))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, float]] = {}
        for batch in batches:
            out = np.zeros((batch.num_rows, n))
            for row, tokens in enumerate(batch.column(batch.schema.get_field_index(column)).to_pylist()):
                for t in tokens or ():
                    if t not in known:
                        if len(known) >= KNOWN_TOKENS:
                            known.clear()
                        h = murmur3_32(t.encode())
                        known[t] = abs(h) % n, 1.0 if h >= 0 else -1.0
                    out[row, known[t][0]] += known[t][1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[:, i]) for i in range(n))], [*batch.schema.names, *(f"{column}_hash_{i}" for i in range(n))])

    return rows.mapInArrow(run, schema)


def robust_statistics(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Median and interquartile range (1 where it is 0) of each column; exact."""
    found = quantiles(train, columns, (0.25, 0.5, 0.75))
    return {c: (q[1], (q[2] - q[0]) or 1.0) if q else (0.0, 1.0) for c, q in found.items()}


def robust_scale(rows: DataFrame, statistics: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumns({c: (C.finite(F.col(c).cast("double")) - F.lit(m)) / F.lit(r) for c, (m, r) in statistics.items()})


def scaled_sample(train: DataFrame, rows: DataFrame, columns: Sequence[str], n: int, seed: object, key: str) -> DataFrame:
    """A keyed sample of ``rows``, scaled by the statistics of all of ``train``."""
    from citeweave.operators.sampling import bounded_sample

    return robust_scale(bounded_sample(rows, n, seed, key), robust_statistics(train, columns))
