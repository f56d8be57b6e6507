"""Fixed-shape batches of a table for a trainer: shards with an index, a keyed order for each epoch, padded pairs of texts.

Shards are written once, ``shard_rows`` rows each in order of the key, and an index has a row for each. An epoch takes the
shards in a keyed order and the rows of each shard in another; batch b has the rows at b * batch ... in that order. So
every row comes once an epoch, a rerun gives the same batches, another epoch other ones, and no table is ever put in
order as a whole: a row's place is its place in its shard plus the rows of the shards before. The last batch may be short; it
is filled with zeros and says how many of its rows are real.

Keys must be unique and not null. Lists are cut or filled with zeros to their stated length; null lists are empty.
An empty table has no shards and no batches. A trainer holds the index and a batch; Spark holds the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.functions import columns as C
from citeweave.operators.ordering import dense_index


def fixed(values: F.Column, length: int, kind: str) -> F.Column:
    """A list of exactly ``length`` values: cut, or filled with zeros."""
    zeros = F.array_repeat(F.lit(0).cast(kind), length)
    whole = F.coalesce(F.transform(values, lambda v: F.coalesce(v.cast(kind), F.lit(0).cast(kind))), F.array().cast(f"array<{kind}>"))
    return F.slice(F.concat(whole, zeros), 1, length)


def write_shards(rows: DataFrame, path: str, key: str, shapes: dict[str, tuple[int, str]], shard_rows: int = 65_536) -> DataFrame:
    """Write key and the columns of ``shapes`` (column: (length, type); length 0 for a number) as shards; the index (shard, rows)."""
    index, total = dense_index(rows, key)
    cells = [fixed(F.col(c), n, kind).alias(c) if n else F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind)).alias(c) for c, (n, kind) in shapes.items()]
    placed = rows.select(key, *cells).join(index, key).withColumn("shard", F.floor(F.col("idx") / shard_rows).cast("int"))
    n_shards = max(1, -(-total // shard_rows))
    placed.drop("idx").repartition(n_shards, "shard").sortWithinPartitions("shard", key).write.partitionBy("shard").mode("overwrite").parquet(f"{path}/shards")
    spark = rows.sparkSession
    sizes = [(s, min(shard_rows, total - s * shard_rows)) for s in range(-(-total // shard_rows))]
    spark.createDataFrame(sizes, "shard int, rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def epoch(spark: SparkSession, path: str, key: str, number: int, batch: int, seed: object = 42) -> DataFrame:
    """(batch, place, key and columns) of one epoch: a row's batch and its place in it."""
    index = spark.read.parquet(f"{path}/index")
    if not index.limit(1).count():
        kinds = spark.createDataFrame([], "batch long, place int")
        return kinds
    turn = index.withColumn("_turn", C.keyed(f"{seed}|{number}|shard", F.col("shard")))
    # a row a shard, put in one order
    before = turn.select("shard", (F.sum("rows").over(Window.orderBy("_turn", "shard")) - F.col("rows")).alias("_before"))
    rows = spark.read.parquet(f"{path}/shards").withColumn("_turn", C.keyed(f"{seed}|{number}|row", F.col(key)))
    within = F.row_number().over(Window.partitionBy("shard").orderBy("_turn", key)) - 1
    at = rows.withColumn("_at", within).join(before, "shard").withColumn("_at", F.col("_at") + F.col("_before"))
    place = F.struct(F.floor(F.col("_at") / batch).alias("batch"), (F.col("_at") % batch).cast("int").alias("place")).alias("_p")
    return at.select(place, *(c for c in rows.columns if c not in ("shard", "_turn"))).select("_p.*", *(c for c in rows.columns if c not in ("shard", "_turn")))


def packed(epoch_rows: DataFrame, batch: int, shapes: dict[str, tuple[int, str]]) -> DataFrame:
    """(batch, real, columns): a row for each batch, its columns flat lists of batch x length numbers, zeros behind the real rows."""
    cells = F.struct("place", *shapes)
    one = epoch_rows.groupBy("batch").agg(F.count(F.lit(1)).cast("int").alias("real"), F.array_sort(F.collect_list(cells)).alias("_r"))  # ``batch`` rows

    def flat(c: str, n: int, kind: str):
        own = F.flatten(F.transform("_r", lambda r: r[c])) if n else F.transform("_r", lambda r: r[c])
        return fixed(own, batch * max(n, 1), kind).alias(c)

    return one.select("batch", "real", *(flat(c, n, kind) for c, (n, kind) in shapes.items()))


def tensors(rows: DataFrame, batch: int, shapes: dict[str, tuple[int, str]]) -> Iterator[dict]:
    """The ``packed`` batches in order as arrays of fixed shape, one at a time: {column: array, "real": rows, "batch": number}."""
    kinds = {"float": np.float32, "double": np.float64, "int": np.int32, "long": np.int64, "bigint": np.int64}
    for r in rows.orderBy("batch").toLocalIterator():
        yield {c: np.array(r[c], kinds[kind]).reshape((batch, n) if n else (batch,)) for c, (n, kind) in shapes.items()} | {"real": r["real"], "batch": r["batch"]}


def tokenized_pairs(rows: DataFrame, left: str, right: str, tokenizer: str, length: int = 128, start: int = 0, between: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``keep``, ``ids`` and ``mask``: both texts' tokens in ``length`` places, by a file of the tokenizers library.

    start, left tokens, between, right tokens, between; the longer side loses its last tokens until both fit. The file's
    path must be readable by the executors. Null texts are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        for b in batches:
            sides = [[e.ids for e in t.encode_batch([x or "" for x in b.column(i).to_pylist()], add_special_tokens=False)] for i in (0, 1)]
            ids, mask = np.zeros((b.num_rows, length), np.int32), np.zeros((b.num_rows, length), np.int32)
            for r, (a, c) in enumerate(zip(*sides)):
                room = length - 3
                n_right = min(len(c), max(room - len(a), room // 2))
                n_left = min(len(a), room - n_right)
                own = [start, *a[:n_left], between, *c[:n_right], between]
                ids[r, : len(own)], mask[r, : len(own)] = own, 1
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * length), pa.array(x.ravel())) for x in (ids, mask)]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], *lists], [*keep, "ids", "mask"])

    if length < 3:
        raise ValueError("three places at least")
    kinds = dict(rows.dtypes)
    read = rows.select(F.col(left).alias("_left"), F.col(right).alias("_right"), *keep)
    return read.mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in keep) + "ids array<int>, mask array<int>")
