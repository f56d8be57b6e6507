"""Helpers shared by the training-data operators: the shared folder, written intermediate tables, batching."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []

#: The white space of the contracts: a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); one of our own where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="citeweave-"))
    return _own_folder[0]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/citeweave/{label}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs that run inside hand ``rows`` rows at a time to Python, as texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it back.

    A lost executor can't lose it, the planner knows its real size, and nothing upstream runs twice.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with small_batches(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, by Spark's own file system layer."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Shipped:
    """A value for executors, sent once to each as bytes; ``value`` is unpacked once in each task."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        # broadcasts pickle classes by reference, which needs this package on executors
        self._sent, self._value = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = cloudpickle.loads(self._sent.value)
        return self._value


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``limit`` bytes at most (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = batch.column(batch.schema.get_field_index(column)).nbytes
        step = max(1, int(batch.num_rows * min(1.0, limit / max(size, 1))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def n_words(text) -> F.Column:
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
