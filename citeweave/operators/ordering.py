"""Order, top-k, first rows, dense numbering, running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.session import written


def value_counts(rows: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))


def top_values(rows: DataFrame, column: str, k: int, ascending: bool = False) -> DataFrame:
    """The k most (or least) frequent values; ties by value."""
    counts = value_counts(rows.where(F.col(column).isNotNull()), column)
    return counts.orderBy(F.col("n").asc() if ascending else F.col("n").desc(), column).limit(k)


def first_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in a total order: an argmin, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    least = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return least.select(*keys, "_first.*").select(*rows.columns)


def union_all(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def dense_index(ids: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(key, idx): numbers 0.. in order of distinct keys, and how many there are.

    Keys are sorted by ranges once and written; each range is numbered by itself and moved by the sizes of those before,
    so nothing but a count for each range meets in one task.
    """
    ranged = ids.select(key).distinct().repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    numbered = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(key)))
    total = ranged.count()
    return numbered.join(before, "_part").select(key, (F.col("_before") + F.col("_row") - 1).cast("long").alias("idx")), total


def running_share(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Share and running share of counts in order of a small key (years)."""
    whole = Window.partitionBy()
    share = F.col(n) / F.sum(n).over(whole)
    return counts.select(key, n, share.alias("weight"), (F.sum(n).over(Window.orderBy(key)) / F.sum(n).over(whole)).alias("cumulative"))


def last_within(cumulative: DataFrame, key: str, share: float) -> DataFrame:
    """The last key whose running share is within ``share``."""
    return cumulative.where(F.col("cumulative") <= share).agg(F.max(key).alias(key))
