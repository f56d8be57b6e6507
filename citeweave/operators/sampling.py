"""Samples and splits. A keyed hash takes the place of a seeded generator, so results don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions import columns as C
from citeweave.operators.ordering import last_within, running_share
from citeweave.session import written


def hash_order(seed: object, *keys: str):
    return [C.keyed(seed, *(F.col(k) for k in keys)), *(F.col(k) for k in keys)]


def bounded_sample(rows: DataFrame, n: int | None, seed: object, *keys: str) -> DataFrame:
    """n rows by keyed hash (all if there are fewer): each task keeps its best n, so nothing is sorted as a whole."""
    return rows if n is None else rows.orderBy(*hash_order(seed, *keys)).limit(n)


def shuffled(rows: DataFrame, seed: object, *keys: str) -> DataFrame:
    return rows.withColumn("position", C.keyed(seed, *(F.col(k) for k in keys)))


def mark_first(rows: DataFrame, by: str, quotas: DataFrame, seed: object, *keys: str) -> DataFrame:
    """Adds ``_first``: whether a row is among the first ``quota`` of its stratum in hash order; exact.

    ``quotas`` has a row (by, quota) for each stratum. Strata may be few and huge, so none is put in order as a whole:
    counts by the hash's first 16 bits show in which of 65,536 bins a stratum's last row lies; only that bin is ordered.
    """
    tagged = rows.withColumn("_h", C.keyed(seed, *(F.col(k) for k in keys))).withColumn("_bin", F.substring("_h", 1, 4))
    counts = tagged.groupBy(by, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.withColumn("_before", F.coalesce(F.sum("_n").over(run), F.lit(0))).join(quotas.select(by, F.col("quota").alias("_quota")), by)
    last = sums.where(F.col("_before") < F.col("_quota")).groupBy(by).agg(F.max(F.struct("_bin", "_before")).alias("_last"), F.first("_quota").alias("_quota"))
    last = written(last.select(by, F.col("_last._bin").alias("_cut"), (F.col("_quota") - F.col("_last._before")).alias("_rest")), "cuts")
    marked = tagged.join(last, by, "left")
    away = marked.where(F.col("_cut").isNull() | (F.col("_bin") != F.col("_cut"))).withColumn("_first", F.coalesce(F.col("_bin") < F.col("_cut"), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("_h", *keys))
    inside = marked.where(F.col("_bin") == F.col("_cut")).withColumn("_rank", rank).withColumn("_first", F.col("_rank") <= F.col("_rest")).drop("_rank")
    return away.unionByName(inside).drop("_h", "_bin", "_cut", "_rest")


def stratified(rows: DataFrame, by: str, quotas: DataFrame, seed: object, *keys: str) -> DataFrame:
    """min(quota, available) rows of each stratum."""
    return mark_first(rows, by, quotas, seed, *keys).where("_first").drop("_first")


def papers_per_year(weights: DataFrame, target: int) -> DataFrame:
    """(year, quota): weight's share of the target, rounded half to even; the last year takes what rounding leaves."""
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy())
    rounded = weights.select("year", F.bround(share * target).cast("long").alias("q"))
    last = F.col("year") == F.max("year").over(Window.partitionBy())
    rest = F.lit(target) - F.sum("q").over(Window.partitionBy())
    return rounded.select("year", F.when(last, F.col("q") + rest).otherwise(F.col("q")).cast("long").alias("quota"))


def chronological_years(counts: DataFrame, train: float = 0.8, validation: float = 0.9, min_years: int = 3, fallback: int = 10) -> dict[str, list[int]]:
    """Years of each split by running share; where a split is under ``min_years`` the last years are dealt instead. Reads a row for each year."""
    cumulative = running_share(counts, "year")
    ends = [last_within(cumulative, "year", p).first()[0] for p in (train, validation)]
    years = sorted(r["year"] for r in counts.select("year").collect())
    cut = lambda lo, hi: [y for y in years if (lo is None or y > lo) and (hi is None or y <= hi)]
    parts = {"train": cut(None, ends[0]) if ends[0] is not None else [], "validation": cut(ends[0], ends[1]) if ends[1] is not None else [], "test": cut(ends[1], None)}
    if all(enough_years(v, min_years) for v in parts.values()):
        return parts
    return {"train": years[: -2 * fallback], "validation": years[-2 * fallback : -fallback], "test": years[-fallback:]}


def enough_years(years: list[int], least: int = 3) -> bool:
    return len(years) >= least


def split_by_year(rows: DataFrame, years: dict[str, list[int]]) -> DataFrame:
    out = None
    for name, own in years.items():
        hit = F.col("year").isin(own)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return rows.withColumn("split", out)


def balance(rows: DataFrame, target: str, method: str, seed: object, key: str) -> DataFrame:
    """Every class to the size of the smallest (under) or largest (over); copies follow the hash order, all rows first."""
    if target not in rows.columns:
        raise KeyError(target)
    if method not in ("under", "over"):
        raise ValueError(f"unknown method {method}")
    counts = rows.groupBy(target).agg(F.count(F.lit(1)).alias("_have"))
    goal = counts.agg((F.min if method == "under" else F.max)("_have").alias("_want"))
    return _resized(rows, counts.crossJoin(F.broadcast(goal)), target, seed, key)


def imbalance(rows: DataFrame, target: str, sizes: dict, seed: object, key: str, allow_oversampling: bool = False) -> DataFrame:
    """Named sizes for classes; without oversampling a class gives what it has."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(k, int(v)) for k, v in sizes.items()], f"{target} {dict(rows.dtypes)[target]}, _want long")
    counts = rows.groupBy(target).agg(F.count(F.lit(1)).alias("_have")).join(wanted, target)
    if not allow_oversampling:
        counts = counts.withColumn("_want", F.least("_want", "_have"))
    return _resized(rows, counts, target, seed, key)


def _resized(rows: DataFrame, sizes: DataFrame, target: str, seed: object, key: str) -> DataFrame:
    sizes = written(sizes, "class-sizes")
    # each row as often as its class fits whole, the first rows in hash order once more
    marked = mark_first(rows, target, sizes.select(target, F.expr("_want % _have").alias("quota")), seed, key)
    out = marked.join(sizes, target).withColumn("_n", F.expr("int(_want div _have)") + F.col("_first").cast("int")).where("_n > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n", "_first", "_want", "_have")


def random_split(rows: DataFrame, seed: object, key: str, train_of_ten: int = 8) -> DataFrame:
    return rows.withColumn("split", F.when(C.keyed_number(10, seed, F.col(key)) < train_of_ten, "train").otherwise("test"))


def stratified_split(rows: DataFrame, target: str, seed: object, key: str, train_share: float = 0.8) -> DataFrame:
    """The same share of each class in train, in hash order; what doesn't make a whole row is test."""
    quotas = rows.groupBy(target).agg(F.floor(F.lit(train_share) * F.count(F.lit(1))).cast("long").alias("quota"))
    return mark_first(rows, target, quotas, seed, key).withColumn("split", F.when(F.col("_first"), "train").otherwise("test")).drop("_first")


def one_of_each_and_more(rows: DataFrame, target: str, n: int, seed: object, key: str) -> DataFrame:
    """A sample with one row of each class at least: those first, the rest in hash order."""
    order = F.struct(*hash_order(seed, key))
    firsts = rows.groupBy(target).agg(F.min(order).alias("_least"))
    marked = rows.join(firsts, rows[target].eqNullSafe(firsts[target]), "left").drop(firsts[target])
    return marked.orderBy(F.when(order == F.col("_least"), 0).otherwise(1), *hash_order(seed, key)).limit(n).drop("_least")


def tuning_rows(train: DataFrame, validation: DataFrame, seed: object, key: str, n: int = 50_000) -> DataFrame:
    """At most ``n`` rows to search parameters on: up to 80 % of train (fold -1) and 20 % of validation (fold 0)."""
    wanted = ((train, n * 8 // 10, -1), (validation, n * 2 // 10, 0))
    fitted, held = (bounded_sample(rows, size, seed, key).withColumn("fold", F.lit(fold)) for rows, size, fold in wanted)
    return fitted.unionByName(held)
