"""Profiles of a table: what is missing, frequent, out of range. Each is one pass and returns a small table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_values(rows: DataFrame, placeholders: Sequence[str] = ()) -> DataFrame:
    """(column, n_null, pct_null, n_placeholder) of each column, all counted in one pass."""
    kinds = dict(rows.dtypes)
    counts = rows.agg(F.count(F.lit(1)).alias("_n"), *(F.struct(F.count_if(F.col(c).isNull()).alias("a"), (F.count_if(F.col(c).isin(*placeholders)) if placeholders and kinds[c] == "string" else F.lit(0)).cast("long").alias("b")).alias(c) for c in rows.columns))
    listed = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c)["a"].alias("n_null"), F.col(c)["b"].alias("n_placeholder")) for c in rows.columns))
    flat = counts.select("_n", F.explode(listed).alias("r")).select("_n", "r.*")
    return flat.select("column", "n_null", F.round(100 * F.col("n_null") / F.col("_n"), 6).alias("pct_null"), "n_placeholder")


def year_trends(rows: DataFrame, year: str = "year", few: int = 100) -> tuple[DataFrame, DataFrame]:
    """Counts by year, and one row of mean, median, least and greatest year and the number of years with few rows."""
    counts = rows.where(F.col(year).isNotNull()).groupBy(year).agg(F.count(F.lit(1)).alias("n"))
    stats = rows.agg(F.round(F.avg(year), 6).alias("mean_year"), F.percentile(year, F.lit(0.5)).alias("median_year"), F.min(year).cast("long").alias("min_year"), F.max(year).cast("long").alias("max_year"))
    return counts, stats.crossJoin(F.broadcast(counts.agg(F.count_if(F.col("n") < few).alias("n_few"), F.count(F.lit(1)).alias("n_years"))))


#: Parts that a pass of ``quantiles`` counts, over all columns.
CELLS = 1 << 20


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as integers in the same order: NaN last, both zeros alike."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.int64)
    return np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF))


def _double(key: int) -> float:
    return float(np.array(key if key >= 0 else key ^ 0x7FFFFFFFFFFFFFFF, np.int64).view(np.float64))


def _parts(rows: DataFrame, columns: Sequence[str], cuts: list[np.ndarray]) -> list[np.ndarray]:
    """For each column (parts x 3): how many values lie in each part between its ``cuts``, the least and the greatest one."""
    sent = rows.sparkSession.sparkContext.broadcast(cuts)
    top, bottom = np.iinfo(np.int64).max, np.iinfo(np.int64).min

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([np.zeros(len(c) + 1, np.int64), np.full(len(c) + 1, top), np.full(len(c) + 1, bottom)]) for c in sent.value]
        for b in batches:
            for column, cut, total in zip(b.columns, sent.value, held):
                x = np.sort(_ordered(column.drop_null().to_numpy(zero_copy_only=False)))
                ends = np.r_[0, np.searchsorted(x, cut, side="left"), len(x)]
                there = np.flatnonzero(np.diff(ends))
                total[0] += np.diff(ends)
                total[1, there] = np.minimum(total[1, there], x[ends[there]])
                total[2, there] = np.maximum(total[2, there], x[ends[there + 1] - 1])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(held)), pa.int32()), pa.array([t.tobytes() for t in held], pa.binary())], ["i", "parts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = np.frombuffer(raw, np.int64).reshape(3, -1)
                held[i] = np.stack([held[i][0] + own[0], np.minimum(held[i][1], own[1]), np.maximum(held[i][2], own[2])]) if i in held else own
        for i, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["i", "parts"])

    plain = rows.select(*(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)))
    found = plain.mapInArrow(counted, "i int, parts binary").repartition("i").mapInArrow(added, "i int, parts binary").collect()
    sent.unpersist()
    return [np.frombuffer(r["parts"], np.int64).reshape(3, -1).T for r in sorted(found, key=lambda r: r["i"])]


def quantiles(rows: DataFrame, columns: Sequence[str], shares: Sequence[float], at_once: int = 100_000, bins: int = 4096) -> dict[str, list[float] | None]:
    """Exact quantiles of each column, linear between neighbours, nulls aside; None for a column without values.

    Up to ``at_once`` rows are gathered at once. Beyond that all columns and shares are sought together: a pass counts
    the values of up to ``bins`` parts of each range that is still open (CELLS at most over all columns), the parts in
    which ranks lie are divided by the next one, until each holds one value. The parts are of the doubles' bits, so
    there are a few passes whatever the values; what reaches the driver are the counts of a pass.
    """
    counts = rows.agg(*(F.count(c).alias(c) for c in columns)).first()
    out: dict[str, list[float] | None] = dict.fromkeys(columns)
    if small := [c for c in columns if 0 < counts[c] <= at_once]:
        found = rows.agg(*(F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in small)).first()
        out |= {c: list(found[c]) for c in small}
    large = [c for c in columns if counts[c] > at_once]
    wanted = {c: sorted({min(int(s * (counts[c] - 1)) + d, counts[c] - 1) for s in shares for d in (0, 1)}) for c in large}
    known: dict[str, dict[int, float]] = {c: {} for c in large}
    cuts = {c: np.zeros(0, np.int64) for c in large}
    while left := [c for c in large if len(known[c]) < len(wanted[c])]:
        ranges: dict[str, set[tuple[int, int]]] = {}
        for c, own in zip(left, _parts(rows, left, [cuts[c] for c in left])):
            ranks = [r for r in wanted[c] if r not in known[c]]
            ends = own[np.searchsorted(np.cumsum(own[:, 0]), ranks, side="right"), 1:].tolist()
            known[c] |= {r: _double(low) for r, (low, high) in zip(ranks, ends) if low == high}
            ranges[c] = {(low, high) for low, high in ends if low < high}
        n = max(2, min(bins, CELLS // max(1, sum(map(len, ranges.values())))))
        for c, own in ranges.items():
            cuts[c] = np.unique(np.array([x for low, high in own for x in (*(low + (high - low) * i // n for i in range(n + 1)), high + 1)], np.int64))
    for c in large:
        places = [s * (counts[c] - 1) for s in shares]
        ends = [(known[c][int(p)], known[c][min(int(p) + 1, counts[c] - 1)], p - int(p)) for p in places]
        out[c] = [a if a == b or not part else a + part * (b - a) for a, b, part in ends]
    return out


def describe_numeric(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, least, exact quartiles and greatest of each column."""
    found = quantiles(rows, columns, (0.25, 0.5, 0.75))

    def stats(c: str):
        q = [F.lit(v).cast("double") for v in found[c] or (None, None, None)]
        return F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("std"), F.min(c).cast("double").alias("low"), F.round(q[0], 6).alias("q1"), F.round(q[1], 6).alias("q2"), F.round(q[2], 6).alias("q3"), F.max(c).cast("double").alias("high"))

    return rows.agg(F.array(*(stats(c) for c in columns)).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def describe_strings(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, distinct values, most frequent value (ties by value) and its count of each column."""
    out = None
    for c in columns:
        counts = rows.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        one = counts.agg(F.lit(c).alias("column"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_unique"), F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("top"), F.max("n").alias("freq"))
        out = one if out is None else out.unionByName(one)
    return out


def authors_profile(papers: DataFrame) -> DataFrame:
    bad = F.exists("authors", lambda a: a["id"].isNull() & a["name"].isNull())
    base = papers.agg(F.count_if(F.col("authors").isNull()).alias("n_null"), F.count_if(F.size("authors") == 0).alias("n_empty"), F.count_if(bad).alias("n_invalid"))
    names = papers.select(F.explode("authors.name").alias("name")).agg(F.count_distinct("name").alias("n_names"))
    return base.crossJoin(F.broadcast(names))


def keywords_profile(papers: DataFrame) -> DataFrame:
    size = F.when(F.size("keywords") > 0, F.size("keywords"))
    base = papers.agg(F.count_if(F.col("keywords").isNull()).alias("n_null"), F.count_if(F.size("keywords") == 0).alias("n_empty"), F.round(F.avg(size), 6).alias("avg_keywords"), F.max(size).cast("long").alias("max_keywords"))
    return base.crossJoin(F.broadcast(keyword_words(papers).agg(F.count_distinct("keyword").alias("n_keywords"))))


def keyword_words(papers: DataFrame) -> DataFrame:
    return papers.select(F.explode("keywords").alias("k")).select(F.lower(F.trim("k")).alias("keyword")).where("keyword <> ''")


def field_profile(papers: DataFrame, column: str) -> DataFrame:
    """Nulls and distinct values of a column; one row."""
    return papers.agg(F.count_if(F.col(column).isNull()).alias("n_null"), F.count_distinct(column).alias("n_unique"))


def year_profile(papers: DataFrame, max_year: int) -> DataFrame:
    y = F.col("year")
    return papers.agg(F.count_if(y.isNull()).alias("n_null"), F.count_distinct(y).alias("n_unique"), F.count_if((y <= 1800) | (y > max_year)).alias("n_invalid"))


def split_summary(raw: DataFrame, final: DataFrame, split: str = "split") -> DataFrame:
    """(split, n_raw, n_final, ratio) of each split and of all together."""
    counts = raw.groupBy(split).agg(F.count(F.lit(1)).alias("n_raw")).join(final.groupBy(split).agg(F.count(F.lit(1)).alias("n_final")), split, "left").na.fill(0, ["n_final"])
    both = counts.unionByName(counts.agg(F.lit("total").alias(split), F.sum("n_raw").alias("n_raw"), F.sum("n_final").alias("n_final")))
    return both.select(split, "n_raw", "n_final", F.when(F.col("n_raw") > 0, F.round(F.col("n_final") / F.col("n_raw"), 3)).otherwise(0.0).alias("ratio"))
