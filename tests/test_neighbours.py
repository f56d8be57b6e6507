"""Both ways of the neighbour join against a plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeweave.operators import neighbours


def plain(queries, base, k, power, exclude_self):
    out = []
    for key, q in queries:
        scored = []
        for other, x in base:
            if not (exclude_self and other == key):
                if power is None:
                    size = np.linalg.norm(q) * np.linalg.norm(x)
                    s = sum(a * b for a, b in zip(q, x)) / size if size else 0.0
                else:
                    s = -(sum(abs(a - b) ** power for a, b in zip(q, x)) ** (1 / power))
                scored.append((-round(s, 9) + 0.0, other))
        out += [(key, rank, other, round(abs(s), 6)) for rank, (s, other) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("power", [None, 2.0, 1.0, 3.0])
def test_pivots_and_direct_match_plain(spark, power):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 4)) * 6
    vectors = [np.round(centres[i % 5] + rng.normal(size=4), 2) for i in range(160)] + [np.round(centres[0], 2)] * 40 + [np.zeros(4)] * 4
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    base = spark.createDataFrame([*rows, (None, [0.0] * 4), (999, None)], "id int, v array<double>").withColumn("label", F.col("id") % 3).repartition(3)
    for k, exclude in ((3, True), (5, False)):
        want = plain(rows, rows, k, power, exclude)
        for direct, params in ((1000, {}), (0, {}), (0, {"tile": 16, "max_pivots": 4})):
            if params:
                there = base.where("id is not null and v is not null")
                found = neighbours._by_pivots(there, there, "id", "v", k, power, exclude, ["label"], **params)
                w = neighbours.Window.partitionBy("query").orderBy(F.col("score").desc(), "neighbour")
                got = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            else:
                got = neighbours._best(base, base, "id", "v", k, power, exclude, ["label"], direct)
            got = got.collect()
            assert sorted((r.query, r["rank"], r.neighbour, round(abs(r.score), 6)) for r in got) == want
            assert all(r.label == r.neighbour % 3 for r in got)


def test_queries_are_sent_to_few_cells(spark):
    """Far clusters: a query is compared with its own cluster, not with all rows."""
    rows = spark.range(4000).select(F.col("id"), F.array((F.col("id") % 20).cast("double") * 100, F.rand(1), F.rand(2)).alias("v")).cache()
    seen = []
    real = neighbours.written
    try:
        neighbours.written = lambda df, label: (seen.append((label, out := real(df, label))), out)[1]
        got = neighbours.best_by_distance(rows, rows, "id", "v", 2, exclude_self=True, direct=0)
        assert got.count() == 8000 and got.where("neighbour % 20 <> query % 20").count() == 0
    finally:
        neighbours.written = real
    assert dict(seen)["sent-queries"].count() < 4000 * 8  # of 31 cells


def test_strings_empty_and_small_tables(spark):
    rows = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "id string, v array<float>")
    for direct in (100, 0):
        near = neighbours.best_by_cosine(rows, rows, "id", "v", 2, exclude_self=True, direct=direct)
        assert sorted((r.query, r["rank"], r.neighbour, r.cosine) for r in near.collect()) == [("a", 1, "b", 1.0), ("a", 2, "c", 0.0), ("b", 1, "a", 1.0), ("b", 2, "c", 0.0), ("c", 1, "a", 0.0), ("c", 2, "b", 0.0)]
        for q, b in ((rows.limit(0), rows), (rows, rows.limit(0)), (rows.limit(0), rows.limit(0))):
            assert neighbours.best_by_cosine(q, b, "id", "v", 2, direct=direct).count() == 0


def test_a_query_is_written_once_and_travels_by_block(spark):
    """Without clusters a query must meet nearly all tiles; it is written once, and each block gets it once."""
    rows = spark.range(600).select(F.col("id"), F.array(*(F.rand(i) for i in range(8))).alias("v")).cache()
    seen, real = [], neighbours.written
    try:
        neighbours.written = lambda df, label: (seen.append((label, out := real(df, label))), out)[1]
        found = neighbours._by_pivots(rows, rows, "id", "v", 3, None, True, [], tile=16).collect()
    finally:
        neighbours.written = real
    asked = dict(seen)["sent-queries"]
    assert asked.count() == 600 and asked.agg(F.max(F.size("_blocks"))).first()[0] <= 24 and len(found) <= 600 * 3 * 24
