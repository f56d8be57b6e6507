"""Labelled article-reference pairs with negative samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.functions import columns as C
from citeweave.operators.ordering import dense_index
from citeweave.session import written

TRIES = 16


def suffixed(papers: DataFrame, side: str) -> DataFrame:
    """The paper table as one side of a pair: id as article_id or ref_id, other columns with the side's suffix."""
    key = "article_id" if side == "article" else "ref_id"
    return papers.select(F.col("id").alias(key), *(F.col(c).alias(f"{c}_{side}") for c in papers.columns if c not in ("id", "references")))


def positive_pairs(exploded: DataFrame, papers: DataFrame) -> DataFrame:
    """(article_id, pos, ref_id, both sides' columns, 1) of the references that are papers of the table."""
    keys = exploded.select(F.col("id").alias("article_id"), "pos", "ref_id")
    return keys.join(suffixed(papers, "ref"), "ref_id").join(suffixed(papers, "article"), "article_id").withColumn("is_reference_valid", F.lit(1))


def positive_keys(exploded: DataFrame, ids: DataFrame) -> DataFrame:
    """The pairs' keys alone: (article_id, pos, ref_id) of references that are among ``ids``."""
    return exploded.select(F.col("id").alias("article_id"), "pos", "ref_id").join(ids.select(F.col("id").alias("ref_id")).distinct(), "ref_id", "left_semi")


def negative_keys(positives: DataFrame, ids: DataFrame, seed: object = 42, include_self: bool = False) -> DataFrame:
    """One (article_id, pos, ref_id) for each positive, uniform over ids that the article doesn't cite (nor is).

    Candidates are drawn by keyed hash into the dense numbering of ids, TRIES at once; the first that isn't forbidden
    stands. Where all are forbidden the numbers after the last one follow: among one more than the forbidden there is one
    that is free, unless all ids are forbidden; then (as in a table of one paper) the last draw stands.
    """
    index, total = dense_index(ids, "id")
    index = written(index, "id-index")
    if total == 0:
        return positives.limit(0)
    forbidden = positives.select("article_id", "ref_id")
    if not include_self:
        forbidden = forbidden.union(positives.select("article_id", F.col("article_id").alias("ref_id")))
    forbidden = written(forbidden.distinct(), "forbidden")
    draws = positives.select("article_id", "pos", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TRIES - 1)), lambda j: C.keyed_number(total, seed, F.col("article_id"), F.col("pos"), j))).alias("j", "idx"))
    drawn = draws.join(index, "idx").select("article_id", "pos", "j", "idx", F.col("id").alias("ref_id"))
    free = drawn.join(forbidden, ["article_id", "ref_id"], "left_anti")
    first = written(free.groupBy("article_id", "pos").agg(F.min_by("ref_id", "j").alias("ref_id")), "negatives")
    left = positives.select("article_id", "pos").join(first, ["article_id", "pos"], "left_anti")
    last = C.keyed_number(total, seed, F.col("article_id"), F.col("pos"), F.lit(TRIES - 1))
    sizes = forbidden.groupBy("article_id").agg(F.count(F.lit(1)).alias("n"))
    steps = left.join(sizes, "article_id").select("article_id", "pos", F.posexplode(F.transform(F.sequence(F.lit(1), (F.col("n") + 1).cast("int")), lambda s: (last + s) % F.lit(total))).alias("j", "idx"))
    found = steps.join(index, "idx").withColumnRenamed("id", "ref_id")
    late = found.join(forbidden, ["article_id", "ref_id"], "left_anti").groupBy("article_id", "pos").agg(F.min_by("ref_id", "j").alias("ref_id"))
    none = left.join(late, ["article_id", "pos"], "left_anti").withColumn("idx", last).join(index, "idx").select("article_id", "pos", F.col("id").alias("ref_id"))
    return first.unionByName(late).unionByName(none)


def training_pairs(exploded: DataFrame, papers: DataFrame, seed: object = 42, strict: bool = True) -> DataFrame:
    """Positives and negatives with both sides' columns; strict: no nulls, and no reference newer than its article."""
    positives = written(positive_keys(exploded, papers), "positives")
    negatives = negative_keys(positives, papers.select("id"), seed)
    keys = positives.withColumn("is_reference_valid", F.lit(1)).unionByName(negatives.withColumn("is_reference_valid", F.lit(0)))
    pairs = keys.join(suffixed(papers, "ref"), "ref_id").join(suffixed(papers, "article"), "article_id")
    return pairs.na.drop().where(F.col("year_article") >= F.col("year_ref")) if strict else pairs


def pairs_by_split(exploded: DataFrame, papers: DataFrame, seeds: dict[str, int], strict: bool = True) -> DataFrame:
    """Pairs within each split of ``papers`` (column split), each with a seed of its own, in one table."""
    out = None
    for split, seed in seeds.items():
        own = papers.where(F.col("split") == split).drop("split")
        refs = exploded.join(own.select("id"), "id", "left_semi")
        part = training_pairs(refs, own, seed, strict).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out
