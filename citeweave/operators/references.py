"""References: explosion, validation against the id registry, re-nesting in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_references(papers: DataFrame) -> DataFrame:
    """(id, pos, ref_id) without null and blank references."""
    return papers.select("id", F.posexplode("references").alias("pos", "ref_id")).where(F.trim("ref_id") != "")


def id_registry(papers: DataFrame) -> DataFrame:
    """(id, year): one row for each id, the earliest year."""
    return papers.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("year").alias("year"))


def valid_references(papers: DataFrame, exploded: DataFrame, registry: DataFrame) -> DataFrame:
    """Exploded references whose registry year isn't after the paper's; all are kept where the paper has no year."""
    years = registry.select(F.col("id").alias("ref_id"), F.col("year").alias("ref_year"))
    # first the papers' years by id, then the registry by reference: two equi-joins, hubs split by the planner
    own = exploded.join(papers.select("id", "year"), "id")
    found = own.join(years, "ref_id", "left")
    return found.where(F.col("year").isNull() | (F.col("ref_year") <= F.col("year"))).select("id", "pos", "ref_id")


def nest_references(papers: DataFrame, exploded: DataFrame) -> DataFrame:
    """Papers with ``references`` from exploded rows in their order; the empty list without any."""
    nested = exploded.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref_id"))), lambda s: s["ref_id"]).alias("references"))
    return papers.drop("references").join(nested, "id", "left").withColumn("references", F.coalesce("references", F.array().cast("array<string>")))


def validate(papers: DataFrame, registry: DataFrame) -> DataFrame:
    """Papers with only those references that their year allows."""
    return nest_references(papers, valid_references(papers, explode_references(papers), registry))


def reference_profile(papers: DataFrame, exploded: DataFrame, registry: DataFrame) -> DataFrame:
    """One row: papers, papers without references, references, those newer than their paper."""
    years = registry.select(F.col("id").alias("ref_id"), F.col("year").alias("ref_year"))
    newer = exploded.join(papers.select("id", "year"), "id").join(years, "ref_id", "left").agg(F.count(F.lit(1)).alias("n_references"), F.count_if((F.col("ref_year") != 0) & (F.col("ref_year") > F.col("year"))).alias("n_newer"), F.count_distinct("id").alias("with_references"))
    return papers.agg(F.count(F.lit(1)).alias("n_papers")).crossJoin(F.broadcast(newer)).select("n_papers", (F.col("n_papers") - F.col("with_references")).alias("n_missing"), "n_references", "n_newer")
