"""Author records, the author registry, gap filling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.functions import columns as C


def author_records(papers: DataFrame) -> DataFrame:
    """One row for each author of each paper: key (id, or else name), is_id, name, org, year, keywords, lang."""
    a = F.col("author")
    key = F.coalesce(F.nullif(a["id"], F.lit("")), a["name"])
    return (
        papers.select("year", "keywords", "lang", F.explode("authors").alias("author"))
        .select(key.alias("id_or_name"), (F.coalesce(a["id"], F.lit("")) != "").alias("is_id"), a["name"].alias("name"), a["org"].alias("org"), F.col("year").cast("int").alias("year"), "keywords", "lang")
        .where(F.col("id_or_name").isNotNull())
    )


def author_registry(records: DataFrame) -> DataFrame:
    """Records merged by key: names as a multiset, pairs of organisation and year, keywords and languages as sets.

    Very frequent names are counted before they are gathered, so a list holds distinct values and their numbers.
    """
    names = records.where(F.col("name").isNotNull()).groupBy("id_or_name", "name").agg(F.count(F.lit(1)).alias("n"))
    names = names.groupBy("id_or_name").agg(F.sort_array(F.collect_list(F.struct("name", "n"))).alias("names"))
    rest = records.groupBy("id_or_name").agg(
        F.bool_or("is_id").alias("is_id"),
        F.sort_array(F.collect_set(F.when(F.col("org").isNotNull() | F.col("year").isNotNull(), F.struct("org", "year")))).alias("org_year"),
        F.sort_array(F.collect_set("lang")).alias("lang"),
    )
    keywords = records.select("id_or_name", F.explode("keywords").alias("keyword")).groupBy("id_or_name").agg(F.sort_array(F.collect_set("keyword")).alias("keywords"))
    return rest.join(names, "id_or_name", "left").join(keywords, "id_or_name", "left")


def official_names(records: DataFrame) -> DataFrame:
    """(id_or_name, official_name): the most frequent valid name, ties by name."""
    counts = records.where(C.is_name(F.col("name"))).groupBy("id_or_name", "name").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("id_or_name").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("official_name"))


def assign_ids(registry: DataFrame) -> DataFrame:
    """Adds ``id``: the key where it is one, else that of the id row with the same official name (the largest), or null."""
    by_name = registry.where(F.col("is_id") & F.col("official_name").isNotNull()).groupBy("official_name").agg(F.max("id_or_name").alias("_id"))
    return registry.join(by_name, "official_name", "left").withColumn("id", F.when(F.col("is_id"), F.col("id_or_name")).otherwise(F.col("_id"))).drop("_id")


def refine(records: DataFrame) -> DataFrame:
    """Key, is_id, official name and id of each author."""
    keys = records.groupBy("id_or_name").agg(F.bool_or("is_id").alias("is_id"))
    return assign_ids(keys.join(official_names(records), "id_or_name", "left"))


def lookups(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four lookups of gap filling: name to official name, official name to id, id to official name, (id, year) to organisation.

    Where rows disagree the largest value wins.
    """
    refined = refine(records).where(F.col("official_name").isNotNull())
    named = records.where(F.col("name").isNotNull()).select("id_or_name", "name").distinct()
    name_official = named.join(refined.select("id_or_name", "official_name"), "id_or_name").groupBy("name").agg(F.max("official_name").alias("official_name"))
    official_id = refined.where(F.col("id").isNotNull()).groupBy("official_name").agg(F.max("id").alias("id"))
    id_official = refined.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("official_name").alias("official_name"))
    ids = refine(records).where(F.col("id").isNotNull()).select("id_or_name", "id")
    id_org = records.where(F.col("org").isNotNull() & F.col("year").isNotNull()).join(ids, "id_or_name").groupBy("id", "year").agg(F.max("org").alias("org"))
    return name_official, official_id, id_official, id_org


def fill_gaps(authorship: DataFrame, records: DataFrame) -> DataFrame:
    """Authorship rows (paper_id, pos, year, author_id, name, org) with gaps filled from the registry.

    In this order: an unknown name by its official form; a missing id by official name; a missing name by id; a missing
    organisation by the original id and the year.
    """
    name_official, official_id, id_official, id_org = lookups(records)
    # many names and ids are null: each goes to a key of its own, so that they don't meet in one task
    spread = lambda c: F.coalesce(c, F.concat(F.lit("\0"), F.xxhash64("paper_id", "pos").cast("string")))
    out = authorship.withColumn("_key", spread(F.col("name"))).join(name_official.select(F.col("name").alias("_key"), F.col("official_name").alias("_official")), "_key", "left")
    out = out.withColumn("new_name", F.coalesce("_official", "name")).withColumn("_key", spread(F.col("new_name")))
    out = out.join(official_id.select(F.col("official_name").alias("_key"), F.col("id").alias("_id")), "_key", "left").withColumn("new_id", F.coalesce("author_id", "_id"))
    out = out.withColumn("_key", spread(F.col("author_id"))).join(id_official.select(F.col("id").alias("_key"), F.col("official_name").alias("_by_id")), "_key", "left").withColumn("new_name", F.coalesce("new_name", "_by_id"))
    out = out.join(id_org.select(F.col("id").alias("_key"), "year", F.col("org").alias("_org")), ["_key", "year"], "left")
    return out.select("paper_id", "pos", "year", F.col("new_id").alias("author_id"), F.col("new_name").alias("name"), F.coalesce("org", "_org").alias("org"))


def nest_authors(authorship: DataFrame) -> DataFrame:
    """(paper_id, authors) with the authors in their order."""
    return authorship.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(F.col("author_id").alias("id"), "name", "org").alias("a")))), lambda s: s["a"]).alias("authors"))


