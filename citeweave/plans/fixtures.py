"""Bibliographic inputs derived from the driver's tables: as DataFrames here, as SQL for the checks beside them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_YEAR = 2026
#: Lines that one task joins, sorts and groups, about.
LINES = 500_000


class Inputs:
    """Base tables and derived ones of one data folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def papers(self) -> DataFrame:
        """Dirty papers: bad years, types, venues, pages, citation counts, missing and empty keywords."""
        d, i = self.table("documents"), F.col("doc_id")
        kind = F.when(i % 6 == 0, "Journal").when(i % 6 == 1, "Conference").when(i % 6 == 2, "conference").when(i % 6 == 3, "Book").when(i % 6 == 4, "-")
        venue = F.when(i % 5 == 0, F.concat(F.lit("International Conference on "), "source")).when(i % 5 == 1, F.concat(F.lit("JOURNAL of "), "source")).when(i % 5 == 2, F.col("source")).when(i % 5 == 3, "N/A")
        keywords = F.when(i % 4 == 1, F.array().cast("array<string>")).when(i % 4 != 0, F.array(F.concat(F.lit("Topic "), "source"), F.concat(F.lit(" "), "lang", F.lit(" ")), F.concat(F.lit("k"), (i % 7).cast("string"))))
        return d.select(
            F.concat(F.lit("d"), i.cast("string")).alias("id"), F.concat(F.lit("Paper "), i.cast("string"), F.lit(" of "), "source").alias("title"),
            F.when(i % 53 == 0, 0).otherwise(1960 + i % 70).cast("int").alias("year"), "lang", F.col("text").alias("abstract"), kind.alias("doc_type"), venue.alias("venue"), keywords.alias("keywords"),
            F.when(i % 9 == 0, "x").otherwise((F.col("n_chars") % 90).cast("string")).alias("page_start"), F.when(i % 11 != 0, (F.col("n_chars") % 90 + i % 13).cast("string")).alias("page_end"), (F.col("n_chars") % 500 - 5).cast("string").alias("n_citation"),
        )

    @cached_property
    def refs(self) -> DataFrame:
        """Exploded references (id, pos, ref_id), up to four for each paper, some to unknown papers."""
        d = self.table("documents").select("doc_id")
        total = d.agg((F.count(F.lit(1)) + 25).alias("n"))
        k = d.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("pos")).where(F.col("pos") <= F.col("doc_id") % 5)
        target = (F.col("doc_id") * 31 + F.col("pos") * 17) % F.col("n")
        return k.crossJoin(F.broadcast(total)).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "pos", F.concat(F.lit("d"), target.cast("string")).alias("ref_id"))

    @cached_property
    def papers_with_references(self) -> DataFrame:
        """Papers with nested references; a tenth of those without any have null instead of the empty list."""
        from citeweave.operators.references import nest_references

        nested = nest_references(self.papers, self.refs)
        number = F.substring("id", 2, 20).cast("long")
        return nested.withColumn("references", F.when((F.size("references") > 0) | (number % 10 != 0), F.col("references")))

    @cached_property
    def authorship(self) -> DataFrame:
        """(paper_id, pos, year, author_id, name, org) with missing ids, names and organisations and name variants."""
        o = self.table("orders").select("o_orderkey", F.year("o_orderdate").cast("int").alias("year"))
        s = self.table("supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("nation"))
        n = self.table("nation").select(F.col("n_nationkey").cast("long").alias("nation"), "n_name")
        lines = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
        # what groups by paper stays in the join's tasks, so that their number follows the lines and not the bytes shuffled
        parts = -(-lines.count() // LINES)
        if parts > self.spark.sparkContext.defaultParallelism:
            lines, o = lines.repartition(parts, "l_orderkey"), o.repartition(parts, "o_orderkey")
        joined = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, "nation")
        letters = F.translate(F.col("l_suppkey").cast("string"), "0123456789", "abcdefghij")
        lk, part = F.col("l_orderkey") + F.col("l_linenumber"), F.col("l_partkey") % 4
        name = F.when(lk % 11 != 0, F.concat(F.when(part == 0, "Dr. ").when(part == 1, "A ").otherwise("Author "), letters))
        return joined.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").cast("long").alias("pos"), "year", F.when(lk % 7 != 0, F.concat(F.lit("a"), F.col("l_suppkey").cast("string"))).alias("author_id"), name.alias("name"), F.when(F.col("l_partkey") % 5 != 0, F.col("n_name")).alias("org"), (F.col("l_partkey") % 3).alias("k"))

    @cached_property
    def author_papers(self) -> DataFrame:
        """Authorship nested by paper: year, lang, keywords, authors."""
        a = F.struct(F.col("author_id").alias("id"), "name", "org")
        return self.authorship.groupBy("paper_id").agg(F.max("year").alias("year"), F.collect_list(a).alias("authors"), F.sort_array(F.collect_set(F.concat(F.lit("k"), F.col("k").cast("string")))).alias("keywords")).withColumn("lang", F.when(F.col("paper_id") % 2 == 0, "en").otherwise("fr"))

    @cached_property
    def records(self) -> DataFrame:
        from citeweave.operators.registry import author_records

        return author_records(self.author_papers)

    @cached_property
    def edges(self) -> DataFrame:
        """An acyclic graph on part keys: consecutive parts of an order, from the larger to the smaller."""
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        pairs = self.table("lineitem").select(F.col("l_partkey").alias("p"), F.lag("l_partkey").over(w).alias("q"))
        return pairs.where("q is not null and p <> q").select(F.greatest("p", "q").alias("src"), F.least("p", "q").alias("dst")).distinct()

    @cached_property
    def parts(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("id"))

    @cached_property
    def order_years(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").cast("long").alias("year"))


#: The same in SQL.
SQL = {
    "fx_papers": """
SELECT 'd' || doc_id AS id, 'Paper ' || doc_id || ' of ' || source AS title,
       CAST(CASE WHEN doc_id % 53 = 0 THEN 0 ELSE 1960 + doc_id % 70 END AS INTEGER) AS year, lang, text AS abstract,
       CASE doc_id % 6 WHEN 0 THEN 'Journal' WHEN 1 THEN 'Conference' WHEN 2 THEN 'conference' WHEN 3 THEN 'Book' WHEN 4 THEN '-' END AS doc_type,
       CASE doc_id % 5 WHEN 0 THEN 'International Conference on ' || source WHEN 1 THEN 'JOURNAL of ' || source WHEN 2 THEN source WHEN 3 THEN 'N/A' END AS venue,
       CASE WHEN doc_id % 4 = 1 THEN CAST([] AS VARCHAR[]) WHEN doc_id % 4 <> 0 THEN ['Topic ' || source, ' ' || lang || ' ', 'k' || (doc_id % 7)] END AS keywords,
       CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE CAST(n_chars % 90 AS VARCHAR) END AS page_start,
       CASE WHEN doc_id % 11 <> 0 THEN CAST(n_chars % 90 + doc_id % 13 AS VARCHAR) END AS page_end, CAST(n_chars % 500 - 5 AS VARCHAR) AS n_citation
FROM documents""",
    "fx_refs": """
SELECT 'd' || doc_id AS id, CAST(k AS BIGINT) AS pos, 'd' || ((doc_id * 31 + k * 17) % (SELECT count(*) + 25 FROM documents)) AS ref_id
FROM documents, (VALUES (1), (2), (3), (4)) t(k) WHERE k <= doc_id % 5""",
    "fx_clean": """
SELECT id, title, CASE WHEN y > 1800 AND y <= 2026 THEN y END AS year, lang, abstract,
       CASE WHEN lower(doc_type) IN ('conference', 'journal') THEN lower(doc_type) END AS doc_type, CASE WHEN venue NOT IN ('None', 'nan', 'NaN', 'N/A', '', '-', '/', '?', 'null') THEN venue END AS venue,
       CASE WHEN len(keywords) > 0 THEN keywords END AS keywords, CASE WHEN p1 <= 0 THEN 0.0 ELSE p1 END AS page_start, CASE WHEN p2 <= 0 THEN 0.0 ELSE p2 END AS page_end, CASE WHEN c <= 0 THEN 0.0 ELSE c END AS n_citation
FROM (SELECT *, CASE WHEN year <= 0 THEN 0.0 ELSE CAST(year AS DOUBLE) END AS y, TRY_CAST(page_start AS DOUBLE) AS p1, TRY_CAST(page_end AS DOUBLE) AS p2, TRY_CAST(n_citation AS DOUBLE) AS c FROM fx_papers) x""",
    "fx_authors": """
SELECT l_orderkey AS paper_id, CAST(l_linenumber AS BIGINT) AS pos, CAST(year(o_orderdate) AS INTEGER) AS year,
       CASE WHEN (l_orderkey + l_linenumber) % 7 <> 0 THEN 'a' || l_suppkey END AS author_id,
       CASE WHEN (l_orderkey + l_linenumber) % 11 <> 0 THEN CASE l_partkey % 4 WHEN 0 THEN 'Dr. ' WHEN 1 THEN 'A ' ELSE 'Author ' END || translate(CAST(l_suppkey AS VARCHAR), '0123456789', 'abcdefghij') END AS name,
       CASE WHEN l_partkey % 5 <> 0 THEN n_name END AS org, l_partkey % 3 AS k, CASE WHEN l_orderkey % 2 = 0 THEN 'en' ELSE 'fr' END AS lang
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "fx_records": """
SELECT coalesce(nullif(author_id, ''), name) AS id_or_name, coalesce(author_id, '') <> '' AS is_id, name, org, CAST(max(year) OVER (PARTITION BY paper_id) AS INTEGER) AS year, paper_id, lang
FROM fx_authors WHERE coalesce(nullif(author_id, ''), name) IS NOT NULL""",
    "fx_official": """
SELECT id_or_name, name AS official_name FROM (SELECT id_or_name, name, row_number() OVER (PARTITION BY id_or_name ORDER BY count(*) DESC, name) AS r
FROM fx_records WHERE regexp_full_match(name, '[A-Za-z\\s]+') GROUP BY 1, 2) WHERE r = 1""",
    "fx_refined": """
SELECT k.id_or_name, k.is_id, o.official_name, CASE WHEN k.is_id THEN k.id_or_name ELSE m.id END AS id
FROM (SELECT id_or_name, bool_or(is_id) AS is_id FROM fx_records GROUP BY 1) k LEFT JOIN fx_official o USING (id_or_name)
LEFT JOIN (SELECT o.official_name, max(r.id_or_name) AS id FROM fx_records r JOIN fx_official o USING (id_or_name) WHERE r.is_id GROUP BY 1) m USING (official_name)""",
    "fx_edges": """
SELECT DISTINCT greatest(p, q) AS src, least(p, q) AS dst FROM (SELECT l_partkey AS p, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS q FROM lineitem) WHERE q IS NOT NULL AND p <> q""",
    "fx_years": "SELECT o_orderkey AS id, CAST(year(o_orderdate) AS BIGINT) AS year FROM orders",
    "fx_pairs": """
SELECT id AS article_id, pos, ref_id FROM fx_refs WHERE ref_id IN (SELECT id FROM fx_papers)""",
    "fx_terms": """
SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents""",
    "fx_words": "SELECT * FROM fx_terms WHERE term NOT IN ('english', 'the')",
}
_NEEDS = {"fx_clean": ["fx_papers"], "fx_records": ["fx_authors"], "fx_official": ["fx_records"], "fx_refined": ["fx_records", "fx_official"], "fx_pairs": ["fx_refs", "fx_papers"], "fx_words": ["fx_terms"]}


def with_fixtures(body: str) -> str:
    """The SQL with those derived tables that it names (and they need) before it."""
    import re

    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in SQL:
        if re.search(rf"\b{name}\b", body):
            add(name)
    if not order:
        return body
    ctes = ", ".join(f"{n} AS ({SQL[n].strip()})" for n in order)
    body = body.strip()
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") and not body.upper().startswith("WITH RECURSIVE") else f"WITH {ctes} {body}"
