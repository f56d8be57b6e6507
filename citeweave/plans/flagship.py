"""The flagship: from papers and references to labelled pairs with graph features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.operators import graph, pairs
from citeweave.plans.fixtures import Inputs
from citeweave.plans.registry import query
from citeweave.session import written

#: Negative pairs by keyed candidates; the first of 16 that is free.
NEGATIVES = """
ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT DISTINCT id FROM fx_papers)), n AS (SELECT count(*) AS n FROM ids),
forbidden AS (SELECT article_id, ref_id FROM fx_pairs UNION SELECT article_id, article_id FROM fx_pairs),
draws AS (SELECT article_id, pos, j, CAST('0x' || substr(md5('42|' || article_id || '|' || pos || '|' || j), 1, 8) AS BIGINT) % n AS idx FROM fx_pairs, n, range(16) t(j)),
free AS (SELECT d.article_id, d.pos, d.j, i.id AS ref_id FROM draws d JOIN ids i USING (idx) WHERE NOT EXISTS (SELECT 1 FROM forbidden f WHERE f.article_id = d.article_id AND f.ref_id = i.id)),
negatives AS (SELECT article_id, pos, arg_min(ref_id, j) AS ref_id FROM free GROUP BY 1, 2)"""

FLAGSHIP = f"""WITH {NEGATIVES.strip()},
years AS (SELECT id, year FROM fx_papers),
labelled AS (SELECT article_id, ref_id, 1 AS y FROM fx_pairs UNION ALL SELECT article_id, ref_id, 0 FROM negatives),
kept AS (SELECT p.article_id, p.ref_id, p.y FROM labelled p JOIN years a ON a.id = p.article_id JOIN years r ON r.id = p.ref_id WHERE a.year >= r.year),
edges AS (SELECT DISTINCT article_id AS s, ref_id AS d FROM kept WHERE y = 1)
SELECT article_id, ref_id, CAST(y AS INTEGER) AS is_reference_valid, CAST((SELECT count(*) FROM edges WHERE s = article_id) AS BIGINT) AS out_article, CAST((SELECT count(*) FROM edges WHERE d = ref_id) AS BIGINT) AS in_ref,
       round((SELECT count(*) FROM edges WHERE s = article_id) / ((SELECT count(*) FROM edges WHERE s = ref_id) + 1), 6) AS degree_ratio FROM kept"""


@query(FLAGSHIP)
def flagship_pair_degrees(t: Inputs) -> DataFrame:
    papers = t.papers.select("id", "year")
    rows = written(pairs.training_pairs(t.refs, papers, 42), "pairs").select("article_id", "ref_id", "is_reference_valid")
    vertices, edges = graph.network(rows)
    nodes = graph.degrees(vertices, edges)
    out = rows.join(nodes.select(F.col("id").alias("article_id"), F.col("out_degree").alias("out_article")), "article_id").join(nodes.select(F.col("id").alias("ref_id"), F.col("in_degree").alias("in_ref"), F.col("out_degree").alias("out_ref")), "ref_id")
    return out.select("article_id", "ref_id", "is_reference_valid", "out_article", "in_ref", F.round(F.col("out_article") / (F.col("out_ref") + 1), 6).alias("degree_ratio"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship_pair_degrees(Inputs(spark, sf_dir))
