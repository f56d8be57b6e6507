"""Queries of graph, encoding and text features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.functions import columns as C
from citeweave.operators import combine, encoding, graph, ordering, sparse, text
from citeweave.plans.fixtures import Inputs
from citeweave.plans.registry import query
from citeweave.session import written

PAGERANK_ROUNDS, KATZ_ROUNDS = 10, 8


def _pagerank_sql(rounds: int) -> str:
    head = "v AS (SELECT p_partkey AS id FROM part), n AS (SELECT count(*) AS n FROM v), o AS (SELECT src, count(*) AS k FROM fx_edges GROUP BY 1), r0 AS (SELECT id, 1.0::DOUBLE / n AS r FROM v, n)"
    for i in range(rounds):
        head += f", r{i + 1} AS MATERIALIZED (SELECT v.id, 0.85::DOUBLE * (coalesce(s.s, 0) + (SELECT coalesce(sum(r), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM o)) / n) + 0.15::DOUBLE / n AS r FROM v CROSS JOIN n LEFT JOIN (SELECT e.dst, sum(r / k) AS s FROM fx_edges e JOIN o ON o.src = e.src JOIN r{i} x ON x.id = e.src GROUP BY 1) s ON s.dst = v.id)"
    return head


def _katz_sql(rounds: int) -> str:
    head = "kv AS (SELECT p_partkey AS id FROM part), x0 AS (SELECT id, 0.0::DOUBLE AS x FROM kv)"
    for i in range(rounds):
        head += f", x{i + 1} AS MATERIALIZED (SELECT kv.id, 0.1::DOUBLE * coalesce(s.s, 0) + 1.0 AS x FROM kv LEFT JOIN (SELECT e.dst, sum(x) AS s FROM fx_edges e JOIN x{i} x ON x.id = e.src GROUP BY 1) s ON s.dst = kv.id)"
    return head


_UNDIRECTED = "und AS (SELECT src AS u, dst AS v FROM fx_edges UNION SELECT dst, src FROM fx_edges)"
_DEGREES = "dg AS (SELECT p_partkey AS id, (SELECT count(*) FROM fx_edges WHERE dst = p_partkey) AS i, (SELECT count(*) FROM fx_edges WHERE src = p_partkey) AS o FROM part)"
_NEAR = f"{_UNDIRECTED}, deg AS (SELECT u, count(*) AS d FROM und GROUP BY 1), cn AS (SELECT e.src, e.dst, count(b.v) AS c FROM fx_edges e JOIN und a ON a.u = e.src LEFT JOIN und b ON b.u = e.dst AND b.v = a.v GROUP BY 1, 2)"


@query("SELECT 'vertex' AS kind, count(*) AS n FROM (SELECT src FROM fx_edges UNION SELECT dst FROM fx_edges) UNION ALL SELECT 'edge', count(*) FROM fx_edges")
def g01_network(t: Inputs) -> DataFrame:
    pairs = t.edges.select(F.col("src").alias("article_id"), F.col("dst").alias("ref_id"), F.lit(1).alias("is_reference_valid"))
    vertices, edges = graph.network(pairs)
    return vertices.agg(F.lit("vertex").alias("kind"), F.count(F.lit(1)).alias("n")).unionByName(edges.agg(F.lit("edge").alias("kind"), F.count(F.lit(1)).alias("n")))


@query(f"WITH {_DEGREES} SELECT id, i AS in_degree, o AS out_degree FROM dg")
def g02_degrees(t: Inputs) -> DataFrame:
    return graph.degrees(t.parts, t.edges)


@query(f"WITH {_pagerank_sql(PAGERANK_ROUNDS)} SELECT id, round(r, 9) AS rank FROM r{PAGERANK_ROUNDS}")
def g03_pagerank_k10(t: Inputs) -> DataFrame:
    return graph.pagerank(t.parts, written(t.edges, "edges"), max_iter=PAGERANK_ROUNDS, tol=None).select("id", F.round("rank", 9).alias("rank"))


@query("SELECT p_partkey AS id, round(coalesce(a, 0), 6) AS avg_neigh_degree FROM part LEFT JOIN (SELECT e.src, avg(coalesce(k, 0)) AS a FROM fx_edges e LEFT JOIN (SELECT src, count(*) AS k FROM fx_edges GROUP BY 1) o ON o.src = e.dst GROUP BY 1) s ON s.src = p_partkey")
def g04_avg_neighbor_degree(t: Inputs) -> DataFrame:
    return graph.average_neighbour_degree(t.parts, t.edges).select("id", F.round("avg_neigh_degree", 6).alias("avg_neigh_degree"))


@query(f"WITH {_katz_sql(KATZ_ROUNDS)} SELECT id, round(x / sqrt(sum(x * x) OVER ()), 6) AS katz FROM x{KATZ_ROUNDS}")
def g05_katz_k8(t: Inputs) -> DataFrame:
    return graph.katz(t.parts, t.edges, max_iter=KATZ_ROUNDS, tol=None).select("id", F.round("katz", 6).alias("katz"))


@query(f"WITH {_NEAR} SELECT src AS u, dst AS v, c AS common_neighbors, round(c / (a.d + b.d - c), 6) AS jaccard_coeff FROM cn JOIN deg a ON a.u = src JOIN deg b ON b.u = dst")
def g08_common_neighbors_jaccard(t: Inputs) -> DataFrame:
    edges = written(t.edges, "edges")
    near = graph.neighbourhoods(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), edges)
    return near.select("u", "v", "common_neighbors", F.round("jaccard_coeff", 6).alias("jaccard_coeff"))


@query(f"""WITH v2 AS (SELECT src AS id FROM fx_edges UNION SELECT dst FROM fx_edges), {_pagerank_sql(8).replace("(SELECT p_partkey AS id FROM part)", "(SELECT id FROM v2)")}, {_katz_sql(8).replace("(SELECT p_partkey AS id FROM part)", "(SELECT id FROM v2)")}, {_NEAR},
i AS (SELECT dst AS id, count(*) AS k FROM fx_edges GROUP BY 1), l AS (SELECT sqrt(sum(x * x)) AS l FROM x8)
SELECT e.src AS article_id, e.dst AS ref_id, coalesce(ia.k, 0) AS in_article, coalesce(oa.k, 0) AS out_article, coalesce(ir.k, 0) AS in_ref, coalesce(orf.k, 0) AS out_ref, round(ra.r, 8) AS pagerank_article, round(rr.r, 8) AS pagerank_ref, round(ka.x / l, 6) AS katz_cent_article, round(kr.x / l, 6) AS katz_cent_ref,
cn.c AS common_neighbors, round(cn.c / (a.d + b.d - cn.c), 6) AS jaccard_coeff, round(coalesce(oa.k, 0) / (coalesce(orf.k, 0) + 1), 6) AS degree_ratio, round(ra.r / (rr.r + 1e-9), 4) AS pagerank_ratio
FROM fx_edges e JOIN cn ON cn.src = e.src AND cn.dst = e.dst JOIN deg a ON a.u = e.src JOIN deg b ON b.u = e.dst LEFT JOIN i ia ON ia.id = e.src LEFT JOIN i ir ON ir.id = e.dst LEFT JOIN o oa ON oa.src = e.src LEFT JOIN o orf ON orf.src = e.dst
JOIN r8 ra ON ra.id = e.src JOIN r8 rr ON rr.id = e.dst JOIN x8 ka ON ka.id = e.src JOIN x8 kr ON kr.id = e.dst CROSS JOIN l""")
def g09_pair_features(t: Inputs) -> DataFrame:
    pairs = written(t.edges.select(F.col("src").alias("article_id"), F.col("dst").alias("ref_id"), F.lit(1).alias("is_reference_valid")), "pairs")
    f = graph.pair_features(pairs, rounds=8)
    r = lambda c, d: F.round(c, d).alias(c)
    return f.select("article_id", "ref_id", "in_article", "out_article", "in_ref", "out_ref", r("pagerank_article", 8), r("pagerank_ref", 8), r("katz_cent_article", 6), r("katz_cent_ref", 6), "common_neighbors", r("jaccard_coeff", 6), r("degree_ratio", 6), r("pagerank_ratio", 4))


def _sparse_edges(t: Inputs) -> DataFrame:
    """Links between customers' and suppliers' nations by account: a graph with many components."""
    c = t.table("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("-"), F.col("c_mktsegment")).alias("dst"))
    return c


_SPARSE = "se AS (SELECT 'c' || c_custkey AS s, 'n' || c_nationkey || '-' || c_mktsegment AS d FROM customer), lab AS (SELECT d AS g, min(s) AS c FROM se GROUP BY 1)"


@query(f"WITH {_SPARSE} SELECT s AS id, c AS component FROM se JOIN lab ON g = d UNION ALL SELECT g, c FROM lab")
def g10_components(t: Inputs) -> DataFrame:
    e = _sparse_edges(t)
    return graph.components(graph.vertices_of(e), e)


@query("""WITH RECURSIVE e AS (
  SELECT p_partkey AS a, (p_partkey * 7 + 3) % 1000 AS b FROM part WHERE p_partkey % 3 = 0 UNION SELECT p_partkey, p_partkey + 1 FROM part WHERE p_partkey % 5 < 2),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
cc(id, component) USING KEY (id) AS (
  SELECT DISTINCT a, a FROM b
  UNION (SELECT b.b, min(c.component) FROM cc c JOIN b ON b.a = c.id JOIN recurring.cc r ON r.id = b.b WHERE c.component < r.component GROUP BY b.b))
SELECT id, component FROM cc""")
def g10_general_components(t: Inputs) -> DataFrame:
    """A graph with cycles, chains and trees."""
    p = t.table("part").select(F.col("p_partkey").alias("src"))
    far = p.where("src % 3 = 0").select("src", ((F.col("src") * 7 + 3) % 1000).alias("dst"))
    edges = far.union(p.where("src % 5 < 2").select("src", (F.col("src") + 1).alias("dst")))
    return graph.components(graph.vertices_of(edges), edges)


@query(f"WITH {_SPARSE} SELECT size, count(*) AS n_components FROM (SELECT d, count(*) + 1 AS size FROM se GROUP BY 1) GROUP BY 1")
def a23_component_sizes(t: Inputs) -> DataFrame:
    e = _sparse_edges(t)
    return graph.component_sizes(graph.components(graph.vertices_of(e), e))


@query(f"WITH {_SPARSE} SELECT CAST(sum(size) AS BIGINT) AS n_nodes, count(*) AS n_components, max(size) AS largest, min(size) AS smallest, round(100 * max(size) / sum(size), 6) AS largest_pct FROM (SELECT d, count(*) + 1 AS size FROM se GROUP BY 1)")
def g10_connectivity(t: Inputs) -> DataFrame:
    e = _sparse_edges(t)
    return graph.connectivity(graph.components(graph.vertices_of(e), e))


@query("SELECT doc_id, CASE WHEN source IN (SELECT source FROM documents GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 5) THEN source ELSE 'Other' END AS source FROM documents")
def e01_top_n_fold(t: Inputs) -> DataFrame:
    return encoding.fold_top(t.table("documents").select("doc_id", "source"), "source")


@query("SELECT c_custkey, " + ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"c_mktsegment_{s}\"" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def e02_one_hot(t: Inputs) -> DataFrame:
    return encoding.one_hot(t.table("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query("SELECT id, " + ", ".join(f"coalesce((SELECT sum(CASE WHEN CAST('0x' || substr(md5(k), 9, 1) AS INTEGER) < 8 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) FROM (SELECT unnest(p.keywords) AS k) WHERE CAST('0x' || substr(md5(k), 1, 8) AS BIGINT) % 16 = {i}), 0.0::DOUBLE) AS keywords_hash_{i}" for i in range(16)) + " FROM fx_papers p")
def e03_token_hash_md5(t: Inputs) -> DataFrame:
    return encoding.hash_tokens(t.papers.select("id", "keywords"), "keywords").drop("keywords")


@query()
def e03_token_hash_murmur(t: Inputs) -> DataFrame:
    return encoding.hash_tokens_murmur(t.papers.select("id", "keywords"), "keywords").drop("keywords")


@query("SELECT c_custkey, round((c_acctbal - m) / CASE WHEN r = 0 THEN 1 ELSE r END, 6) AS c_acctbal FROM customer, (SELECT median(c_acctbal) AS m, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS r FROM customer)")
def e06_robust_scale(t: Inputs) -> DataFrame:
    rows = t.table("customer").select("c_custkey", "c_acctbal")
    return encoding.robust_scale(rows, encoding.robust_statistics(rows, ["c_acctbal"])).select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query("SELECT id, coalesce(len(keywords), 0) AS n_keywords FROM fx_papers")
def a26_list_sizes(t: Inputs) -> DataFrame:
    return t.papers.select("id", F.coalesce(F.size("keywords"), F.lit(0)).cast("long").alias("n_keywords"))


def _terms(t: Inputs) -> DataFrame:
    return text.tokens(t.table("documents"), "doc_id", "text")


@query("SELECT doc_id, term, count(*) AS tf FROM fx_words GROUP BY 1, 2")
def t01_token_counts(t: Inputs) -> DataFrame:
    counts = text.counted(t.table("documents"), "doc_id", "text")
    return counts.select("doc_id", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("doc_id", F.col("t.terms").alias("term"), F.col("t.counts").alias("tf"))


@query("SELECT g AS term, count(*) AS n FROM (SELECT term || ' ' || lead(term) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, w[i] AS term, i FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'), lambda x: x NOT IN ('english', 'the')) AS w FROM documents) x, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i))) WHERE g IS NOT NULL GROUP BY 1")
def t01_bigram_counts(t: Inputs) -> DataFrame:
    return ordering.value_counts(text.tokens(t.table("documents"), "doc_id", "text", n_grams=(2, 2)), "term")


@query("SELECT term, count(*) AS n FROM fx_words GROUP BY 1 ORDER BY n DESC, term LIMIT 2000")
def t03_vocabulary(t: Inputs) -> DataFrame:
    return text.vocabulary(_terms(t))


_TFIDF = """voc AS (SELECT term FROM fx_words GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 2000), tf AS (SELECT doc_id, term, count(*) AS tf FROM fx_words JOIN voc USING (term) GROUP BY 1, 2),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1), raw AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
len AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM raw GROUP BY 1), weights AS (SELECT doc_id, term, w / l AS weight FROM raw JOIN len USING (doc_id))"""


def _weights(t: Inputs, size: int = 2000, names: bool = False) -> tuple[DataFrame, list[str]]:
    """The documents' weights, a row each, and the vocabulary in order."""
    counts = text.counted(t.table("documents"), "doc_id", "text")
    terms, idf = sparse.vocabulary_of(text.term_statistics(counts, size, t.table("documents").count()))
    return sparse.tfidf(counts, "doc_id", terms, idf, names), terms


@query(f"WITH {_TFIDF} SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def t04_tfidf_weights(t: Inputs) -> DataFrame:
    each = _weights(t, names=True)[0].select("doc_id", F.explode(F.arrays_zip("terms", "weights")).alias("t"))
    return each.select("doc_id", F.col("t.terms").alias("term"), F.round("t.weights", 6).alias("weight"))


@query(f"WITH {_TFIDF}, p AS (SELECT DISTINCT CAST(substr(article_id, 2) AS BIGINT) AS a, CAST(substr(ref_id, 2) AS BIGINT) AS b FROM fx_pairs) SELECT a, b, round(coalesce((SELECT sum(x.weight * y.weight) FROM weights x JOIN weights y ON x.term = y.term WHERE x.doc_id = a AND y.doc_id = b), 0), 6) AS cosine FROM p")
def t05_pair_tfidf_cosine(t: Inputs) -> DataFrame:
    from citeweave.operators.pairs import positive_keys

    keys = positive_keys(t.refs, t.papers).select(F.substring("article_id", 2, 20).cast("long").alias("a"), F.substring("ref_id", 2, 20).cast("long").alias("b"))
    cosine = sparse.pair_products(keys, written(_weights(t)[0], "weights"), "doc_id", "a", "b")
    return cosine.select("a", "b", F.round("cosine", 6).alias("cosine"))


@query()
def t08_svd_embedding(t: Inputs) -> DataFrame:
    weights, terms = _weights(t)
    weights = written(weights, "weights")
    return text.flat(sparse.projected(weights, {"embedding": text.loadings(weights, terms, 64)}), "embedding", "article_emb", 64, ["doc_id"])


@query("SELECT round(avg(n), 6) AS norm_mean, round(stddev_pop(n), 6) AS norm_std FROM (SELECT sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)")
def t11_embedding_norms(t: Inputs) -> DataFrame:
    return text.embedding_statistics(t.table("embeddings"), "embedding")


_DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_COS = f"({_DOT} / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))))"


@query(f"SELECT CAST(a.label = b.label AS INTEGER) AS same, count(*) AS n, round(avg({_COS}), 6) AS mean, round(stddev_samp({_COS}), 6) AS std, round(min({_COS}), 6) AS low, round(max({_COS}), 6) AS high FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY 1")
def a19_cosine_by_label(t: Inputs) -> DataFrame:
    e = t.table("embeddings")
    a, b = e.select("vec_id", "embedding", "label"), e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("other_label"))
    cos = a.join(b, "vec_id").select((F.col("label") == F.col("other_label")).cast("int").alias("same"), C.cosine(F.col("embedding"), F.col("other")).alias("c"))
    return cos.groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("mean"), F.round(F.stddev_samp("c"), 6).alias("std"), F.round(F.min("c"), 6).alias("low"), F.round(F.max("c"), 6).alias("high"))


@query()
def t12_pca(t: Inputs) -> DataFrame:
    p = text.pca(t.table("embeddings"), "vec_id", "embedding", 8)
    return text.flat(p, "projection", "pc", 8, ["vec_id", "explained"])


#: The queries of the searches: every row whose id is divisible by 50, against all rows.
_QUERIES = "(SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0)"


@query(f"SELECT query, CAST(rank AS INTEGER) AS rank, neighbour, round(round(c, 9), 5) AS cosine FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, {_COS} AS c, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 9) DESC, b.vec_id) AS rank FROM {_QUERIES} a, embeddings b WHERE a.vec_id <> b.vec_id) WHERE rank <= 3")
def j10_knn_join_top3(t: Inputs) -> DataFrame:
    e = t.table("embeddings")
    near = text.nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 3, exclude_self=True)
    return near.select("query", "rank", "neighbour", F.round("cosine", 5).alias("cosine"))


@query(f"SELECT query, CAST(rank AS INTEGER) AS rank, neighbour, round(round(c, 9), 5) AS cosine FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, {_COS} AS c, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 9) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id) WHERE rank <= 3")
def j10_knn_join_all(t: Inputs) -> DataFrame:
    """Every row as a query, joined by pivots."""
    e = t.table("embeddings")
    near = text.nearest(e, e, "vec_id", "embedding", 3, exclude_self=True, direct=0)
    return near.select("query", "rank", "neighbour", F.round("cosine", 5).alias("cosine"))


@query("SELECT x.article_id, x.ref_id, CAST(x.is_reference_valid AS INTEGER) AS is_reference_valid, a.year AS year_article, r.year AS year_ref, CAST(d.o AS BIGINT) AS out_article FROM (SELECT article_id, ref_id, 1 AS is_reference_valid FROM fx_pairs) x JOIN fx_papers a ON a.id = x.article_id JOIN fx_papers r ON r.id = x.ref_id JOIN (SELECT article_id, count(DISTINCT ref_id) AS o FROM fx_pairs GROUP BY 1) d ON d.article_id = x.article_id")
def j07_feature_join(t: Inputs) -> DataFrame:
    from citeweave.operators.pairs import positive_pairs

    normal = written(positive_pairs(t.refs, t.papers.select("id", "year")).drop("pos"), "normal").withColumn("keywords_article_hash_0", F.lit(0.0))
    keys = normal.select("article_id", "ref_id", "is_reference_valid").distinct()
    out = keys.join(keys.groupBy("article_id").agg(F.count(F.lit(1)).alias("out_article")), "article_id")
    return combine.join_features(normal, out, keys).select("article_id", "ref_id", "is_reference_valid", "year_article", "year_ref", "out_article")


@query("SELECT c_custkey, round((c_acctbal - m) / CASE WHEN r = 0 THEN 1 ELSE r END, 6) AS c_acctbal FROM (SELECT * FROM customer ORDER BY md5('42|' || c_custkey), c_custkey LIMIT 50), (SELECT median(c_acctbal) AS m, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS r FROM customer)")
def e07_scaled_sample(t: Inputs) -> DataFrame:
    rows = t.table("customer").select("c_custkey", "c_acctbal")
    return encoding.scaled_sample(rows, rows, ["c_acctbal"], 50, 42, "c_custkey").select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query()
def t09_classic_matrix(t: Inputs) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    from citeweave.operators.pairs import positive_keys

    keys = positive_keys(t.refs, t.papers).select(F.substring("article_id", 2, 20).cast("long").alias("a"), F.substring("ref_id", 2, 20).cast("long").alias("b")).distinct()
    weights, terms = _weights(t, 256)
    rows = text.classic_matrix(keys, written(weights, "weights"), len(terms), "doc_id", "a", "b")
    return rows.select("a", "b", F.round("cosine", 6).alias("cosine"), F.size(vector_to_array("features")).alias("n_features"))


@query(f"""WITH {_TFIDF.replace("LIMIT 2000", "LIMIT 256")}, p AS (SELECT DISTINCT CAST(substr(article_id, 2) AS BIGINT) AS a, CAST(substr(ref_id, 2) AS BIGINT) AS b FROM fx_pairs),
vi AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS i, count(*) OVER () AS n FROM voc),
c AS (SELECT a, b, i, weight AS value FROM p JOIN weights ON doc_id = a JOIN vi USING (term) UNION ALL SELECT a, b, n + i, weight FROM p JOIN weights ON doc_id = b JOIN vi USING (term)
  UNION ALL SELECT a, b, 2 * any_value(n), sum(x.weight * y.weight) FROM p JOIN weights x ON x.doc_id = a JOIN weights y ON y.doc_id = b AND y.term = x.term JOIN vi ON vi.term = x.term GROUP BY a, b)
SELECT a, b, CAST(i AS INTEGER) AS i, round(value, 6) AS value FROM c""")
def t09_classic_cells(t: Inputs) -> DataFrame:
    """Every cell of the sparse pair matrix that isn't 0."""
    from citeweave.operators.pairs import positive_keys

    keys = positive_keys(t.refs, t.papers).select(F.substring("article_id", 2, 20).cast("long").alias("a"), F.substring("ref_id", 2, 20).cast("long").alias("b")).distinct()
    weights, terms = _weights(t, 256)
    rows = sparse.matrix_of(written(keys, "keys"), written(weights, "weights"), len(terms), "doc_id", "a", "b")
    cells = rows.select("a", "b", F.explode(F.arrays_zip("indices", "values")).alias("c"))
    return cells.select("a", "b", F.col("c.indices").alias("i"), F.round("c.values", 6).alias("value"))


@query()
def t07_random_projection_svd(t: Inputs) -> DataFrame:
    """Singular values of the documents' weights over 10,000 terms."""
    weights, names = _weights(t, 10_000)
    rows = written(weights, "packed")
    values, _ = sparse.truncated_svd(rows, len(names), min(64, len(names) - 1))
    return t.spark.createDataFrame([(i, round(float(v), 4)) for i, v in enumerate(values)], "component int, value double")
