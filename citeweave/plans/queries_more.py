"""Queries of file formats, column selection, splits and searches that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.functions import columns as C
from citeweave.operators import cleaning, models, ordering, pair_texts, sampling, text
from citeweave.plans.fixtures import Inputs
from citeweave.plans.queries_features import _TFIDF, _terms
from citeweave.plans.registry import query
from citeweave.session import shared_path, written
from citeweave.sources import papers as sources


@query("SELECT id, title, CAST(year AS VARCHAR) AS year, CAST(coalesce(len(keywords), -1) AS INTEGER) AS n_keywords, page_start FROM fx_papers")
def s01_read_jsonl(t: Inputs) -> DataFrame:
    path = shared_path(t.spark, "jsonl")
    t.papers.select("id", "title", "year", "keywords", "page_start").write.json(path)
    rows = sources.read_jsonl(t.spark, path)
    return rows.select("id", "title", "year", F.coalesce(F.size("keywords"), F.lit(-1)).alias("n_keywords"), "page_start")


@query("SELECT least(5, count(*)) AS n FROM documents")
def s06_peek(t: Inputs) -> DataFrame:
    return sources.peek(t.spark, f"{t.sf_dir}/documents.parquet", 5).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' ELSE column_type END AS kind FROM (DESCRIBE SELECT * FROM documents)")
def s07_file_schema(t: Inputs) -> DataFrame:
    fields = sources.file_schema(t.spark, f"{t.sf_dir}/documents.parquet").fields
    return t.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in fields], "name string, kind string")


@query("SELECT r_regionkey, r_name FROM region")
def s09_file_list(t: Inputs) -> DataFrame:
    rows = sources.read_parquet(t.spark, f"{t.sf_dir}/region.parquet", columns=["r_regionkey", "r_name"])
    return rows.unionByName(sources.read_parquet(t.spark, schema=rows.schema))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 IN (1, 2)")
def s10_numbered_chunks(t: Inputs) -> DataFrame:
    template = shared_path(t.spark, "chunk") + "-{}"
    for k in range(4):
        t.table("customer").where(F.col("c_custkey") % 4 == k).select("c_custkey", "c_name").write.parquet(template.format(k))
    return sources.read_chunks(t.spark, template, end=2)


@query("SELECT id, CAST(year AS DOUBLE) AS year, TRY_CAST(n_citation AS DOUBLE) AS n_citation, CAST(coalesce(len(keywords), -1) AS INTEGER) AS n_keywords FROM fx_papers")
def s17_typed_checkpoint(t: Inputs) -> DataFrame:
    path = shared_path(t.spark, "typed")
    sources.write_checkpoint(t.papers.select("keywords", "n_citation", "year", "id"), path)
    return t.spark.read.parquet(path).select("id", "year", "n_citation", F.coalesce(F.size("keywords"), F.lit(-1)).alias("n_keywords"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment FROM customer")
def s19_csv(t: Inputs) -> DataFrame:
    path = shared_path(t.spark, "csv")
    sources.write_csv(t.table("customer").select("c_custkey", "c_mktsegment"), path)
    return t.spark.read.option("header", "true").csv(path)


@query("SELECT 'rows' AS name, CAST(count(*) AS VARCHAR) AS value FROM customer")
def s19_json_record(t: Inputs) -> DataFrame:
    path = shared_path(t.spark, "record")
    sources.write_metadata(t.spark, path, {"rows": t.table("customer").count()})
    pairs = F.from_json("value", "map<string,string>")
    return t.spark.read.text(path).select(F.explode(pairs).alias("name", "value"))


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def p09_drop_columns(t: Inputs) -> DataFrame:
    return cleaning.drop_columns(t.table("customer"), ["c_acctbal", "c_mktsegment", "absent"])


@query("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def p10_drop_prefixed(t: Inputs) -> DataFrame:
    return cleaning.drop_prefixed(t.table("customer"), "c_n")


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def p22_numeric_columns(t: Inputs) -> DataFrame:
    rows = t.table("customer")
    return rows.select(*cleaning.numeric_columns(rows))


@query("SELECT 'features' AS part, sum(quality) AS total FROM labels UNION ALL SELECT 'target', sum(toxic) FROM labels")
def p23_features_and_target(t: Inputs) -> DataFrame:
    x, y = cleaning.split_target(t.table("labels"), "toxic", drop=["doc_id"])
    total = lambda part, rows: rows.agg(F.lit(part).alias("part"), sum(F.sum(c) for c in rows.columns).cast("decimal(38,0)").alias("total"))
    return total("features", x).unionByName(total("target", y))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN c_acctbal ELSE 0 END AS value FROM customer")
def p24_finite(t: Inputs) -> DataFrame:
    bad = F.when(F.col("c_custkey") % 4 == 0, F.lit(float("nan"))).when(F.col("c_custkey") % 4 == 1, F.lit(float("-inf"))).when(F.col("c_custkey") % 4 == 3, F.col("c_acctbal"))
    return t.table("customer").select("c_custkey", C.finite(bad).alias("value"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey % 5 IN (1, 2)")
def p25_select_split(t: Inputs) -> DataFrame:
    names = F.element_at(F.array(*(F.lit(n) for n in ("train", "validation", " Val ", "test", "Training"))), (F.col("c_nationkey") % 5 + 1).cast("int"))
    return cleaning.select_split(t.table("customer").withColumn("split", names), "validation").select("c_custkey")


@query("SELECT paper_id, CAST(max(year) AS INTEGER) AS year FROM fx_authors GROUP BY 1")
def e04_drop_authors(t: Inputs) -> DataFrame:
    return cleaning.drop_columns(t.author_papers, ["authors", "keywords", "lang"])


@query("SELECT toxic FROM labels")
def e05_exclude_columns(t: Inputs) -> DataFrame:
    rows = t.table("labels").withColumns({"article_id": F.lit(1), "ref_id": F.lit(1), "split": F.lit("x")})
    return cleaning.drop_columns(rows, ["article_id", "ref_id", "split", "doc_id", "quality"])


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM customer")
def o01_sorted(t: Inputs) -> DataFrame:
    return ordering.dense_index(t.table("customer"), "c_custkey")[0]


@query("SELECT year, CASE WHEN r > 4 THEN 'train' WHEN r > 2 THEN 'validation' ELSE 'test' END AS split FROM (SELECT year, row_number() OVER (ORDER BY year DESC) AS r FROM (SELECT DISTINCT year FROM fx_years))")
def m02_few_years(t: Inputs) -> DataFrame:
    parts = sampling.chronological_years(ordering.value_counts(t.order_years, "year"), min_years=50, fallback=2)
    return t.spark.createDataFrame([(y, name) for name, years in parts.items() for y in years], "year long, split string")


@query("SELECT c_custkey, md5('42|' || c_custkey) AS position FROM customer")
def m04_shuffled(t: Inputs) -> DataFrame:
    return sampling.shuffled(t.table("customer").select("c_custkey"), 42, "c_custkey")


@query("SELECT vec_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('7|' || vec_id), vec_id) <= floor(0.8 * count(*) OVER (PARTITION BY label)) THEN 'train' ELSE 'test' END AS split FROM embeddings")
def m13_stratified_split(t: Inputs) -> DataFrame:
    return sampling.stratified_split(t.table("embeddings").select("vec_id", "label"), "label", 7, "vec_id")


@query("""WITH d AS (SELECT q.vec_id AS query, e.label, e.vec_id, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))), 9) AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS r FROM d), w AS (SELECT *, CASE WHEN min(distance) OVER (PARTITION BY query) = 0 THEN CAST(distance = 0 AS DOUBLE) ELSE 1 / distance END AS w FROM n WHERE r <= 7)
SELECT query, prediction FROM (SELECT query, label AS prediction, row_number() OVER (PARTITION BY query ORDER BY round(sum(w), 9) DESC, label) AS k FROM w GROUP BY 1, 2) WHERE k = 1""")
def l02_knn_by_distance(t: Inputs) -> DataFrame:
    e = t.table("embeddings")
    return models.knn_classify(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", "label", 7, weights="distance", power=1.0)


@query(f"WITH {_TFIDF} SELECT term, round(weight, 6) AS weight FROM weights WHERE doc_id = (SELECT min(doc_id) FROM documents)")
def t06_text_vector(t: Inputs) -> DataFrame:
    terms = written(_terms(t), "terms")
    idf = text.inverse_frequencies(terms, written(text.vocabulary(terms), "vocabulary"), "doc_id", t.table("documents").count())
    first = t.table("documents").orderBy("doc_id").first()["text"]
    return text.vector_of(t.spark, first, idf).select("term", F.round("weight", 6).alias("weight"))


@query("SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY c_acctbal, c_custkey) <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM customer")
def p25_train_and_test(t: Inputs) -> DataFrame:
    train, test = cleaning.train_and_test(t.table("customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")
    return train.select("c_custkey", F.lit("train").alias("split")).unionByName(test.select("c_custkey", F.lit("test").alias("split")))


@query("SELECT p_partkey, CASE c WHEN 0 THEN 'embeddings' WHEN 1 THEN 'graph_based' WHEN 2 THEN 'mix' WHEN 3 THEN 'normal' ELSE 'default' END AS family FROM (SELECT p_partkey, p_size % 5 AS c FROM part)")
def p29_feature_family(t: Inputs) -> DataFrame:
    names = F.element_at(F.array(*map(F.lit, ("Textual 64", "Graph + mix", "HYBRID set", "exploded pairs", " -- "))), (F.col("p_size") % 5 + 1).cast("int"))
    return t.table("part").select("p_partkey", C.feature_family(names).alias("family"))


def _split_pairs(t: Inputs) -> tuple[DataFrame, DataFrame]:
    """The pairs' keys with their split, and the texts they name."""
    from citeweave.operators.pairs import positive_keys

    keys = positive_keys(t.refs, t.papers).select(F.substring("article_id", 2, 20).cast("long").alias("article_id"), F.substring("ref_id", 2, 20).cast("long").alias("ref_id"))
    pairs = sampling.random_split(keys.withColumn("is_reference_valid", F.lit(1)), 5, "article_id")
    texts = written(pair_texts.least_texts(t.table("documents").select("doc_id", "text"), "doc_id", "text"), "texts")
    return written(pair_texts.deduplicated(pairs), "pairs"), texts


@query("""WITH p AS (SELECT DISTINCT CAST(substr(article_id, 2) AS BIGINT) AS a, CAST(substr(ref_id, 2) AS BIGINT) AS b FROM fx_pairs),
s AS (SELECT a, b, CASE WHEN CAST('0x' || substr(md5('5|' || a), 1, 8) AS BIGINT) % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM p),
m AS (SELECT doc_id, count(*) AS n FROM (SELECT a AS doc_id FROM s WHERE split = 'train' UNION ALL SELECT b FROM s WHERE split = 'train') GROUP BY 1),
tf AS (SELECT doc_id, term, count(*) AS tf FROM fx_words GROUP BY 1, 2),
voc AS (SELECT term, sum(n) AS df FROM tf JOIN m USING (doc_id) GROUP BY 1 ORDER BY sum(tf * n) DESC, term LIMIT 2000),
idf AS (SELECT term, ln((1.0 + (SELECT sum(n) FROM m)) / (1 + df)) + 1 AS idf FROM voc),
raw AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term)), len AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM raw GROUP BY 1),
weights AS (SELECT doc_id, term, w / l AS weight FROM raw JOIN len USING (doc_id)),
c AS (SELECT a, b, sum(x.weight * y.weight) AS c FROM s JOIN weights x ON x.doc_id = a JOIN weights y ON y.doc_id = b AND x.term = y.term GROUP BY 1, 2)
SELECT s.split, s.a AS article_id, s.b AS ref_id, round(coalesce(c, 0), 6) AS tfidf_similarity FROM s LEFT JOIN c ON s.a = c.a AND s.b = c.b""")
def t10_split_similarity(t: Inputs) -> DataFrame:
    pairs, texts = _split_pairs(t)
    fitted = pair_texts.fit(pairs.where("split = 'train'"), None, 2000, texts=texts)
    return fitted.similarities(pairs, texts).select("split", "article_id", "ref_id", F.round("tfidf_similarity", 6).alias("tfidf_similarity"))


@query()
def t10_split_embeddings(t: Inputs) -> DataFrame:
    pairs, texts = _split_pairs(t)
    return pair_texts.fit(pairs.where("split = 'train'"), 64, 2000, texts=texts).embeddings(pairs, texts=texts)


@query("SELECT CAST(doc_id % 4 AS INTEGER) AS part, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars, CASE WHEN doc_id % 4 < 2 THEN 'kept' ELSE 'written' END AS state FROM documents GROUP BY doc_id % 4")
def s16_resumed_parts(t: Inputs) -> DataFrame:
    """Four parts whose writer stops before the third; a second call writes what is left, and a merge makes one table."""
    from citeweave.session import shared_path
    from citeweave.sources import resumable

    docs, path = t.table("documents").select("doc_id", "n_chars"), shared_path(t.spark, "resumable")
    parts: dict[str, list[str]] = {str(k): [] for k in range(4)}

    def make(key: str, _: list[str]) -> DataFrame:
        return docs.where(F.col("doc_id") % 4 == int(key))

    resumable.write_parts(t.spark, path, {k: parts[k] for k in ("0", "1")}, make)  # as far as the first call came
    states = resumable.write_parts(t.spark, path, parts, make)
    state = F.get(F.array(*(F.lit(states[str(k)]) for k in range(4))), F.col("part"))
    rows = resumable.merge_parts(t.spark, path, parts, f"{path}/table").groupBy((F.col("doc_id") % 4).cast("int").alias("part"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars")).withColumn("state", state)


@query("""WITH i AS (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY doc_id) - 1) // 256 AS shard FROM documents),
s AS (SELECT shard, count(*) AS rows FROM i GROUP BY 1), b AS (SELECT shard, sum(rows) OVER (ORDER BY md5('7|3|shard|' || shard), shard) - rows AS before FROM s),
p AS (SELECT doc_id, n_chars, before + row_number() OVER (PARTITION BY shard ORDER BY md5('7|3|row|' || doc_id), doc_id) - 1 AS pos FROM i JOIN b USING (shard))
SELECT CAST(pos // 32 AS BIGINT) AS batch, CAST(count(*) AS INTEGER) AS real, list(doc_id ORDER BY pos)[1] AS first_id, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM p GROUP BY pos // 32""")
def t14_epoch_batches(t: Inputs) -> DataFrame:
    """The batches of one epoch over shards of all documents."""
    from citeweave.sources import batches

    path = shared_path(t.spark, "shards")
    shapes = {"doc_id": (0, "long"), "n_chars": (0, "long")}
    docs = t.table("documents").select("doc_id", "n_chars").withColumn("id", F.col("doc_id"))
    batches.write_shards(docs, path, "id", shapes, shard_rows=256)
    rows = batches.packed(batches.epoch(t.spark, path, "id", 3, 32, 7), 32, shapes)
    return rows.select("batch", "real", F.get("doc_id", F.lit(0)).alias("first_id"), F.aggregate("n_chars", F.lit(0).cast("long"), lambda s, x: s + x).alias("n_chars"))
