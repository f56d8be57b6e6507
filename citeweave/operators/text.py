"""Text features: tokens, vocabulary, TF-IDF, similarities, embeddings. Weights are in long form (row, term, weight)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.functions import columns as C
from citeweave.operators import sparse
from citeweave.session import written

STOP_WORDS = ("english", "the")


def _listed(rows: DataFrame, key: str, text: str, stop_words: Sequence[str] | str, n_grams: tuple[int, int]) -> DataFrame:
    """(key, terms) of ``term_lists``, also for texts without a word."""
    if isinstance(stop_words, str):
        from pyspark.ml.feature import StopWordsRemover

        stop_words = StopWordsRemover.loadDefaultStopWords(stop_words)
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})")), lambda w: ~w.isin(*stop_words))

    def runs(w: Column, n: int) -> Column:
        starts = F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda _, i: F.array_join(F.slice(w, i + 1, n), " "))

    # the words are a lambda's variable: as a column, a filter pushed below would split the text anew for each run
    terms = words if n_grams == (1, 1) else F.get(F.transform(F.array(words), lambda w: F.concat(*(runs(w, n) for n in range(n_grams[0], n_grams[1] + 1)))), F.lit(0))
    return rows.select(key, words.alias("_w"), terms.alias("terms"))


def term_lists(rows: DataFrame, key: str, text: str, stop_words: Sequence[str] | str = STOP_WORDS, n_grams: tuple[int, int] = (1, 1)) -> DataFrame:
    """(key, terms): runs of two word characters or more, lower-cased, without stop words; n-grams of what is left.

    ``stop_words`` are words, or the name of a language whose list MLlib has ("english").
    """
    return _listed(rows, key, text, stop_words, n_grams).where(F.size("_w") > 0).select(key, "terms")


def tokens(rows: DataFrame, key: str, text: str, stop_words: Sequence[str] | str = STOP_WORDS, n_grams: tuple[int, int] = (1, 1)) -> DataFrame:
    """(key, term): a row for each of the ``term_lists``' terms."""
    # an outer explode, as a plain one adds a filter that makes the lists once more
    return _listed(rows, key, text, stop_words, n_grams).select(key, F.explode_outer("terms").alias("term")).where(F.col("term").isNotNull())


def counted(rows: DataFrame, key: str, text: str, stop_words: Sequence[str] | str = STOP_WORDS, n_grams: tuple[int, int] = (1, 1)) -> DataFrame:
    """(key, terms, counts): each row's distinct terms and how often it has them; counted where the text is read."""
    return sparse.counted(term_lists(rows, key, text, stop_words, n_grams), key)


def term_statistics(counts: DataFrame, size: int, n_rows: int, weight: str | None = None) -> DataFrame:
    """(term, n, idf) of the ``size`` most frequent terms of ``counted`` rows, ties by term; a row counts ``weight`` times."""
    one = F.col(weight) if weight else F.lit(1).cast("long")
    each = counts.select(F.explode(F.arrays_zip("terms", "counts")).alias("t"), one.alias("_n"))
    sums = each.groupBy(F.col("t.terms").alias("term")).agg(F.sum(F.col("t.counts") * F.col("_n")).alias("n"), F.sum("_n").alias("df"))
    idf = F.log((F.lit(1.0) + n_rows) / (1 + F.col("df"))) + 1
    return sums.orderBy(F.col("n").desc(), "term").limit(size).select("term", "n", idf.alias("idf"))


def vocabulary(terms: DataFrame, size: int = 2000) -> DataFrame:
    """(term, n): the most frequent terms of the fitted rows, ties by term."""
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "term").limit(size)


def inverse_frequencies(terms: DataFrame, vocab: DataFrame, key: str, n_rows: int) -> DataFrame:
    """(term, idf): ln((1 + rows) / (1 + rows with the term)) + 1."""
    df = terms.join(vocab.select("term"), "term", "left_semi").groupBy("term").agg(F.count_distinct(key).alias("df"))
    return df.select("term", (F.log((F.lit(1.0) + n_rows) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(terms: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """(key, term, weight), each row of unit length."""
    counts = terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")).join(idf, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return counts.select(key, "term", (F.col("raw") / length).alias("weight"))


def vector_of(spark: SparkSession, value: str, idf: DataFrame) -> DataFrame:
    """(term, weight) of a single text; no row if it has none of the terms."""
    one = spark.createDataFrame([(0, value)], "_key long, _text string")
    return tfidf(tokens(one, "_key", "_text"), idf, "_key").drop("_key")


def pair_cosine(pairs: DataFrame, weights: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(left, right, cosine) of pairs of rows; 0 if either has no term."""
    return sparse.pair_products(pairs, written(sparse.packed(weights, key), "packed"), key, left, right)


def embedding_statistics(rows: DataFrame, vector: str) -> DataFrame:
    """Mean and population deviation of the vectors' norms; one row."""
    return rows.select(C.norm(F.col(vector)).alias("n")).agg(F.round(F.avg("n"), 6).alias("norm_mean"), F.round(F.stddev_pop("n"), 6).alias("norm_std"))


def fit_svd(weights: DataFrame, vocab: DataFrame, key: str, k: int, gram_terms: int = 2000) -> DataFrame:
    """(term, load): the right vectors of a truncated SVD; each component's largest entry is positive."""
    long, terms = sparse.indexed(weights, vocab)
    if k >= len(terms):
        raise ValueError("k must be less than the number of terms")
    return loadings(written(sparse.packed(long, key, "i"), "packed"), terms, k, gram_terms)


def loadings(rows: DataFrame, terms: Sequence[str], k: int, gram_terms: int = 2000) -> DataFrame:
    """(term, load) as ``fit_svd``, of packed rows by their terms' places in ``terms``.

    Up to ``gram_terms`` terms they are the eigenvectors of the Gram matrix, which is summed in one pass (32 MB on the
    driver at 2,000); beyond, they come from a random projection in four passes (``sparse.truncated_svd``), with
    blocks of vocabulary x (k + 20) on the driver.
    """
    import numpy as np

    size = len(terms)
    if k >= size:
        raise ValueError("k must be less than the number of terms")
    if size > gram_terms:
        v = sparse.truncated_svd(rows, size, k)[1]
    else:
        v = np.linalg.eigh(sparse.gram(rows, size))[1][:, ::-1][:, :k]
        v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return rows.sparkSession.createDataFrame([(t, v[i].tolist()) for i, t in enumerate(terms)], "term string, load array<double>")


def project(weights: DataFrame, loadings: DataFrame, key: str) -> DataFrame:
    """(key, embedding): the weights times the loadings."""
    return sparse.projected(sparse.packed(weights, key), {"embedding": loadings}).select(key, "embedding")


def svd(weights: DataFrame, vocab: DataFrame, key: str, k: int) -> DataFrame:
    """(key, embedding) by truncated SVD of the weights."""
    return project(weights, fit_svd(weights, vocab, key, k), key)


def flat(rows: DataFrame, vector: str, prefix: str, k: int, keep: Sequence[str]) -> DataFrame:
    """A vector as k float columns prefix_000, prefix_001, ..."""
    return rows.select(*keep, *(F.get(vector, F.lit(i)).cast("float").alias(f"{prefix}_{i:03d}") for i in range(k)))


def pca(rows: DataFrame, key: str, vector: str, k: int):
    """(key, projection, explained): centred principal components of an array column."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = rows.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("x"))
    centred = StandardScaler(inputCol="x", outputCol="c", withMean=True, withStd=False).fit(x).transform(x)
    model = PCA(k=k, inputCol="c", outputCol="p").fit(centred)
    return model.transform(centred).select(key, vector_to_array("p").alias("projection"), F.lit(float(sum(model.explainedVariance))).alias("explained"))


def nearest(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, exclude_self: bool = False, keep: Sequence[str] = (), **ways) -> DataFrame:
    """(query, rank, neighbour, cosine): the k base rows of largest cosine for each query; ties by key."""
    from citeweave.operators.neighbours import best_by_cosine

    return best_by_cosine(queries, base, key, vector, k, exclude_self, keep, **ways)


def classic_matrix(pairs: DataFrame, rows: DataFrame, size: int, key: str, left: str, right: str, numeric: Sequence[str] = ()) -> DataFrame:
    """Pairs with ``cosine`` and ``features``, a sparse vector: numeric columns, both sides' packed weights over ``size`` terms, the cosine."""
    return sparse.vectors(sparse.matrix_of(pairs, rows, size, key, left, right, numeric))
