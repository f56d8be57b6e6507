"""Text features of pairs: fitted on the train split, applied to any rows, with a reducer for each side."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.operators import sparse, text
from citeweave.session import written

META = ("split", "article_id", "ref_id", "is_reference_valid")


def _text_id(value: Column) -> Column:
    return F.sha2(F.coalesce(value, F.lit("")), 256)


def deduplicated(pairs: DataFrame) -> DataFrame:
    """One row of each pair of a split: the least by its other columns."""
    keys = ["split", "article_id", "ref_id"]
    rest = [c for c in pairs.columns if c not in keys]
    return pairs.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*")


def least_texts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): the least text of each key, null first; what ``deduplicated`` keeps of pairs joined with all of them."""
    return rows.groupBy(key).agg(F.min(F.struct(text)).alias("_t")).select(key, f"_t.{text}")


@dataclass
class PairTexts:
    """Fitted vocabulary with idf, and one table of loadings for each side.

    Texts come with the pairs, or as a table (id, text) of their own, which the pairs name by article_id and ref_id: then
    no text is ever copied for its pairs. Equal texts (or ids) are tokenised and projected once, and count for as many
    pairs as have them. A null text is empty; a text without a known term has similarity 0 and a zero embedding.
    """

    idf: DataFrame
    loadings: dict[str, DataFrame]
    k: int
    article: str
    ref: str
    options: dict

    def _weights(self, rows: DataFrame, texts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        marked, texts = _keyed(rows, self.article, self.ref, texts)
        counts = sparse.counted(text.term_lists(texts, "_id", "_text", **self.options), "_id")
        return marked, sparse.tfidf(counts, "_id", *sparse.vocabulary_of(self.idf))

    def similarities(self, rows: DataFrame, texts: DataFrame | None = None) -> DataFrame:
        """The rows with ``tfidf_similarity``."""
        marked, weights = self._weights(rows, texts)
        return sparse.multiplied(marked, written(weights, "weights"), "_id", "_a", "_r", "tfidf_similarity").drop("_a", "_r")

    def embeddings(self, rows: DataFrame, meta: Sequence[str] = META, texts: DataFrame | None = None) -> DataFrame:
        """``meta``, ``tfidf_similarity``, then article_emb_000, ... and ref_emb_000, ... as floats."""
        if missing := [c for c in meta if c not in rows.columns]:
            raise ValueError(f"missing columns: {missing}")
        marked, weights = self._weights(rows, texts)
        weights = written(sparse.projected(weights, self.loadings), "weights")
        marked = marked.select(*meta, *(c for c in ("_a", "_r") if c not in meta))
        out = sparse.multiplied(marked, weights, "_id", "_a", "_r", "tfidf_similarity")
        for side, name in (("_a", "_article"), ("_r", "_ref")):
            out = out.join(weights.select(F.col("_id").alias(side), F.col(side).alias(name)), side, "left")
        parts = [F.coalesce(F.get(f"_{name}", F.lit(i)), F.lit(0.0)).cast("float").alias(f"{name}_emb_{i:03d}") for name in ("article", "ref") for i in range(self.k)]
        return out.select(*meta, "tfidf_similarity", *parts)


def _keyed(rows: DataFrame, article: str, ref: str, texts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The pairs with the ids of their texts (_a, _r), and those texts (_id, _text), one row each."""
    if texts is not None:
        key, value = texts.columns
        return rows.withColumns({"_a": F.col("article_id"), "_r": F.col("ref_id")}), texts.select(F.col(key).alias("_id"), F.col(value).alias("_text"))
    marked = rows.withColumns({"_a": _text_id(F.col(article)), "_r": _text_id(F.col(ref))})
    both = F.inline(F.array(*(F.struct(F.col(i).alias("_id"), F.coalesce(F.col(c), F.lit("")).alias("_text")) for i, c in (("_a", article), ("_r", ref)))))
    return marked, marked.select(both).groupBy("_id").agg(F.any_value("_text").alias("_text"))


def fit(train: DataFrame, k: int | None = 128, size: int = 10000, article: str = "vector_text_article", ref: str = "vector_text_ref", texts: DataFrame | None = None, **options) -> PairTexts:
    """Fit on the train rows; ``k`` components for each side (None: no reducers, similarities only).

    ``texts``: a table of two columns, id and text (one row an id), for pairs without text columns. ``options`` are those
    of ``text.term_lists``. Both sides' texts fit the vocabulary; each side fits its own reducer.
    """
    marked, found = _keyed(train, article, ref, texts)
    sides = F.inline(F.array(*(F.struct(F.col(c).alias("_id"), F.lit(int(c == "_a")).alias("a"), F.lit(int(c == "_r")).alias("r")) for c in ("_a", "_r"))))
    uses = marked.select(sides).groupBy("_id").agg(F.sum("a").alias("_a"), F.sum("r").alias("_r"))
    uses = written(uses.withColumn("_n", F.col("_a") + F.col("_r")), "uses")
    counts = sparse.counted(text.term_lists(found, "_id", "_text", **options), "_id")
    n_texts = uses.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    idf = written(text.term_statistics(counts.join(uses, "_id"), size, n_texts, "_n"), "idf")
    loadings = {}
    if k is not None:
        terms, values = sparse.vocabulary_of(idf)
        weights = written(sparse.tfidf(counts, "_id", terms, values).join(uses, "_id"), "weights")
        for side in ("_a", "_r"):
            own = F.transform("weights", lambda w: w * F.sqrt(F.col(side)))  # noqa: B023
            rows = weights.where(F.col(side) > 0).select("_id", "terms", own.alias("weights"))
            loadings[side] = written(text.loadings(rows, terms, k), "loadings")
    return PairTexts(idf, loadings, k or 0, article, ref, options)
