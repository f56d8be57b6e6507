"""The queries of this subpackage's operators, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm import decontaminate, divergence, html_text, interactions, media, mixing, pii, simhash, substrings, token_ids, toxicity, url_filters, warc
from citeweave.llm.common import table, written
from citeweave.llm.oracles import ORACLES

#: The chain's categories, in its order, as SQL over ``labels``.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}
#: The url rules: verdict, host and path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def tokenizer_path() -> str:
    """The public vocabulary; CITEWEAVE_TOKENIZER names another file."""
    if named := os.environ.get("CITEWEAVE_TOKENIZER"):
        return named
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit_chain(docs, table(spark, sf_dir, "labels"), CATEGORIES))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(table(spark, sf_dir, "pages"), RULES)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.encoded(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = written(simhash.fingerprints(table(spark, sf_dir, "documents")), "fingerprints")
    found = prints.join(simhash.near_duplicates(prints), "fp")
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op11_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_mixing, op3_html_text, op4_pii, op5_warc, op6_url_filters, op7_decontamination, op8_token_ids, op9_simhash, op10_media, op11_interactions, op12_substrings, op13_divergence)
}

__all__ = ["ORACLES", "QUERIES"]
