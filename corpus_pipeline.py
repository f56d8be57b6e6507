"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, the mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
Stages 1 to 4 return the columns of ``documents``; the mix repeats a row as often as it takes it. The toxicity stage
fits its chain on the stage's own documents that have labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeweave.llm import decontaminate, mixing, simhash, token_ids, toxicity
from citeweave.llm.common import table, written
from citeweave.llm.queries import CATEGORIES, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = toxicity.fit_chain(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return toxicity.without_toxic(docs, chain)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_of(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_ids.encoded(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_ids", to_token_ids),
]

#: A trained chain, SimHash and a tokenizer aren't expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
