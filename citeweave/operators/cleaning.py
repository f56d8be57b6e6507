"""Cleaning of the paper table: one projection, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.functions import columns as C
from citeweave.schema import DROPPED_AFTER_CLEANING, LIST_COLUMNS, NUMERIC_COLUMNS, STRING_COLUMNS, STRUCT_LIST_COLUMNS


def clean_types(papers: DataFrame, max_year: int) -> DataFrame:
    """All type rules: placeholders, numbers, years, document types, lists; columns in no group stay as they are."""
    out = []
    for name in papers.columns:
        c = F.col(name)
        if name in STRING_COLUMNS:
            c = C.real_string(c.cast("string"))
            c = C.document_type(c) if name == "doc_type" else c
        elif name in NUMERIC_COLUMNS:
            c = C.number(c)
            c = C.valid_year(c, max_year) if name == "year" else c
        elif name in LIST_COLUMNS:
            c = C.valid_list(c, empty=name == "references")
        elif name in STRUCT_LIST_COLUMNS:
            c = C.valid_list(c)
        out.append(c.alias(name))
    return papers.select(*out)


def add_n_pages(papers: DataFrame) -> DataFrame:
    return papers.withColumn("n_pages", C.n_pages(F.col("page_start"), F.col("page_end")))


def drop_columns(rows: DataFrame, names: Sequence[str] = DROPPED_AFTER_CLEANING) -> DataFrame:
    return rows.drop(*names)


def drop_prefixed(rows: DataFrame, prefix: str = "keywords_") -> DataFrame:
    return rows.select(*(c for c in rows.columns if not c.startswith(prefix)))


def repair_types(papers: DataFrame) -> DataFrame:
    return papers.withColumn("doc_type", C.repaired_type(F.col("venue"), F.col("doc_type")))


def repair_counts(papers: DataFrame) -> DataFrame:
    """How many rows each repair rule concerns; one row."""
    conference, journal = F.lower("venue").contains("conference"), F.lower("venue").contains("journal")
    kind = F.col("doc_type")
    return papers.agg(
        F.count_if(conference & (kind == "journal")).alias("journal_to_conference"),
        F.count_if(journal & (kind == "conference")).alias("conference_to_journal"),
        F.count_if(kind.isNull() & conference).alias("null_to_conference"),
        F.count_if(kind.isNull() & journal).alias("null_to_journal"),
    )


def select_split(rows: DataFrame, split: str) -> DataFrame:
    """Rows of a split by any of its names."""
    names = {"train": ("train", "training"), "validation": ("validation", "val"), "test": ("test",)}[split]
    return rows.where(F.lower(F.trim("split")).isin(*names))


def train_and_test(rows: DataFrame, *order: str, train_share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Train and the rest by the split's names; where either is missing, the first part of the rows by ``order``."""
    if "split" in rows.columns:
        name = F.lower("split")
        train, test = rows.where(name.isin("train", "training")), rows.where(name.isin("test", "validation", "val"))
        if not train.isEmpty() and not test.isEmpty():
            return train, test
    from citeweave.operators.ordering import dense_index

    marked = rows.withColumn("_o", F.struct(*order))
    index, n = dense_index(marked, "_o")
    placed = marked.join(index, "_o")
    cut = int(n * train_share)
    return tuple(placed.where(side).drop("_o", "idx") for side in (F.col("idx") < cut, F.col("idx") >= cut))


def numeric_columns(rows: DataFrame) -> list[str]:
    return [f.name for f in rows.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "boolean")]


def numeric_matrix(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """All other columns as finite doubles."""
    return rows.select(*keep, *(C.finite(F.col(c).try_cast("double")).alias(c) for c in rows.columns if c not in keep))


def split_target(rows: DataFrame, target: str, drop: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Features and target of a table."""
    if target not in rows.columns:
        raise KeyError(target)
    return rows.drop(target, *drop), rows.select(target)
