"""Schemas and naming contracts of the paper tables."""

from __future__ import annotations

from pyspark.sql import types as T

AUTHOR = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "name", "org")])

# The column groups of the paper table, the strings that stand for a missing value, the document types,
# and the columns that are never features.
STRING_COLUMNS = ("id", "title", "lang", "doc_type", "venue", "issn", "isbn", "doi", "abstract")
NUMERIC_COLUMNS = ("year", "n_citation", "page_start", "page_end", "volume", "issue", "n_pages")
LIST_COLUMNS = ("references", "keywords", "url")
STRUCT_LIST_COLUMNS = ("authors",)
PLACEHOLDERS = ("None", "nan", "NaN", "N/A", "", "-", "/", "?", "null")
DOC_TYPES = ("conference", "journal")
RESERVED_COLUMNS = ("article_id", "ref_id", "is_reference_valid", "split")
DROPPED_AFTER_CLEANING = ("isbn", "issn", "issue", "volume", "page_start", "page_end")
PAIR_KEY = ("article_id", "ref_id", "is_reference_valid")


def _field(name: str) -> T.StructField:
    if name in NUMERIC_COLUMNS:
        return T.StructField(name, T.DoubleType())
    if name in LIST_COLUMNS:
        return T.StructField(name, T.ArrayType(T.StringType()))
    if name in STRUCT_LIST_COLUMNS:
        return T.StructField(name, T.ArrayType(AUTHOR))
    return T.StructField(name, T.StringType())


PAPER_RAW = T.StructType(
    [T.StructField(n, T.StringType()) if n in ("year", "n_citation", "page_start", "page_end", "volume", "issue") else _field(n) for n in ("id", "title", "year", "authors", "lang", "doc_type", "venue", "references", "keywords", "abstract", "n_citation", "page_start", "page_end", "volume", "issue", "issn", "isbn", "doi", "url")]
)
PAPER_CLEAN = T.StructType([_field(n) for n in ("id", "title", "year", "authors", "lang", "doc_type", "venue", "references", "keywords", "abstract", "n_citation", "n_pages", "doi", "url")])


def typed_schema(columns: list[str]) -> T.StructType:
    """The checkpoint schema of a table: its declared columns by group, in the groups' order."""
    groups = (*STRING_COLUMNS, *NUMERIC_COLUMNS, *LIST_COLUMNS, *STRUCT_LIST_COLUMNS)
    return T.StructType([_field(n) for n in groups if n in columns])
