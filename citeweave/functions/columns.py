"""Column functions: cleaning rules, text and list normalisation, buckets, keyed hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeweave.schema import DOC_TYPES, PLACEHOLDERS

EMPTY_LIST = "array<string>"


def real_string(c: Column) -> Column:
    """Null for the strings that stand for a missing value."""
    return F.when(~c.isin(*PLACEHOLDERS), c)


def number(c: Column) -> Column:
    """A double; null if it can't be read or isn't a number, 0 if it is negative."""
    x = c.try_cast("double")
    x = F.when(~F.isnan(x), x)
    return F.when(x <= 0, 0.0).otherwise(x)


def valid_year(c: Column, max_year: int) -> Column:
    """The year if it lies in (1800, max_year]."""
    return F.when((c > 1800) & (c <= max_year), c)


def document_type(c: Column) -> Column:
    return F.when(F.lower(c).isin(*DOC_TYPES), F.lower(c))


def valid_list(c: Column, empty: bool = False) -> Column:
    """The list if it has elements and no null; else null, or the empty list."""
    good = (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull())
    return F.when(good, c).otherwise(F.array().cast(EMPTY_LIST)) if empty else F.when(good, c)


def clean_references(c: Column) -> Column:
    """Trimmed references without nulls and blanks; the empty list for null."""
    return F.coalesce(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast(EMPTY_LIST))


def is_name(c: Column) -> Column:
    """ASCII letters and white space only."""
    return c.rlike(r"^[A-Za-z\s]+$")


def n_pages(start: Column, end: Column) -> Column:
    return end - start + 1


def normal_text(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def author_names(authors: Column) -> Column:
    """Names of a list of authors, trimmed, without blanks, joined by a comma."""
    return F.coalesce(F.array_join(F.filter(F.transform(authors, lambda a: F.trim(a["name"])), lambda n: n != ""), ", "), F.lit(""))


def pair_text(title: Column, abstract: Column, keywords: Column, names: Column | None = None) -> Column:
    """Title, abstract, keywords (and author names) joined by spaces, blanks left out."""
    parts = [F.nullif(F.trim(c), F.lit("")) for c in (title, abstract, F.array_join(keywords, " "), *([names] if names is not None else []))]
    return F.concat_ws(" ", *parts)


def repaired_type(venue: Column, doc_type: Column) -> Column:
    """Document type by its venue: a venue named after the other type wins, and fills a missing type."""
    conference, journal = F.lower(venue).contains("conference"), F.lower(venue).contains("journal")
    return F.when(conference & (doc_type == "journal"), "conference").when(journal & (doc_type == "conference"), "journal").when(doc_type.isNull() & journal, "journal").when(doc_type.isNull() & conference, "conference").otherwise(doc_type)


def year_bucket(year: Column) -> Column:
    """Directory of a year: nan, b_1970 or the year."""
    y = year.try_cast("int")
    return F.when(y.isNull(), "nan").when(y < 1970, "b_1970").otherwise(y.cast("string"))


def finite(c: Column) -> Column:
    """0 for null, NaN and the infinities."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def grade(p: Column) -> Column:
    return F.when(p > 0.85, "Excellent").when(p > 0.65, "Good").when(p > 0.40, "Weak").otherwise("Poor")


def slug(c: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")
    return F.when(out != "", out).otherwise("default")


#: Parts of a table's name, and the folder of its models; the first that fits counts.
FAMILIES = (("embeddings", ("embedding", "textual")), ("graph_based", ("graph",)), ("mix", ("mix", "mixed", "hybrid")), ("normal", ("normal", "classic", "raw", "exploded")))


def feature_family(name: Column) -> Column:
    """The family of a feature table by its name; the name's slug if none fits."""
    value = slug(name)
    return F.coalesce(*(F.when(value.rlike("|".join(parts)), family) for family, parts in FAMILIES), value)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def keyed(seed: object, *keys: Column) -> Column:
    """A hash that both engines compute alike: MD5 of the seed and keys. Replaces seeded random draws."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)))


def keyed_number(n: Column | int, seed: object, *keys: Column) -> Column:
    """A keyed number in [0, n)."""
    return F.conv(F.substring(keyed(seed, *keys), 1, 8), 16, 10).cast("long") % (F.lit(n) if isinstance(n, int) else n)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one has norm 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norms = norm(a) * norm(b)
    return F.when(norms > 0, dot / norms).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
