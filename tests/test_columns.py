"""Column functions and cleaning on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from citeweave.functions import columns as C
from citeweave.operators import cleaning
from citeweave.schema import PLACEHOLDERS, typed_schema


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_placeholders_are_exact(spark):
    assert values(spark, [(p,) for p in PLACEHOLDERS], "a string", C.real_string(F.col("a"))) == [None] * len(PLACEHOLDERS)
    assert values(spark, [(" ",), ("none",), ("N/A ",), (None,)], "a string", C.real_string(F.col("a"))) == [" ", "none", "N/A ", None]


def test_numbers(spark):
    assert values(spark, [("x",), ("-3",), ("0",), ("2.5",), (None,), ("NaN",)], "a string", C.number(F.col("a"))) == [None, 0.0, 0.0, 2.5, None, None]


def test_years(spark):
    assert values(spark, [(0.0,), (1800.0,), (1801.0,), (2026.0,), (2027.0,), (None,)], "a double", C.valid_year(F.col("a"), 2026)) == [None, None, 1801.0, 2026.0, None, None]


def test_document_types(spark):
    assert values(spark, [("Journal",), ("CONFERENCE",), ("Book",), (None,)], "a string", C.document_type(F.col("a"))) == ["journal", "conference", None, None]


def test_lists(spark):
    rows = [(None,), ([],), (["a", None],), (["a"],)]
    assert values(spark, rows, "a array<string>", C.valid_list(F.col("a"))) == [None, None, None, ["a"]]
    assert values(spark, rows, "a array<string>", C.valid_list(F.col("a"), empty=True)) == [[], [], [], ["a"]]
    assert values(spark, [(None,), ([" x ", "", None, " "],)], "a array<string>", C.clean_references(F.col("a"))) == [[], ["x"]]


def test_names(spark):
    assert values(spark, [("John Smith",), ("José",), ("Ann-Lee",), ("J. B.",), ("",)], "a string", C.is_name(F.col("a"))) == [True, False, False, False, False]


@pytest.mark.parametrize(
    "venue,kind,want",
    [("A Conference", "journal", "conference"), ("JOURNAL x", "conference", "journal"), ("Journal Conference", "journal", "conference"), ("Journal Conference", "conference", "journal"), ("Journal Conference", None, "journal"), ("conference", None, "conference"), (None, "journal", "journal"), ("x", None, None)],
)
def test_repaired_types(spark, venue, kind, want):
    assert values(spark, [(venue, kind)], "v string, k string", C.repaired_type(F.col("v"), F.col("k"))) == [want]


def test_texts(spark):
    row = [("T ", None, ["k1", "k2"], [("1", " A "), ("2", ""), (None, None)])]
    schema = "t string, a string, k array<string>, au array<struct<id:string,name:string>>"
    assert values(spark, row, schema, C.pair_text(F.col("t"), F.col("a"), F.col("k"), C.author_names(F.col("au")))) == ["T k1 k2 A"]
    assert values(spark, [(None,), ("  x ",)], "a string", C.normal_text(F.col("a"))) == ["", "x"]


def test_slug_and_grade(spark):
    assert values(spark, [(" A-b  C! ",), ("--",), ("É1",)], "a string", C.slug(F.col("a"))) == ["a_b_c", "default", "é1"]
    assert values(spark, [(0.86,), (0.85,), (0.65,), (0.40,)], "a double", C.grade(F.col("a"))) == ["Excellent", "Good", "Weak", "Poor"]


def test_year_bucket(spark):
    assert values(spark, [("1969",), ("1970",), ("x",), (None,)], "a string", C.year_bucket(F.col("a"))) == ["b_1970", "1970", "nan", "nan"]


def test_finite_and_cosine(spark):
    assert values(spark, [(float("inf"),), (float("nan"),), (None,), (1.5,)], "a double", C.finite(F.col("a"))) == [0.0, 0.0, 0.0, 1.5]
    assert values(spark, [([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>", F.round(C.cosine(F.col("a"), F.col("b")), 6)) == [0.0, 1.0]


def test_clean_types_keeps_other_columns(spark):
    rows = spark.createDataFrame([("1", "2020", "-", [], None, 7)], "id string, year string, venue string, references array<string>, keywords array<string>, other int")
    assert cleaning.clean_types(rows, 2026).first().asDict() == {"id": "1", "year": 2020.0, "venue": None, "references": [], "keywords": None, "other": 7}


def test_split_target(spark):
    rows = spark.createDataFrame([(1, 2, 3)], "a int, b int, y int")
    x, y = cleaning.split_target(rows, "y", ["b"])
    assert x.columns == ["a"] and y.columns == ["y"]
    with pytest.raises(KeyError):
        cleaning.split_target(rows, "z")


def test_prefix_and_split_selection(spark):
    rows = spark.createDataFrame([("Training", 1, 2), (" val", 3, 4)], "split string, keywords_a int, k int")
    assert cleaning.drop_prefixed(rows).columns == ["split", "k"]
    assert [r.k for r in cleaning.select_split(rows, "train").collect()] == [2]
    assert [r.k for r in cleaning.select_split(rows, "validation").collect()] == [4]


def test_typed_schema_has_pages():
    assert typed_schema(["n_pages", "id", "unknown"]).names == ["id", "n_pages"]
