import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as X


def column(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["r"] for r in df.select("i", f(F.col("t")).alias("r")).orderBy("i").collect()]


def test_page_numbers(spark):
    yes = ["12", "xiv", "- 7 -", "[3]", "página 3 de 20", "3/20", "", "—"]
    no = ["Chapter 12", "1984 was a year", "12345", "xivv is no number"]
    assert column(spark, X.is_page_number, yes) == [True] * len(yes)
    assert column(spark, X.is_page_number, no) == [False] * len(no)


def test_running_key_leaves_numbers_aside(spark):
    a, b = column(spark, X.running_key, ["The Press   12", " the press 345"])
    assert a == b == "the press #"


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("ofﬁce", "office"), ("so­ft", "soft"), ("it’s", "it's"), ("a  \tb", "a b"), ("é", "é"), ("a\x07b", "ab"), (None, "")],
)
def test_clean(spark, given, wanted):
    assert column(spark, X.clean, [given]) == [wanted]


def test_fold(spark):
    assert column(spark, X.fold, ["CAPÍTULO 2 - As Colunas!", "capitulo 2: as colunas", "Straße 1"]) == ["capitulo2ascolunas", "capitulo2ascolunas", "straße1"]


def test_list_markers(spark):
    assert column(spark, X.list_marker, ["• one", "1. two", "a) three", "plain text", "1.two"]) == ["•", "1.", "a)", None, None]
    assert column(spark, X.list_rest, ["• one", "1. two", "plain"]) == ["one", "two", "plain"]


def test_capitals_and_chapters(spark):
    assert column(spark, X.is_all_caps, ["A LOMBADA PARTIDA", "A Lombada", "AB", None]) == [True, False, False, False]
    assert column(spark, X.is_chapter, ["Capítulo 3", "CAPÍTULO 3", "Chapter One", "chapters", "Partes", "a chapter"]) == [True, True, True, False, False, False]


def test_contents_entries(spark):
    assert column(spark, X.is_toc_entry, ["Part . . . . . 3", "Title  12", "Short 7", "Nothing here", "x" * 80 + " 7"]) == [True, True, True, False, False]


def test_half_points_round_to_even(spark):
    df = spark.createDataFrame([(10.25,), (10.75,), (9.5,)], "s double").select(X.half_point(F.col("s")).alias("h"))
    assert [r["h"] for r in df.collect()] == [10.0, 11.0, 9.5]


def test_names(spark):
    assert column(spark, X.stem, ["/a/the_salt_road.pdf", "x.y.pdf", "", None]) == ["the salt road", "x.y", "Documento", "Documento"]
    assert column(spark, X.safe_filename, ["../a b?.pdf", "", None]) == ["a b_.pdf", "documento.pdf", "documento.pdf"]
