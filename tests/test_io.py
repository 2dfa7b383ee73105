import pytest
from pyspark.sql import functions as F

from leafmill.operators import layout as L
from leafmill.sources import spans as src
from leafmill.streaming import ingest
from tests.sample import SPAN_TYPES, sample


class Page:
    class rect:
        width, height = 420.0, 595.0

    def get_text(self, _):
        span = {"text": "hello", "size": 10, "font": "F", "flags": 16, "bbox": (1, 2, 3, 4)}
        line = {"spans": [span], "bbox": (1, 2, 3, 4), "dir": (1, 0)}
        return {"blocks": [{"type": 0, "bbox": (1, 2, 3, 4), "lines": [line]}, {"type": 1, "bbox": (0, 0, 9, 9), "image": b"x", "ext": "png"}]}


class Doc(list):
    metadata = {"title": " T ", "author": None}


def test_rows_of_an_open_document():
    d = Doc([Page()])
    assert list(src.pdf_rows(d, "b", "p", "spans"))[0][:9] == ("b", 0, 0, 0, 0, "hello", 10.0, "F", 16)
    assert list(src.pdf_rows(d, "b", "p", "images")) == [("b", 0, 1, 0.0, 0.0, 9.0, 9.0, b"x", "png")]
    assert list(src.pdf_rows(d, "b", "p", "pages")) == [("b", 0, 420.0, 595.0)]
    assert list(src.pdf_rows(d, "b", "p", "books")) == [("b", "p", 1, {"title": "T", "author": ""})]


def test_pdf_source_says_what_it_needs(spark, tmp_path):
    pytest.importorskip("pyspark.sql.datasource")
    try:
        import fitz  # noqa: F401
    except ImportError:
        (tmp_path / "a.pdf").write_bytes(b"%PDF-")
        spark.dataSource.register(src.PdfDataSource)
        with pytest.raises(Exception, match="PyMuPDF"):
            spark.read.format("leafmill-pdf").option("paths", str(tmp_path / "*.pdf")).load().count()


def test_documents_as_lines(spark):
    d = spark.createDataFrame([(2, "a\n\n b ", "s"), (1, "first", "s"), (3, None, "s"), (2, "a\n\n b ", "s")], "doc_id long, text string, source string")
    got = [(r["page"], r["line_seq"], r["text"]) for r in src.documents_as_lines(d).orderBy("page", "line_seq").collect()]
    assert got == [(0, 0, "first"), (1, 0, "a"), (1, 2, "b")]


def test_recogniser_errors_are_reported(spark):
    def read(image):
        if image == b"bad":
            raise ValueError("no text")
        return [{"text": "word", "size": 9, "bbox": (0, 0, 1, 1)}]

    pages = spark.createDataFrame([("b", 0, b"ok"), ("b", 1, b"bad")], "book_id string, page int, image binary")
    got = {r["page"]: (r["text"], r["error"]) for r in src.recognise_pages(pages, read).collect()}
    assert got[0] == ("word", None)
    assert got[1][0] is None and "no text" in got[1][1]


def test_language_resolution(spark):
    df = spark.createDataFrame([("por+eng", ["eng", "deu"]), ("xyz", ["por", "eng"]), ("xyz", ["eng", "deu"]), ("xyz", [])], "r string, a array<string>")
    got = [r[0] for r in df.select(L.resolve_languages(F.col("r"), F.col("a"))).collect()]
    assert got == ["eng", "por", "deu", ""]


def test_recognition_plan(spark):
    lines = spark.createDataFrame([("b", 0, "x" * 200), ("c", 0, "y")], "book_id string, page int, text string")
    pages = spark.createDataFrame([("b", 1), ("c", 2)], "book_id string, pages long")
    got = {(r["book_id"], r["page"]): r["recognise"] for r in L.recognition_plan(lines, pages).collect()}
    assert got == {("b", 0): False, ("c", 0): True, ("c", 1): True}
    assert {r["recognise"] for r in L.recognition_plan(lines, pages, "force").collect()} == {True}


def test_stream_of_span_tables(spark, tmp_path):
    spark.createDataFrame(sample().rows, SPAN_TYPES).write.parquet(str(tmp_path / "in"))
    seen = []
    q = ingest.convert_stream(ingest.stream_spans(spark, str(tmp_path / "in")), lambda df, n: seen.append(df.count()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sum(seen) > 30


def test_binary_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"1")
    (tmp_path / "b.txt").write_bytes(b"2")
    assert src.binary_files(spark, str(tmp_path)).count() == 1


def test_documents_without_a_source_are_kept(spark, tmp_path):
    from leafmill.plans import catalog

    rows = [(1, "one\ntwo", "s"), (2, "three", None), (3, "four\n\nfive", None), (3, "four\n\nfive", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["book_id"]: (r["pages"], r["lines"]) for r in catalog.queries()["document_lines_all"](spark, str(tmp_path)).collect()}
    assert got == {"s": (1, 2), "(no source)": (2, 3)}


def test_recognised_pages_take_the_place_of_the_text_layer(spark):
    from leafmill.options import Options
    from leafmill.plans.pipeline import Conversion
    from leafmill.operators.document import warnings_of
    from tests.sample import Book, frames

    k = Book("scan")
    k.add(0, ["x"])
    k.add(1, ["kept as it is"])
    inputs = frames(spark, k, pages=2)
    inputs.page_images = spark.createDataFrame([("scan", 0, b"good"), ("scan", 1, b"bad")], "book_id string, page int, image binary")

    def read(image, lang, dpi):
        if image == b"bad":
            raise ValueError("unreadable")
        return [{"text": f"A recognised line in {lang} at {dpi}.", "size": 10, "bbox": (40, 200, 300, 212)}]

    c = Conversion(inputs, Options(ocr_dpi=200), read, ["eng", "deu"])
    assert [r["text"] for r in c.elements.orderBy("seq").collect()] == ["A recognised line in eng at 200.", "kept as it is"]
    r = c.stats.first()
    assert (r["recognised_pages"], r["failed_pages"]) == (1, 1)
    assert len(warnings_of(c.stats).first()["warnings"]) == 2
    assert Conversion(inputs, Options(ocr="off"), read, ["eng"]).recognised[1].count() == 0


def test_recognition_data(tmp_path, monkeypatch):
    from leafmill.sources import recognition

    monkeypatch.delenv("TESSDATA_PREFIX", raising=False)
    for folder, languages in (("a", ()), ("b", ("por", "eng")), ("c", ("deu",))):
        (tmp_path / folder).mkdir()
        for lang in languages:
            (tmp_path / folder / f"{lang}.traineddata").write_bytes(b"")
    folders = [str(tmp_path / x) for x in "abc"]
    assert recognition.data_folder(folders) == folders[1]
    assert recognition.languages_in(folders[1]) == ["eng", "por"]
    monkeypatch.setenv("TESSDATA_PREFIX", folders[2])
    assert recognition.data_folder(folders) == folders[2]
    assert recognition.data_folder([]) == folders[2] and recognition.languages_in(None) == []


def test_whole_conversion_of_a_batch(spark, tmp_path):
    spark.createDataFrame(sample().rows, SPAN_TYPES).write.parquet(str(tmp_path / "in"))
    seen = []
    q = ingest.convert_books_stream(ingest.stream_spans(spark, str(tmp_path / "in")), lambda c, n: seen.append(c.elements.where("kind = 'heading'").count()), str(tmp_path / "cp"))
    q.awaitTermination(200)
    assert sum(seen) > 3


def test_ranks_across_stretches_of_ids(spark, monkeypatch):
    monkeypatch.setattr(src, "PAGE_STRETCH", 3)
    d = spark.createDataFrame([(i, "t", "s" if i % 2 else None) for i in range(1, 21)], "doc_id long, text string, source string")
    got = {(r["book_id"], r["page"]) for r in src.documents_as_lines(d).collect()}
    assert got == {("s", p) for p in range(10)} | {(src.NO_SOURCE, p) for p in range(10)}
