"""Readers that bring files into the engine's input contract.

``span_facts`` is the contract; PDF decoding needs PyMuPDF, which is imported
only where a file is read and is not needed for anything else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from leafmill.functions.text import utrim

SPAN_SCHEMA = (
    "book_id string, page int, block_seq int, line_seq int, span_seq int, text string, size double, font string, flags int, "
    "x0 double, y0 double, x1 double, y1 double, dir_x double, dir_y double, l_x0 double, l_y0 double, l_x1 double, l_y1 double, "
    "b_x0 double, b_y0 double, b_x1 double, b_y1 double"
)
IMAGE_SCHEMA = "book_id string, page int, block_seq int, x0 double, y0 double, x1 double, y1 double, image binary, ext string"
PAGE_SCHEMA = "book_id string, page int, width double, height double"
BOOK_SCHEMA = "book_id string, path string, page_count int, metadata map<string,string>"
_SCHEMAS = {"spans": SPAN_SCHEMA, "images": IMAGE_SCHEMA, "pages": PAGE_SCHEMA, "books": BOOK_SCHEMA}


def stored(spark: SparkSession, folder: str, name: str = "span_facts") -> DataFrame:
    """A table of the contract that was written as Parquet."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def clean_metadata(metadata: Column) -> Column:
    """Metadata with stripped values; nulls become empty strings."""
    return F.transform_values(metadata, lambda _, v: utrim(F.coalesce(v, F.lit(""))))


#: Ids that are ranked together; bounds the rows of one window.
PAGE_STRETCH = 100_000
#: The book of documents whose source is null.
NO_SOURCE = "(no source)"


def documents_as_lines(documents: DataFrame) -> DataFrame:
    """Plain texts in the shape of lines: one book a source, one page a document;
    the documents without a source make the book ``NO_SOURCE``.

    The page number is the rank of ``doc_id`` in its source; geometry is whole
    numbers, so that layout rules can run on it.
    """
    from pyspark.sql import Window as W

    d = documents.where("text is not null and doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text"), F.coalesce(F.max("source"), F.lit(NO_SOURCE)).alias("book_id"))
    # ranks of a stretch of ids, and how many the stretches before hold: a source
    # with a large share of all documents is spread over its stretches
    stretch = F.floor(F.col("doc_id") / PAGE_STRETCH)
    ids = d.select("book_id", "doc_id", stretch.alias("stretch"))
    before = F.sum("n").over(W.partitionBy("book_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1))
    first = ids.groupBy("book_id", "stretch").agg(F.count("*").alias("n")).select("book_id", "stretch", F.coalesce(before, F.lit(0)).alias("first"))
    rank = F.row_number().over(W.partitionBy("book_id", "stretch").orderBy("doc_id"))
    pages = ids.withColumn("rank", rank).join(first, ["book_id", "stretch"]).select("doc_id", (F.col("first") + F.col("rank") - 1).cast("int").alias("page"))
    p = d.join(pages, "doc_id")
    lines = p.select("book_id", "page", F.posexplode(F.split("text", "\n")).alias("line_seq", "text"))
    t = utrim(F.col("text"))
    return lines.withColumn("text", t).where("text <> ''").select(
        "book_id", "page", F.lit(0).alias("block_seq"), "line_seq", "text", F.lit(10.0).alias("size"), F.lit(False).alias("bold"),
        F.lit(40.0).alias("x0"), (F.col("line_seq") * 14.0).alias("top"), (F.length("text") * 5 + 40.0).alias("x1"), (F.col("line_seq") * 14.0 + 10.0).alias("bottom"),
    )


def binary_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Files as rows of path and bytes; globs are expanded by the reader."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _PdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split("\n") if p]
        self.what = options.get("table", "spans")
        if self.what not in _SCHEMAS:
            raise ValueError(f"table must be one of {', '.join(_SCHEMAS)}")

    def partitions(self) -> list[InputPartition]:
        import glob

        found = [f for p in self.paths for f in (sorted(glob.glob(p)) if any(c in p for c in "*?[") else [p])]
        return [_File(f) for f in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            import fitz
        except ImportError as e:
            raise ImportError("reading PDF files needs PyMuPDF on the executors; span tables can be read without it") from e
        import os

        book = os.path.splitext(os.path.basename(partition.path))[0]
        doc = fitz.open(partition.path)
        try:
            yield from pdf_rows(doc, book, partition.path, self.what)
        finally:
            doc.close()


def pdf_rows(doc, book: str, path: str, what: str) -> Iterator[tuple]:
    """Rows of one table from an open document that offers page dictionaries."""
    if what == "books":
        meta = {str(k): str(v or "").strip() for k, v in (doc.metadata or {}).items()}
        yield book, path, len(doc), meta
        return
    for number, page in enumerate(doc):
        if what == "pages":
            yield book, number, float(page.rect.width), float(page.rect.height)
            continue
        for b, block in enumerate(page.get_text("dict")["blocks"]):
            box = tuple(map(float, block["bbox"]))
            if block.get("type") == 1:
                if what == "images":
                    yield (book, number, b, *box, block.get("image"), block.get("ext"))
                continue
            if what != "spans":
                continue
            for i, line in enumerate(block.get("lines", ())):
                d = line.get("dir", (1.0, 0.0))
                for s, span in enumerate(line.get("spans", ())):
                    yield (
                        book, number, b, i, s, span.get("text", ""), float(span.get("size", 0)), span.get("font", ""), int(span.get("flags", 0)),
                        *map(float, span["bbox"]), float(d[0]), float(d[1]), *map(float, line["bbox"]), *box,
                    )


class PdfDataSource(DataSource):
    """``spark.read.format("leafmill-pdf").option("table", "spans")``: one
    partition a file; tables spans, images, pages and books."""

    @classmethod
    def name(cls) -> str:
        return "leafmill-pdf"

    def schema(self) -> str:
        return _SCHEMAS[self.options.get("table", "spans")]

    def reader(self, schema) -> DataSourceReader:
        return _PdfReader(self.options)


def recognise_pages(pages: DataFrame, recogniser: Callable[[bytes], list[dict]]) -> DataFrame:
    """Lines recognised in page images, with an error instead of a failed task.

    ``pages`` has ``book_id, page, image``; ``recogniser`` gives dictionaries with
    text, size and a box of four numbers.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for book, page, image in zip(pdf["book_id"], pdf["page"], pdf["image"], strict=True):
                try:
                    for i, x in enumerate(recogniser(bytes(image))):
                        out.append((book, page, i, 0, x["text"], float(x["size"]), *map(float, x["bbox"]), None))
                except Exception as e:  # a page that fails is reported, the others go on
                    out.append((book, page, 0, 0, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["book_id", "page", "block_seq", "line_seq", "text", "size", "x0", "top", "x1", "bottom", "error"])

    return pages.mapInPandas(
        run, "book_id string, page int, block_seq int, line_seq int, text string, size double, x0 double, top double, x1 double, bottom double, error string"
    )
