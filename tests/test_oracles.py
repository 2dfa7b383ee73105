"""The SQL of the conversion queries on a book that has what the tables lack:
columns, a page of contents, running titles, split headings, page bitmaps."""

import duckdb
import pytest

from leafmill.plans import catalog, sql
from tests.sample import Book, frames, sample

QUERIES = {  # and the least rows each must give here
    "column_splits": 1, "reading_order": 20, "toc_pages": 1, "paragraphs_without_toc": 15, "running_lines": 2, "running_titles": 2, "body_font_size": 2, "fold_keys": 20,
    "split_headings_merged": 20, "classified": 15, "heading_levels": 3, "footnotes": 1, "list_items": 3, "converted_elements": 15, "converted_runs": 15, "title_author": 2,
    "book_stats": 2, "images_kept": 1, "scanned_flags": 2,
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    k = sample()
    k.add(3, ["Chapter 9 -"], top=300, size=17, flags=16, width=110)
    k.add(3, ["A heading in two pieces"], top=322, size=17, flags=16, width=210)
    small = Book("small")
    small.add(0, [[("mostly small words in this line ", 0), ("BIG", 0)]])
    small.rows = [(*r[:6], 8.0 if "small" in r[5] else 30.0, *r[7:]) for r in small.rows]
    k.rows += small.rows
    image = [("sample", 5, 40, 40.0, 320.0, 280.0, 410.0, b"\x89PNG", "png"), ("sample", 2, 41, 0.0, 0.0, 420.0, 595.0, b"scan", "png")]
    i = frames(spark, k, image)
    books = i.books.unionByName(spark.createDataFrame([("small", "/in/s.pdf", 1, {"title": "Told", "author": " A "})], i.books.schema))
    out = tmp_path_factory.mktemp("tables")
    for name, df in (("span_facts", i.spans), ("image_facts", i.images), ("page_info", i.page_info), ("books", books)):
        df.toPandas().to_parquet(out / f"{name}.parquet") if name != "books" else df.coalesce(1).write.parquet(str(out / "books.parquet"))
    return str(out)


@pytest.fixture(scope="module")
def conversion(spark, folder):
    return catalog.Conversion(catalog.Inputs.read(spark, folder))


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", QUERIES)
def test_query_and_sql_agree(spark, folder, conversion, monkeypatch, name):
    monkeypatch.setattr(catalog, "_c", lambda s, d: conversion)
    df = catalog.queries()[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=repr)
    db = duckdb.connect()
    for t in ("span_facts", "image_facts", "page_info"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    db.sql(f"CREATE VIEW books AS SELECT * FROM '{folder}/books.parquet/*.parquet'")
    rel = db.sql(sql.ORACLES[name])
    at = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(rounded(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want
    assert len(got) >= QUERIES[name]
