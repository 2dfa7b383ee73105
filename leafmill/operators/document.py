"""Documents: elements in order, title, author, figures, styles and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import structure as S
from leafmill.options import Options

CONTENT_WIDTH_CM = 12.0
SECTION_TITLES = {"toc": "Sumário", "notes": "Notas"}
ELEMENT = ["book_id", "seq", "kind", "level", "marker", "runs", "text", "digest", "image_w", "image_h", "ext", "page"]


def elements_of(classified: DataFrame, images: DataFrame, body_blocks: DataFrame, before_drops: DataFrame | None = None) -> DataFrame:
    """Typed elements and images of every book in reading order (``seq``).

    An image stands where its block is read, between the paragraphs around it;
    with ``before_drops``, the paragraphs as they were before any was dropped or
    merged, it stands before the paragraph of the number it had among those.
    """
    runs = S.runs_of(F.col("lines"))
    runs = F.when(F.col("kind") == "list_item", S.strip_marker(runs)).otherwise(runs)
    null = lambda t: F.lit(None).cast(t)
    paras = classified.withColumn("runs", runs).select(
        "book_id", "page", "read_seq", F.col("para").alias("part"), "kind", "level", "marker", "runs",
        S.run_text(F.col("runs")).alias("text"), null("string").alias("digest"), null("double").alias("image_w"),
        null("double").alias("image_h"), null("string").alias("ext"),
    )
    place = body_blocks.select("book_id", "page", "block_seq", "read_seq")
    pictures = images.join(place, ["book_id", "page", "block_seq"]).select(
        "book_id", "page", "read_seq", F.lit(0).cast("long").alias("part"), F.lit("image").alias("kind"), F.lit(0).alias("level"),
        F.lit("").alias("marker"), F.array().cast("array<struct<text:string,bold:boolean,italic:boolean>>").alias("runs"),
        F.lit("").alias("text"), "digest", (F.col("x1") - F.col("x0")).alias("image_w"), (F.col("y1") - F.col("y0")).alias("image_h"), "ext",
    )
    if before_drops is None:
        return _numbered(paras.unionByName(pictures)).select(*ELEMENT)
    return _by_ordinal(paras, pictures, before_drops).select(*ELEMENT)


def _by_ordinal(paras: DataFrame, pictures: DataFrame, before_drops: DataFrame) -> DataFrame:
    place = ["book_id", "page", "read_seq", "part", "kind"]
    old = before_drops.select("book_id", "page", "read_seq", F.col("para").alias("part"), F.lit("paragraph").alias("kind"))
    order = W.partitionBy("book_id").orderBy("page", "read_seq", "part", "kind")
    counted = old.unionByName(pictures.select(*place)).withColumn("no", F.count_if(F.col("kind") != "image").over(order))
    numbers = _numbered(paras.select(*place, "digest")).select(*place, F.col("seq").cast("long").alias("no")).unionByName(counted.where("kind = 'image'").distinct())
    # at one number images come first, among themselves as they are read
    seq = F.row_number().over(W.partitionBy("book_id").orderBy("no", F.col("kind") != "image", "page", "read_seq", "part")) - 1
    places = numbers.withColumn("seq", seq.cast("int")).select(*place, "seq")
    return paras.unionByName(pictures).join(places, place)


def _numbered(items: DataFrame) -> DataFrame:
    """Items with ``seq``, their place in the book from 0: the rank in the page
    and, joined to it, how many items the pages before hold.  No window sees more
    than a page of items, or a book's pages as bare counts."""
    before = F.sum("n").over(W.partitionBy("book_id").orderBy("page").rowsBetween(W.unboundedPreceding, -1))
    first = items.groupBy("book_id", "page").agg(F.count("*").alias("n")).select("book_id", "page", F.coalesce(before, F.lit(0)).alias("first"))
    rank = F.row_number().over(W.partitionBy("book_id", "page").orderBy("read_seq", "part", "kind", "digest"))
    return items.withColumn("rank", rank).join(first, ["book_id", "page"]).withColumn("seq", (F.col("first") + F.col("rank") - 1).cast("int"))


def split_notes(elements: DataFrame, policy: str = "end") -> tuple[DataFrame, DataFrame]:
    """Elements and end notes by the footnote policy end, inline or drop."""
    note = F.col("kind") == "note"
    if policy == "inline":
        return elements, elements.where("false")
    notes = elements.where(note & (F.length(X.utrim(F.col("text"))) > 2)) if policy == "end" else elements.where("false")
    return elements.where(~note), notes


def inferred_titles(elements: DataFrame, books: DataFrame, options: Options | None = None) -> DataFrame:
    """``book_id, title, author``: from metadata, else from the first elements."""
    o = options or Options()
    order = W.partitionBy("book_id").orderBy("seq")
    first = elements.select("book_id", "seq", "page", "kind", "text").withColumn("rn", F.row_number().over(order)).where("rn <= 12")
    fits = (F.length("text") > 3) & (F.length("text") < 120)
    front = (F.col("rn") <= 6) & (F.col("page") == 0)
    g = first.groupBy("book_id").agg(
        F.min_by(F.when(fits & (F.col("kind") == "heading"), F.col("text")), F.when(fits & (F.col("kind") == "heading"), F.col("rn"))).alias("of_heading"),
        F.min_by(F.when(fits & (F.col("kind") == "paragraph") & (F.col("rn") <= 6), F.col("text")), F.when(fits & (F.col("kind") == "paragraph") & (F.col("rn") <= 6), F.col("rn"))).alias("of_paragraph"),
        F.transform(F.array_sort(F.collect_list(F.when(front, F.struct("rn", "text")))), lambda s: X.utrim(s["text"])).alias("front"),
    )
    one = books.groupBy("book_id").agg(
        F.max(F.col("metadata").getItem("title")).alias("m_title"), F.max(F.col("metadata").getItem("author")).alias("m_author"), F.max("path").alias("path")
    )
    j = one.join(g, "book_id", "left")
    said = X.utrim(X.sanitize(F.col("m_title")))
    good = (F.length(said) > 3) & ~F.lower(said).endswith(".pdf")
    title = F.coalesce(F.when(good, said), F.col("of_heading"), F.col("of_paragraph"), X.stem(F.col("path")))
    j = j.withColumn("title", title)
    author = X.utrim(X.sanitize(F.col("m_author")))
    rest = F.slice("front", 2, F.greatest(F.lit(0), F.size("front") - 1))
    byline = F.filter(rest, lambda t: (F.length(t) > 3) & (F.length(t) <= 60) & ~X.has(t, "[.!?]$") & (t != F.col("title")))
    front_ok = F.coalesce(F.size("front").between(2, 4), F.lit(False))
    j = j.withColumn("author", F.when(author != "", author).when(front_ok, F.coalesce(F.get(byline, F.lit(0)), F.lit(""))).otherwise(""))
    if o.title:
        j = j.withColumn("title", X.sanitize(F.lit(o.title)))
    if o.author:
        j = j.withColumn("author", X.sanitize(F.lit(o.author)))
    return j.select("book_id", "title", "author")


def book_stats(elements: DataFrame, notes: DataFrame, books: DataFrame, body: DataFrame, page_counts: DataFrame) -> DataFrame:
    """One row of figures a book; books without elements or pages count zero."""
    n = elements.groupBy("book_id").agg(
        F.count("*").alias("elements"),
        F.count_if(F.col("kind") == "heading").alias("headings"),
        F.count_if(F.col("kind") == "paragraph").alias("paragraphs"),
        F.count_if(F.col("kind") == "image").alias("images"),
        F.count_if(F.col("kind") == "note").alias("inline_notes"),
    )
    e = notes.groupBy("book_id").agg(F.count("*").alias("end_notes"))
    pages = books.select("book_id").distinct().join(page_counts.select("book_id", "pages"), "book_id", "left")
    j = pages.join(n, "book_id", "left").join(e, "book_id", "left").join(body, "book_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return j.select(
        "book_id", zero("pages").alias("pages"), zero("elements").alias("elements"), zero("headings").alias("headings"), zero("paragraphs").alias("paragraphs"),
        zero("images").alias("images"), (zero("inline_notes") + zero("end_notes")).alias("notes"),
        F.coalesce("body", F.lit(10.0)).alias("body_font_size"),
    )


def warnings_of(stats: DataFrame) -> DataFrame:
    """``book_id, warnings``: what a reader of the result should know, in the order
    of the stages.

    ``stats`` may carry ``scanned``, ``recognised_pages``, ``failed_pages`` and
    ``toc_pages_dropped``; what is missing or null gives no warning.
    """
    there = set(stats.columns)
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int") if c in there else F.lit(0)
    scanned = F.coalesce(F.col("scanned"), F.lit(False)) if "scanned" in there else F.lit(False)
    read, failed, toc = number("recognised_pages"), number("failed_pages"), number("toc_pages_dropped")
    found = F.array(
        F.when(read > 0, F.format_string("recognition: %d page(s) read from images", read)),
        F.when(failed > 0, F.format_string("recognition: %d page(s) failed, their text layer was kept", failed)),
        F.when(scanned & (read == 0), F.lit("scanned: hardly any text layer")),
        F.when(toc > 0, F.format_string("contents: %d page(s) left out", toc)),
        F.when((F.col("headings") == 0) & (F.coalesce("pages", F.lit(0)) > 5), F.lit("headings: none found")),
    )
    return stats.select("book_id", F.filter(found, lambda w: w.isNotNull()).alias("warnings"))


def front_duplicates(elements: DataFrame, titles: DataFrame) -> DataFrame:
    """Elements with ``duplicate``: title or author repeated at the very front."""
    order = W.partitionBy("book_id").orderBy("seq")
    # the rank is bounded before anything is shuffled: six narrow rows a book
    front = elements.select("book_id", "seq", "page", "kind", "text").withColumn("rn", F.row_number().over(order)).where("rn <= 6")
    front = front.withColumn("later", F.max(F.col("page") > 0).over(order))
    keys = titles.select("book_id", X.front_key(F.col("title")).alias("k1"), X.front_key(F.col("author")).alias("k2"))
    key = X.front_key(F.col("text"))
    same = (key != "") & ((key == F.col("k1")) | (key == F.col("k2")))
    found = front.where(~F.coalesce("later", F.lit(False)) & F.col("kind").isin("heading", "paragraph")).join(keys, "book_id").where(same)
    marks = found.select("book_id", "seq", F.lit(True).alias("duplicate"))
    return elements.join(marks, ["book_id", "seq"], "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))


def image_width_cm(width_pt: Column) -> Column:
    return F.when(F.coalesce(width_pt, F.lit(0.0)) <= 0, CONTENT_WIDTH_CM).otherwise(F.least(F.lit(CONTENT_WIDTH_CM), width_pt / 72 * 2.54))


def acceptable_image(ext: Column) -> Column:
    return F.coalesce(F.lower(ext).isin("png", "jpeg", "jpg", "gif", "bmp", "tiff", "tif"), F.lit(False))


def styled(elements: DataFrame, options: Options | None = None) -> DataFrame:
    """Elements with ``style`` and ``page_break``; images no document can hold
    fall out before the element that follows looks back."""
    o = options or Options()
    kept = elements.where((F.col("kind") != "image") | acceptable_image(F.col("ext")))
    order = W.partitionBy("book_id").orderBy("seq")
    places = kept.select("book_id", "seq", F.lag("kind").over(order).alias("before"), (F.row_number().over(order) == 1).alias("first"))
    before, first = F.col("before"), F.col("first")
    level = F.greatest(F.lit(1), F.least(F.lit(3), F.when(F.coalesce("level", F.lit(0)) == 0, 1).otherwise(F.col("level"))))
    style = (
        F.when(F.col("kind") == "heading", F.concat(F.lit("Heading "), level.cast("string")))
        .when(F.col("kind") == "paragraph", F.when(before.isNull() | before.isin("heading", "image"), "Body First").otherwise("Body"))
        .when(F.col("kind") == "list_item", F.when(F.col("level") == 1, "List Number").otherwise("List Bullet"))
        .when(F.col("kind") == "note", "Note")
        .otherwise("Figure")
    )
    heading = F.col("kind") == "heading"
    chapter = heading & (level == 1) & ~first & F.lit(o.page_break_chapters)
    opening = heading & first & F.lit(o.toc or o.title_page)
    return kept.join(places, ["book_id", "seq"]).withColumns({"style": style, "page_break": chapter | opening}).drop("before", "first")


def notes_section(notes: DataFrame) -> DataFrame:
    """End notes in order, each with its page before it."""
    order = W.partitionBy("book_id").orderBy("seq")
    return notes.select(
        "book_id",
        F.row_number().over(order).cast("long").alias("note_no"),
        F.concat(F.format_string("[p. %d] ", (F.col("page") + 1).cast("int")), F.col("text")).alias("text"),
    )
