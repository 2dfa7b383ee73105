"""Geometry: spans to lines, images, columns and reading order.

Every function takes and gives DataFrames keyed by ``book_id, page, ...``; rows
repeated in full count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions.text import has, is_page_number, nfc, running_key, utrim

LINE = ["book_id", "page", "block_seq", "line_seq"]
BLOCK = ["book_id", "page", "block_seq"]
PAGE = ["book_id", "page"]
HEADER_ZONE = 0.075
FOOTER_ZONE = 0.925
BINS = 200


def decode_spans(spans: DataFrame) -> DataFrame:
    """Spans with composed text, size to two places, bold and italic from flags or font."""
    font = F.lower(F.coalesce("font", F.lit("")))
    flags = F.coalesce("flags", F.lit(0))
    return (
        spans.where("text is not null and text <> ''")
        .withColumns(
            {
                "text": nfc(F.col("text")),
                "size": F.coalesce(F.round("size", 2), F.lit(0.0)),
                "bold": (flags.bitwiseAND(16) != 0) | has(font, "bold|black"),
                "italic": (flags.bitwiseAND(2) != 0) | has(font, "italic|oblique"),
                "vertical": F.abs(F.coalesce("dir_x", F.lit(1.0))) < 0.7,
            }
        )
        .drop("flags", "dir_x", "dir_y")
    )


def lines_of(spans: DataFrame) -> DataFrame:
    """Horizontal, non-empty lines: text, mean size by characters, bold where more
    than 0.6 of the characters are, the parsed boxes and the spans in order.

    One shuffle, on the line key; repeated spans fall together in the set.
    """
    d = decode_spans(spans)
    item = F.struct("span_seq", "text", "size", "bold", "italic")
    box = ["l_x0", "l_y0", "l_x1", "l_y1", "b_x0", "b_y0", "b_x1", "b_y1"]
    g = (
        d.where("not vertical")
        .groupBy(*LINE)
        .agg(F.sort_array(F.collect_set(item)).alias("spans"), *[F.min(c).alias(c) for c in box])
    )
    zero = F.lit(0.0)
    n_all = F.aggregate("spans", zero, lambda a, s: a + F.length(s["text"]))
    weighted = F.aggregate("spans", zero, lambda a, s: a + s["size"] * F.length(s["text"]))
    solid = lambda s: F.length(utrim(s["text"]))
    n_solid = F.aggregate("spans", zero, lambda a, s: a + solid(s))
    n_bold = F.aggregate("spans", zero, lambda a, s: a + F.when(s["bold"], solid(s)).otherwise(0))
    return (
        g.withColumn("text", utrim(F.array_join("spans.text", "")))
        .where("text <> ''")
        .withColumns(
            {
                "size": F.round(weighted / n_all, 4),
                "bold": n_bold > 0.6 * n_solid,
                "x0": F.col("l_x0"),
                "top": F.col("l_y0"),
                "x1": F.col("l_x1"),
                "bottom": F.col("l_y1"),
            }
        )
        .drop("l_x0", "l_y0", "l_x1", "l_y1")
    )


def page_sizes(page_info: DataFrame) -> DataFrame:
    """One width and height a page, A4 where the file has none."""
    return page_info.groupBy(*PAGE).agg(F.max("width").alias("width"), F.max("height").alias("height"))


def with_page_size(df: DataFrame, page_info: DataFrame) -> DataFrame:
    j = df.join(page_sizes(page_info), PAGE, "left")
    return j.withColumns({"width": F.coalesce("width", F.lit(595.0)), "height": F.coalesce("height", F.lit(842.0))})


def images_of(image_facts: DataFrame, page_info: DataFrame, keep: bool = True) -> DataFrame:
    """Images with bytes that are not tiny; digest instead of bytes, and whether
    one covers the page.  The bytes are joined again only by the sink."""
    i = image_facts.where("image is not null and octet_length(image) > 0" if keep else "false")
    i = i.select(*BLOCK, "x0", "y0", "x1", "y1", "ext", F.sha1("image").alias("digest")).distinct()
    i = with_page_size(i, page_info)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    area, page_area = w * h, F.col("width") * F.col("height")
    return i.where((w >= 40) & (h >= 40) & (area >= 0.01 * page_area)).withColumn("full_page", area > 0.8 * page_area)


def text_blocks(lines: DataFrame) -> DataFrame:
    """Text blocks with the box the parser gave."""
    return lines.groupBy(*BLOCK).agg(
        F.min("b_x0").alias("x0"), F.min("b_y0").alias("y0"), F.min("b_x1").alias("x1"), F.min("b_y1").alias("y1")
    )


def column_splits(blocks: DataFrame, page_info: DataFrame) -> DataFrame:
    """``book_id, page, splits``: x positions between the columns of each page,
    an empty array where there is one column.

    The widths of narrow blocks are rasterised into 200 bins; wide enough empty
    runs inside the page split it, if every band then holds two narrow blocks.
    All of it is array algebra over one page's few blocks.
    """
    b = with_page_size(blocks, page_info).withColumn("narrow", F.col("x1") - F.col("x0") < 0.7 * F.col("width"))
    p = b.groupBy(*PAGE).agg(
        F.max("width").alias("width"),
        F.count("*").alias("n"),
        F.collect_list(F.when(F.col("narrow"), F.struct("x0", "x1"))).alias("iv"),
    )
    bin_of = lambda x: F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(x / F.col("width") * BINS).cast("int")))
    spans = F.transform("iv", lambda s: F.struct(bin_of(s["x0"]).alias("a"), bin_of(s["x1"]).alias("b")))
    p = p.withColumn("bins", spans)
    empty = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: ~F.exists("bins", lambda s: (s["a"] <= i) & (i <= s["b"])))
    p = p.withColumn("empty", empty)
    # an empty bin opens a run if the one before is not empty, and closes it likewise
    starts = F.filter("empty", lambda i: ~F.array_contains("empty", i - 1))
    ends = F.filter("empty", lambda i: ~F.array_contains("empty", i + 1))
    runs = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    wide = F.filter(runs, lambda r: (r["a"] > 0) & (r["b"] < BINS - 1) & (r["b"] - r["a"] + 1 >= max(2, int(BINS * 0.035))))
    centres = F.transform(wide, lambda r: (r["a"] + r["b"] + 1) / 2.0 / BINS)
    inside = F.filter(centres, lambda c: (c > 0.2) & (c < 0.8))
    p = p.withColumn("cand", F.transform(inside, lambda c: c * F.col("width")))
    edges = F.concat(F.array(F.lit(float("-inf"))), F.col("cand"), F.array(F.lit(float("inf"))))
    bands = F.arrays_zip(F.slice(edges, 1, F.size("cand") + 1).alias("lo"), F.slice(edges, 2, F.size("cand") + 1).alias("hi"))
    centre = lambda s: (s["x0"] + s["x1"]) / 2
    full = F.forall(bands, lambda q: F.size(F.filter("iv", lambda s: (centre(s) >= q["lo"]) & (centre(s) <= q["hi"]))) >= 2)
    enough = (F.col("n") >= 4) & (F.size("iv") >= 4)
    return p.select(*PAGE, F.when(enough & (F.size("cand") > 0) & full, F.col("cand")).otherwise(F.array().cast("array<double>")).alias("splits"))


def assign_columns(blocks: DataFrame, splits: DataFrame) -> DataFrame:
    """Blocks with ``col``: splits left of the centre, 0 if the box straddles one."""
    j = blocks.join(splits, PAGE, "left").withColumn("splits", F.coalesce("splits", F.array().cast("array<double>")))
    centre = (F.col("x0") + F.col("x1")) / 2
    straddles = F.exists("splits", lambda s: (F.col("x0") < s) & (s < F.col("x1")))
    return j.withColumn("col", F.when(straddles, 0).otherwise(F.size(F.filter("splits", lambda s: centre > s)))).drop("splits")


def reading_order(blocks: DataFrame) -> DataFrame:
    """Blocks with ``read_seq``, their place in the page from 0."""
    order = W.partitionBy(*PAGE).orderBy("col", F.round("y0", 1), "x0", "block_seq")
    return blocks.withColumn("read_seq", F.row_number().over(order) - 1)


def margin(df: DataFrame) -> Column:
    return (F.col("top") < HEADER_ZONE * F.col("height")) | (F.col("bottom") > FOOTER_ZONE * F.col("height"))


def page_counts(books: DataFrame, lines: DataFrame) -> DataFrame:
    """``book_id, pages``: as the file says, else one more than the last page seen."""
    said = books.groupBy("book_id").agg(F.max("page_count").alias("said"))
    seen = lines.groupBy("book_id").agg((F.max("page") + 1).alias("seen"))
    return seen.join(said, "book_id", "full").select("book_id", F.coalesce("said", "seen").cast("long").alias("pages"))


def running_lines(lines: DataFrame, page_info: DataFrame, pages: DataFrame, share: float = 0.35) -> DataFrame:
    """``book_id, running_key, n_pages``: keys of margin lines on enough pages."""
    m = with_page_size(lines, page_info).where(margin(lines)).withColumn("running_key", running_key(F.col("text")))
    n = m.where("running_key <> ''").groupBy("book_id", "running_key").agg(F.count_distinct("page").alias("n_pages"))
    need = F.greatest(F.lit(3), F.floor(F.col("pages") * share))
    return n.join(pages, "book_id").where(F.col("n_pages") >= need).select("book_id", "running_key", "n_pages")


def without_running(lines: DataFrame, page_info: DataFrame, running: DataFrame) -> DataFrame:
    """Lines that are neither running lines nor page numbers of a margin."""
    sized = with_page_size(lines, page_info).withColumn("in_margin", margin(lines)).withColumn("running_key", running_key(F.col("text")))
    keys = running.select("book_id", "running_key", F.lit(True).alias("runs"))
    kept = sized.join(keys, ["book_id", "running_key"], "left")
    dropped = F.col("in_margin") & (F.coalesce("runs", F.lit(False)) | is_page_number(F.col("text")))
    return kept.where(~dropped).drop("runs", "running_key", "in_margin")


def recomputed_boxes(lines: DataFrame) -> DataFrame:
    """Boxes of the blocks that still have lines."""
    return lines.groupBy(*BLOCK).agg(
        F.min("x0").alias("x0"), F.min("top").alias("y0"), F.max("x1").alias("x1"), F.max("bottom").alias("y1"), F.count("*").alias("n_lines")
    )


def book_text(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Characters a book and page, and whether it looks like a scan."""
    n = lines.groupBy("book_id").agg(F.sum(F.length("text")).alias("text_chars"))
    j = pages.join(n, "book_id", "left").withColumn("text_chars", F.coalesce("text_chars", F.lit(0)))
    per = F.col("text_chars") / F.greatest(F.lit(1), F.col("pages"))
    return j.withColumns({"chars_per_page": F.round(per, 4), "scanned": per < 80, "drops_full_page": per >= 200})


def kept_images(images: DataFrame, text: DataFrame) -> DataFrame:
    """Images that stay: no page scans in books with text, none repeated on
    nearly a third of the pages."""
    i = images.join(text.select("book_id", "pages", "drops_full_page"), "book_id")
    i = i.where(~(F.col("full_page") & F.col("drops_full_page")))
    n = F.count("*").over(W.partitionBy("book_id", "digest"))
    repeated = (F.col("pages") >= 4) & (F.col("n_same") >= F.greatest(F.lit(3), F.floor(F.col("pages") * 0.3)))
    return i.withColumn("n_same", n).where(~repeated).drop("pages", "drops_full_page", "n_same")


def sampled_text_layer(lines: DataFrame, pages: DataFrame, sample: int = 10, least: int = 100) -> DataFrame:
    """Whether up to ten evenly spaced pages hold text enough to skip recognition."""
    k = F.least(F.lit(sample), F.col("pages")).cast("int")
    at = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.floor(i * (F.col("pages") - 1) / F.greatest(F.lit(1), k - 1)).cast("int"))
    picked = pages.where("pages > 0").select("book_id", F.explode(F.array_distinct(at)).alias("page"))
    chars = lines.groupBy(*PAGE).agg(F.sum(F.length("text")).alias("n"))
    mean = picked.join(chars, PAGE, "left").groupBy("book_id").agg(
        F.count("*").alias("sampled"), F.round(F.avg(F.coalesce("n", F.lit(0))), 4).alias("mean_chars")
    )
    return mean.withColumn("has_text", F.col("mean_chars") >= least)


def recognition_plan(lines: DataFrame, pages: DataFrame, mode: str = "auto") -> DataFrame:
    """``book_id, page, chars, recognise``: which pages to send to recognition."""
    every = pages.where("pages > 0").select("book_id", F.explode(F.sequence(F.lit(0), (F.col("pages") - 1).cast("int"))).alias("page"))
    chars = lines.groupBy(*PAGE).agg(F.sum(F.length("text")).alias("chars"))
    j = every.join(chars, PAGE, "left").withColumn("chars", F.coalesce("chars", F.lit(0)))
    if mode == "off":
        return j.withColumn("recognise", F.lit(False))
    if mode == "force":
        return j.withColumn("recognise", F.lit(True))
    text = sampled_text_layer(lines, pages).select("book_id", "has_text")
    return j.join(text, "book_id", "left").select(
        *PAGE, "chars", (~F.coalesce("has_text", F.lit(False)) & (F.col("chars") < 100)).alias("recognise")
    )


def explode_recognised_blocks(lines: DataFrame) -> DataFrame:
    """Recognised pages: every line its own block, with the line's box."""
    order = W.partitionBy(*PAGE).orderBy("block_seq", "line_seq")
    return lines.withColumn("block_seq", F.row_number().over(order) - 1).withColumns(
        {"line_seq": F.lit(0), "b_x0": F.col("x0"), "b_y0": F.col("top"), "b_x1": F.col("x1"), "b_y1": F.col("bottom")}
    )


def resolve_languages(requested: Column, available: Column) -> Column:
    """Languages of ``a+b`` that are there, in order; else ``por``, else the first
    of the others, else empty."""
    found = F.array_intersect(F.split(requested, "[+]"), available)
    rest = F.when(F.array_contains(available, "por"), F.lit("por")).when(F.size(available) > 0, F.sort_array(available)[0]).otherwise(F.lit(""))
    return F.when(F.size(found) > 0, F.array_join(found, "+")).otherwise(rest)
