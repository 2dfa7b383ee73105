"""All registered queries of the core library and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import document as D
from leafmill.operators import layout as L
from leafmill.operators import structure as S
from leafmill.plans import sql
from leafmill.plans.pipeline import Conversion, Inputs
from leafmill.session import table
from leafmill.sinks import docx
from leafmill.sources import spans
from leafmill.streaming import ingest

LINE = L.LINE
PARA = ["book_id", "page", "read_seq", "para"]


def _c(spark: SparkSession, d: str) -> Conversion:
    return Conversion(Inputs.read(spark, d))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return L.lines_of(table(spark, d, "span_facts"))


def _elements(spark: SparkSession, d: str) -> DataFrame:
    """The stored elements, each record once, in the shape of our own."""
    runs = F.coalesce("runs", F.array().cast("array<struct<text:string,bold:boolean,italic:boolean>>"))
    e = table(spark, d, "elements").withColumn("runs", runs).withColumn("text", F.array_join(F.transform("runs", lambda r: F.coalesce(r["text"], F.lit(""))), ""))
    e = e.dropDuplicates(["book_id", "el_seq"])
    return e.withColumnsRenamed({"el_seq": "seq", "image_ext": "ext"})


def span_decode(spark, d):
    s = L.decode_spans(table(spark, d, "span_facts"))
    return s.select(*LINE, "span_seq", "text", "size", "bold", "italic").distinct()


def lines_built(spark, d):
    return _lines(spark, d).select(*LINE, "text", "size", "bold", "x0", "top", "x1", "bottom")


def lines_normalized(spark, d):
    return _lines(spark, d).select(*LINE, X.running_key(F.col("text")).alias("running_key"))


def page_number_lines(spark, d):
    s = L.with_page_size(_lines(spark, d), table(spark, d, "page_info"))
    return s.where(L.margin(s) & X.is_page_number(F.col("text"))).select(*LINE, "text")


def running_lines(spark, d):
    return _c(spark, d).running


def lines_without_running(spark, d):
    c = _c(spark, d)
    return L.without_running(c.all_lines, c.inputs.page_info, c.running).select(*LINE, "text")


def blocks_recomputed(spark, d):
    c = _c(spark, d)
    return L.recomputed_boxes(L.without_running(c.all_lines, c.inputs.page_info, c.running))


def column_splits(spark, d):
    s = L.column_splits(L.text_blocks(_lines(spark, d)), table(spark, d, "page_info"))
    return s.select("book_id", "page", F.explode("splits").alias("split")).withColumn("split", F.round("split", 6))


def reading_order(spark, d):
    return _c(spark, d).blocks.select(*L.BLOCK, "col", "read_seq")


def images_kept(spark, d):
    i = _c(spark, d).images
    return i.select(*L.BLOCK, "digest", "ext", "full_page", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))


def image_digests(spark, d):
    i = L.images_of(table(spark, d, "image_facts"), table(spark, d, "page_info"))
    return i.groupBy("book_id", "digest").agg(F.count("*").alias("n"), F.count_distinct("page").alias("n_pages"))


def scanned_flags(spark, d):
    return _c(spark, d).text.select("book_id", "pages", "text_chars", "chars_per_page", "scanned")


def text_layer_sampling(spark, d):
    c = _c(spark, d)
    return L.sampled_text_layer(c.all_lines, c.pages)


def recognition_plan(spark, d):
    c = _c(spark, d)
    return L.recognition_plan(c.all_lines, c.pages)


def page_coverage(spark, d):
    p = L.page_sizes(table(spark, d, "page_info"))
    return p.select("book_id", "page", F.round("width", 4).alias("width"), F.round("height", 4).alias("height"))


def body_font_size(spark, d):
    return _c(spark, d).body


def paragraph_split(spark, d):
    c = _c(spark, d)
    return S.paragraph_breaks(c.lines, c.body).select(*LINE, "para")


def paragraph_stats(spark, d):
    return _c(spark, d).paragraphs.select(*PARA, "text", F.col("n_lines").cast("long").alias("n_lines"), "size", "bold", "x0", "x1", "top", "bottom")


def toc_pages(spark, d):
    return S.toc_pages(_c(spark, d).paragraphs)


def paragraphs_without_toc(spark, d):
    return S.without_toc(_c(spark, d).paragraphs).select(*PARA, "text")


def heading_candidates(spark, d):
    return S.without_toc(_c(spark, d).paragraphs).where(S.is_heading()).select(*PARA, "text")


def heading_levels(spark, d):
    h = S.without_toc(_c(spark, d).paragraphs).where(S.is_heading())
    j = h.join(S.heading_anchors(h), "book_id")
    return j.select(*PARA, S.heading_level(F.col("size"), F.col("text"), F.col("anchors")).alias("level"))


def footnotes(spark, d):
    return S.without_toc(_c(spark, d).paragraphs).where(S.is_note()).select(*PARA, "text")


def all_caps_lines(spark, d):
    return _lines(spark, d).where(X.is_all_caps(F.col("text"))).select(*LINE, "text")


def list_items(spark, d):
    t = F.col("text")
    p = _c(spark, d).paragraphs.where(X.list_marker(t).isNotNull() & (F.length(t) < 1200))
    return p.select(*PARA, X.list_marker(t).alias("marker"), X.list_rest(t).alias("rest"))


def chapter_lines(spark, d):
    return _lines(spark, d).where(X.is_chapter(F.col("text"))).select(*LINE, "text")


def sanitize_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", X.utrim(X.clean(F.col("text"))).alias("text")).distinct()


def fold_keys(spark, d):
    return _c(spark, d).paragraphs.select(*PARA, X.fold(F.col("text")).alias("fold"))


def running_titles(spark, d):
    c = _c(spark, d)
    return c.merged.join(S.without_running_titles(c.merged), PARA, "left_anti").select(*PARA, "text")


def split_headings_merged(spark, d):
    return _c(spark, d).merged.select(*PARA, "text", "n_lines")


def classified(spark, d):
    return _c(spark, d).classified.select(*PARA, "kind", "level", "marker")


def converted_elements(spark, d):
    return _c(spark, d).elements.select("book_id", "seq", "kind", "level", "marker", "text", "page")


def converted_runs(spark, d):
    e = _c(spark, d).elements.select("book_id", "seq", F.posexplode("runs").alias("run_no", "run"))
    return e.select("book_id", "seq", "run_no", "run.text", "run.bold", "run.italic")


def title_author(spark, d):
    return _c(spark, d).titles


def book_stats(spark, d):
    return _c(spark, d).stats


def book_warnings(spark, d):
    return D.warnings_of(_c(spark, d).stats)


def results_json(spark, d):
    c = _c(spark, d)
    j = c.stats.join(c.titles, "book_id").join(D.warnings_of(c.stats), "book_id")
    return j.select("book_id", F.to_json(F.struct(*[x for x in j.columns])).alias("result"))


def docx_render(spark, d):
    c = _c(spark, d)
    pictures = c.inputs.images.where("image is not null").select(F.sha1("image").alias("digest"), "image")
    f = docx.documents(c.styled(), c.notes, c.titles, pictures, c.options)
    return f.select("book_id", "file_name", F.length("docx").alias("n_bytes"))


def element_counts(spark, d):
    k = F.col("kind")
    return _elements(spark, d).groupBy("book_id").agg(
        F.count("*").alias("elements"), F.count_if(k == "heading").alias("headings"), F.count_if(k == "paragraph").alias("paragraphs"),
        F.count_if(k == "image").alias("images"), F.count_if(k == "note").alias("notes"),
    )


def toc_outline(spark, d):
    level = F.greatest(F.lit(1), F.least(F.lit(3), F.when(F.coalesce("level", F.lit(0)) == 0, 1).otherwise(F.col("level"))))
    return _elements(spark, d).where("kind = 'heading'").select("book_id", F.col("seq").alias("el_seq"), level.alias("level"), "text")


def style_selection(spark, d):
    return D.styled(_elements(spark, d)).select("book_id", F.col("seq").alias("el_seq"), "style", "page_break")


def image_widths(spark, d):
    e = _elements(spark, d).where("kind = 'image'")
    return e.select("book_id", F.col("seq").alias("el_seq"), F.round(D.image_width_cm(F.col("image_w")), 6).alias("width_cm"), D.acceptable_image(F.col("ext")).alias("accepted"))


def notes_section(spark, d):
    return D.notes_section(_elements(spark, d).where("kind = 'note'"))


def continuations(spark, d):
    e = _elements(spark, d).where("kind <> 'note'")
    kept = S.merge_continuations(e.select("book_id", "seq", "kind", "runs", "text"))
    gone = e.select("book_id", "seq").join(kept.select("book_id", "seq"), ["book_id", "seq"], "left_anti")
    return gone.withColumnRenamed("seq", "el_seq")


def metadata_titles(spark, d):
    m = lambda k: X.utrim(X.sanitize(F.max(F.col("metadata").getItem(k))))
    return table(spark, d, "books").groupBy("book_id").agg(m("title").alias("title"), m("author").alias("author"), X.stem(F.max("path")).alias("fallback"))


def safe_names(spark, d):
    return table(spark, d, "convert_jobs").where("name is not null").select("job_id", X.safe_filename(F.col("name")).alias("safe_name")).distinct()


def job_windows(spark, d):
    return ingest.job_windows(table(spark, d, "convert_jobs"), "1 hour")


def document_lines(spark, d):
    """Plain texts as lines: pages and lines of every source that is named."""
    return _book_lines(table(spark, d, "documents").where("source is not null"))


def document_lines_all(spark, d):
    """The same of all documents, those without a source included."""
    return _book_lines(table(spark, d, "documents"))


def _book_lines(documents: DataFrame) -> DataFrame:
    lines = spans.documents_as_lines(documents)
    return lines.groupBy("book_id").agg(F.count_distinct("page").alias("pages"), F.count("*").alias("lines"), F.max("x1").alias("widest"))


_QUERIES = [
    span_decode, lines_built, lines_normalized, page_number_lines, running_lines, lines_without_running, blocks_recomputed, column_splits,
    reading_order, images_kept, image_digests, scanned_flags, text_layer_sampling, recognition_plan, page_coverage, body_font_size, paragraph_split,
    paragraph_stats, toc_pages, paragraphs_without_toc, heading_candidates, heading_levels, footnotes, all_caps_lines, list_items, chapter_lines,
    sanitize_clean, fold_keys, running_titles, split_headings_merged, classified, converted_elements, converted_runs, title_author, book_stats,
    book_warnings, results_json, docx_render, element_counts, toc_outline, style_selection, image_widths, notes_section, continuations,
    metadata_titles, safe_names, job_windows, document_lines, document_lines_all,
]


def queries() -> dict:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
