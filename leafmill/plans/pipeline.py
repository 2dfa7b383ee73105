"""The whole conversion as one plan over many books."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import document as D
from leafmill.operators import layout as L
from leafmill.operators import structure as S
from leafmill.options import Options
from leafmill.session import cut, table
from leafmill.sources.recognition import recognised_lines
from leafmill.sources.spans import IMAGE_SCHEMA, PAGE_SCHEMA, PdfDataSource, clean_metadata


@dataclass
class Inputs:
    """The engine's input contract."""

    spans: DataFrame
    images: DataFrame
    page_info: DataFrame
    books: DataFrame

    #: ``book_id, page, image`` of rendered pages, for recognition.
    page_images: DataFrame | None = None

    @classmethod
    def read(cls, spark: SparkSession, d: str) -> Inputs:
        spans, images, page_info, books = (table(spark, d, t) for t in ("span_facts", "image_facts", "page_info", "books"))
        return cls(spans, images, page_info, books.withColumn("metadata", clean_metadata(F.col("metadata"))))

    @classmethod
    def of_files(cls, spark: SparkSession, paths: list[str]) -> Inputs:
        """From PDF files or globs, decoded on the executors."""
        spark.dataSource.register(PdfDataSource)
        load = lambda t: spark.read.format(PdfDataSource.name()).option("paths", "\n".join(paths)).option("table", t).load()
        return cls(*(load(t) for t in ("spans", "images", "pages", "books")))

    @classmethod
    def of_spans(cls, spans: DataFrame) -> Inputs:
        """From spans alone: no images, pages of the usual size, books named by
        their id."""
        spark = spans.sparkSession
        books = spans.where("book_id is not null").select("book_id").distinct()
        books = books.select("book_id", F.col("book_id").alias("path"), F.lit(None).cast("int").alias("page_count"), F.lit(None).cast("map<string,string>").alias("metadata"))
        return cls(spans, spark.createDataFrame([], IMAGE_SCHEMA), spark.createDataFrame([], PAGE_SCHEMA), books)


class Conversion:
    """Stages of a conversion, each built when first asked for.

    Stages that several later ones read are cut into the checkpoint folder, so
    they are computed once and no plan grows with the number of stages.
    """

    def __init__(self, inputs: Inputs, options: Options | None = None, recogniser: Callable[[bytes, str, int], list[dict]] | None = None, languages: Sequence[str] = ()):
        """``recogniser`` reads a page image, given the languages and resolution of
        the options; ``languages`` are those it has data for."""
        self.inputs, self.options = inputs, options or Options()
        self.recogniser, self.languages = recogniser, languages

    @cached_property
    def text_lines(self) -> DataFrame:
        """Lines of the text layer."""
        return cut(L.lines_of(self.inputs.spans))

    @cached_property
    def recognised(self) -> tuple[DataFrame, DataFrame]:
        """Lines with recognised pages in place, and the pages tried."""
        if self.recogniser is None or self.inputs.page_images is None:
            return self.text_lines, self.text_lines.select(*L.PAGE, F.lit(False).alias("failed")).limit(0)
        pages = L.page_counts(self.inputs.books, self.text_lines)
        lines, tried = recognised_lines(self.text_lines, pages, self.inputs.page_images, self.recogniser, self.languages, self.options)
        return cut(lines), tried

    @cached_property
    def all_lines(self) -> DataFrame:
        return self.recognised[0]

    @cached_property
    def pages(self) -> DataFrame:
        return cut(L.page_counts(self.inputs.books, self.all_lines))

    @cached_property
    def text(self) -> DataFrame:
        return L.book_text(self.all_lines, self.pages)

    @cached_property
    def images(self) -> DataFrame:
        return cut(L.kept_images(self.found_images, self.text))

    @cached_property
    def found_images(self) -> DataFrame:
        return L.images_of(self.inputs.images, self.inputs.page_info, self.options.keep_images)

    @cached_property
    def blocks(self) -> DataFrame:
        parsed = L.text_blocks(self.all_lines)
        boxes = parsed.unionByName(self.images.select(*parsed.columns).dropDuplicates(L.BLOCK))
        return cut(L.reading_order(L.assign_columns(boxes, L.column_splits(parsed, self.inputs.page_info))))

    @cached_property
    def running(self) -> DataFrame:
        return L.running_lines(self.all_lines, self.inputs.page_info, self.pages, self.options.running_share)

    @cached_property
    def lines(self) -> DataFrame:
        kept = L.without_running(self.all_lines, self.inputs.page_info, self.running)
        return cut(kept.join(self.blocks.select(*L.BLOCK, "col", "read_seq"), L.BLOCK))

    @cached_property
    def body(self) -> DataFrame:
        return cut(S.body_font_size(self.lines))

    @cached_property
    def paragraphs(self) -> DataFrame:
        paras = S.paragraphs(S.paragraph_breaks(self.lines, self.body), self.blocks)
        return cut(S.with_body(L.with_page_size(paras, self.inputs.page_info), self.body))

    @cached_property
    def merged(self) -> DataFrame:
        return cut(S.merged_headings(S.without_toc(self.paragraphs)))

    @cached_property
    def classified(self) -> DataFrame:
        return cut(S.classify(self.bodied, S.heading_anchors(self.bodied.where(S.is_heading()))))

    @cached_property
    def bodied(self) -> DataFrame:
        return cut(S.without_running_titles(self.merged))

    @cached_property
    def ordered(self) -> DataFrame:
        before_drops = self.paragraphs if self.options.compat_image_anchor else None
        return cut(D.elements_of(self.classified, self.images, self.blocks, before_drops))

    @cached_property
    def elements(self) -> DataFrame:
        return cut(S.without_noise(S.merge_continuations(D.split_notes(self.ordered, self.options.footnotes)[0])))

    @cached_property
    def notes(self) -> DataFrame:
        return D.split_notes(self.ordered, self.options.footnotes)[1]

    @cached_property
    def titles(self) -> DataFrame:
        return D.inferred_titles(self.elements, self.inputs.books, self.options)

    @cached_property
    def stats(self) -> DataFrame:
        """Figures of each book, with the counts of what was left out or read anew."""
        figures = D.book_stats(self.elements, self.notes, self.inputs.books, self.body, self.pages)
        figures = figures.join(self.text.select("book_id", "scanned"), "book_id", "left")
        for counted in self._counters():
            figures = figures.join(counted, "book_id", "left")
        return figures.fillna(0, ["toc_pages_dropped", "running_titles_dropped", "full_page_images_dropped", "recognised_pages", "failed_pages"])

    def _counters(self) -> Iterator[DataFrame]:
        n = lambda df, name: df.groupBy("book_id").agg(F.count("*").alias(name))
        yield n(S.toc_pages(self.paragraphs), "toc_pages_dropped")
        titles = n(self.merged, "before").join(n(self.bodied, "after"), "book_id", "left")
        yield titles.select("book_id", (F.col("before") - F.coalesce("after", F.lit(0))).alias("running_titles_dropped"))
        covering = self.found_images.where("full_page").join(self.text.where("drops_full_page").select("book_id"), "book_id", "left_semi")
        yield n(covering, "full_page_images_dropped")
        yield self.recognised[1].groupBy("book_id").agg(F.count_if(~F.col("failed")).alias("recognised_pages"), F.count_if("failed").alias("failed_pages"))

    def styled(self) -> DataFrame:
        d = D.front_duplicates(self.elements, self.titles)
        return D.styled(d.where("not duplicate") if self.options.title_page else d, self.options)
