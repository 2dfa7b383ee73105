"""Page recognition: where its data lies, and recognised pages as lines."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from glob import glob

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import layout as L
from leafmill.options import Options
from leafmill.sources.spans import recognise_pages

SUFFIX = ".traineddata"


def data_folder(folders: Sequence[str], variable: str = "TESSDATA_PREFIX") -> str | None:
    """The first folder that holds language data: the one the environment names,
    then ``folders`` in order; None if there is none."""
    named = os.environ.get(variable)
    for folder in ([named] if named else []) + list(folders):
        if glob(os.path.join(glob_safe(folder), f"*{SUFFIX}")):
            return folder
    return None


def glob_safe(folder: str) -> str:
    return "".join(f"[{c}]" if c in "*?[" else c for c in folder)


def languages_in(folder: str | None) -> list[str]:
    """Languages a folder has data for, in order."""
    found = glob(os.path.join(glob_safe(folder), f"*{SUFFIX}")) if folder else []
    return sorted(os.path.basename(f)[: -len(SUFFIX)] for f in found)


def resolved(spark: SparkSession, requested: str, available: Sequence[str]) -> str:
    """The requested languages that are there, or what stands in for them."""
    have = F.array(*map(F.lit, available)) if available else F.array().cast("array<string>")
    return spark.range(1).select(L.resolve_languages(F.lit(requested), have).alias("l")).first()["l"]


def recognised_lines(
    lines: DataFrame, pages: DataFrame, page_images: DataFrame, recogniser: Callable[[bytes, str, int], list[dict]], languages: Sequence[str], options: Options
) -> tuple[DataFrame, DataFrame]:
    """``lines`` with the pages read from images in place of their text layer, and
    ``book_id, page, failed`` of the pages tried.

    ``page_images`` has ``book_id, page, image``.  Only pages the plan names are
    read; without any language none is.  A page that fails, or gives nothing,
    keeps its text layer.
    """
    spark = lines.sparkSession
    lang, dpi = resolved(spark, options.ocr_lang, languages), options.ocr_dpi
    plan = L.recognition_plan(lines, pages, options.ocr if lang else "off").where("recognise").select(*L.PAGE)
    read = recognise_pages(page_images.where("image is not null").join(plan, L.PAGE, "left_semi"), lambda image: recogniser(image, lang, dpi))
    from leafmill.session import cut

    read = cut(read)
    tried = read.groupBy(*L.PAGE).agg(F.max(F.col("error").isNotNull()).alias("failed"))
    good = L.explode_recognised_blocks(read.where("error is null and trim(text) <> ''"))
    span = F.struct(F.lit(0).alias("span_seq"), F.col("text"), F.col("size"), F.lit(False).alias("bold"), F.lit(False).alias("italic"))
    good = good.withColumns({"spans": F.array(span), "bold": F.lit(False)})
    types = dict(lines.dtypes)
    good = good.select(*[F.col(c).cast(types[c]).alias(c) for c in lines.columns])
    kept = lines.join(good.select(*L.PAGE).distinct(), L.PAGE, "left_anti")
    return kept.unionByName(good), tried
