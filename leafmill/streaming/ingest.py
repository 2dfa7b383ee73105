"""Arriving files: convert every micro-batch of new span tables.

Files are self-contained books, so no state is carried between batches; the
checkpoint of the stream remembers what was read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.operators import layout as L
from leafmill.options import Options
from leafmill.plans.pipeline import Conversion, Inputs
from leafmill.sources.spans import SPAN_SCHEMA


def stream_spans(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """Span tables that arrive as Parquet files in a folder."""
    return spark.readStream.schema(SPAN_SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def convert_stream(spans: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start a query that hands the lines of every batch to ``handle``."""

    def batch(df: DataFrame, batch_id: int) -> None:
        handle(L.lines_of(df), batch_id)

    return spans.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def convert_books_stream(spans: DataFrame, handle: Callable[[Conversion, int], None], checkpoint: str, options: Options | None = None) -> StreamingQuery:
    """Start a query that hands ``handle`` the whole conversion of every batch."""

    def batch(df: DataFrame, batch_id: int) -> None:
        handle(Conversion(Inputs.of_spans(df), options), batch_id)

    return spans.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_windows(jobs: DataFrame, window: str = "1 hour", late: str = "7 days") -> DataFrame:
    """Finished and failed jobs a window of event time; works on streams and tables.

    ``late`` bounds how long a stored job may trail its creation.
    """
    if jobs.isStreaming:
        j = jobs.withWatermark("created", late).dropDuplicatesWithinWatermark(["job_id"])
    else:
        j = jobs.dropDuplicates(["job_id"])
    status = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    return j.groupBy(F.window("created", window).alias("w")).agg(
        F.count("*").alias("jobs"), F.count_if(status == "done").alias("done"), F.count_if(status.isin("error", "failed")).alias("failed")
    ).select(F.col("w.start").alias("start"), "jobs", "done", "failed")
