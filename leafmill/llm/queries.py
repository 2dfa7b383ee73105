"""The training-text queries, by name, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import leakage, lookalike, mojibake, notices, quality, residue, scans, sentences, tokens
from leafmill.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return notices.repeated_lines(table(spark, d, "book_lines"))


def p1_kept_lines(spark: SparkSession, d: str) -> DataFrame:
    kept = notices.without_repeated_lines(table(spark, d, "book_lines"))
    return kept.select("book_id", "page", "block_seq", "line_seq", "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_spans(table(spark, d, "span_facts"))


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored_spans(table(spark, d, "span_facts"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_places(table(spark, d, "span_facts"), table(spark, d, "elements"))


def p3_consistent(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent_texts(table(spark, d, "span_facts"), table(spark, d, "elements"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(table(spark, d, "elements"), table(spark, d, "common_words"))


def p4_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_statistics(table(spark, d, "elements"), table(spark, d, "common_words")).drop("text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.element_sentences(table(spark, d, "elements"), table(spark, d, "span_facts"), table(spark, d, "common_words"), table(spark, d, "book_lines"))


def p5_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.all_sentences(table(spark, d, "elements"), table(spark, d, "book_lines"), table(spark, d, "common_words"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_noise(table(spark, d, "book_lines"))


def p6_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.reflowed_paragraphs(table(spark, d, "book_lines"))


def p6_runs(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired_runs(table(spark, d, "elements"), table(spark, d, "book_lines"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.corpus_ids(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaking_documents(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_lengths(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_lengths(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(table(spark, d, "documents"))


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(table(spark, d, "documents")).select("doc_id", "source", "text")


_QUERIES = [p1_found, p1_kept_lines, p2_found, p2_restored, p3_found, p3_consistent, p4_found, p4_statistics, p5_found, p5_sentences, p6_found, p6_paragraphs, p6_runs, p7_ids, p8_found, p8_lengths, p9_found, p9_kept]


def queries() -> dict:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {}
