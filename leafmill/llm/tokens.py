"""Problem 7: token ids of whole texts by a public byte-level BPE.

The vocabulary is a local rank file; no special tokens exist in it, so strings
that look like special tokens are encoded as ordinary text.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-splitting pattern of this vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts above this many code points are encoded piece by piece.
PIECE = 50_000
#: A cut before the single space of " x", where a non-space stands before it,
#: is always a boundary of PATTERN: " x" starts a match and nothing spans it.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str):
    """The tiktoken encoding of ``rank_file``, loaded once per worker."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(rank_file, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cut a long text at safe boundaries only; the pieces' ids concatenate to
    the ids of the whole.  Where no safe boundary follows, the piece runs on."""
    start = 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode(text: str | None, rank_file: str = RANK_FILE) -> list[int]:
    """Ids of one text; null and empty texts give an empty list."""
    if not text:
        return []
    enc = encoding(rank_file)
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text) for i in enc.encode_ordinary(p)]


def token_ids(text: Column, rank_file: str = RANK_FILE) -> Column:
    """Column of token ids (``array<int>``), Arrow-batched."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding(rank_file)
        for s in batches:
            yield pd.Series([encode(t, rank_file) for t in s], dtype=object)

    return ids(text)


def decode_bytes(ids: Column, rank_file: str = RANK_FILE) -> Column:
    """The raw bytes behind a list of ids; a list cut anywhere stays decodable
    because no character is assembled here."""

    @F.pandas_udf(T.BinaryType())
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(rank_file)
        for s in batches:
            yield pd.Series([None if x is None else enc.decode_bytes([int(i) for i in x]) for x in s], dtype=object)

    return raw(ids)


def corpus_ids(documents: DataFrame, rank_file: str = RANK_FILE) -> DataFrame:
    """``doc_id, ids``: one row per ``doc_id`` of the whole corpus.

    Null and empty texts give an empty list.  Rows repeated under one
    ``doc_id`` count once (of differing texts the longest, then the greatest,
    null last).  A null ``doc_id`` is no record.  Other columns are ignored.
    Only ids and texts are shuffled, never the longer id lists.
    """
    one = (
        documents.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max(F.struct(F.length("text").alias("n"), F.col("text").alias("t")))["t"].alias("text"))
    )
    return one.select("doc_id", token_ids(F.col("text"), rank_file).alias("ids"))
