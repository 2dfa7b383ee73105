"""Problem 1: lines repeated across the pages of one book.

Every page is one stream of letters, without line breaks, cut into
content-defined chunks: a cut stands where a rolling hash of the last letters
is the least of its neighbourhood.  Chunks are counted by distinct pages of
their book; lines that hold chunks repeated excessively are compared with the
few frequent readings they share such a chunk with, and the lines of a reading
found on enough pages are the cases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.textkeys import glyphs, is_page_number, letters

LINE_KEY = ["book_id", "page", "block_seq", "line_seq"]
WINDOW = 4  # letters under the rolling hash
REACH = 2  # a cut is the least hash among this many neighbours on either side
MIN_PAGES = 5
MIN_SHARE = 0.1
MISREAD = 2  # letters by which two lines may differ and still read the same
CENTRE_SHARE = 0.25  # a reading leads a group if it stands alone on this share of the pages needed

_MUL = np.uint64(0x9E3779B97F4A7C15)  # fixed odd multiplier of the hash


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MUL
    return x ^ (x >> np.uint64(29))


def chunk_spans(stream: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content-defined chunks of a letter stream: starts, ends and 64-bit hashes.

    The start and the end of the stream are cuts too; an empty stream has none.
    """
    n = len(stream)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    codes = np.frombuffer(stream.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    roll = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):  # the rolling hash, all positions at once
        shifted = np.zeros(n, dtype=np.uint64)
        shifted[k:] = codes[: n - k] if k else codes
        roll = roll * _MUL + _mix(shifted + np.uint64(k + 1))
    roll = _mix(roll)
    padded = np.full(n + 2 * REACH, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[REACH : REACH + n] = roll
    least = np.ones(n, dtype=bool)
    for d in range(1, REACH + 1):
        least &= (roll < padded[REACH + d : REACH + d + n]) & (roll <= padded[REACH - d : REACH - d + n])
    cuts = np.flatnonzero(least) + 1
    bounds = np.unique(np.concatenate(([0], cuts, [n])))
    starts, ends = bounds[:-1], bounds[1:]
    place = np.concatenate(([np.uint64(0)], np.cumsum(_mix(codes + np.uint64(7)) * _powers(n))))
    # a position-free hash of each chunk: difference of prefix sums times the inverse power of its start
    h = (place[ends] - place[starts]) * _inverse_powers(n)[starts]
    return starts, ends, _mix(h + (ends - starts).astype(np.uint64)).view(np.int64)


_POW = np.uint64(0x5851F42D4C957F2D)  # fixed odd base
_INV = np.uint64(pow(int(_POW), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def _power_table(name: str, base: np.uint64, n: int) -> np.ndarray:
    t = _tables.get(name)
    if t is None or len(t) < n + 1:
        size = max(4096, 2 * (n + 1))
        t = np.ones(size, dtype=np.uint64)
        t[1:] = base
        t = np.cumprod(t)
        _tables[name] = t
    return t[: n + 1]


def _powers(n: int) -> np.ndarray:
    return _power_table("pow", _POW, n)[:n]


def _inverse_powers(n: int) -> np.ndarray:
    return _power_table("inv", _INV, n)


def _page_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages with their lines -> one row a line with its key and chunk hashes."""
    for pages in batches:
        out: dict[str, list] = {c: [] for c in (*LINE_KEY, "key", "chunks")}
        for book, page, rows in zip(pages["book_id"], pages["page"], pages["lines"], strict=True):
            keys = ["" if is_page_number(r["text"]) else letters(r["text"]) for r in rows]
            starts, ends, hashes = chunk_spans("".join(keys))
            edge = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
            first = np.searchsorted(ends, edge[:-1], side="right")
            last = np.searchsorted(starts, edge[1:], side="left")
            for r, k, a, b in zip(rows, keys, first, last, strict=True):
                if k:
                    out["book_id"].append(book)
                    out["page"].append(page)
                    out["block_seq"].append(r["block_seq"])
                    out["line_seq"].append(r["line_seq"])
                    out["key"].append(k)
                    out["chunks"].append(np.unique(hashes[a:b]))
        if out["key"]:
            yield pd.DataFrame(out)


def line_chunks(book_lines: DataFrame) -> DataFrame:
    """Lines with letters, their key and the chunks of the page that touch them.

    One shuffle gathers each page; a page is a bounded group.  Repeated rows
    count once; page numbers and lines without letters fall out here.
    """
    pages = (
        book_lines.where("book_id is not null and page is not null")
        .groupBy("book_id", "page")
        .agg(F.sort_array(F.collect_set(F.struct("block_seq", "line_seq", "text"))).alias("lines"))
    )
    return pages.mapInPandas(
        _page_lines, "book_id string, page int, block_seq int, line_seq int, key string, chunks array<bigint>"
    )


def repeated_lines(
    book_lines: DataFrame,
    min_pages: int = MIN_PAGES,
    min_share: float = MIN_SHARE,
    misread: int = MISREAD,
) -> DataFrame:
    """``book_id, page, block_seq, line_seq`` of the lines repeated excessively.

    Empty tables give no rows.  Null texts, page numbers and lines without
    letters are never cases; a null ``book_id`` or ``page`` is no record.
    Extra columns are ignored.  A book with a third of all rows is safe: every
    shuffle is keyed by (book, chunk) or (book, key), and the readings that
    lead a group are bounded by the page's number of lines, not by the book.
    """
    lines = line_chunks(book_lines).withColumn("kid", F.xxhash64("key")).transform(_keep)
    need = (
        book_lines.groupBy("book_id")
        .agg(F.count_distinct("page").alias("pages"))
        .select("book_id", F.greatest(F.lit(min_pages), F.ceil(F.col("pages") * min_share - 1e-9)).alias("need"))
    )
    # from here to the comparison only hashes of lines travel
    pieces = lines.select("book_id", "page", "kid", F.explode("chunks").alias("chunk"))
    chunks = (
        pieces.select("book_id", "chunk", "page").distinct().groupBy("book_id", "chunk").agg(F.count("*").alias("np"))
        .join(need, "book_id").where("np >= need").select("book_id", "chunk")
    ).transform(_keep)
    on_pages = lines.select("book_id", "kid", "page").distinct()
    readings = (
        on_pages.groupBy("book_id", "kid").agg(F.count("*").alias("np"))
        .join(need, "book_id")
        .where(F.col("np") >= F.greatest(F.lit(2), F.ceil(F.col("need") * CENTRE_SHARE)))
        .select("book_id", "kid")
    )
    # sides that grow with the corpus are never broadcast, however small a run finds them
    held = pieces.join(chunks.hint("merge"), ["book_id", "chunk"], "left_semi").select("book_id", "kid", "chunk").distinct()
    leading = held.join(readings.hint("merge"), ["book_id", "kid"], "left_semi").withColumnRenamed("kid", "centre_id")
    pairs = held.join(leading.hint("merge"), ["book_id", "chunk"]).select("book_id", "kid", "centre_id").distinct()
    keys = lines.groupBy("book_id", "kid").agg(F.first("key").alias("key"))
    centres = keys.withColumnsRenamed({"kid": "centre_id", "key": "centre"})
    near = (
        pairs.join(keys.hint("merge"), ["book_id", "kid"]).join(centres.hint("merge"), ["book_id", "centre_id"])
        .where(F.abs(F.length("key") - F.length("centre")) <= 2 * misread)
        .where(
            (F.col("kid") == F.col("centre_id"))
            | (F.levenshtein("key", "centre", misread) >= 0)
            | (F.levenshtein(glyphs(F.col("key")), glyphs(F.col("centre")), misread) >= 0)
        )
        .select("book_id", "kid", "centre_id")
    ).transform(_keep)
    groups = (
        near.join(on_pages.hint("merge"), ["book_id", "kid"])
        .select("book_id", "centre_id", "page").distinct()
        .groupBy("book_id", "centre_id").agg(F.count("*").alias("np"))
        .join(need, "book_id").where("np >= need").select("book_id", "centre_id")
    )
    found = near.join(groups.hint("merge"), ["book_id", "centre_id"], "left_semi").select("book_id", "kid").distinct()
    return lines.join(found.hint("merge"), ["book_id", "kid"], "left_semi").select(*LINE_KEY)


def _keep(df: DataFrame) -> DataFrame:
    from leafmill.session import cut

    return cut(df)


def without_repeated_lines(book_lines: DataFrame, **limits) -> DataFrame:
    """Every line of every page but the repeated ones, columns unchanged."""
    cases = repeated_lines(book_lines, **limits)
    same = [book_lines[c].eqNullSafe(cases[c]) for c in LINE_KEY]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return book_lines.join(cases.hint("merge"), cond, "left_anti")
