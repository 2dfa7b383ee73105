"""Problem 8: evaluation passages inside corpus documents.

Both sides become folded words.  Item-sized windows are fingerprinted with
SimHash: eight words, as every passage of twelve running words with one of any
ten changed holds a window of eight with at most one changed, and whole items
where they are shorter.  Five blocks of a fingerprint are met by all values
within two bits of them, so every item window within 14 bits of a document
window is found; the weighted similarity of their words verifies such a pair,
and an alignment word by word tells how far the passage goes.

Only document windows that can pass the verification are fingerprinted: most of
their words must be words of the items at all.
"""

from __future__ import annotations

import itertools
import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm.lookalike import _CYRILLIC, _CYRILLIC_AS, _GREEK, _GREEK_AS
from leafmill.llm.simhash import codes_of, gram_hashes, pack, signs

WINDOW = 8  # words of a window; shorter items are windows as a whole
GRAM = 3  # letters of a shingle inside the padded words
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # first bit and bits of each block
FLIPS = 2
RADIUS = len(BLOCKS) * (FLIPS + 1) - 1
SHARED = 0.75  # share of a window's words that must be words of the item window
MIN_WORDS = 12
SPAN = 10  # of so many running words one may differ
SLACK = 30  # letters a changed word may have
BLOCK_ITEMS = 500  # items searched for in one pass over the corpus
KNOWN_WORDS = 200_000  # words a worker remembers the vectors of

_TWINS = str.maketrans(_CYRILLIC + _GREEK, _CYRILLIC_AS + _GREEK_AS)
_INVISIBLE = re.compile("[­͏​-‏⁠-⁤﻿]")
_WORD = re.compile(r"[^\W_]+")
_HYPHEN_BREAK = re.compile(r"[-‐‑]\s*\n\s*[>|*]?\s*(?=\w)")


def _ranges(codes: list[int]) -> str:
    """A character class of code points in ascending order."""
    groups = itertools.groupby(enumerate(codes), lambda x: x[1] - x[0])
    spans = [[c for _, c in g] for _, g in groups]
    return "".join(f"\\U{g[0]:08x}-\\U{g[-1]:08x}" for g in spans)


_MARKS = re.compile(f"[{_ranges([c for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))])}]+")


#: Characters that may bind, part or become words once they are decomposed.
_ODD = re.compile(r"[^\w\s!-/:-@\[-`{-~“”‘’«»–—…¿¡·•§°]")
_folded: dict[str, tuple[str, ...]] = {}


def _fold_all(text: str) -> list[str]:
    text = _INVISIBLE.sub("", text)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text.translate(_TWINS)))
    return _WORD.findall(_HYPHEN_BREAK.sub("", text).lower())


def words_of(text: str) -> list[str]:
    """Folded words: letters and digits without case, accents and look-alikes."""
    if "\n" in text:
        text = _HYPHEN_BREAK.sub("", text)
    if text.isascii():
        return _WORD.findall(text.lower())
    if _ODD.search(text):
        return _fold_all(text)
    # word by word then, each form once
    words = _WORD.findall(text.lower())
    if len(_folded) > KNOWN_WORDS:
        _folded.clear()
    for w in set(words).difference(_folded):
        _folded[w] = (w,) if w.isascii() else tuple(_fold_all(w))
    return [x for w in words for x in _folded[w]]


def starts_of(words: list[str]) -> np.ndarray:
    """Where each word starts in the letters of all."""
    return np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64)[:-1])) if words else np.zeros(0, dtype=np.int64)


class Vectors:
    """Sign sums of the shingles of words, of equal weight each."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.table = np.zeros((1024, 64), dtype=np.float32)
        self.lengths = np.zeros(1024, dtype=np.int64)

    def ids(self, words: list[str]) -> np.ndarray:
        for w in set(words).difference(self.number):
            self._id(w)
        return np.array([self.number[w] for w in words], dtype=np.int64)

    def _id(self, word: str) -> int:
        n = self.number.get(word)
        if n is None:
            n = self.number[word] = len(self.number)
            if n >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            self.lengths[n] = len(word)
            v = signs(gram_hashes(codes_of(f"^{word}$"), GRAM)).sum(axis=0, dtype=np.float32)
            self.table[n] = v / max(1e-6, float(np.sqrt((v * v).sum())))
        return n

    def fingerprints(self, windows: np.ndarray) -> np.ndarray:
        """Fingerprints of windows given as rows of word ids."""
        parts = [pack(self.table[windows[a : a + 4096]].sum(axis=1)) for a in range(0, len(windows), 4096)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


class Tables:
    """Block tables of the fingerprints of item windows of one size."""

    def __init__(self, fingerprints: np.ndarray):
        self.fp = fingerprints
        self.blocks = []
        for first, bits in BLOCKS:
            masks = np.array([sum(1 << b for b in bs) for k in range(FLIPS + 1) for bs in itertools.combinations(range(bits), k)], dtype=np.uint16)
            values = ((self.fp >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.uint16)
            probes = (values[:, None] ^ masks).ravel()
            order = np.argsort(probes, kind="stable")
            offset = np.searchsorted(probes[order], np.arange((1 << bits) + 1, dtype=np.int64))
            self.blocks.append((first, bits, (order // len(masks)).astype(np.int32), offset))

    def hits(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (document window, item window) pairs within the radius."""
        found = []
        for a in range(0, len(fps), 1024):
            part = fps[a : a + 1024]
            for first, bits, items, offset in self.blocks:
                v = ((part >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)
                n = offset[v + 1] - offset[v]
                i = np.repeat(np.arange(len(part)), n)
                within = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                j = items[np.repeat(offset[v], n) + within]
                near = np.flatnonzero(np.bitwise_count(part[i] ^ self.fp[j]) <= RADIUS)
                found.append((i[near] + a) * len(self.fp) + j[near])
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        return both // max(1, len(self.fp)), both % max(1, len(self.fp))


class ItemIndex:
    """All item windows by size, with their fingerprints in block tables."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.words = [words_of(text) for _, text in items]
        self.streams, self.starts = ["".join(w) for w in self.words], [starts_of(w) for w in self.words]
        self.vectors = Vectors()
        numbers = [self.vectors.ids(w) for w in self.words]
        self.counts = np.array([len(w) for w in self.words], dtype=np.int64)
        pad = np.full(MIN_WORDS + BAND, -2, dtype=np.int64)
        self.flat = np.concatenate([y for x in numbers for y in (pad, x)] + [pad])
        self.first = np.cumsum([0] + [len(x) + len(pad) for x in numbers])[:-1] + len(pad)
        self.own = len(self.vectors.number)  # words of the items have the least numbers
        self.sizes: dict[int, tuple[Tables, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({min(WINDOW, len(w)) for w in self.words} - {0}):
            which = [k for k, w in enumerate(self.words) if min(WINDOW, len(w)) == size]
            windows = [np.lib.stride_tricks.sliding_window_view(numbers[k], size) for k in which]
            owner = np.repeat(which, [len(x) for x in windows])
            start = np.concatenate([np.arange(len(x)) for x in windows])
            all_ = np.concatenate(windows)
            self.sizes[size] = (Tables(self.vectors.fingerprints(all_)), all_, owner, start)

    def word(self, k: int, j: int) -> str:
        s, w = self.streams[k], self.starts[k]
        return s[w[j] : w[j + 1] if j + 1 < len(w) else len(s)]

    def align(self, k: int, j: int, doc: str, starts: np.ndarray, at: int) -> tuple[list[tuple[int, bool]], int, int]:
        """Words of item ``k`` around word ``j`` matched to ``doc`` around
        ``at``: (word, unchanged) in order, and the stretch of ``doc``.  A change
        is bridged to the two words beyond it, or over exactly one word of
        ``doc`` to a single one, as the passage may end there."""
        bounds = np.append(starts, len(doc))

        def bound(at: int) -> int:
            n = int(np.searchsorted(bounds, at))
            return n if n < len(bounds) and bounds[n] == at else -1

        total = len(self.starts[k])
        here = self.word(k, j) + (self.word(k, j + 1) if j + 1 < total else "")
        if not doc.startswith(here, at):  # windows within the radius may be a few letters apart
            near = doc.find(here, max(0, at - 8), at + 8 + len(here))
            at = near if near >= 0 else at
        right: list[tuple[int, bool]] = []
        pos, i = at, j
        while i < total:
            w = self.word(k, i)
            if doc.startswith(w, pos):
                right.append((i, True))
                pos += len(w)
                i += 1
                continue
            if i + 1 >= total:
                break
            ahead = self.word(k, i + 1) + (self.word(k, i + 2) if i + 2 < total else "")
            nxt = doc.find(ahead, pos, pos + SLACK + len(ahead))
            if nxt < 0:
                n, w = bound(pos), self.word(k, i + 1)
                if not 0 <= n < len(starts) - 1 or not doc.startswith(w, bounds[n + 1]) or bound(bounds[n + 1] + len(w)) < 0:
                    break
                nxt = int(bounds[n + 1])
            right.append((i, False))
            pos = nxt
            i += 1
        end = pos
        left: list[tuple[int, bool]] = []
        pos, i = at, j - 1
        while i >= 0:
            w = self.word(k, i)
            if pos >= len(w) and doc.startswith(w, pos - len(w)):
                left.append((i, True))
                pos -= len(w)
                i -= 1
                continue
            if i == 0:
                break
            behind = (self.word(k, i - 2) if i > 1 else "") + self.word(k, i - 1)
            prv = doc.rfind(behind, max(0, pos - SLACK - len(behind)), pos)
            if prv < 0:
                n, w = bound(pos), self.word(k, i - 1)
                if n < 2 or (first := int(bounds[n - 1]) - len(w)) < 0 or not doc.startswith(w, first) or bound(first) < 0:
                    break
                prv, behind = first, w
            left.append((i, False))
            pos = prv + len(behind)
            i -= 1
        return left[::-1] + right, pos, end


def longest_run(flags: list[tuple[int, bool]]) -> tuple[int, int, int]:
    """Longest stretch of running words of which no ten hold two changed ones:
    its length, first and last word.  It starts and ends with an unchanged word."""
    best = (0, -1, -1)
    start, changed = 0, []
    for n, (i, same) in enumerate(flags):
        if not same:
            if changed and i - flags[changed[-1]][0] < SPAN:
                start = changed[-1] + 1
                changed = [c for c in changed if c >= start]
            changed.append(n)
            continue
        a = start
        while a <= n and not flags[a][1]:
            a += 1
        if i - flags[a][0] + 1 > best[0]:
            best = (i - flags[a][0] + 1, flags[a][0], i)
    return best


def compare(a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows ``a`` and ``b``: the share of words that both hold, the lesser of
    both directions, and where the longest shared word stands in either."""
    size = a.shape[1] if a.ndim > 1 else 1
    share, here, there = np.zeros(len(a)), np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
    for lo in range(0, len(a), 16384):
        x, y = a[lo : lo + 16384], b[lo : lo + 16384]
        same = x[:, :, None] == y[:, None, :]
        share[lo : lo + 16384] = np.minimum(same.any(axis=2).mean(axis=1), same.any(axis=1).mean(axis=1))
        at = (same * lengths[x][:, :, None]).reshape(len(x), -1).argmax(axis=1)
        here[lo : lo + 16384], there[lo : lo + 16384] = at // size, at % size
    return share, here, there


BAND = 2  # places by which words broken in two may shift a passage
LOST = 3  # words of twelve that may be changed or broken


def may_be_passage(index: ItemIndex, numbers: list[np.ndarray], anchors: np.ndarray) -> np.ndarray:
    """Whether enough words around the anchors (text, item, word of either) stand
    in both at about the same distance; alignment by letters decides."""
    pad = MIN_WORDS + BAND
    edge = lambda n: np.full(pad, n, dtype=np.int64)
    docs = np.concatenate([y for x in numbers for y in (edge(-1), x)] + [edge(-1)])
    doc_first = np.cumsum([0] + [len(x) + pad for x in numbers])[:-1] + pad
    reach = np.arange(1 - MIN_WORDS, MIN_WORDS)
    t, k, n, j = anchors
    out = np.zeros(len(t), dtype=bool)
    for lo in range(0, len(t), 8192):
        part = slice(lo, lo + 8192)
        item = index.flat[index.first[k[part]][:, None] + j[part][:, None] + reach]
        at = doc_first[t[part]][:, None] + n[part][:, None] + reach
        same = np.zeros(item.shape, dtype=bool)
        for shift in range(-BAND, BAND + 1):
            same |= docs[at + shift] == item
        total = np.concatenate([np.zeros((len(same), 1), dtype=np.int64), np.cumsum(same, axis=1)], axis=1)
        most = (total[:, MIN_WORDS:] - total[:, :-MIN_WORDS]).max(axis=1)
        out[part] = most >= np.maximum(1, np.minimum(MIN_WORDS, index.counts[k[part]]) - LOST)
    return out


def leaked_items(index: ItemIndex, texts: list[str]) -> Iterator[tuple[int, int, int]]:
    """(text number, item number, running words) of every leak: of a passage of
    nearly the least length or more, or of a whole item shorter than that."""
    if len(index.vectors.number) > index.own + KNOWN_WORDS:
        for w in itertools.islice(list(index.vectors.number), index.own, None):
            del index.vectors.number[w]
    words = [words_of(t) for t in texts]
    numbers = [index.vectors.ids(w) for w in words]
    streams: dict[int, tuple[str, np.ndarray]] = {}
    pairs: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for size, (tables, item_windows, owner, start) in index.sizes.items():
        parts, text, place = [], [], []
        for t, ids in enumerate(numbers):
            if len(ids) < size:
                continue
            known = np.concatenate(([0], np.cumsum(ids < index.own)))
            at = np.flatnonzero(known[size:] - known[:-size] >= SHARED * size)
            if len(at):
                parts.append(np.lib.stride_tricks.sliding_window_view(ids, size)[at])
                text.append(np.full(len(at), t))
                place.append(at)
        if not parts:
            continue
        windows, text_, place_ = np.concatenate(parts), np.concatenate(text), np.concatenate(place)
        left, right = tables.hits(index.vectors.fingerprints(windows))
        lengths = index.vectors.lengths
        share, o, q = compare(windows[left], item_windows[right], lengths)
        t, k, first = text_[left], owner[right], start[right]
        # the longest word they share is where the alignment sets out
        anchors = np.unique(np.stack([t, k, place_[left] + o, first + q])[:, share >= SHARED], axis=1)
        for x in anchors[:, may_be_passage(index, numbers, anchors)].T.tolist():
            pairs[x[0], x[1]].append((x[2], x[3]))
    for (t, k), found in pairs.items():
        if t not in streams:
            streams[t] = ("".join(words[t]), starts_of(words[t]))
        doc, starts = streams[t]
        best = 0
        covered: list[tuple[int, int, int, int]] = []
        for n, j in found:
            at = int(starts[n])
            if any(a <= at < b and first <= j <= last for a, b, first, last in covered):
                continue
            flags, _, b = index.align(k, j, doc, starts, at)
            best = max(best, longest_run(flags)[0])
            if flags and flags[0][0] <= j:
                covered.append((at, max(b, at + 1), flags[0][0], flags[-1][0]))
        if best >= min(MIN_WORDS - 2, len(index.words[k])):
            yield t, k, best


_indexes: dict[int, tuple[list, ItemIndex]] = {}


def _index_of(items: list[tuple[int, str]]) -> ItemIndex:
    """The index of these items, built once by a worker process."""
    key = hash(tuple(items))
    got = _indexes.get(key)
    if got is None or got[0] != items:
        _indexes.clear()
        got = _indexes[key] = (items, ItemIndex(items))
    return got[1]


def _leaks(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """``doc_id, item_id, running_words, item_words``.

    The items are the stated query set: read to the driver in blocks of at most
    ``BLOCK_ITEMS`` and searched for in all documents, one pass a block.
    """
    items = eval_items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.max("text").alias("text"))
    spark = documents.sparkSession
    n = items.count()
    blocks = max(1, -(-n // BLOCK_ITEMS))
    block = items.select("item_id", F.ntile(blocks).over(W.orderBy("item_id")).alias("block"))
    docs = documents.where("doc_id is not null and trim(text) <> ''").select("doc_id", "text")
    schema = "doc_id bigint, item_id bigint, running_words int, item_words int"
    out = spark.createDataFrame([], schema)
    for b in range(1, blocks + 1):
        part = items.join(block.where(F.col("block") == b), "item_id") if blocks > 1 else items
        rows = sorted((r["item_id"], r["text"]) for r in part.collect())

        def search(batches: Iterator[pd.DataFrame], rows=rows) -> Iterator[pd.DataFrame]:
            index = _index_of(rows)
            for pdf in batches:
                ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
                found: list[tuple] = []
                for a in range(0, len(ids), 500):
                    found += [(ids[a + t], index.ids[k], run, len(index.words[k])) for t, k, run in leaked_items(index, texts[a : a + 500])]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "running_words", "item_words"])

        out = out.unionByName(docs.mapInPandas(search, schema))
    return out.groupBy("doc_id", "item_id").agg(F.max("running_words").alias("running_words"), F.max("item_words").alias("item_words"))


def leak_lengths(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """``doc_id, item_id, running_words`` of every document and item that share
    a stretch of nearly the length of a passage, or the whole of a shorter item."""
    return _leaks(documents, eval_items).drop("item_words")


def leaking_documents(documents: DataFrame, eval_items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, item_id``: the document holds a passage of the item, or all of an
    item that is shorter than a passage.

    Null, empty and blank texts, null ids and empty tables give nothing;
    repeated rows count once.  Whole texts are searched, however long.
    """
    return _leaks(documents, eval_items).where(F.col("running_words") >= F.least(F.lit(min_words), F.col("item_words"))).select("doc_id", "item_id")
