"""Problem 6: noise in text from scanned pages.

Margin lines are told by geometry, broken words by their line ends.  For
misread words the corpus itself is the dictionary: token, pair and letter-group
counts and skip-gram vectors are learned from all lines; a rare word is linked
to a frequent one by plausible glyph edits, and where several are possible the
vectors of its neighbours choose.  Paragraphs are then reflowed without
furniture and with the corrections applied.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Word2Vec
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm import textkeys
from leafmill.llm.textkeys import is_page_number
from leafmill.session import cut

fold = functools.lru_cache(200_000)(textkeys.fold)  # words come again and again

LINE_KEY = ["book_id", "page", "block_seq", "line_seq"]
SMALL = 0.87  # share of the body size under which a line at the edge is furniture
MIN_COUNT = 4
#: Words (pairs) above this share of all tokens are frequent; no more than
#: 1 / share can be, so what travels to the tasks is bounded.
WORD_SHARE = 1e-5
PAIR_SHARE = 2e-6
SURE_RATIO = 6  # the same where the edit is a usual confusion of glyphs
RATIO = 20  # a word must be so many times as frequent as its misreading
RARE_GROUP = 2e-6  # share of all letter groups of names up to which one is rare
VECTOR = 24

_BREAK = re.compile(r"([^\W\d_])[-‐¬­‑]$")
_RUN_BREAK = re.compile(r"(?<=[^\W\d_])[-‐¬\u00ad‑][ \n]+(?=[^\W\d_])(?=[^A-ZÀ-Þ])")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_SYMBOL = re.compile(r"[@|^~\\/=+*#<>{}$%&§_¦!?¢£€¥©®\[\]()]")
_DIGIT = re.compile(r"\d")
_LETTER = re.compile(r"[^\W\d_]")
_ORDINAL = re.compile(r"^\d+(?:[.,:/\-–]\d+)*\.?(?:[aoªº]|st|nd|rd|th|er|ère|e|ème)?$", re.I)
_PLAIN_INNER = re.compile(r"[-'’‐‑.·]")

# Glyphs that scans confuse (fixed values): what is read -> what may stand.
_GLYPHS = {
    "0": "o", "1": "li", "5": "s", "6": "be", "9": "gq", "8": "b", "3": "e", "4": "a", "7": "t", "2": "z", "@": "a", "$": "s", "|": "li", "!": "li", "&": "e",
}
_GROUPS = [("rn", "m"), ("iii", "m"), ("ii", "u"), ("ii", "n"), ("vv", "w"), ("cl", "d"), ("li", "h"), ("iri", "in"), ("ri", "n"), ("nn", "m"), ("lc", "k"), ("in", "m"), ("ni", "m"), ("m", "rn"), ("d", "cl"), ("u", "ii"), ("n", "ri"), ("h", "li"), ("w", "vv"), ("m", "in"), ("m", "iii"), ("n", "ii")]
_PLAUSIBLE = {frozenset(x) for x in (
    "ec", "co", "oe", "il", "lt", "it", "ij", "jl", "ft", "tf", "lf", "hb", "un", "nr", "rv", "vy", "gq", "yg", "sz", "ao", "ae", "ce", "bh", "hn", "mn", "kh", "lk", "lI", "rt", "rc", "tc", "uv", "xk", "db", "pq", "gy", "sg", "eo", "ui", "ri", "rf", "sf", "tr", "lr", "li",
)}
_PARTNERS: dict[str, list[str]] = {c: sorted({x for p in _PLAUSIBLE if c in p for x in p} - {c}) for c in sorted({c for p in _PLAUSIBLE for c in p})}


def body_sizes(lines: DataFrame) -> DataFrame:
    """``book_id, body``: the size most letters of a book are set in."""
    by = lines.groupBy("book_id", "size").agg(F.sum(F.length("text")).alias("n"))
    return by.where("size is not null").groupBy("book_id").agg(F.max_by("size", F.struct("n", "size")).alias("body"))


def pages_of(book_lines: DataFrame) -> DataFrame:
    """One row a page: its lines in reading order, repeated rows once, and the
    book's body size.  A page is a bounded group."""
    lines = book_lines.where("book_id is not null and page is not null").select(*LINE_KEY, "text", "size", "top", "bottom", "x0", "x1")
    return (
        lines.groupBy("book_id", "page")
        .agg(F.sort_array(F.collect_set(F.struct("block_seq", "line_seq", "text", "size", "top", "bottom", "x0", "x1"))).alias("lines"))
        .join(body_sizes(lines), "book_id", "left")
    )


def margin_flags(rows, body: float | None) -> list[bool]:
    """Which lines of a page are furniture: smaller than the body and before its
    first or after its last line, or a page number at either edge."""
    n = len(rows)
    small = [bool(body and r["size"] is not None and r["size"] < SMALL * body) for r in rows]
    number = [is_page_number(r["text"]) for r in rows]
    edge = [False] * n
    i = 0
    while i < n and (small[i] or (number[i] and i < 2)):
        edge[i] = True
        i += 1
    j = n - 1
    while j >= i and (small[j] or (number[j] and j >= n - 2)):
        edge[j] = True
        j -= 1
    return edge if i <= j or n <= 3 else [number[k] or (small[k] and (k < 2 or k >= n - 3)) for k in range(n)]


def tokens_of(text: str) -> list[str]:
    return text.split()


@functools.lru_cache(200_000)
def core(token: str) -> str:
    """A token without marks at its edges."""
    return _EDGE.sub("", token)


def _page_tokens(rows, edge):
    """Per line its tokens; the two halves of a broken word are left out of the
    counts and returned as (line, next line)."""
    toks = [tokens_of(r["text"] or "") for r in rows]
    breaks: list[tuple[int, int]] = []
    body = [i for i in range(len(rows)) if not edge[i] and toks[i]]
    for a, b in zip(body, body[1:], strict=False):
        if _BREAK.search(rows[a]["text"].rstrip()) and (first := toks[b][0].lstrip("“«(")[:1]) and not first.isdigit():
            target = b
            if first.isupper() and not toks[a][-1].isupper():
                # a notice set into the running text is skipped
                k = body.index(b)
                if k + 1 < len(body) and toks[body[k + 1]] and toks[body[k + 1]][0][:1].islower():
                    target = body[k + 1]
            breaks.append((a, target))
    return toks, breaks


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pages in batches:
        words: Counter[str] = Counter()
        pairs: Counter[tuple[str, str]] = Counter()
        groups: Counter[str] = Counter()
        forms: Counter[tuple[str, str]] = Counter()
        for rows, body in zip(pages["lines"], pages["body"], strict=True):
            edge = margin_flags(rows, body)
            toks, breaks = _page_tokens(rows, edge)
            lost_last, lost_first = {a for a, _ in breaks}, {b for _, b in breaks}
            for i, line in enumerate(toks):
                if rows[i]["text"] and _BREAK.search(rows[i]["text"].rstrip()):
                    lost_last.add(i)
                kept = line[1:] if i in lost_first else line
                kept = kept[:-1] if i in lost_last else kept
                cores = [core(t) for t in kept]
                keys = [fold(c) for c in cores]
                words.update(k for k in keys if k)
                forms.update((k, c.lower()) for k, c in zip(keys, cores, strict=True) if k and not c.isascii())
                pairs.update((a, b) for a, b in zip(keys, keys[1:], strict=False) if a and b and a.isalpha() and b.isalpha())
                for c, k in zip(cores, keys, strict=True):
                    if c[:1].isupper() and k.isalpha() and len(k) >= 3:
                        groups.update(f"^{k}$"[j : j + 3] for j in range(len(k)))
            for a, b in breaks:
                joined = fold(core(toks[a][-1].rstrip("-‐¬­‑")) + core(toks[b][0]))
                words[joined] += 1
        rows_out = [("word", a, "", n) for a, n in words.items()]
        rows_out += [("pair", a, b, n) for (a, b), n in pairs.items()]
        rows_out += [("group", a, "", n) for a, n in groups.items()]
        rows_out += [("form", a, b, n) for (a, b), n in forms.items()]
        yield pd.DataFrame(rows_out, columns=["what", "a", "b", "n"])


class Lexicon:
    """What was learned of the corpus; bounded by the shares above.  ``seen``
    holds the true counts of the rarer words and pairs of the text at hand."""

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int], groups: dict[str, int], vectors: dict[str, np.ndarray], least: int, forms: dict[str, str] | None = None):
        self.forms = forms or {}  # the usual spelling of a folded word, accents included
        self.words, self.pairs, self.groups, self.vectors, self.least = words, pairs, groups, vectors, least
        self.rare = max(2, least // 8)  # words from this count on are kept, pairs from ``pair_least`` on
        self.pair_least = 3
        self.seen: dict[tuple[str, str], int] = {}
        self.group_floor = 0  # letter groups seen no more often than this are not kept
        self._sorted = sorted(w for w, n in words.items() if n >= least)
        self._known: dict[str, list] = {}
        self._lacking: dict[str, list[tuple[str, int]]] | None = None

    def __getstate__(self) -> dict:
        # tables that a worker builds for itself do not travel
        return {**self.__dict__, "_lacking": None, "_known": {}, "_sorted": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._sorted = sorted(w for w, n in self.words.items() if n >= self.least)

    def group(self, letters: str) -> int:
        return max(self.groups.get(letters, 0), self.group_floor)

    def starts_word(self, prefix: str) -> bool:
        """Whether a frequent word begins so."""
        i = bisect_left(self._sorted, prefix)
        return i < len(self._sorted) and self._sorted[i].startswith(prefix)

    def lacking(self) -> dict[str, list[tuple[str, int]]]:
        """Every frequent word without one of its letters -> the words and places."""
        if self._lacking is None:
            self._lacking = defaultdict(list)
            for w in self._sorted:
                for i in range(len(w)):
                    self._lacking[w[:i] + w[i + 1 :]].append((w, i))
            self._lacking.default_factory = None
        return self._lacking

    def frequent(self, key: str) -> bool:
        return self.words.get(key, 0) >= self.least

    def look(self, known) -> None:
        """Take the counts joined to a row, for as long as it is worked on."""
        self.seen = {(x["a"], x["b"]): x["n"] for x in known} if known is not None else {}

    def count(self, word: str) -> int:
        return self.words.get(word) or self.seen.get((word, ""), 0)

    def pair(self, a: str, b: str) -> int:
        return self.pairs.get((a, b)) or self.seen.get((a, b), 0)

    def wanted(self, cores: list[str]) -> Iterator[tuple[str, str]]:
        """Words and pairs that may be counted below the limits and that the
        verdicts on these tokens read; the second word is empty for a word."""
        keys = [fold(c) for c in cores]
        for a, b in zip(keys, keys[1:], strict=False):
            if a and b and self.words.get(a + b, 0) >= self.least and (a, b) not in self.pairs:
                yield a, b
        for key in keys:
            if self.frequent(key) or len(key) < 2 or not _PLAIN_INNER.sub("", key).isalpha():
                continue
            if self.rare > 2 and key not in self.words:
                yield key, ""
            if len(key) < 5 or (self.pair_least <= 3 and self.rare <= RATIO):
                continue
            for k in range(1, len(key)):
                a, b = key[:k], key[k:]
                if self.rare > RATIO:
                    yield from ((x, "") for x in (a, b) if x not in self.words)
                elif min(self.words.get(a, 0), self.words.get(b, 0)) < RATIO:
                    continue
                if (a, b) not in self.pairs:
                    yield a, b

    def edits(self, key: str) -> list[tuple[str, bool]]:
        """Frequent words one edit away, and whether the edit is a plausible
        confusion of glyphs."""
        got = self._known.get(key)
        if got is not None:
            return got
        found: dict[str, bool] = {}

        def add(w: str, plausible: bool) -> None:
            if w != key and self.words.get(w, 0) >= self.least:
                found[w] = found.get(w, False) or plausible

        lacking = self.lacking()
        for a, b in _GROUPS:
            i = key.find(a)
            while i >= 0:
                add(key[:i] + b + key[i + len(a) :], True)
                i = key.find(a, i + 1)
        for i in range(len(key)):
            without = key[:i] + key[i + 1 :]
            add(without, True)
            for w, j in lacking.get(without, ()):
                if i == j and w != key:
                    add(w, frozenset((w[i], key[i])) in _PLAUSIBLE)
        for w, _ in lacking.get(key, ()):
            add(w, True)
        if len(self._known) > 200_000:
            self._known.clear()
        got = self._known[key] = list(found.items())
        return got

    def context(self, words: list[str]) -> np.ndarray | None:
        vs = [self.vectors[w] for w in words if w in self.vectors]
        if not vs:
            return None
        v = np.mean(vs, axis=0)
        norm = np.linalg.norm(v)
        return v / norm if norm else None

    def fit(self, word: str, context: np.ndarray | None) -> float:
        v = self.vectors.get(word)
        return float(v @ context) if v is not None and context is not None else 0.0


def undigit(key: str, lex: Lexicon) -> Iterator[str]:
    """The frequent words a token reads as with digits and signs as the letters
    they look like; beginnings of no word are not followed."""
    ways = [""]
    for c in key:
        subs = _GLYPHS.get(c, c if c.isalpha() or c in "-'’" else "")
        ways = [x for w in ways for s in (subs or [""]) if lex.starts_word(x := w + s)]
    yield from (w for w in dict.fromkeys(ways) if lex.frequent(w))


def _near(cores: list[str], i: int) -> list[str]:
    return [fold(x) for x in cores[max(0, i - 3) : i] + cores[i + 1 : i + 4]]


def misread(cores: list[str], i: int, lex: Lexicon) -> tuple[str | None, int]:
    """The correction of token ``i`` of a line and how many tokens it replaces
    (0: the token is sound)."""
    c = cores[i]
    key = fold(c)
    if not key or not _LETTER.search(key):
        return None, 0
    if _DIGIT.search(key) or _SYMBOL.search(key):
        if _ORDINAL.match(c) or (_SYMBOL.search(key) and not _DIGIT.search(key) and re.fullmatch(r"[^\W\d_]+(?:[/&][^\W\d_]+)+", c)):
            return None, 0
        letters = sum(x.isalpha() for x in key)
        if letters < 1 or (letters < 2 and len(key) > 3) or re.fullmatch(r"[a-z]{1,3}[.-]?\d+|\d+[a-z]{1,2}|\d[\d.,]*[-–][a-z]+", key):
            return None, 0
        best = _choose([(w, True) for w in undigit(key, lex)], lex, _near(cores, i), 1)
        return (best or c), 1
    if lex.frequent(key):
        return _grown_apart(cores, i, key, lex)
    got = _grown_apart(cores, i, key, lex)
    if got[1]:
        return got
    count = lex.count(key)
    bare = _PLAIN_INNER.sub("", key)
    if not bare.isalpha() or len(bare) < 2:
        return None, 0
    parts = [p for p in re.split(r"[-'’‐‑]", key) if p]
    if len(parts) > 1 and all(lex.frequent(p) for p in parts):
        return None, 0
    name = c[:1].isupper() and not c.isupper()
    # grown together with its neighbour
    for k in range(1, len(key)):
        a, b = key[:k], key[k:]
        if lex.count(a) >= RATIO * max(1, count) and lex.count(b) >= RATIO * max(1, count):
            together = lex.pair(a, b)
            if together >= max(3, 2 * count) and len(key) >= 5:
                return f"{c[:k]} {c[k:]}", 1
    if not name and count <= lex.rare and (parts_ := _segments(key, lex)):
        return " ".join(parts_), 1
    inner = re.search(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])", c)
    if inner:
        return f"{c[: inner.start()]} {c[inner.start() :]}", 1
    if name and not lex.frequent(key):
        for k in range(4, len(key) - 4):
            if lex.count(key[k:]) >= 200 * max(1, count) and not c[k].isupper():
                return f"{c[:k]} {c[k:]}", 1
    near_words = lex.edits(key)
    if len(key) == 2:
        near_words = [x for x in near_words if x[1] and len(x[0]) >= 2]
    ok = [(w, p) for w, p in near_words if lex.words[w] >= (SURE_RATIO if p and not name else RATIO) * max(1, count) and (p or not name)]
    if len(key) <= 3:
        ok = [(w, p) for w, p in ok if lex.words[w] >= 10 * RATIO * max(1, count)]
    if name and ok and _name_like(key, lex):
        ok = [x for x in ok if lex.words[x[0]] >= 10 * RATIO * max(1, count)]
    best = _choose(ok, lex, _near(cores, i), max(1, count)) if ok else None
    if best:
        return best, 1
    if name:
        # a name reads wrong if one of its letter groups hardly ever occurs and a plausible edit mends it
        rare = _rarity(key, lex)
        if rare <= max(1, RARE_GROUP * lex.groups.get("", 0)):
            for a, b in _GROUPS:
                j = key.find(a)
                if j >= 0 and _rarity(key[:j] + b + key[j + len(a) :], lex) >= 30 * max(1, rare):
                    return key[:j] + b + key[j + len(a) :], 1
            for j in range(len(key)):
                for s in _PARTNERS.get(key[j], ()):
                    if _rarity(key[:j] + s + key[j + 1 :], lex) >= 30 * max(1, rare):
                        return key[:j] + s + key[j + 1 :], 1
        return None, 0
    # a small letter's word no one knows, two edits from a frequent one, or the rest of a split name
    if count <= lex.rare and len(key) >= 5:
        best = _choose(list(_two_edits(key, lex)), lex, _near(cores, i), 1)
        if best:
            return best, 1
    if count <= lex.rare and c[:1].islower() and i and cores[i - 1][:1].isupper() and len(key) >= 2 and not lex.frequent(fold(cores[i - 1])) and not lex.frequent(key):
        return None, 1
    return None, 0


def _segments(key: str, lex: Lexicon) -> list[str]:
    """The frequent words of four letters or more, the middle ones of three, that
    make up the whole of an unknown one; empty if there are none."""
    n = len(key)
    if n < 8:
        return []
    best: list[list[str] | None] = [[]] + [None] * n
    for j in range(3, n + 1):
        for i in range(j - 3, -1, -1):
            if best[i] is not None and (j - i >= 4 or (i > 0 and j < n)) and lex.words.get(key[i:j], 0) >= lex.least:
                if best[j] is None or len(best[i]) + 1 < len(best[j]):
                    best[j] = [*best[i], key[i:j]]
    return best[n] if best[n] and len(best[n]) > 1 else []


def _two_edits(key: str, lex: Lexicon) -> Iterator[tuple[str, bool]]:
    for a, b in _GROUPS:
        i = key.find(a)
        while i >= 0:
            mid = key[:i] + b + key[i + len(a) :]
            for w, p in lex.edits(mid):
                if p and lex.words[w] >= 10 * RATIO:
                    yield w, p
            i = key.find(a, i + 1)


def _name_like(key: str, lex: Lexicon) -> bool:
    return _rarity(key, lex) >= max(20, 1e-4 * lex.groups.get("", 0))


def _rarity(key: str, lex: Lexicon) -> int:
    s = f"^{key}$"
    return min((lex.group(s[j : j + 3]) for j in range(len(s) - 2)), default=0)


def _grown_apart(cores: list[str], i: int, key: str, lex: Lexicon) -> tuple[str | None, int]:
    """A word with a space inside: this token and the next make a frequent word,
    and they are not a usual pair."""
    if i + 1 >= len(cores):
        return None, 0
    nxt = fold(cores[i + 1])
    joined = lex.words.get(key + nxt, 0)
    if joined < lex.least:
        return None, 0
    if not _PLAIN_INNER.sub("", nxt).isalpha() or not _PLAIN_INNER.sub("", key).isalpha() or cores[i + 1][:1].isupper() and not cores[i].isupper():
        return None, 0
    pair = lex.pair(key, nxt)
    both = lex.frequent(key) and lex.frequent(nxt)
    if pair * RATIO > joined or (both and (pair >= 3 or min(len(key), len(nxt)) < 2 or joined < 100)):
        return None, 0
    return cores[i] + cores[i + 1], 2


def _choose(found: list[tuple[str, bool]], lex: Lexicon, near: list[str], count: int) -> str | None:
    """The best of several frequent words, by frequency and by the vectors of
    the neighbours; an implausible edit must at least fit its context."""
    if not found:
        return None
    context = lex.context([w for w in near if w])
    best, score = None, -1e9
    for w, plausible in found:
        fit = lex.fit(w, context)
        if not plausible and fit < 0.0 and lex.words[w] < 500 * count:
            continue
        s = np.log(lex.words[w]) + 4 * fit + (1.5 if plausible else 0)
        if s > score:
            best, score = w, s
    return best


def learn(pages: DataFrame) -> tuple[Lexicon, DataFrame]:
    """Counts and skip-gram vectors over all lines of all pages; and ``a, b, n``
    of the words (``b`` empty) and pairs too rare for the lexicon, to be joined."""
    counts = cut(
        pages.select("lines", "body").mapInPandas(_count, "what string, a string, b string, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n"))
    )
    total = counts.where("what = 'word'").agg(F.sum("n")).first()[0] or 0
    least, least_pair = max(MIN_COUNT, int(WORD_SHARE * total)), max(3, int(PAIR_SHARE * total))
    # the counts of rarer ones are joined to the rows that need them
    def read(what: str, limit: int) -> pd.DataFrame:
        return counts.where((F.col("what") == what) & (F.col("n") >= limit)).select("a", "b", "n").toPandas()

    all_groups = counts.where("what = 'group'").agg(F.sum("n")).first()[0] or 0
    # a verdict on a name tells groups apart from thirty times less than a rare one on
    floor = int(RARE_GROUP * all_groups / 30)
    w, p, g, f = read("word", max(2, least // 8)), read("pair", least_pair), read("group", floor + 1), read("form", max(2, least // 8))
    words = dict(zip(w["a"], w["n"].tolist(), strict=True))
    pairs = dict(zip(zip(p["a"], p["b"], strict=True), p["n"].tolist(), strict=True))
    groups = dict(zip(g["a"], g["n"].tolist(), strict=True))
    groups[""] = int(all_groups)
    best = f.sort_values(["n", "b"]).drop_duplicates("a", keep="last")
    forms = {a: b for a, b, n in zip(best["a"], best["b"], best["n"], strict=True) if 2 * n > words.get(a, 0)}
    vectors = _vectors(pages, least, {a for a, n in words.items() if n >= least})
    lex = Lexicon(words, pairs, groups, vectors, least, forms)
    lex.pair_least, lex.group_floor = least_pair, floor
    rest = counts.where((F.col("what") == "word") & (F.col("n") < lex.rare) | (F.col("what") == "pair") & (F.col("n") < least_pair))
    return lex, rest.select("a", "b", "n")


def with_counts(rows: DataFrame, key: list[str], lines_of, lex: Lexicon, rest: DataFrame) -> DataFrame:
    """``rows`` with a column ``known``: the true counts of what is too rare for
    the lexicon and wanted for their lines of tokens (``lines_of`` a row)."""

    def want(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.to_dict("records"):
                need = {x for cores in lines_of(row, lex) for x in lex.wanted(cores)}
                out += [(*(row[k] for k in key), a, b) for a, b in need]
            yield pd.DataFrame(out, columns=[*key, "a", "b"])

    schema = ", ".join(f"{k} {t}" for k, t in rows.select(*key).dtypes)
    found = rows.mapInPandas(want, f"{schema}, a string, b string").join(rest.hint("merge"), ["a", "b"])
    known = found.groupBy(*key).agg(F.collect_list(F.struct("a", "b", "n")).alias("known"))
    return rows.join(known.hint("merge"), key, "left")


def _page_lines(row: dict, lex: Lexicon) -> list[list[str]]:
    """The tokens of the lines of a page, and its broken words joined."""
    rows = row["lines"]
    toks, breaks = _page_tokens(rows, margin_flags(rows, row["body"]))
    joined = [[core(toks[a][-1]).rstrip("-‐¬\u00ad‑") + core(toks[b][0])] for a, b in breaks]
    return [[core(t) for t in line] for line in toks] + [x for x in joined if x[0]]


def _run_lines(row: dict, lex: Lexicon) -> list[list[str]]:
    return [[core(t) for t in _joined_breaks("".join(row["texts"]), lex)[0].split()]]


def _vectors(pages: DataFrame, least: int, known: set[str]) -> dict[str, np.ndarray]:
    """Skip-gram vectors of the frequent words, of unit length."""
    if not known:
        return {}
    lines = pages.select(F.explode("lines.text").alias("text")).select(
        F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}]+(?:[-'’][\p{L}\p{M}]+)*"), 0).alias("words")
    )
    lines = lines.where("size(words) > 1")
    if lines.isEmpty():
        return {}
    parts = max(1, pages.sparkSession.sparkContext.defaultParallelism)
    model = Word2Vec(vectorSize=VECTOR, minCount=least, windowSize=3, maxIter=1, stepSize=0.05, numPartitions=parts, seed=11, inputCol="words", outputCol="v").fit(lines)
    out: dict[str, np.ndarray] = {}
    for r in model.getVectors().toLocalIterator():
        key = fold(r["word"])
        v = np.array(r["vector"].toArray(), dtype=np.float32)
        norm = np.linalg.norm(v)
        if key in known and norm:
            out[key] = v / norm
    return out


def _noise(batches: Iterator[pd.DataFrame], lex: Lexicon) -> Iterator[pd.DataFrame]:
    for pages in batches:
        out: list[tuple] = []
        for book, page, rows, body, known in zip(pages["book_id"], pages["page"], pages["lines"], pages["body"], pages["known"], strict=True):
            lex.look(known)
            edge = margin_flags(rows, body)
            bad, _, _ = page_misread(rows, edge, lex)
            last_body = max((i for i in range(len(rows)) if not edge[i]), default=-1)
            for i, r in enumerate(rows):
                at = (book, page, r["block_seq"], r["line_seq"])
                if edge[i]:
                    out.append((*at, "margin"))
                elif r["text"] and _BREAK.search(r["text"].rstrip()) and (i <= last_body):
                    out.append((*at, "broken_word"))
                if i in bad:
                    out.append((*at, "misread"))
        yield pd.DataFrame(out, columns=[*LINE_KEY, "noise"])


def _mended(first: str, last: str, c: str, better: str, lex: Lexicon) -> str:
    """A correction with the marks around the tokens it replaces, and their case."""
    lead = first[: len(first) - len(first.lstrip("“«(¿¡„—–-'\""))]
    trail = re.search(r"[\W_]*$", last)[0]
    better = " ".join(lex.forms.get(x, x) for x in better.split(" ")) if better.islower() else better
    word = better if not c.isupper() else better.upper()
    if c[:1].isupper() and word[:1].islower():
        word = word[:1].upper() + word[1:]
    return f"{lead}{word}{trail}"


def page_misread(rows, edge, lex: Lexicon) -> tuple[set[int], list[list[str]], list[tuple[int, int]]]:
    """Lines of a page with misread words, the corrected tokens of each line,
    and its broken words as (line, next line)."""
    toks, breaks = _page_tokens(rows, edge)
    bad: set[int] = set()
    fixed = [list(t) for t in toks]
    first_lost, last_lost = {b for _, b in breaks}, {a for a, _ in breaks}
    top = next((i for i in range(len(rows)) if not edge[i] and toks[i]), -1)
    for i, line in enumerate(toks):
        broken = bool(rows[i]["text"] and _BREAK.search(rows[i]["text"].rstrip()))
        cores = [core(t) for t in line]
        skip = -1
        for j in range(len(line)):
            # a small letter opening the page may be the rest of a word broken on the page before
            if j <= skip or (j == 0 and (i in first_lost or (i == top and line[0][:1].islower()))) or (j == len(line) - 1 and (broken or i in last_lost)):
                continue
            # the half of a broken word is no neighbour to grow together with
            window = cores[: len(cores) - 1] if broken or i in last_lost else cores
            better, n = misread(window, j, lex)
            if n:
                bad.add(i)
                if better:
                    fixed[i][j] = _mended(line[j], line[min(j + n - 1, len(line) - 1)], cores[j], better, lex)
                    for k in range(j + 1, min(j + n, len(line))):
                        fixed[i][k] = ""
                skip = j + n - 1
    for a, b in breaks:
        left, right = core(toks[a][-1]), core(toks[b][0])
        left = left.rstrip("-‐¬­‑")
        key = fold(left + right)
        if lex.frequent(key) or lex.frequent(fold(f"{left}-{right}")) or not key:
            continue
        for half, i in ((left, a), (right, b)):
            if _DIGIT.search(half) and _LETTER.search(half) or _SYMBOL.search(half):
                bad.add(i)
        if a in bad or b in bad or not key.isalpha():
            continue
        if left[:1].isupper():
            continue
        ok = [(w, p) for w, p in lex.edits(key) if lex.words[w] >= RATIO * max(1, lex.count(key))]
        best = _choose(ok, lex, [fold(core(t)) for t in toks[a][-4:-1] + toks[b][1:4]], 1)
        if best:
            same = next((k for k, (x, y) in enumerate(zip(key, best, strict=False)) if x != y), min(len(key), len(best)))
            bad.add(a if same < len(fold(left)) else b)
    return bad, fixed, breaks


def scan_noise(book_lines: DataFrame) -> DataFrame:
    """``book_id, page, block_seq, line_seq, noise`` of the noisy lines.

    Null texts, empty tables and books of one line give no misreadings; null
    sizes are taken for body text; repeated rows count once; a null ``book_id``
    or ``page`` is no record.  Extra columns are ignored.
    """
    pages = cut(pages_of(book_lines))
    lex, rest = learn(pages)
    return with_counts(pages, ["book_id", "page"], _page_lines, lex, rest).mapInPandas(
        lambda it: _noise(it, lex), "book_id string, page int, block_seq int, line_seq int, noise string"
    ).distinct()


def _page_paragraphs(batches: Iterator[pd.DataFrame], lex: Lexicon | None) -> Iterator[pd.DataFrame]:
    for pages in batches:
        out: list[tuple] = []
        for n_page, (book, page, rows, body) in enumerate(zip(pages["book_id"], pages["page"], pages["lines"], pages["body"], strict=True)):
            edge = margin_flags(rows, body)
            if lex:
                lex.look(pages["known"].iloc[n_page])
            fixed, breaks = page_misread(rows, edge, lex)[1:] if lex else _page_tokens(rows, edge)
            joins = {a: b for a, b in breaks}
            right = np.median([r["x1"] for k, r in enumerate(rows) if not edge[k] and r["x1"] is not None] or [0])
            seq, text, prev = 0, "", None
            for i, r in enumerate(rows):
                if edge[i] or not fixed[i]:
                    continue
                line = " ".join(t for t in fixed[i] if t)
                if prev is not None:
                    closed = re.search(r"[.!?…:][”»\"')]*$", text) and rows[prev]["x1"] is not None and rows[prev]["x1"] < 0.86 * right
                    if closed:
                        out.append((book, page, seq, text))
                        seq, text = seq + 1, ""
                if text and prev in joins and joins[prev] == i:
                    left, first = text.rsplit(" ", 1)[-1].rstrip("-‐¬­‑"), line.split(" ", 1)[0]
                    whole = lex and _compound(left, first, lex)
                    text = text.rstrip("-‐¬­‑") + ("-" if whole else "") + line
                else:
                    text = f"{text} {line}" if text else line
                prev = i
            if text:
                out.append((book, page, seq, text))
        yield pd.DataFrame(out, columns=["book_id", "page", "seq", "text"])


def _compound(left: str, right: str, lex: Lexicon) -> bool:
    """Whether the hyphen between two halves is the word's own."""
    apart, joined = fold(core(left) + "-" + core(right)), fold(core(left) + core(right))
    # broken words are counted as joined, compounds broken at their hyphen among them
    return lex.frequent(apart) and lex.words[apart] > lex.words.get(joined, 0)


def _joined_breaks(text: str, lex: Lexicon) -> tuple[str, list[tuple[int, int, str]]]:
    """A text with its broken words joined, and the places and what stands there then."""
    breaks, out, last = [], [], 0
    for m in _RUN_BREAK.finditer(text):
        right = text[m.end() :].split(None, 1)[0]
        left = text[: m.start()].rsplit(None, 1)[-1]
        breaks.append((m.start(), m.end(), "-" if _compound(left, right, lex) else ""))
        out += [text[last : m.start()], breaks[-1][2]]
        last = m.end()
    return "".join([*out, text[last:]]), breaks


def mended_runs(texts: list[str], lex: Lexicon) -> list[str]:
    """The run texts of an element with broken words joined and misread words
    corrected.  A word that crosses runs stays in the run it begins in."""
    chars = "".join(texts)
    owner = [k for k, t in enumerate(texts) for _ in t]

    def put(spans: list[tuple[int, int, str]]) -> None:
        nonlocal chars
        for a, b, new in reversed(spans):
            chars = chars[:a] + new + chars[b:]
            owner[a:b] = [owner[a]] * len(new)

    put(_joined_breaks(chars, lex)[1])
    at = [m.span() for m in re.finditer(r"\S+", chars)]
    tokens = [chars[a:b] for a, b in at]
    cores = [core(t) for t in tokens]
    spans, skip = [], -1
    for j in range(len(tokens)):
        if j <= skip:
            continue
        better, n = misread(cores, j, lex)
        skip = j + n - 1
        if n and better:
            last = min(j + n - 1, len(tokens) - 1)
            spans.append((at[j][0], at[last][1], _mended(tokens[j], tokens[last], cores[j], better, lex)))
    put(spans)
    out = [[] for _ in texts]
    for c, k in zip(chars, owner, strict=True):
        out[k].append(c)
    return ["".join(x) for x in out]


def repaired_runs(elements: DataFrame, book_lines: DataFrame) -> DataFrame:
    """``book_id, el_seq, run, text``: the runs of the elements of scanned books,
    words mended by the lexicon of ``book_lines``.

    Null run texts read as empty, null or empty runs give no row; repeated rows
    count once.  A run may be left empty where its words began in the run before.
    """
    books = book_lines.select("book_id").where("book_id is not null").distinct()
    runs = (
        elements.where("runs is not null and size(runs) > 0")
        .join(books, "book_id", "left_semi")
        .groupBy("book_id", "el_seq")
        .agg(F.max(F.transform("runs", lambda r: F.coalesce(r["text"], F.lit("")))).alias("texts"))
    )
    lex, rest = learn(cut(pages_of(book_lines)))

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for b, s, texts, known in zip(pdf["book_id"], pdf["el_seq"], pdf["texts"], pdf["known"], strict=True):
                lex.look(known)
                rows += [(b, s, k, t) for k, t in enumerate(mended_runs(list(texts), lex))]
            yield pd.DataFrame(rows, columns=["book_id", "el_seq", "run", "text"])

    return with_counts(runs, ["book_id", "el_seq"], _run_lines, lex, rest).mapInPandas(mend, "book_id string, el_seq int, run int, text string")


def joined_texts(book_lines: DataFrame) -> DataFrame:
    """``text``: the lines of each page joined to paragraphs, words as read."""
    parts = pages_of(book_lines).mapInPandas(lambda it: _page_paragraphs(it, None), "book_id string, page int, seq int, text string")
    return parts.select("text")


def reflowed_paragraphs(book_lines: DataFrame) -> DataFrame:
    """``book_id, para_seq, first_page, text``: continuous paragraphs without
    furniture, words mended, pages joined where a paragraph runs on.

    Lines found to be repeated notices are left out as well.
    """
    from leafmill.llm.notices import without_repeated_lines

    pages = cut(pages_of(without_repeated_lines(book_lines)))
    lex, rest = learn(pages)
    parts = cut(with_counts(pages, ["book_id", "page"], _page_lines, lex, rest).mapInPandas(lambda it: _page_paragraphs(it, lex), "book_id string, page int, seq int, text string"))
    # the window over a book sees flags only; the texts are joined to the numbers
    ended, lower = F.col("text").rlike(r"[.!?…:][”»\"')]*$"), F.col("text").rlike(r"^\p{Ll}")
    order = W.partitionBy("book_id").orderBy("page", "seq")
    flags = parts.select("book_id", "page", "seq", ended.alias("ended"), lower.alias("lower"))
    before = F.lag("ended").over(order)
    runs_on = (F.col("seq") == 0) & before.isNotNull() & (~before | F.col("lower"))
    numbers = flags.withColumn("new", F.when(runs_on, 0).otherwise(1)).withColumn("para_seq", F.sum("new").over(order)).select("book_id", "page", "seq", "para_seq")
    numbered = parts.join(numbers.hint("merge"), ["book_id", "page", "seq"])
    joined = F.array_join(F.sort_array(F.collect_list(F.struct("page", "seq", "text")))["text"], " ")
    return (
        numbered.groupBy("book_id", "para_seq")
        .agg(F.min("page").alias("first_page"), joined.alias("text"))
        .withColumn("text", F.regexp_replace("text", r"(?<=\p{L})[-‐¬­‑] (?=\p{Ll})", ""))
    )
