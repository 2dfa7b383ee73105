"""Problem 4: statistics of every element's text and what kind of text it is.

Characters, tokens and words are counted in Arrow batches, each text once: the
usual ratios, and repetition (duplicate lines and paragraphs, how much of the
text its dominant word n-grams cover).  Combined rules, one built-in expression,
then tell prose from lists, tables, indexes, contents, boilerplate and junk.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_COMMON = 100_000  # rows of common_words that may travel with a task

MEASURES = (
    "words int, mean_word_length double, symbol_share double, end_mark_share double, common_share double, digit_share double, "
    "duplicate_line_share double, duplicate_paragraph_share double, top_word_share double, top_bigram_coverage double, top_trigram_coverage double, "
    "repeated_5gram_coverage double, tokens int, longest int, solid int, letters int, digits int, eastern int, top_char_share double, commas int, "
    "separators int, leaders int, items int, ends int, numbers int, mixed int, odd_share double"
)
STATISTICS = [
    "words", "mean_word_length", "symbol_share", "end_mark_share", "common_share", "digit_share", "duplicate_line_share", "duplicate_paragraph_share",
    "top_word_share", "top_bigram_coverage", "top_trigram_coverage", "repeated_5gram_coverage",
]

_CHAR = r"(?:[^\W\d_]|[\u0300-\u036f\u0900-\u0963\u0970-\u097f\u064b-\u065f])"
_WORD = re.compile(rf"{_CHAR}+(?:[-'’·‐]{_CHAR}+)*")
_SIGNS = re.compile(r"[\u0300-\u036f\u0900-\u097f\u064b-\u065f]")
_PLAIN_WORD = re.compile(r"[^\W\d_]+(?:[-'’·‐][^\W\d_]+)*")  # the same where no signs are about
_EASTERN = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿]")
_VOWEL = re.compile(r"[aeiouyáéíóúàèìòùâêîôûãõäëïöüæœåø]", re.I)
_MIXED = re.compile(r"(?=\w*\d)(?=\w*[^\W\d_])\w{3,}")
_NUMBER = re.compile(r"^[\W_]*\d[\d.,:/%\-–]*[\W_]*$")
_DIGIT = re.compile(r"\d")

_CLOSING = "'\"”’»)]」』"
_END_MARKS = frozenset(".!?…。！？।॥؟")
_EAST_ENDS = "。！？"
_LINE_ENDS = _END_MARKS | frozenset("؟;:،,;·")
_LEADER = re.compile(r"(?:[.·…_‥]\s?){4,}\s*\d{1,4}|(?:[.·…_]\s?){6,}")
_LEADER_CHARS = ".·…_‥"
_ITEM = re.compile(r"\d{1,3}[.)]|[-*•–]")
_SEPARATOR = re.compile(r"[,;|/\t•·\n]|\s{2,}|\s-\s")
_SEPARATORS = ",;|/•·"
_GREEK = re.compile("[α-ωά-ώ]")
#: The same in a pattern of built-in expressions.
SENTENCE_END = r"(?:[.!?…。！？।॥؟]|(?<=[α-ωά-ώ]);)['\"”’»)\]」』]*(?=\s|$)|[。！？]"


def common_by_language(common_words: DataFrame) -> dict[str, frozenset[str]]:
    """The table of function words; checked to be small before it is read."""
    rows = common_words.select("lang", F.lower("word").alias("word")).where("word is not null").limit(MAX_COMMON + 1).collect()
    if len(rows) > MAX_COMMON:
        raise ValueError(f"common_words has more than {MAX_COMMON} rows; it is meant to hold function words only")
    by: dict[str, set[str]] = defaultdict(set)
    for r in rows:
        by[r["lang"]].add(r["word"])
    return {k: frozenset(v) for k, v in by.items()}


def _grams(words: list[str], n: int) -> Counter:
    return Counter(zip(*(words[i:] for i in range(n)), strict=False))


def _coverage(grams: Counter, letters: int) -> float:
    """Share of the words' characters inside the most frequent n-gram."""
    k = max(grams.values(), default=0)
    if k < 2:
        return 0.0
    return min(1.0, k * max(sum(map(len, g)) for g, c in grams.items() if c == k) / max(1, letters))


def _repeated(words: list[str], n: int) -> float:
    """Share of the words that stand in an n-gram seen before."""
    seen: set[tuple] = set()
    covered, upto = 0, 0
    for i, g in enumerate(zip(*(words[k:] for k in range(n)), strict=False)):
        if g in seen:
            covered += i + n - max(upto, i)
            upto = i + n
        seen.add(g)
    return covered / len(words) if words else 0.0


def repetition(words: list[str], letters: int) -> tuple[float, float, float]:
    """Coverage of the dominant bigram and trigram, and the share of repeated
    5-grams; longer n-grams are repeated only where shorter ones are."""
    pairs = _grams(words, 2)
    if len(pairs) == sum(pairs.values()):
        return 0.0, 0.0, 0.0
    threes = _grams(words, 3)
    if len(threes) == sum(threes.values()):
        return _coverage(pairs, letters), 0.0, 0.0
    return _coverage(pairs, letters), _coverage(threes, letters), _repeated(words, 5)


def _duplicates(parts: list[str]) -> float:
    parts = [p.strip() for p in parts if p.strip()]
    return 1 - len(set(parts)) / len(parts) if parts else 0.0


def languages_of(commons: dict[str, frozenset[str]]) -> dict[str, tuple[str, ...]]:
    """The languages of each common word."""
    by: dict[str, list[str]] = defaultdict(list)
    for lang, known in commons.items():
        for w in known:
            by[w].append(lang)
    return {w: tuple(langs) for w, langs in by.items()}


def common_share(counts: Counter, n: int, text: str, eastern: int, solid: int, commons: dict[str, frozenset[str]], languages: dict[str, tuple[str, ...]]) -> float:
    """Greatest share of one language's common words; of scripts without spaces,
    the characters the common words cover."""
    if eastern > 0.3 * max(1, solid):
        cover = (sum(len(w) * text.count(w) for w in commons.get(k, ())) for k in ("ja", "zh"))
        return min(1.0, max(cover) / eastern)
    by: Counter[str] = Counter()
    for w in languages.keys() & counts.keys():
        for lang in languages[w]:
            by[lang] += counts[w]
    return max(by.values()) / n if by else 0.0


@functools.lru_cache(50_000)
def _odd(word: str) -> int:
    """Of a Latin word of four letters or more: 1 without a vowel, else 0; -1 of others."""
    return -1 if len(word) < 4 or not word.isascii() else int(not _VOWEL.search(word))


class _Kinds(dict):
    """Whether a character is a letter (or a sign of one), a digit, an eastern letter."""

    def __missing__(self, char: str) -> tuple[int, int, int]:
        letter = char.isalpha() or "ऀ" <= char <= "ॿ" or "ً" <= char <= "ٟ"
        kind = self[char] = int(letter), int(char.isdigit()), int(bool(_EASTERN.match(char)))
        return kind


_KINDS = _Kinds()


def _ends(tokens: list[str], chars: Counter) -> int:
    """Marks that end a sentence: at the end of a token, closing marks aside, and
    the eastern ones anywhere."""
    n = sum(chars[c] for c in _EAST_ENDS if c in chars)
    for t in tokens:
        bare = t.rstrip(_CLOSING)
        last = bare[-1:]
        if last in _END_MARKS and last not in _EAST_ENDS or last == ";" and _GREEK.fullmatch(bare[-2:-1]):
            n += bool(last)
    return n


def _separators(text: str, tokens: list[str], chars: Counter, blanks: int) -> int:
    if blanks != len(tokens) - 1 or text.count(" ") != blanks:
        return len(_SEPARATOR.findall(text))  # line ends, tabs or wide gaps
    return sum(chars[c] for c in _SEPARATORS if c in chars) + text.count(" - ")


def measure(text: str, languages: dict[str, tuple[str, ...]], commons: dict[str, frozenset[str]]) -> tuple:
    """``MEASURES`` of one text.  Characters are looked at once each kind, tokens
    and words once; patterns run only where their characters occur."""
    low = text.lower()
    words = (_PLAIN_WORD if low.isascii() or not _SIGNS.search(low) else _WORD).findall(low)
    n, in_words = len(words), sum(map(len, words))
    tokens = text.split()
    chars = Counter(low)
    blanks = sum(chars.pop(c) for c in [c for c in chars if c.isspace()])
    solid = sum(chars.values())
    letters = digits = eastern = 0
    for c, k in chars.items():
        letter, digit, east = _KINDS[c]
        letters, digits, eastern = letters + k * letter, digits + k * digit, eastern + k * east
    size = max(1, solid)
    lines = [x for x in text.split("\n") if x.strip()] if "\n" in text else [text] if tokens else []
    marks = sum((x.rstrip().rstrip(_CLOSING) or " ")[-1] in _LINE_ENDS for x in lines)
    numbers = mixed = items = 0
    if digits:
        with_digit = [t for t in tokens if _DIGIT.search(t)]
        numbers = sum(bool(_NUMBER.match(t)) for t in with_digit)
        mixed = sum(bool(_MIXED.fullmatch(t.strip(".,;:!?()"))) for t in with_digit)
    if digits or any(c in chars for c in "-*•–"):
        items = sum(bool(_ITEM.fullmatch(t)) for t in [t for t in tokens[:-1] if len(t) <= 4 and t[-1] in ".)-*•–"])
    counts = Counter(words)
    odd = [k for k in map(_odd, words) if k >= 0] if n >= 5 else []
    return (
        n,
        in_words / n if n else 0.0,
        (solid - letters - digits) / size if solid else 0.0,
        marks / len(lines) if lines else 0.0,
        common_share(counts, n, text, eastern, solid, commons, languages),
        digits / size,
        _duplicates(lines) if len(lines) > 1 else 0.0,
        _duplicates(text.split("\n\n")) if "\n\n" in text else 0.0,
        max(counts.values()) / n if n else 0.0,
        *(repetition(words, in_words) if len(counts) < n else (0.0, 0.0, 0.0)),
        len(tokens),
        max(map(len, tokens), default=0),
        size,
        letters,
        digits,
        eastern,
        max(chars.values()) / solid if solid else 0.0,
        chars[","] + chars[";"],
        _separators(text, tokens, chars, blanks),
        len(_LEADER.findall(text)) if sum(chars[c] for c in _LEADER_CHARS) >= 4 else 0,
        items,
        _ends(tokens, chars),
        numbers,
        mixed,
        sum(odd) / len(odd) if len(odd) >= 5 else 0.0,
    )


REPEATED = 0.6  # said twice, a text is half repeated and may be prose yet; said three times, two thirds


def repetitive() -> Column:
    """Whether what is repeated outweighs the rest: one word, a phrase, a passage
    or a line said over and over.  Common words do not make that prose."""
    n = F.col("words")
    over = lambda c: F.col(c) > REPEATED
    phrase = over("top_bigram_coverage") | over("top_trigram_coverage")
    passage = over("repeated_5gram_coverage") | over("duplicate_line_share") | over("duplicate_paragraph_share")
    spaced = F.col("eastern") <= 0.3 * F.col("solid")  # where nothing parts the words there are no phrases
    return ((n >= 5) & (F.col("top_word_share") > 0.5)) | ((n >= 12) & phrase & spaced) | ((n >= 8) & passage)


def verdict(t: Column) -> Column:
    """Prose, list, table, index, contents, boilerplate, junk or blank, by
    combined rules over the measured columns."""
    c = F.col
    n, tokens, solid, common, ends = c("words"), c("tokens"), c("solid"), c("common_share"), c("ends")
    items, separators, numbers, mixed = c("items"), c("separators"), c("numbers"), c("mixed")
    closed = F.substring(t, -4, 4).rlike(SENTENCE_END)
    east = F.when((common >= 0.02) | (F.length(t) < 12) | ((ends > 0) & (solid < 40 * ends)), "prose").otherwise(F.when(separators > 0, "list").otherwise("junk"))
    signs = F.when(c("digits") > 0.25 * solid, "table").otherwise("junk")
    figures = F.when(c("commas") >= 0.6 * numbers, "index").otherwise("table")
    prose = (
        ((common >= 0.08) & (n >= 6) & (ends > 0))
        | ((ends > 0) & (n >= 2 * ends) & (items <= 1) & (separators <= F.when(closed, 0.55).otherwise(0.25) * n))
        | ((n < 8) & (ends > 0) & (separators <= 1) & (items <= 1))
        | ((ends > 0) & (n <= 12 * ends) & (items <= 1) & (separators <= 0.35 * n) & ((common > 0) | (n < 5 * ends)))
    )
    return (
        F.when(tokens == 0, "blank")
        .when((c("leaders") >= 2) | ((c("leaders") == 1) & t.rlike(r"[0-9]\s*$")), "contents")
        .when((solid >= 6) & (c("top_char_share") > 0.6), "junk")
        .when(repetitive(), F.when(c("top_word_share") > 0.5, "junk").otherwise("boilerplate"))
        .when(c("eastern") > 0.3 * solid, east)
        .when(c("letters") < 0.5 * solid, signs)
        .when((c("longest") >= 40) & (c("longest") > 0.5 * solid) & (tokens < 6) & ~F.substring(t, 1, 8).contains("/"), "junk")
        .when((common >= 0.15) & (numbers <= 0.4 * tokens), "prose")
        # hardly any function word: prose only where it is short and closed like a sentence
        .when((numbers >= 3) & (numbers >= 0.3 * tokens), figures)
        .when((mixed >= 3) & (mixed > 0.12 * tokens), "junk")
        .when(c("odd_share") > 0.2, "junk")
        .when(prose, "prose")
        .when((items >= 3) | (separators >= 0.3 * n), "list")
        .when(n < 4, F.when(ends > 0, "prose").otherwise("junk"))
        .otherwise("list")
    )


def element_text(runs: Column) -> Column:
    """Runs joined without a separator; null runs and texts read as empty."""
    return F.array_join(F.transform(F.coalesce(runs, F.array()), lambda r: F.coalesce(r["text"], F.lit(""))), "")


def text_statistics(elements: DataFrame, common_words: DataFrame) -> DataFrame:
    """``book_id, el_seq, kind`` and the statistics and verdict of each element.

    One row per element however often repeated (of differing texts the
    greatest).  Null runs and blank texts get the verdict ``blank``; elements
    that are not paragraphs are measured like them.  Very long texts are
    measured whole; an empty ``common_words`` makes every share 0.
    """
    commons = common_by_language(common_words)
    languages = languages_of(commons)
    one = elements.groupBy("book_id", "el_seq", "kind").agg(F.max(element_text(F.col("runs"))).alias("text"))

    names = [c.split(" ")[0] for c in MEASURES.split(", ")]

    @F.pandas_udf(MEASURES)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            yield pd.DataFrame([measure(t, languages, commons) for t in s], columns=names)

    d = one.withColumn("m", run("text")).select("book_id", "el_seq", "kind", "text", "m.*")
    return d.select("book_id", "el_seq", "kind", "text", *STATISTICS, verdict(F.col("text")).alias("verdict"))


def not_prose(elements: DataFrame, common_words: DataFrame) -> DataFrame:
    """``book_id, el_seq`` of the paragraphs that are not natural prose."""
    stats = text_statistics(elements.where("kind = 'paragraph'"), common_words)
    return stats.where("verdict not in ('prose', 'blank')").select("book_id", "el_seq").distinct()
