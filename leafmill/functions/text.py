"""Scalar text rules as Column expressions.

White space is the Unicode property, spelled out so that the same class can be
used in any engine; letters and digits are Unicode classes as well.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of the White_Space property (fixed values), without brackets.
WS = r"\t\n\x0b\x0c\r \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: Ligatures and their letters (fixed values).
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}

#: Patterns that decide what a text is (fixed values).
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{fffe}\x{ffff}]"
BULLET = rf"^[{WS}]*([•·▪◦‣∙*–—\-])[{WS}]+"
ENUMERATOR = rf"(?i)^[{WS}]*(\(?[0-9]{{1,3}}[.)]|\(?[a-z][.)]|\(?[ivxlcdm]{{1,5}}[.)])[{WS}]+"
CHAPTER_NAMES = (
    "anexo", "apêndice", "ato", "book", "capítulo", "chapter", "conclusão", "epílogo", "introdução", "livro", "part", "parte",
    "prefácio", "prólogo", "seção", "section",
)


def _accent_or_none(word: str) -> str:
    """A pattern of the word in which accented letters may stand without accent."""
    return "".join(c if c.isascii() else f"[{c}{unicodedata.normalize('NFD', c)[0]}]" for c in word)


CHAPTER_WORDS = "|".join(map(_accent_or_none, CHAPTER_NAMES))
CHAPTER = rf"(?i)^[{WS}]*({CHAPTER_WORDS})($|[^\p{{L}}\p{{M}}\p{{N}}_])"
NUMBERED = rf"^[{WS}]*[0-9]{{1,2}}(\.[0-9]{{1,2}}){{0,2}}[{WS}]+[^{WS}]"
TOC_LEADER = rf"([.·][{WS}]?){{4,}}"
TOC_TAIL = rf"[{WS}]{{2,}}[0-9]{{1,4}}[{WS}]*$"
TOC_SHORT_TAIL = rf"[{WS}][0-9]{{1,3}}[{WS}]*$"
NOTE_MARKER = rf"^[{WS}]*(\[?[0-9]{{1,3}}\]?[.)]?|\*{{1,3}})[{WS}]+[^{WS}]"
SENTENCE_END = r"[.!?…:;»”\"')\]]$"
PARAGRAPH_END = r"[.!?…][\"'»”’)\]]?$"
ROMAN = r"(?i)^[ivxlcdm]{1,7}$"
PAGE_OF = rf"(?i)^(p[áa]g(ina)?\.?)?[{WS}]*#?[{WS}]*[0-9]+[{WS}]*(de|/)[{WS}]*[0-9]+$"


def has(c: Column, pattern: str) -> Column:
    """Whether a pattern is found; ``(?i)`` means Unicode case as well."""
    return F.coalesce(c.rlike(pattern.replace("(?i)", "(?iu)")), F.lit(False))


def utrim(c: Column) -> Column:
    """Strip Unicode white space at both ends."""
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+$", "")


def urtrim(c: Column) -> Column:
    return F.regexp_replace(c, rf"[{WS}]+$", "")


def sanitize(c: Column) -> Column:
    """Without the control characters a document file may not hold; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), CONTROL, "")


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(c: Column) -> Column:
    """Composed form; only texts with marks or beyond the common ranges are sent
    to Python, all others as nulls."""
    far = c.rlike(r"[^\x00-\x{2ff}\x{2010}-\x{2027}]")
    return F.when(far, _nfc(F.when(far, c))).otherwise(c)


def clean_composed(c: Column) -> Column:
    """``clean`` of a text that is composed already; stays in the JVM."""
    t = sanitize(c)
    for lig, letters in LIGATURES.items():
        t = F.replace(t, F.lit(lig), F.lit(letters))
    return F.regexp_replace(F.translate(t, "’­﻿", "'"), r"[ \t\xa0]+", " ")


def clean(c: Column) -> Column:
    """Sanitised text with ligatures resolved, soft hyphens dropped, typewriter
    apostrophes, composed letters and single blanks."""
    return nfc(clean_composed(c))


def _fold_one(text: str) -> str:
    t = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"\W+", "", t).lower()


@F.pandas_udf(T.StringType())
def _fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: None if t is None else _fold_one(t))


def fold(c: Column) -> Column:
    """The comparable skeleton of a text: no accents, punctuation or case."""
    plain = F.lower(F.regexp_replace(c, "[^A-Za-z0-9_]+", ""))
    far = c.rlike(r"[^\x00-\x7f]")
    return F.when(far, _fold(F.when(far, c))).otherwise(plain)


def running_key(c: Column) -> Column:
    """The key under which running lines agree: digits as #, single blanks."""
    t = F.regexp_replace(F.lower(c), r"\p{Nd}+", "#")
    return utrim(F.regexp_replace(t, rf"[{WS}]+", " "))


def is_page_number(c: Column) -> Column:
    t = F.regexp_replace(c, r"^[ .\-–—\[\]()]+|[ .\-–—\[\]()]+$", "")
    return F.coalesce((t == "") | t.rlike(r"^[0-9]{1,4}$") | has(t, ROMAN) | has(t, PAGE_OF), F.lit(False))


def is_all_caps(c: Column) -> Column:
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(c, r"[^\p{Lu}]", ""))
    return F.coalesce((letters >= 3) & (upper / letters > 0.85), F.lit(False))


def list_marker(c: Column) -> Column:
    """Marker of a list item, null for other text."""
    starts = has(c, BULLET + rf"[^{WS}]"), has(c, ENUMERATOR + rf"[^{WS}]")
    return F.when(starts[0], F.regexp_extract(c, BULLET, 1)).when(starts[1], F.regexp_extract(c, ENUMERATOR, 1))


def list_rest(c: Column) -> Column:
    """The text behind the marker; other text unchanged."""
    bullet, enum = has(c, BULLET + rf"[^{WS}]"), has(c, ENUMERATOR + rf"[^{WS}]")
    return F.when(bullet, F.regexp_replace(c, BULLET, "")).when(enum, F.regexp_replace(c, ENUMERATOR, "")).otherwise(c)


def is_ordered(c: Column) -> Column:
    return has(c, ENUMERATOR + rf"[^{WS}]")


def is_chapter(c: Column) -> Column:
    return has(c, CHAPTER)


def is_toc_leader(c: Column) -> Column:
    return has(c, TOC_LEADER)


def is_toc_entry(c: Column) -> Column:
    return is_toc_leader(c) | has(c, TOC_TAIL) | ((F.length(c) < 70) & has(c, TOC_SHORT_TAIL))


def half_point(c: Column) -> Column:
    """Size rounded to half points, halves to even."""
    return F.rint(c * 2) / 2


def starts_lower(c: Column) -> Column:
    return has(c, r"^\p{Ll}")


def safe_filename(c: Column) -> Column:
    """Base name with everything outside a small set replaced."""
    base = F.regexp_extract(c, r"([^/\\]*)$", 1)
    t = F.regexp_replace(base, r"[^\p{L}\p{N}_.\- ]", "_")
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit("documento.pdf")).otherwise(t)


def front_key(c: Column) -> Column:
    """Letters and digits only, lower case, accents kept."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{M}\p{N}_]+", ""))


def stem(path: Column) -> Column:
    """File stem with underscores as blanks, or a fixed word."""
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^./]*$", "$1")
    t = utrim(F.replace(name, F.lit("_"), F.lit(" ")))
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit("Documento")).otherwise(t)
