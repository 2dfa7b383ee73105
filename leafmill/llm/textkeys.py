"""Letter keys: what a line reads like, aside from case, accents, digits,
spacing and punctuation."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Glyph groups that scans confuse with one letter (fixed values); both sides
#: of a comparison are folded, so such a misreading costs nothing.
GLYPH_GROUPS = (("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"))

_NOT_LETTER = re.compile(r"[\W\d_]+")
_PAGE_WORD = (
    r"(?:p|pp|pg|pag|page|pagina|pagine|s|seite|st|str|стр|с|σ|σελ|σελιδα|f|fl|fol|folio|folha|hoja|blatt|blattseite|feuillet|"
    r"第|ページ|页|頁|ص|صفحة|पृ|पृष्ठ)"
)
_NUMBER = r"(?:\d{1,5}|[ivxlcdm]{1,8})"
_PAGE_NUMBER = re.compile(
    rf"^(?:{_PAGE_WORD}\s*)?{_NUMBER}(?:\s*(?:/|de|of|von|sur|из|από|の|共|من|में से|di|del|da)\s*{_NUMBER})?(?:\s*{_PAGE_WORD})?$"
)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def fold(text: str) -> str:
    """Lower case without accents; compatibility forms resolved."""
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFKD", text)
    return unicodedata.normalize("NFC", "".join(c for c in t if not unicodedata.combining(c))).lower()


def letters(text: str | None) -> str:
    """Only the letters of ``fold(text)``."""
    return _NOT_LETTER.sub("", fold(text)) if text else ""


def glyphs(key: Column) -> Column:
    """A letter key with misread glyph groups folded."""
    for group, one in GLYPH_GROUPS:
        key = F.replace(key, F.lit(group), F.lit(one))
    return key


def is_page_number(text: str | None) -> bool:
    """Whether the line is a page number only: digits or Roman numerals, bare
    or in dashes and brackets, with a page word or "n of m"."""
    if not text:
        return False
    t = text
    while True:
        cut = _EDGE.sub("", t)
        if cut == t:
            break
        t = cut
    t = re.sub(r"[.\-–—:]+\s*", " ", fold(t)).strip()
    return bool(_PAGE_NUMBER.match(t))
