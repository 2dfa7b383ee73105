"""Problem 2: text decoded with the wrong character encoding.

A best-first search walks over texts: an edge is one encode-and-decode, an
unescape or a glyph-table shift; visited texts are remembered by hash, and a
character-plausibility cost says which text to expand next and when the
cheapest reachable one has been found.  Only texts whose cost is not zero for
sure (one JVM pattern) go through the search.
"""

from __future__ import annotations

import functools
import heapq
import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN_KEY = ["book_id", "page", "block_seq", "line_seq", "span_seq"]
RESTORED = "text string, cost double, first_cost double, damaged boolean"

#: Single-byte encodings a text may wrongly have been read in (fixed values).
READ_AS = ("cp1252", "latin-1", "mac-roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866", "cp1253", "iso8859-5", "mac-cyrillic")
#: Encodings the bytes may really have been in (fixed values).
WRITTEN_IN = ("utf-8", "cp1252", "cp1251", "koi8-r", "cp866", "cp1253", "cp1256", "gbk", "shift_jis", "euc-kr", "big5", "mac-roman", "cp437", "cp850")
_MULTIBYTE = {"gbk", "shift_jis", "euc-kr", "big5"}

# Letters of Greek and Cyrillic that look like a Latin letter (fixed values): a
# Latin word holding one is a look-alike, not a wrong decoding.
_TWINS = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυικАВЕКМНОРСТУХЅІЈаеорсухіјѕһԁԛԝ"
_INVISIBLE = r"­​-‏⁠﻿̀-ͯ"
_LATIN = r"A-Za-zÀ-ÖØ-öø-ɏ"
_GREEK = "".join(c for c in map(chr, range(0x370, 0x400)) if c.isalpha() and c not in _TWINS)
_CYRIL = "".join(c for c in map(chr, range(0x400, 0x530)) if c.isalpha() and c not in _TWINS)
_OTHER = r"一-鿿぀-ヿ가-힯֐-ۿ"
_SIGN = (
    r"¢£¤¥¦§¨©¬®¯±´µ¶·¸¼½¾×÷†‡•‰€™ˆ˜ˇ˘˙˚˛˝√∂∑∏∫≈≠≤≥∞∆◊⌐⌠⌡⁄"
    + r"⌀-⏿─-◿₠-₫"
)
_LETTER = rf"{_LATIN}Ͱ-ϿЀ-ԯ"
_CONTROL = r"\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f-"

# Every entry: what it looks for, and its cost per finding.
_RULES: list[tuple[str, float]] = [
    (rf"[{_CONTROL}]", 3.0),
    ("�", 2.0),
    ("[ﬀ-ﬆ]", 0.05),
    (rf"(?<=[{_LETTER}])[?!](?=[{_LETTER}])", 1.5),
    (rf"(?<![^\s])\?(?=[a-zß-öø-ÿ])", 1.5),
    (rf"(?<=[{_LETTER}])[{_SIGN}]", 1.2),
    (rf"[{_SIGN}](?=[{_LETTER}])", 1.2),
    (rf"(?<=[{_LETTER}])[«¿¡‹“](?=[{_LETTER}\s])", 1.2),
    (rf"(?<=[{_LETTER}])[»›”…](?=[{_LETTER}])", 1.2),
    (rf"[{_SIGN}«»ªº°][{_SIGN}«»ªº°]", 1.0),
    (r"[ÂÃâÐÑÎÏ][ -¿]", 1.5),
    (r"â€", 1.5),
    (r"[À-ÖØ-öø-ÿŒœŠšŽžŸƒ]{3,}", 2.5),
    (r"(?<=[a-zß-öø-ÿα-ωа-яё])[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЀ-Џ]", 1.0),
    (rf"(?<=[{_LETTER}])[‚„]", 1.2),
    (rf"(?<=[{_LATIN}])[一-鿿가-힯｡-ﾟ]|[一-鿿가-힯](?=[{_LATIN}])", 1.2),
    (rf"(?<=[{_LATIN}ƒ])[؀-ۿ]|[؀-ۿ](?=[{_LATIN}ƒ])", 1.2),
    (r"[｡-ﾟ]{3,}", 2.0),
    (r"[ЀЂЃЄЇЉЊЋЌЎЏђѓєїљњћќўџҐґ]", 0.7),
    (rf"[–—][{_SIGN}ªºøæÄÅÇ]", 1.5),
    (r"(?i)(?<=[bcdfghjklmnpqrstvwxz])ß", 1.5),
    (rf"(?<!\S)[α-ωΑ-ΩА-Яа-я](?=\s[{_LATIN}])(?<!\([αx])", 1.0),
    (r"(?i)[bcdfghjklmnpqrstvwxz]{6,}", 1.0),
    (r"(?<![A-Za-zÀ-ɏ'’.])(?i:[bcdfghjklmnpqrstvwxz]{4,})(?![A-Za-zÀ-ɏ'’.])", 0.8),
    (r"(?<=[A-Za-z])[\"#$%&(*+<=>@\[\\^`{|}~](?=[A-Za-z])", 1.2),
    (r"[a-z][0-9][a-z]", 0.8),
    (r"&(?:[a-zA-Z]{2,8}|#\d{2,6}|#x[0-9a-fA-F]{2,6});", 2.0),
    (r"\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}", 2.0),
    (r"%[C-F][0-9A-F]%[89AB][0-9A-F]|=[C-F][0-9A-F]=[89AB][0-9A-F]", 2.0),
    (r"[^\s฀-鿿가-힯＀-￯_.\-]{36,}", 1.5),
    (r"[¡-ª¬-º¼-¿][؀-ۿ]", 1.2),
    (r"[ƀ-ɏ҂-ԯ܀-࣯]", 0.8),
    (rf"(?<=[{_LETTER}])‘(?=\S)", 1.2),
    (r"[¨´¸ˆ˜˘˙˚˛˝][‘’“”\xad]|[‘’“”\xad][¨´¸ˆ˜˘˙˚˛˝]", 1.0),
]
_COMPILED = [(re.compile(p), w) for p, w in _RULES]

# Russian letters from frequent to rare (fixed values), to tell one Cyrillic
# table from another where the case of the letters does not.
_RUSSIAN = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
_RUSSIAN_COST = {c: i / len(_RUSSIAN) for i, c in enumerate(_RUSSIAN)}
_CYR_LETTER = re.compile(r"[А-Яа-яёЁ]")
_CAPS = re.compile(r"[А-ЯЁ]{3,}")
# The same for Latin letters in European languages (fixed values).
_EUROPEAN = "eaoirsntdlcumpghbfvyjqzxkw"
_EUROPEAN_COST = {c: i / len(_EUROPEAN) for i, c in enumerate(_EUROPEAN)}
_MIXED = re.compile(rf"[{_LATIN}Ͱ-ϿЀ-ԯ]+")
_IS_LATIN = re.compile(rf"[{_LATIN}]")
_IS_GREEK_CYR = re.compile(r"[Ͱ-ϿЀ-ԯ]")
_ODD_GREEK_CYR = re.compile(rf"[{_GREEK}{_CYRIL}]")
# Latin letters without a Greek or Cyrillic twin (fixed values).
_ODD_LATIN = re.compile(r"[DFGLQRUWbdfghlmnqrtwzÀ-ÖØ-öø-ɏ]")


def _mixture(text: str) -> float:
    """Letters of the lesser script that stand inside words of both scripts and
    have no twin in the other script; those with a twin count very little."""
    foreign = len(_IS_GREEK_CYR.findall(text))
    if not foreign:
        return 0
    latin = len(_IS_LATIN.findall(text))
    if not latin:
        return 0
    odd, any_ = (_ODD_GREEK_CYR, _IS_GREEK_CYR) if latin >= foreign else (_ODD_LATIN, _IS_LATIN)
    return sum(
        len(odd.findall(w)) + 0.03 * len(any_.findall(w))
        for w in _MIXED.findall(text)
        if _IS_LATIN.search(w) and _IS_GREEK_CYR.search(w)
    )


def _letter_mean(text: str) -> tuple[float, int]:
    """Mean rank share of the ASCII letters, from 0 (frequent) to 1 (rare)."""
    ranks = [_EUROPEAN_COST[c] for c in text.lower() if c in _EUROPEAN_COST]
    return (sum(ranks) / len(ranks) if ranks else 0.0), len(ranks)

#: JVM counterpart: texts it does not match have cost zero.
SUSPECT = (
    r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f�-]"
    r"|\p{L}[?!]\p{L}|(?:^|\s)\?\p{Ll}"
    r"|\p{L}[\p{S}¢£¤¥¦§¨©¬®¯±²³´µ¶·¸¹¼½¾×÷†‡•‰‚„«¿¡‹“ˆ]|[\p{S}¢£¤¥¦§¨©¬®¯±²³´µ¶·¸¹¼½¾×÷†‡•‰‚„»›…”ˆ]\p{L}"
    r"|[\p{S}\p{No}¡¢-¿]{2}|[ÂÃâÐÑÎÏ][ -¿]|[À-ÖØ-öø-ÿŒœŠšŽžŸƒ]{3,}|\p{Ll}\p{Lu}"
    r"|[\p{IsLatin}][\p{IsGreek}\p{IsCyrillic}\p{IsHan}\p{IsHangul}]|[\p{IsGreek}\p{IsCyrillic}\p{IsHan}\p{IsHangul}][\p{IsLatin}]"
    r"|[｡-ﾟ]{3,}|[ЀЂЃЄЅІЇЈЉЊЋЌЎЏђѓєѕіїјљњћќўџҐґ]|[А-Я]{3,}|[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ]ß"
    r"|(?:^|\s)[α-ωΑ-ΩА-Яа-я][\s\xa0]+\p{IsLatin}|[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ]{4,}"
    r"|[A-Za-z][\"#$%&(*+<=>@\[\\^`{|}~][A-Za-z]|[a-z][0-9][a-z]"
    r"|&(?:\w{2,8}|#\w{2,6});|\\[ux][0-9a-fA-F]{2}|[%=][C-F][0-9A-F][%=]|[^\s฀-鿿가-힯＀-￯_.\-]{36,}"
    r"|[–—][\p{S}ªºøæÄÅÇ¡-¿]|[¡-ª¬-º¼-¿][؀-ۿ]|[ƀ-ɏ҂-ԯ܀-࣯]"
    r"|\p{L}‘\S|[¨´¸ˆ˜˘˙˚˛˝][‘’“”\xad]|[‘’“”\xad][¨´¸ˆ˜˘˙˚˛˝]"
)


_CONSONANT = "bcdfghjklmnpqrstvwxz"
_CONSONANT += _CONSONANT.upper()
#: Texts of these characters alone can be suspects by the few patterns below only.
BEYOND_PLAIN = r"[^A-Za-zÀ-ÖØ-öø-ÿ0-9 .,;:\-]"
PLAIN_SUSPECT = rf"[a-zß-öø-ÿ][A-ZÀ-ÖØ-Þ]|[À-ÖØ-öø-ÿ]{{3}}|[{_CONSONANT}]ß|[{_CONSONANT}]{{4}}|[a-z][0-9][a-z]|[^ .\-]{{36}}"
#: Damage of a name in ASCII alone.
ASCII_DAMAGE = r"\?|[%=][C-F][0-9A-F][%=]|&#?\w{2,8};|\\[ux][0-9a-fA-F]{2}"


def cost(text: str) -> float:
    """How implausible the characters of a text are, in sum; 0 is plain."""
    c = 0.0
    for rule, weight in _COMPILED:
        n = len(rule.findall(text))
        if n:
            c += n * weight
    if text.isascii():
        mean, n = _letter_mean(text)
        if n >= 4:
            c += max(0.0, mean - 0.36) * 1.5 * min(n, 40)
    else:
        c += 1.2 * _mixture(text)
        if _CAPS.search(text):
            found = _CYR_LETTER.findall(text)
            mean = sum(_RUSSIAN_COST.get(x.lower(), 1.0) for x in found) / len(found)
            c += max(0.0, mean - 0.34) * 1.5 * min(len(found), 40)
    return c


def _byte_table(name: str) -> dict[int, int]:
    """Character -> byte; bytes the encoding leaves undefined stand for the
    control of the same number, as careless decoders do."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[ord(bytes([b]).decode(name))] = b
        except UnicodeDecodeError:
            table.setdefault(b, b)
    return table


_BYTES = {e: _byte_table(e) for e in READ_AS}


def _to_bytes(text: str, enc: str) -> bytes | None:
    table = _BYTES[enc]
    out = bytearray()
    for ch in text:
        o = ord(ch)
        if o < 0x80:
            out.append(o)
        else:
            b = table.get(o)
            if b is None:
                return None
            out.append(b)
    return bytes(out)


_FOREIGN = re.compile(r"[^\x00-\x7f]+")


def _utf8_runs(text: str, enc: str) -> str:
    """Decode each non-ASCII run that is UTF-8 read in ``enc``; keep the rest."""
    table = _BYTES[enc]

    def one(m: re.Match) -> str:
        run, out, held = m[0], [], bytearray()

        def flush() -> None:
            if held:
                try:
                    out.append(held.decode("utf-8"))
                except UnicodeDecodeError as e:
                    good = held[: e.start].decode("utf-8", "ignore")
                    out.append(good + back(held[e.start :]))
                held.clear()

        inverse = _INVERSE[enc]

        def back(rest: bytearray) -> str:
            return "".join(inverse[b] for b in rest)

        for ch in run:
            b = table.get(ord(ch))
            if b is None:
                flush()
                out.append(ch)
            else:
                held.append(b)
        flush()
        return "".join(out)

    return _FOREIGN.sub(one, text)


_INVERSE = {e: {b: chr(o) for o, b in t.items()} for e, t in _BYTES.items()}
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})")
_QUOTED = re.compile(r"(?:[%=][0-9A-F]{2})+")


@functools.lru_cache(512)
def _shifted(k: int) -> dict[int, int]:
    return {o: o + k for o in range(0x100) if 9 <= o + k < 0x100}


def _shift(text: str, k: int) -> str:
    return text.translate(_shifted(k))


def _readable(text: str) -> bool:
    """Whether an unshifted text could be words: mostly small letters and
    spaces, frequent letters, vowels in their usual share."""
    small = [c for c in text if "a" <= c <= "z"]
    if len(small) < 2 or len(small) + text.count(" ") < 0.6 * len(text):
        return False
    vowels = sum(c in "aeiou" for c in small) / len(small)
    return 0.22 <= vowels <= 0.68 and _letter_mean(text)[0] < 0.4


def neighbours(text: str) -> Iterator[str]:
    """Texts one operation away.  Where runs of the text are valid UTF-8 and
    read better as such, no other table is tried: that is no coincidence."""
    foreign = not text.isascii()
    if foreign:
        here, better = cost(text), False
        for enc in READ_AS:
            got = _utf8_runs(text, enc)
            if got != text:
                better |= cost(got) < 0.4 * here
                yield got
        for enc in READ_AS if not better else ():
            raw = _to_bytes(text, enc)
            if raw is None:
                continue
            for dec in WRITTEN_IN[1:]:
                if dec == enc:
                    continue
                try:
                    got = raw.decode(dec, "replace" if dec in _MULTIBYTE else "strict")
                except UnicodeDecodeError:
                    continue
                if got != text:
                    yield got
    if "&" in text:
        yield html.unescape(text)
    if "\\" in text:
        yield _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)), text)
    if _QUOTED.search(text):
        yield _QUOTED.sub(lambda m: bytes.fromhex(re.sub("[%=]", "", m[0])).decode("utf-8", "replace"), text)
    # a glyph table shifted by a constant: any of the characters may be the space
    if sum(ord(c) < 0x100 for c in text) == len(text):
        shifts = {32 - ord(c) for c in set(text)} | {-1, 29, -31}
        for k in sorted(shifts - {0}):
            got = _shift(text, k)
            if _readable(got):
                yield got


STEP_COST = 0.25  # a longer way must pay for itself
DETOUR = 4.0  # the first step may make a text so much worse; every later one must make it better


def restore(text: str | None) -> tuple[str | None, float, float]:
    """The cheapest text reachable, its cost and the cost of the given text.

    The graph holds the texts one step away and all that are reached from them
    by steps that each lower the cost.  Its cheapest text is found whatever its
    depth: the search ends when no text beyond those held can beat the best, as
    each costs its steps at least.
    """
    if not text:
        return text, 0.0, 0.0
    first = cost(text)
    best, best_cost = text, first
    seen = {hash(text)}
    heap = [(first, 0, text, first)] if first else []
    while heap:
        _, depth, t, here = heapq.heappop(heap)
        if STEP_COST * (depth + 1) >= best_cost:
            continue
        for n in neighbours(t):
            h = hash(n)
            if h in seen:
                continue
            seen.add(h)
            plain = cost(n)
            cn = plain + STEP_COST * (depth + 1)
            if cn < best_cost:
                best, best_cost = n, cn
            if plain < (here if depth else first + DETOUR):
                heapq.heappush(heap, (cn, depth + 1, n, plain))
    return best, best_cost, first


#: Damage that no decoding undoes: replacement characters, question marks in
#: or before a word, controls that stayed.
_DAMAGE = re.compile(rf"�|(?<=[{_LATIN}Ͱ-ԯ])\?(?=[a-zß-öø-ÿα-ωа-я])|(?<!\S)\?(?=[a-zß-öø-ÿ]{{2}})|[{_CONTROL}]")
MARGIN = 0.6  # a restored text must be this much cheaper


def judge(text: str | None) -> tuple[str | None, float, float, bool]:
    """``restore`` and whether damage remains: null texts are plain."""
    best, after, before = restore(text)
    if before - after < MARGIN:
        best, after = text, before
    return best, after, before, bool(text and _DAMAGE.search(best or ""))


def restored(text: Column) -> Column:
    """Struct ``text, cost, first_cost, damaged`` of each text (Arrow)."""

    @F.pandas_udf(RESTORED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple] = {}
        for s in batches:
            rows = []
            for t in s:
                if t is None:
                    rows.append((None, 0.0, 0.0, False))
                    continue
                r = known.get(t)
                if r is None:
                    if len(known) > 20_000:
                        known.clear()
                    r = known[t] = judge(t)
                rows.append(r)
            yield pd.DataFrame(rows, columns=["text", "cost", "first_cost", "damaged"])

    return run(text)


def is_suspect(text: Column) -> Column:
    """The JVM filter: a suspect character, or ASCII letters of which too many
    are rare ones.  Texts of plain characters are looked at with few patterns."""
    lacking = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    letters = lacking("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    rare = lacking("bfhjkpqvwxyzBFHJKPQVWXYZ")
    signs = F.when(text.rlike(BEYOND_PLAIN), text.rlike(SUSPECT)).otherwise(text.rlike(PLAIN_SUSPECT))
    return F.coalesce(signs | ((letters >= 4) & (rare > 0.3 * letters)), F.lit(False))


def is_suspect_name(font: Column) -> Column:
    """The same of a font name, whose capitals inside are no sign of damage."""
    return F.coalesce(font.rlike(ASCII_DAMAGE) | (font.rlike(r"[^\x00-\x7f]") & is_suspect(font)), F.lit(False))


def _is_case(found: str, original: str) -> Column:
    return F.coalesce((F.col(f"{found}.text") != F.col(original)) | F.col(f"{found}.damaged"), F.lit(False))


def restored_spans(spans: DataFrame) -> DataFrame:
    """The garbled spans with ``text_restored``, ``font_restored`` and
    ``fully_restored``; one row per span, however often it is repeated.

    Null texts and fonts are plain, and so are empty ones.  Very long texts are
    searched whole.  Other columns are ignored; an empty table gives no rows.
    """
    bare = F.regexp_replace("font", r"^[A-Z]{6}\+", "")
    odd_font = is_suspect_name(bare)
    suspects = spans.select(*SPAN_KEY, "text", "font").where(is_suspect(F.col("text")) | odd_font).distinct()
    found = (
        suspects.withColumn("ft", restored(F.when(is_suspect(F.col("text")), F.col("text"))))
        .withColumn("bare", F.when(odd_font, bare))
        .withColumn("ff", restored(F.col("bare")))
    )
    of_text, of_font = _is_case("ft", "text"), _is_case("ff", "bare")
    return found.where(of_text | of_font).select(
        *SPAN_KEY,
        "text",
        "font",
        F.when(of_text, F.col("ft.text")).otherwise(F.col("text")).alias("text_restored"),
        F.when(of_font, F.concat(F.regexp_extract("font", r"^([A-Z]{6}\+)?", 1), F.col("ff.text"))).otherwise(F.col("font")).alias("font_restored"),
        (~F.coalesce(F.col("ft.damaged"), F.lit(False)) & ~F.coalesce(F.col("ff.damaged"), F.lit(False))).alias("fully_restored"),
    )


def garbled_spans(spans: DataFrame) -> DataFrame:
    """The keys of ``restored_spans``, each once."""
    return restored_spans(spans).select(*SPAN_KEY).distinct()
