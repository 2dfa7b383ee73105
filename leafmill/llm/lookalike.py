"""Problem 3: one consistent form for text that looks the same.

Texts holding a character of the mapping tables are exploded to positioned
code points, joined with the decomposition and look-alike tables, their
combining marks ordered by class, recomposed, and rebuilt.  The tables come
from the Unicode database and a short list of twins; their size is fixed by the
standard, so they may be broadcast.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.mojibake import SPAN_KEY, garbled_spans
from leafmill.session import cut

PLACE_KEY = ["place", "book_id", "k1", "k2", "k3", "k4"]

# Letters of the same look, position by position (fixed values).
_CYRILLIC = "АВЕКМНОРСТУХЅІЈаеорсухіјѕһԁԛԝ"
_CYRILLIC_AS = "ABEKMHOPCTYXSIJaeopcyxijshdqw"
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανυρικ"
_GREEK_AS = "ABEZHIKMNOPTYXoavupik"

# Compatibility characters that are plain in running text (fixed values):
# ordinals, typographic dots, signs and quotes.
_PLAIN = set("ªº…©®™°№℃€′″‐‑‒–—―‘’‚‛“”„‟«»‹›·•§¶")
_INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
_SPACES = "               　"


@functools.lru_cache(maxsize=1)
def decompositions() -> dict[str, str]:
    """Character -> plain form, for every character with another form of the
    same look: compatibility forms, invisible characters, spaces, ligatures,
    composition exclusions left as they are."""
    table = {c: "" for c in _INVISIBLE} | {c: " " for c in _SPACES}
    for o in range(0xA0, sys.maxunicode + 1):
        c = chr(o)
        if 0xD800 <= o < 0xE000 or c in table or c in _PLAIN:
            continue
        d = unicodedata.decomposition(c)
        if not d:
            continue
        kind = d.split(" ")[0] if d.startswith("<") else ""
        if kind in ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<noBreak>") and not unicodedata.category(c).startswith("L"):
            continue
        plain = unicodedata.normalize("NFKC", c)
        if kind == "" and unicodedata.normalize("NFC", c) == c:
            continue  # a composed letter is plain
        if kind == "" and len(plain) > 1:
            continue  # composition exclusions: both spellings are standard
        if plain != c and not plain.startswith(" "):
            table[c] = plain
    return table


@functools.lru_cache(maxsize=1)
def compositions() -> dict[str, str]:
    """Fully decomposed letter with marks -> composed letter."""
    table = {}
    for o in range(0xC0, 0x2FA20):
        c = chr(o)
        if 0xAC00 <= o < 0xD7A4 or 0xD800 <= o < 0xE000:
            continue
        if unicodedata.normalize("NFC", c) == c and (full := unicodedata.normalize("NFD", c)) != c:
            table[full] = c
    return table


_EASTERN = r"[぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿가-힯、。「-』]"


# Characters that are their own plain form wherever they stand, by range; the
# tables decide on all others.
_SURELY_PLAIN = (
    r"\t\n\r\x20-\x7e¡-¬®-ĲĴ-ľŁ-ňŊ-žƀ-ǃǍ-ǰǴ-ʯ"
    r"Ͱ-ͳͶ-͹ͻ-ͽ΄-ϏЀ-ҁ҈-ԯא-ת؀-؛؝-ْٖ-ٴٹ-ۿऀ-ॿ"
    r"ก-าิ-๛‐-‧‰-⁞₠-₿∀-⏿─-➿⺀-⻳、-〿ぁ-ゖゝゞァ-ヾ㄀-ㄯ㐀-䶿一-鿿가-힣"
    r"！-／：-＠［-｀｛-～"
)
#: Texts that do not match this hold plain characters only.
SUSPECT = (
    rf"[^{_SURELY_PLAIN}]|[ऩनरळ]़"
    r"|[A-Za-zÀ-ɏ][Ͱ-ϿЀ-ԯ]|[Ͱ-ϿЀ-ԯ][A-Za-zÀ-ɏ]"
)
_WIDE_SIGN = r"[！-／：-＠［-｀｛-～]"


#: First look: most texts hold nothing beyond these few ranges, and a short
#: class is tested far faster than the full one.
_BEYOND = r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-\xff‐-‧]"


def is_suspect(text: Column) -> Column:
    full = text.rlike(SUSPECT) | (text.rlike(_WIDE_SIGN) & ~text.rlike(_EASTERN))
    return F.coalesce(text.rlike(_BEYOND) & full, F.lit(False))


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    forms = spark.createDataFrame(list(decompositions().items()), "ch string, plain string")
    composed = spark.createDataFrame(list(compositions().items()), "cluster string, composed string")
    return F.broadcast(forms), F.broadcast(composed)


def _code_points(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), 0)


_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏḀ-ỿͰ-ͽͿ-ΆΈ-Ͽἀ-῿Ѐ-ҁҊ-ԯ̀-ͯ"
_MIXED = r"[A-Za-zÀ-ɏḀ-ỿ][̀-ͯ]*[Ͱ-ϿЀ-ԯ]|[Ͱ-ϿЀ-ԯ][̀-ͯ]*[A-Za-zÀ-ɏḀ-ỿ]"


def one_script(word: Column) -> Column:
    """A word whose letters of one script all have a twin in the other is
    brought to that other script; all other words stay as they are."""

    def count(chars: str, but: str = "") -> Column:
        kept = F.regexp_replace(word, f"[^{chars}]" + (f"|[{but}]" if but else ""), "")
        return F.length(kept)

    latin, greek, cyr = "A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ", "Ͱ-ͽͿ-ΆΈ-Ͽἀ-῿", "Ѐ-ҁҊ-ԯ"
    n_latin, n_greek, n_cyr = count(latin), count(greek), count(cyr)
    own_latin = count(latin, "".join(sorted(set(_CYRILLIC_AS + _GREEK_AS))))
    own_greek, own_cyr = count(greek, _GREEK), count(cyr, _CYRILLIC)
    to_latin = (own_greek == 0) & (own_cyr == 0) & ((own_latin > 0) | (n_latin >= n_greek + n_cyr))
    to_cyr = (own_latin == 0) & (own_greek == 0) & (n_cyr > 0)
    to_greek = (own_latin == 0) & (own_cyr == 0) & (n_greek > 0)
    return (
        F.when(~word.rlike(_MIXED), word)
        .when(to_latin, F.translate(word, _CYRILLIC + _GREEK, _CYRILLIC_AS + _GREEK_AS))
        .when(to_cyr, F.translate(word, _CYRILLIC_AS, _CYRILLIC))
        .when(to_greek, F.translate(word, _GREEK_AS, _GREEK))
        .otherwise(word)
    )


_LEAD, _VOWEL, _TAIL = "\\x{1100}-\\x{1112}", "\\x{1161}-\\x{1175}", "\\x{11a8}-\\x{11c2}"
_JAMO_PAIR = f"[{_LEAD}][{_VOWEL}]|[\\x{{ac00}}-\\x{{d7a3}}][{_TAIL}]"
_JAMO = f"[{_LEAD}][{_VOWEL}][{_TAIL}]?|[\\x{{ac00}}-\\x{{d7a3}}][{_TAIL}]|(?s)."


def composed_hangul(text: Column) -> Column:
    """Decomposed Hangul as syllables, by the arithmetic of the standard; a tail
    joins only a syllable that has none."""

    def one(part: Column) -> Column:
        code = lambda i: F.ascii(F.substring(part, i, 1))
        first, last = code(1), code(2)
        of_jamo = F.lit(0xAC00) + ((first - 0x1100) * 21 + (last - 0x1161)) * 28 + F.when(F.length(part) == 3, code(3) - 0x11A7).otherwise(0)
        open_ = (F.length(part) == 2) & first.between(0xAC00, 0xD7A3) & ((first - 0xAC00) % 28 == 0)
        letter = lambda o: F.decode(F.unhex(F.lpad(F.hex(o), 8, "0")), "UTF-32")
        return F.when(first.between(0x1100, 0x1112) & (F.length(part) > 1), letter(of_jamo)).when(open_, letter(first + last - 0x11A7)).otherwise(part)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_JAMO), 0), one), "")


def _rejoined(parts: DataFrame, key: list[str], part: str) -> DataFrame:
    return parts.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", part)))[part], "").alias("plain"))


def consistent(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """The texts of ``texts`` that hold other than plain characters, with
    ``plain``: the one form of each.  ``key`` identifies a row.

    Code points are exploded with their position and joined with the
    decomposition table; then words of two scripts are brought to one, and
    clusters of a letter and its marks, ordered by class, are recomposed.  Only
    texts that need a step go through it.  A very long text is one of many
    groups and is exploded whole.
    """
    forms, composed = _tables(texts.sparkSession)
    held = texts.where(is_suspect(F.col(text)))
    # East Asian punctuation stays in East Asian text, and alone; elsewhere it is a wide form
    wide_stays = F.col(text).rlike(_EASTERN) | ~F.col(text).rlike(r"[A-Za-zÀ-ɏͰ-ԯ0-9Ａ-Ｚａ-ｚ０-９]")
    pos = held.select(*key, wide_stays.alias("stays"), F.posexplode(_code_points(F.col(text))).alias("pos", "ch"))
    o = F.ascii("ch")
    wide = (o == 0x3000) | (o.between(0xFF01, 0xFF65) & ~o.between(0xFF10, 0xFF19) & ~o.between(0xFF21, 0xFF3A) & ~o.between(0xFF41, 0xFF5A))
    mapped = pos.join(forms, "ch", "left").withColumn(
        "out", F.when(F.col("plain").isNull() | (wide & F.col("stays")), F.col("ch")).otherwise(F.col("plain"))
    )
    step1 = _rejoined(mapped, key, "out")
    words = F.regexp_extract_all("plain", F.lit(f"[{_LETTERS}]+|[^{_LETTERS}]+"), 0)
    step2 = step1.withColumn(
        "plain", F.when(F.col("plain").rlike(_MIXED), F.array_join(F.transform(words, one_script), "")).otherwise(F.col("plain"))
    )
    step2 = step2.withColumn("plain", F.when(F.col("plain").rlike(_JAMO_PAIR), composed_hangul(F.col("plain"))).otherwise(F.col("plain")))
    has_marks = F.col("plain").rlike(r"\p{M}")
    clusters = step2.where(has_marks).select(
        *key, F.posexplode(F.regexp_extract_all("plain", F.lit(r"(?s)\P{M}\p{M}*|\p{M}+"), 0)).alias("pos", "raw")
    )
    clusters = clusters.withColumn("cluster", F.when(F.length("raw") > 2, _ordered(F.col("raw"))).otherwise(F.col("raw"))).withColumn(
        "part", F.when(F.length("cluster") > 2, F.substring("cluster", 1, 2))
    )
    short = F.broadcast(composed.withColumnsRenamed({"cluster": "part", "composed": "composed_part"}))
    rebuilt = (
        clusters.join(composed, "cluster", "left")
        .join(short, "part", "left")
        .withColumn("out", F.coalesce("composed", F.concat("composed_part", F.expr("substring(cluster, 3)")), "cluster"))
        .transform(lambda c: _rejoined(c, key, "out"))
        .withColumnRenamed("plain", "recomposed")
    )
    plain = step2.join(rebuilt, key, "left").select(*key, F.coalesce("recomposed", "plain").alias("plain"))
    return held.join(plain, key)


def _ordered(cluster: Column) -> Column:
    """The marks of a cluster in the order of their combining class; equal
    classes keep their order."""
    known = F.create_map(*[F.lit(x) for kv in mark_classes().items() for x in kv])
    chars = F.regexp_extract_all(cluster, F.lit("(?s)."), 0)
    keyed = F.transform(chars, lambda c, i: F.struct(F.coalesce(F.try_element_at(known, c), F.lit(0)).alias("ccc"), i.alias("i"), c.alias("c")))
    return F.array_join(F.array_sort(keyed)["c"], "")


@functools.lru_cache(maxsize=1)
def mark_classes() -> dict[str, int]:
    """Combining class of the marks that take part in a composed letter."""
    marks = {m for full in compositions() for m in full[1:]}
    return {m: k for m in sorted(marks) if (k := unicodedata.combining(m))}


def placed_texts(spans: DataFrame, elements: DataFrame) -> DataFrame:
    """All span and run texts with their place, repeated rows once."""
    zero = F.lit(0)
    of_spans = spans.select(
        F.lit("span").alias("place"), "book_id", F.col("page").alias("k1"), F.col("block_seq").alias("k2"),
        F.col("line_seq").alias("k3"), F.col("span_seq").alias("k4"), "text", "font",
    )
    of_runs = elements.select("book_id", "el_seq", F.posexplode("runs").alias("k2", "run")).select(
        F.lit("run").alias("place"), "book_id", F.col("el_seq").alias("k1"), "k2",
        zero.alias("k3"), zero.alias("k4"), F.col("run.text").alias("text"), F.lit(None).cast("string").alias("font"),
    )
    return of_spans.unionByName(of_runs)


def consistent_texts(spans: DataFrame, elements: DataFrame) -> DataFrame:
    """``place, book_id, k1..k4, text, plain`` of the span and run texts whose
    consistent form differs from what is stored.

    Garbled spans (problem 2) are left out.  Null texts and runs, empty texts
    and empty tables give nothing; repeated rows count once.
    """
    texts = cut(placed_texts(spans, elements).where(is_suspect(F.col("text"))).distinct())
    named = texts.withColumnsRenamed(dict(zip(["k1", "k2", "k3", "k4"], SPAN_KEY[1:], strict=True)))
    garbled = garbled_spans(named.where("place = 'span'"))
    garbled = garbled.withColumnsRenamed(dict(zip(SPAN_KEY[1:], ["k1", "k2", "k3", "k4"], strict=True)))
    clean = texts.drop("font").join(garbled.withColumn("place", F.lit("span")), PLACE_KEY, "left_anti")
    clean = clean.groupBy(*PLACE_KEY).agg(F.max("text").alias("text"))
    return consistent(cut(clean), PLACE_KEY).where("plain != text")


def lookalike_places(spans: DataFrame, elements: DataFrame) -> DataFrame:
    """The places of ``consistent_texts``, typed as in the tables."""
    return consistent_texts(spans, elements).select(*PLACE_KEY)
