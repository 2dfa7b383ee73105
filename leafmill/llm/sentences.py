"""Problem 5: sentence boundaries in many languages and scripts.

Abbreviations, collocations of numbers and sentence starters are learned from
the corpus itself, per language, by log-likelihood ratios; every full stop is
then classified with these statistics.  Marks that always end a sentence,
quotations and their speakers' clauses follow fixed rules.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.quality import common_by_language, element_text
from leafmill.llm.scans import joined_texts, reflowed_paragraphs
from leafmill.session import broadcast_if_small, cut

MIN_COUNT = 3
ABBREVIATION_SCORE = 0.3
LLR_START = 10.83  # chi-square at 0.001
NUMBER = "##"

_WORD = re.compile(r"[^\W\d_]+")
_SPACE = r"\s  -     　​‌‍⁠﻿"
_HIDDEN = "​‌‍⁠﻿­‎‏"
_QUOTES = re.compile(r"“[^“”]*”|«[^«»]*»|「[^「」]*」|『[^『』]*』|„[^„“”]*[“”]|\"[^\"]*\"|‹[^‹›]*›")
_TERMS = re.compile(r"(?:[.!?…;;؟。！？｡．।॥]|(?<=[.!?…])\s(?=[!?]))+")
_CLOSE = "”’»)]」』】〉》›\"'"
_OPEN = "“«(「『„\"‹¿¡[—–-‘'*•"
_EAST_TERM = set("。！？｡")
_DASH_SPEAKER = re.compile(rf"[{_SPACE}]*[—–-][{_SPACE}]*(\w)")
# How a speaker's clause goes on after a quotation where letters have no case (fixed values).
_SPEAKER = re.compile(
    r"(?:[ \s]*(?:と|って)|[^。！？“”「」]{0,14}(?:说|说道|问|问道|道|答|喊|叫|回答)(?:着|了|道)?[。！？，]"
    r"|\s*[^।॥?!“”]{1,48}(?:पूछा|कहा|बोला|बोली|बोले|चिल्लाया|पुकारा)\s*[।॥]|\s*(?:قال|قالت|سأل|سألت|صاح|أجاب)\b)"
)
_TOKEN_EDGE = re.compile(r"[\s“”«»„\"()\[\]—–¿¡,;:!?]")
_NEXT = re.compile(r"[^\s]+")
_PERIOD_CONTEXT = re.compile(r"([^\s“”«»„\"()\[\]—–¿¡,;:!?]+)\.[»”\")\]]*\s+([^\s]+)")
_INITIAL = re.compile(r"[^\w\s]*[^\W\d_]\.")
_SURE_START = re.compile(r"[!?][»”\")\]]*\s+([^\s]+)")


_SCRIPTS = {name: re.compile(f"[{chars}]") for name, chars in (
    ("latin", "A-Za-zÀ-ÖØ-öø-ɏ"), ("greek", "Ͱ-Ͽ"), ("cyrillic", "Ѐ-ԯ"), ("arabic", "\u0600-\u06ff"), ("devanagari", "\u0900-\u097f"), ("kana", "\u3040-\u30ff"), ("han", "\u4e00-\u9fff"),
)}


def script_of(text: str) -> str:
    """A coarse script name of a text, by all its letters; kana count three times,
    as they stand among more han characters."""
    if text.isascii():
        return "latin"
    n = {name: len(chars.findall(text)) * (3 if name == "kana" else 1) for name, chars in _SCRIPTS.items()}
    best = max(n, key=n.get)
    return best if n[best] else "latin"


def language_of(text: str, commons: dict[str, frozenset[str]]) -> str:
    """The language whose common words are most frequent in a Latin text; the
    script's name otherwise, or if no common word occurs."""
    script = script_of(text)
    if script != "latin":
        return script
    words = _WORD.findall(text.lower())
    best, lang = 0, "latin"
    for k, known in commons.items():
        n = sum(w in known for w in words)
        if n > best:
            best, lang = n, k
    return lang


def _type(token: str) -> str:
    t = token.lower().strip(_HIDDEN + "'’")
    return NUMBER if t[:1].isdigit() and not any(c.isalpha() for c in t) else t


def _next_type(token: str) -> tuple[str, str]:
    """Lower-case type of a following token and its class: upper, lower, digit, open."""
    t = token.lstrip(_OPEN + _HIDDEN)
    if not t:
        return "", "open"
    kind = "digit" if t[0].isdigit() else "upper" if t[0].isupper() else "lower" if t[0].islower() else "open"
    word = _WORD.match(t)
    return (word[0].lower() if word else t[:1]), kind


def _count(batches: Iterator[pd.DataFrame], commons: dict[str, frozenset[str]]) -> Iterator[pd.DataFrame]:
    """Batch-wise counts: tokens with and without a full stop, what follows
    full stops, and words after sure sentence ends."""
    for pdf in batches:
        n: Counter[tuple] = Counter()
        by_lang: dict[str, list[str]] = {}
        for text in pdf["text"]:
            lang = language_of(text, commons)
            if lang in ("han", "kana", "devanagari"):
                continue
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            joined = "\n".join(texts)
            for token, k in Counter(joined.split()).items():
                bare = token.strip("“”«»„\"()[]—–¿¡,;:!?'" + _HIDDEN)
                if bare.endswith("."):
                    n[lang, "with", _type(bare[:-1]), "", ""] += k
                elif bare:
                    n[lang, "without", _type(bare), "", ""] += k
            for (a, b), k in Counter(_PERIOD_CONTEXT.findall(joined)).items():
                word, kind = _next_type(b)
                t = _type(a)
                n[lang, "next", t, word if kind == "upper" else "", kind] += k
                if kind == "upper" and len(t) >= 5 and not _INITIAL.match(b):
                    n[lang, "start", word, "", ""] += k
            for b, k in Counter(_SURE_START.findall(joined)).items():
                word, kind = _next_type(b)
                if kind == "upper" and not _INITIAL.match(b):
                    n[lang, "start", word, "", ""] += k
        yield pd.DataFrame([(*key, v) for key, v in n.items()], columns=["lang", "what", "a", "b", "kind", "n"])


def log_likelihood(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Dunning's ratio of two binomials against one; negative where the first
    share is the lesser."""
    k1, k2 = k1.cast("double"), k2.cast("double")
    n1, n2 = F.greatest(n1.cast("double"), F.lit(1.0)), F.greatest(n2.cast("double"), F.lit(1.0))
    p1, p2, p = k1 / n1, k2 / n2, (k1 + k2) / (n1 + n2)

    def fits(k: Column, n: Column, q: Column) -> Column:
        q = F.least(F.greatest(q, F.lit(1e-9)), F.lit(1 - 1e-9))
        return k * F.log(q) + (n - k) * F.log(1 - q)

    ratio = 2 * (fits(k1, n1, p1) + fits(k2, n2, p2) - fits(k1, n1, p) - fits(k2, n2, p))
    return F.when(p1 >= p2, ratio).otherwise(-ratio)


class Model:
    """Learned statistics of all languages; small by construction."""

    def __init__(self) -> None:
        self.abbreviations: dict[str, dict[str, float]] = {}
        self.starters: dict[str, set[str]] = {}
        self.after_number: dict[str, set[str]] = {}
        self.any_abbreviation: dict[str, float] = {}
        self.any_starter: set[str] = set()

    def abbreviation(self, lang: str, t: str) -> float | None:
        """Share of its full stops that end a sentence; None if ``t`` is none."""
        known = self.abbreviations.get(lang)
        return (known or {}).get(t) if known is not None and lang != "latin" else self.any_abbreviation.get(t)

    def starts(self, lang: str, word: str) -> bool:
        known = self.starters.get(lang)
        return word in known if known is not None and lang != "latin" else word in self.any_starter


def learn(texts: DataFrame, common_words: DataFrame) -> Model:
    """Learn a model from a column ``text``; counts cover all texts.

    All counts are weighed where they lie; only what was learned (abbreviations,
    starters and collocations by their ratios) reaches the driver.
    """
    commons = common_by_language(common_words)
    counts = cut(
        texts.where("text is not null and text <> ''")
        .select("text")
        .mapInPandas(lambda it: _count(it, commons), "lang string, what string, a string, b string, kind string, n long")
        .groupBy("lang", "what", "a", "b", "kind")
        .agg(F.sum("n").alias("n"))
    )
    return model_of(*learned(counts))


def learned(counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``lang, a, ending`` of the abbreviations, ``lang, a`` of the starters and
    ``lang, b`` of the words that go on after a number with a full stop."""

    def total(*what: str, kind: str | None = None) -> Column:
        of = F.col("what").isin(*what) if kind is None else F.col("what").isin(*what) & (F.col("kind") == kind)
        return F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0))

    # a row a language: as many as there are scripts and languages of common words
    langs = F.broadcast(counts.groupBy("lang").agg(total("with").alias("stops"), total("with", "without").alias("tokens"), total("start").alias("begun")))
    types = (
        counts.groupBy("lang", "a")
        .agg(
            total("with").alias("k"), total("without").alias("miss"), total("start").alias("s"), total("next").alias("followed"),
            *[total("next", kind=x).alias(x) for x in ("upper", "lower", "digit", "open")],
        )
        .join(langs, "lang")
    )
    seen = F.greatest(F.col("k") + F.col("miss"), F.col("s"))
    at_start = log_likelihood(F.col("s"), F.col("begun"), seen - F.col("s"), F.col("tokens") - F.col("begun"))
    starters = cut(types.where((F.col("s") >= MIN_COUNT) & (F.col("a") != "") & (at_start > LLR_START)).select("lang", "a"))
    follows = counts.where("what = 'next' and kind = 'upper'").select("lang", "a", "b", "n")
    begins = broadcast_if_small(starters.withColumnRenamed("a", "b"))
    starting = follows.join(begins, ["lang", "b"], "left_semi").groupBy("lang", "a").agg(F.sum("n").alias("starting"))

    letters = F.greatest(F.lit(1), F.length(F.replace("a", F.lit(".")))).cast("double")
    inner = F.length("a") - F.length(F.replace("a", F.lit("."))) + 1
    ratio = log_likelihood(F.col("k"), F.col("k") + F.col("miss"), F.col("stops") - F.col("k"), F.col("tokens") - F.col("k") - F.col("miss"))
    score = ratio * F.exp(-letters) * inner * F.pow(letters, -F.least(F.col("miss"), F.lit(30)))
    t = types.where((F.col("k") >= MIN_COUNT) & (F.col("a") != "") & (F.col("a") != NUMBER) & F.col("a").rlike(r"\p{L}")).join(starting, ["lang", "a"], "left")
    begun = F.coalesce("starting", F.lit(0))
    inside = F.col("lower") + F.col("digit") + F.col("upper") - begun
    ending = F.when(F.col("followed") > 0, (begun + 0.5 * F.col("open")) / F.col("followed")).otherwise(0.0)
    goes_on = (inside > 0.5 * F.greatest(F.lit(1), F.col("followed"))) & (F.col("k") > F.col("miss")) & (F.length("a") <= 5)
    abbreviations = t.where((score >= ABBREVIATION_SCORE) | goes_on).select("lang", "a", ending.alias("ending"))

    # collocations of a number with a full stop: months after ordinals
    is_number = F.col("a") == NUMBER
    c, o = F.coalesce(F.sum(F.when(is_number, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(~is_number, F.col("n"))), F.lit(0))
    numbers = types.where(is_number).select("lang", F.col("followed").alias("numbers"), "stops")
    words = follows.groupBy("lang", "b").agg(c.alias("c"), o.alias("o")).where("b <> '' and c > o").join(F.broadcast(numbers), "lang")
    after = log_likelihood(F.col("c"), F.col("numbers"), F.col("o"), F.col("stops") - F.col("numbers"))
    after_number = words.where((F.col("c") >= MIN_COUNT) & (after > LLR_START)).join(begins, ["lang", "b"], "left_anti").select("lang", "b")
    return abbreviations, starters, after_number


MAX_LEARNED = 2_000_000  # rows of a model that a driver is asked to hold


def model_of(abbreviations: DataFrame, starters: DataFrame, after_number: DataFrame) -> Model:
    model = Model()

    def rows(df: DataFrame) -> list:
        got = df.limit(MAX_LEARNED + 1).collect()
        if len(got) > MAX_LEARNED:
            raise ValueError("the sentence model outgrows the driver; learn it a language at a time")
        return got

    for r in rows(abbreviations):
        model.abbreviations.setdefault(r["lang"], {})[r["a"]] = r["ending"]
        model.any_abbreviation[r["a"]] = min(r["ending"], model.any_abbreviation.get(r["a"], 1.0))
    for r in rows(starters):
        model.starters.setdefault(r["lang"], set()).add(r["a"])
        model.any_starter.add(r["a"])
    for r in rows(after_number):
        model.after_number.setdefault(r["lang"], set()).add(r["b"])
    for lang in {*model.abbreviations, *model.starters}:
        model.abbreviations.setdefault(lang, {})
        model.starters.setdefault(lang, set())
    return model


def _letter_after(text: str, i: int) -> str:
    n = len(text)
    while i < n and (text[i].isspace() or text[i] in _OPEN or text[i] in _HIDDEN or text[i] in "”»"):
        i += 1
    return text[i] if i < n else ""


_CLAUSE = re.compile(rf"[{_SPACE}]*[,，、]")
_BLANK = re.compile(r"\s*")


def _quotations(text: str) -> list[tuple[int, int, bool, bool]]:
    """Spans of quotations; whether a speaker's clause follows, or precedes."""
    out = []
    for m in _QUOTES.finditer(text):
        end = m.end()
        follows = bool(_CLAUSE.match(text, end))
        if not follows:
            d = _DASH_SPEAKER.match(text, end)
            at = _BLANK.match(text, end).end()
            c = d[1] if d else text[at : at + 1]
            follows = bool(c) and c.islower()
        k = m.start()
        while k and text[k - 1].isspace():
            k -= 1
        precedes = k > 0 and text[k - 1] in ":："
        if not follows and not precedes:
            follows = bool(_SPEAKER.match(text, end))
        out.append((m.start(), end, follows, precedes))
    return out


_GUILLEMET_GAP = re.compile(rf"[{_SPACE}]+(?=»)")
_BRACKET = re.compile(r"\s*\(")


def sentence_ends(text: str, model: Model, lang: str) -> list[int]:
    """Code points up to and including the last one of every sentence."""
    n = len(text)
    stripped = len(text.rstrip())
    if stripped == 0:
        return [n]
    quotes = _quotations(text) if any(c in text for c in "“«「『„\"‹") else []
    opens, by_end = [q[0] for q in quotes], {q[1]: q for q in quotes}
    tokens = Tokens(text)
    ends: list[int] = []
    greek = lang == "greek"
    for m in _TERMS.finditer(text):
        term = m[0].strip()
        last = term[-1]
        if set(term) <= {";", ";"} and not (greek or "Ͱ" <= text[m.start() - 1 : m.start()] < "Ͽ"):
            continue
        end = m.end()
        # closing marks belong to the sentence they close
        closed = None
        while end < n:
            c = text[end]
            if c in _HIDDEN:
                end += 1
                continue
            gap = _GUILLEMET_GAP.match(text, end)
            if gap and (q := by_end.get(gap.end() + 1)) and q[0] < m.start():
                end = gap.end()
                continue
            q = by_end.get(end + 1)
            if q is not None and q[0] < m.start():
                closed = q
                end += 1
                continue
            if c in ")]】〉》" or (c in "’'" and end + 1 < n and text[end + 1].isspace()):
                end += 1
                continue
            if c in ".!?…。！？" and text[end - 1] in _CLOSE:
                end += 1
                closed = None
                continue
            break
        while end > m.end() and text[end - 1] in _HIDDEN:
            end -= 1
        k = bisect_left(opens, m.start()) - 1  # quotations do not overlap
        inside = quotes[k] if k >= 0 and quotes[k][1] > end else None
        if inside and (inside[2] or inside[3]):
            continue
        if closed and closed[2]:
            continue
        if end >= stripped:
            continue
        i = end
        while i < n and text[i] in _HIDDEN:
            i += 1
        spaced = i < n and text[i].isspace()
        east = last in _EAST_TERM or last in "।॥"
        if not spaced and not east:
            nxt = text[i] if i < n else ""
            if not ("⺀" <= nxt < "꓀" or (last in "!?؟…" and nxt in "“«「—–") or (closed and nxt in "“«「—–")):
                continue
        d = _DASH_SPEAKER.match(text, end)
        if d and d[1].islower():
            continue
        following = _letter_after(text, end)
        ellipsis = len(term) >= 2 and set(term) <= {".", "…"} or term == "…"
        if following.islower() and not east:
            # a small letter goes on, but for a bracket of its own after a full stop
            if not (_BRACKET.match(text, end) and not ellipsis and _stop_kind(tokens, m.start(), model, lang) is None):
                continue
        if term == "." or term == "．":
            if lang == "devanagari" and "ऀ" <= text[m.start() - 1 : m.start()] <= "ॿ":
                continue
            if not _is_end(tokens, m.start(), end, model, lang):
                continue
        ends.append(end)
    if not ends or ends[-1] < stripped:
        ends.append(stripped)
    return sorted(set(ends))


class Tokens:
    """The token before any place of a text, its edges found once."""

    def __init__(self, text: str):
        self.text = text
        self._edges: list[int] | None = None

    def before(self, stop: int) -> str:
        if self._edges is None:
            self._edges = [0, *(m.end() for m in _TOKEN_EDGE.finditer(self.text))]
        return self.text[self._edges[bisect_right(self._edges, stop) - 1] : stop]


_FIRST_NUMBER = re.compile(r"\s*\[?\d{1,3}\]?$")


def _opens_text(text: str, stop: int) -> bool:
    """Whether only a number in brackets or bare stands before ``stop``."""
    start = _BLANK.match(text).end()
    return stop - start <= 5 and bool(_FIRST_NUMBER.match(text[start:stop]))


def _stop_kind(tokens: Tokens, stop: int, model: Model, lang: str) -> float | None:
    before = tokens.before(stop)
    return model.abbreviation(lang, _type(before)) if before else None


_LEADING = re.compile(rf"[{re.escape(_HIDDEN + _OPEN)} \t]*")


def _is_end(tokens: Tokens, stop: int, end: int, model: Model, lang: str) -> bool:
    """Classify one full stop that is followed by space and no small letter."""
    text, token = tokens.text, tokens.before(stop)
    nxt = _NEXT.search(text, end)
    word, kind = _next_type(nxt[0]) if nxt else ("", "open")
    t = _type(token)
    if not t:
        return True
    if t == NUMBER:
        if _LEADING.match(text).end() >= stop - len(token):
            return False  # a number that opens the text counts something
        if _opens_text(text, stop):
            return False
        return not (kind == "upper" and len(token) <= 2 and word in model.after_number.get(lang, ()))
    initial = len(t) == 1 and t.isalpha() and (token.isupper() or kind == "digit")
    if len(t) == 1 and nxt and _ONE_LETTER.match(nxt[0]):
        return False  # a row of initials
    share = model.abbreviation(lang, t)
    if initial and share is None:
        share = 0.0
    if share is None:
        return True
    if kind == "digit":
        return share > 0.5
    if kind == "upper":
        if initial and token.isupper() and nxt and nxt[0][0].isupper():
            return model.starts(lang, word) and share > 0.5
        return share >= 0.9 or model.starts(lang, word)
    return share > 0.3 or len(t) > 3


_ONE_LETTER = re.compile(r"[^\W\d_]\.")


def element_texts(elements: DataFrame) -> DataFrame:
    """``book_id, el_seq, kind, text`` of the elements, each record once."""
    return elements.groupBy("book_id", "el_seq", "kind").agg(F.max(element_text(F.col("runs"))).alias("text"))


def split_texts(texts: DataFrame, keys: list[str], model: Model, common_words: DataFrame) -> DataFrame:
    """``keys`` and ``sent_end`` of every sentence of a column ``text``."""
    commons = common_by_language(common_words)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ends = [sentence_ends(t, model, language_of(t, commons)) for t in pdf["text"]]
            out = pdf[keys].assign(sent_end=ends).explode("sent_end", ignore_index=True)
            yield out.astype({"sent_end": "int32"})

    schema = ", ".join(f"{k} {t}" for k, t in texts.select(*keys).dtypes)
    return texts.select(*keys, "text").mapInPandas(split, f"{schema}, sent_end int")


def element_sentences(elements: DataFrame, spans: DataFrame, common_words: DataFrame, book_lines: DataFrame | None = None) -> DataFrame:
    """``book_id, el_seq, sent_end`` of the paragraphs and notes of the books
    that occur in ``spans``; the model is learned from all elements and from the
    joined ``book_lines``.

    Every such element has a row: an empty text one with 0, a blank text one
    with its length.  Null runs read as empty; repeated rows count once (of
    differing texts the greatest); very long texts are split whole.
    """
    texts = cut(element_texts(elements))
    model = learn(_all_texts(texts, book_lines), common_words)
    books = spans.select("book_id").where("book_id is not null").distinct()
    own = texts.where("kind in ('paragraph', 'note')").join(books, "book_id", "left_semi")
    own = own.groupBy("book_id", "el_seq").agg(F.max("text").alias("text"))
    return split_texts(own, ["book_id", "el_seq"], model, common_words)


def _all_texts(texts: DataFrame, book_lines: DataFrame | None) -> DataFrame:
    return texts.select("text") if book_lines is None else texts.select("text").unionByName(joined_texts(book_lines))


def all_sentences(elements: DataFrame, book_lines: DataFrame, common_words: DataFrame) -> DataFrame:
    """``place, book_id, seq, sent_end`` of every sentence: place is 'element'
    (seq is ``el_seq``; elements of every kind with text) or 'paragraph' (seq is
    the ``para_seq`` of the reflowed paragraphs of ``book_lines``).
    """
    texts = cut(element_texts(elements))
    model = learn(_all_texts(texts, book_lines), common_words)
    own = texts.where("text <> ''").groupBy("book_id", F.col("el_seq").alias("seq")).agg(F.max("text").alias("text"))
    lines = reflowed_paragraphs(book_lines).select("book_id", F.col("para_seq").cast("int").alias("seq"), "text")
    both = own.withColumn("place", F.lit("element")).unionByName(lines.withColumn("place", F.lit("paragraph")))
    return split_texts(both, ["place", "book_id", "seq"], model, common_words)
