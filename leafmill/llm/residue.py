"""Problem 9: template residue, filler, error messages and script notices.

Documents are cut into units (sentences and lines).  Unfilled placeholders are
residue by their syntax and stay where they are.  Everything else spreads from
a few trusted texts: every unit gets a SimHash fingerprint, four tables of its
16-bit blocks are probed with all blocks within three bits of a trusted one, so
that every fingerprint within 15 bits is met; the Hamming distance and then the
similarity of the shingles verify a link, and labels run along these links from
the trusted texts until no connected component gains a member.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.simhash import codes_of, gram_hashes, pack, signs
from leafmill.llm.textkeys import fold
from leafmill.session import broadcast_if_small, cut

SIMILARITY = 0.8  # Jaccard of the shingles of two units; units are too short for shingles of five words
SHINGLE = 3  # letters of a shingle, taken inside the padded words of a unit
RADIUS = 15  # bits; two units of the similarity above differ by ten on average
FLIPS = 3  # bits changed in a probe of one of four blocks: 4 * (FLIPS + 1) - 1 = RADIUS

#: Trusted residue, one text a wording (fixed values).  Letter case, accents,
#: digits, punctuation and the order of words play no part.
SEEDS = (
    # scripts and cookies
    "Please enable JavaScript to read this book.", "Cookies and JavaScript must be enabled to continue.",
    "This reader needs scripts turned on in your browser.", "Your browser has blocked scripts; allow them and reload.",
    "Ative o JavaScript para ler este livro.", "Para continuar, habilite cookies e JavaScript.",
    "Este leitor precisa de scripts habilitados no navegador.", "Seu navegador bloqueou os scripts; libere-os e recarregue.",
    "Active JavaScript para leer este libro.", "Para continuar, habilite cookies y JavaScript.",
    "Este lector necesita los scripts habilitados en el navegador.", "Su navegador bloqueó los scripts; permítalos y recargue.",
    # errors
    "404 - the book page could not be found", "Erro 404: a página do livro não foi encontrada", "Error 404: la página del libro no se encontró",
    "Internal server error (500).", "Ocorreu um erro interno no servidor (500).", "Error interno del servidor (500).",
    "Service temporarily unavailable for maintenance", "Serviço temporariamente indisponível para manutenção", "Servicio temporalmente no disponible por mantenimiento",
    "Too many requests.", "Wait 30 seconds.", "Muitas solicitações.", "Aguarde 30 segundos.", "Demasiadas solicitudes.", "Espere 30 segundos.",
    "Access denied.", "Your session has expired, sign in again.", "Acesso negado.", "Sua sessão expirou, entre de novo.", "Acceso denegado.", "Su sesión caducó, entre de nuevo.",
    "The requested file does not exist or was removed.", "O arquivo solicitado não existe ou foi removido.", "El archivo solicitado no existe o fue retirado.",
    "Conversion failed: the file is damaged.", "Falha na conversão: o arquivo está corrompido.", "Falló la conversión: el archivo está dañado.",
    # what was to be filled in
    "Your text goes here.", "Insert the blurb in this box.", "Placeholder paragraph, replace before publishing.", "TBD - section to be completed",
    "Escreva aqui o texto do capítulo.", "Insira a sinopse neste campo.", "Texto provisório, substituir antes de publicar.", "TODO: completar esta seção",
    "Escriba aquí el texto del capítulo.", "Inserte la sinopsis en este campo.", "Texto de relleno, sustituir antes de publicar.", "PENDIENTE: completar esta sección",
)
#: Words of filler (fixed values): a unit of nothing else is trusted as well.
FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "lorva ipsel dolit amentu consec tempra velitu fugit nostra xxxx xxxxx asdf qwer qwerty bla test teste foo bar 0".split()
)

_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
_END = re.compile(r"[.!?…:;।؟。！？]['\"”’»)\]]*$")
_SPLIT = re.compile(r"(?<=[.!?…।؟])(?<!\bp\.)['\"”’»)\]]*\s+(?=[^\W\d_a-zà-ÿа-я]|[“\"«¿¡{\[<$%#@_(—])|(?<=[。！？])")

_NAME = r"[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ]*(?:[_ .-][A-Za-zÀ-ÿ0-9]+)*"
_FIELD = r"(?:[a-zà-ÿ]{3,}(?:_[a-zà-ÿ0-9]+)*|[A-ZÀ-Ý]{3,}(?:_[A-ZÀ-Ý0-9]+)*)"
_UNSET = r"(?:undefined|NaN|null|UNDEFINED|NAN|NULL)"
#: Unfilled placeholders, bracketed in any of the usual ways, and values that were never set.
PLACEHOLDER = re.compile(
    rf"\{{\{{\s*(?:{_NAME})?\s*\}}\}}|\$\{{\s*{_NAME}\s*\}}|<%=?\s*{_NAME}\s*%>|<<\s*{_NAME}\s*>>|@@\s*{_NAME}\s*@@"
    rf"|\[\[\s*(?:{_NAME})?\s*\]\]|(?<!\w)__{_FIELD}__(?!\w)|(?<![\w%])%{_FIELD}%(?!\w)|(?<![\w#])\#{_FIELD}\#(?!\w)"
    rf"|(?<![\w)\]$\{{])\{{(?:{_FIELD}|\d)\}}(?!\}})|(?<![\w)\]\[!])\[{_FIELD}\](?![(\[\]])"
    rf"|(?<!\w)%(?:\d\$)?[ds]\b(?=[:,;.\s]|$)|(?<=[:\s])_{{5,}}(?=\s|$|[.,;])"
    rf"|\[[oO][bB][jJ][eE][cC][tT] [oO][bB][jJ][eE][cC][tT]\]|\b{_UNSET}\b(?=\W+(?:\w{{1,3}}\W+)?{_UNSET}\b)"
)
_OPENING = re.compile(r"[{\[<@_%#]|\b(?i:undefined|nan|null)\b")
_QUOTE_BEFORE = "“\"«‘'„`「"
_QUOTE_AFTER = "”\"»’'“`」"
_WORD = re.compile(r"[^\W_]+")
_CODE = re.compile(r"[;{}]\s*$|//|\*\*|\b(?:def|return|import|function|var|const|let|printf?|console)\b.*[(=]|\w\[\w\]|==|!=|\+=|=>|->")
KNOWN_WORDS = 100_000  # words a worker remembers the fingerprint sums of


def _sentences(text: str) -> list[str]:
    return [s for x in _SPLIT.split(text) if x and (s := x.strip())]


def lines_of(text: str) -> list[str]:
    """Lines in compatibility form, single blanks; empty ones stand for breaks."""
    return [" ".join(x.split()) for x in _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).split("\n")]


def units(text: str) -> list[str]:
    """Sentences of a text; lines broken inside a sentence are joined."""
    return _joined(lines_of(text))


def _joined(lines: list[str]) -> list[str]:
    out: list[list[str]] = []
    held: list[str] = []
    size = 0
    for line in lines:
        if line and held and not _END.search(held[-1]) and (line[0].islower() or not line[0].isalpha() or size > 45):
            held.append(line)
            size += len(line) + 1
            continue
        if held:
            out.append(held)
        held, size = ([line], len(line)) if line else ([], 0)
    if held:
        out.append(held)
    return [s for u in out for s in _sentences(" ".join(u))]


def spread_units(lines: list[str]) -> Iterator[str]:
    """All units that may be residue as a whole: sentences, and the sentences of
    single lines and of two lines, as residue starts and ends at a line's edge."""
    yield from _joined(lines)
    for a, b in itertools.zip_longest(lines, lines[1:], fillvalue=""):
        if not a:
            continue
        yield from _sentences(a)
        if b and not _END.search(a):
            yield _sentences(f"{a} {b}")[0]


def _quoted(unit: str, start: int, end: int) -> bool:
    before, after = unit[:start].rstrip(), unit[end:].lstrip()
    return bool(before and after and before[-1] in _QUOTE_BEFORE and after[0] in _QUOTE_AFTER)


def unfilled(unit: str) -> bool:
    """Whether a placeholder stands in the unit that is neither quoted nor code."""
    if not _OPENING.search(unit):
        return False
    found = False
    for m in PLACEHOLDER.finditer(unit):
        if _quoted(unit, m.start(), m.end()):
            return False
        found = True
    return found and not _CODE.search(PLACEHOLDER.sub("", unit))


class Words:
    """Folded forms and fingerprint sums of words, remembered by the worker."""

    def __init__(self) -> None:
        self.folded: dict[str, str] = {}
        self.number: dict[str, int] = {}
        self.sums = np.zeros((1024, 64), dtype=np.int16)

    def learn(self, words: set[str]) -> None:
        """Make sure that ``folded`` holds these words."""
        new = words.difference(self.folded)
        if new and len(self.folded) >= KNOWN_WORDS:
            self.folded.clear()
            new = words
        for w in new:
            self.folded[w] = re.sub(r"\d+", "0", fold(w))

    def forget(self) -> None:
        """Start anew once too many words are known; never while ids are in use."""
        if len(self.number) >= KNOWN_WORDS:
            self.number.clear()

    def id(self, word: str) -> int:
        n = self.number.get(word)
        if n is None:
            n = self.number[word] = len(self.number)
            if n >= len(self.sums):
                self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
            self.sums[n] = signs(gram_hashes(codes_of(f"^{word}$"), SHINGLE)).sum(axis=0, dtype=np.int16)
        return n

    def fingerprints(self, sets: list[list[str]]) -> np.ndarray:
        """64-bit fingerprints of sets of words, none of them empty."""
        if not sets:
            return np.zeros(0, dtype=np.int64)
        self.forget()
        out = []
        for a in range(0, len(sets), 4096):
            part = sets[a : a + 4096]
            for w in set().union(*part).difference(self.number):
                self.id(w)
            number = self.number
            ids = [number[w] for s in part for w in s]
            first = np.concatenate(([0], np.cumsum([len(s) for s in part])[:-1]))
            out.append(pack(np.add.reduceat(self.sums[ids].astype(np.int32), first, axis=0)))
        return np.concatenate(out).view(np.int64)

    def of(self, unit: str) -> list[str]:
        words = _WORD.findall(unit)
        self.learn(set(words))
        return sorted({self.folded[w] for w in words} - {""})


def _units_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``doc_id, words, fingerprint, label`` of the distinct units of documents:
    label 1 for placeholders (no words) and units of filler words."""
    known = Words()
    for docs in batches:
        ids, sets, labels, unset = [], [], [], []
        for doc, text in zip(docs["doc_id"].tolist(), docs["text"], strict=True):
            lines = lines_of(text)
            if _OPENING.search(text) and any(map(unfilled, _joined(lines))):
                unset.append(doc)
            seen: set[str] = set()
            known.learn({w for line in lines for w in _WORD.findall(line)})
            folded = known.folded
            for u in dict.fromkeys(spread_units(lines)):
                all_ = _WORD.findall(u)
                words = sorted({folded[w] for w in all_} - {""})
                key = " ".join(words)
                if key and key not in seen:
                    seen.add(key)
                    ids.append(doc)
                    sets.append(words)
                    labels.append(int(len(all_) >= 3 and words != ["0"] and FILLER.issuperset(words)))
        out = pd.DataFrame({"doc_id": ids, "words": [" ".join(s) for s in sets], "fingerprint": known.fingerprints(sets), "label": labels})
        yield pd.concat([out, pd.DataFrame({"doc_id": unset, "words": "", "fingerprint": 0, "label": 1})], ignore_index=True)


def shingles(words: str) -> set[str]:
    """Shingles inside the padded words of a unit given as its words."""
    return {w[i : i + SHINGLE] for w in (f"^{x}$" for x in words.split(" ")) for i in range(max(1, len(w) - SHINGLE + 1))}


@F.pandas_udf(T.DoubleType())
def _shingle_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[str, set[str]] = {}
    out = []
    for x, y in zip(a, b, strict=True):
        own, other = (known.get(k) or known.setdefault(k, shingles(k)) for k in (x, y))
        both = len(own & other)
        out.append(both / (len(own) + len(other) - both))
        if len(known) > KNOWN_WORDS:
            known.clear()
    return pd.Series(out, dtype="float64")


_MASKS = np.array([sum(1 << b for b in bits) for k in range(FLIPS + 1) for bits in itertools.combinations(range(16), k)], dtype=np.int64)


def probes(fingerprints: DataFrame) -> DataFrame:
    """``of_fingerprint, block, value``: for each of the four blocks of a
    fingerprint all values within ``FLIPS`` bits of its own."""

    def flip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 64):
                fp = pdf["of_fingerprint"].to_numpy(np.int64)[a : a + 64]
                value = (fp.view(np.uint64)[:, None] >> (np.uint64(16) * np.arange(4, dtype=np.uint64))) & np.uint64(0xFFFF)
                all_ = value.astype(np.int64)[:, :, None] ^ _MASKS
                n, _, m = all_.shape
                yield pd.DataFrame({"of_fingerprint": np.repeat(fp, 4 * m), "block": np.tile(np.repeat(np.arange(4), m), n), "value": all_.ravel()})

    return fingerprints.mapInPandas(flip, "of_fingerprint bigint, block int, value int")


def within_radius(tables: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """``fingerprint, of_fingerprint`` of all pairs at most ``RADIUS`` bits apart;
    ``tables`` has ``fingerprint, block, value`` of all, four rows each."""
    every = probes(fingerprints.withColumnRenamed("fingerprint", "of_fingerprint"))
    of = broadcast_if_small(every)
    if of is every:  # too many; a run must not broadcast them by itself either
        of = every.hint("shuffle_hash")
    near = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("of_fingerprint"))) <= RADIUS
    return tables.join(of, ["block", "value"]).where(near).select("fingerprint", "of_fingerprint").distinct()


def block_tables(fingerprints: DataFrame) -> DataFrame:
    blocks = [F.struct(F.lit(b).alias("block"), F.shiftrightunsigned("fingerprint", 16 * b).bitwiseAND(0xFFFF).cast("int").alias("value")) for b in range(4)]
    return fingerprints.select("fingerprint", F.explode(F.array(*blocks)).alias("t")).select("fingerprint", "t.block", "t.value")


def near_duplicates(found: DataFrame, tables: DataFrame, frontier: DataFrame) -> DataFrame:
    """``words, fingerprint`` of the units linked to a unit of ``frontier``."""
    pairs = within_radius(tables, frontier.select("fingerprint").distinct())
    of = frontier.select(F.col("words").alias("of_words"), F.col("fingerprint").alias("of_fingerprint"))
    some = pairs.join(broadcast_if_small(of), "of_fingerprint")
    hit = found.select("words", "fingerprint").join(broadcast_if_small(cut(some)), "fingerprint").distinct()
    return hit.where(_shingle_similarity("words", "of_words") >= SIMILARITY).select("words", "fingerprint").distinct()


def labelled_units(documents: DataFrame) -> DataFrame:
    """``doc_id, words`` of the units that are residue by themselves or linked to it."""
    spark = documents.sparkSession
    texts = documents.where("doc_id is not null and trim(text) <> ''").select("doc_id", "text")
    found = cut(texts.mapInPandas(_units_of, "doc_id bigint, words string, fingerprint bigint, label int"))
    open_ = found.where("label = 0")
    tables = block_tables(cut(open_.select("fingerprint").distinct()))
    known = Words()
    sets = [known.of(s) for s in SEEDS]
    trusted = spark.createDataFrame([(" ".join(s), int(f)) for s, f in zip(sets, known.fingerprints(sets), strict=True)], "words string, fingerprint bigint")
    own = found.where("label = 1 and words <> ''").select("words", "fingerprint").distinct()
    frontier = cut(trusted.unionByName(own))
    reached = frontier
    while not frontier.isEmpty():
        frontier = cut(near_duplicates(open_, tables, frontier).join(reached.select("words"), "words", "left_anti"))
        # the trusted texts may stand in documents themselves
        reached = reached.unionByName(frontier)
    linked = reached.select("words").distinct()
    gained = open_.select("doc_id", "words").join(broadcast_if_small(linked), "words", "left_semi")
    return found.where("label = 1").select("doc_id", "words").unionByName(gained)


def residue_documents(documents: DataFrame) -> DataFrame:
    """``doc_id`` of the documents with residue in some place of the text.

    Null, empty and blank texts are no cases; a null ``doc_id`` is no record.
    Repeated rows count once; texts are read whole, whatever their length.
    Other columns are ignored.
    """
    return labelled_units(documents).select("doc_id").distinct()


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents that hold no residue, columns unchanged."""
    return documents.join(residue_documents(documents), "doc_id", "left_anti")
