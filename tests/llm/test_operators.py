"""Edge cases and small exact comparisons of the nine training-text operators."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import leakage, lookalike, mojibake, notices, quality, residue, scans, sentences, simhash, textkeys, tokens

LINE = "book_id string, page int, block_seq int, line_seq int, text string, size double, top double, bottom double, x0 double, x1 double"
COMMON = [("en", w) for w in "the of and to in a is was that it for on with".split()] + [("pt", w) for w in "a o de da do em um uma que com e".split()] + [("ja", w) for w in "はのをに"] + [("zh", w) for w in "的了在"]


def line(page, n, text, size=10.0, book="b", x1=300.0, top=None):
    return (book, page, n, 0, text, size, 100.0 + 14 * n if top is None else top, 110.0 + 14 * n, 40.0, x1)


def lines(spark, rows):
    return spark.createDataFrame(rows, LINE)


@pytest.fixture(scope="session")
def common(spark):
    return spark.createDataFrame(COMMON, "lang string, word string")


def keys(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# 1 ---------------------------------------------------------------------------


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(3, 8))) for _ in range(n))


def test_repeated_lines_against_brute_force(spark):
    rng = random.Random(4)
    rows, want = [], set()
    notice = "Share this reading with a friend who loves books"
    variants = [notice, notice.upper(), notice + " 12", "Share thls reading with a friend who loves books", "Share this reading with a fríend who loves b0oks"]
    for p in range(20):
        rows += [line(p, n, words(rng, 8)) for n in range(1, 12)]
        if p < 7:
            rows.append(line(p, 0, variants[p % 5]))
            want.add(("b", p, 0, 0))
        if p < 4:
            rows.append(line(p, 20, "Printed on four pages only, which is not enough"))
        rows.append(line(p, 30, f"- {p} -"))
    got = notices.repeated_lines(lines(spark, rows + rows[:9]))
    assert set(keys(got, *notices.LINE_KEY)) == want
    kept = notices.without_repeated_lines(lines(spark, rows))
    assert kept.count() == len(rows) - len(want)


def test_repeated_lines_of_nothing(spark):
    empty = lines(spark, []).withColumn("need", F.lit(1)).withColumn("np", F.lit(1))
    assert notices.repeated_lines(empty).count() == 0
    odd = lines(spark, [line(0, 0, None), line(1, 0, ""), (None, 0, 0, 0, "x", 1.0, 1.0, 1.0, 1.0, 1.0)])
    assert notices.repeated_lines(odd).count() == 0


def test_chunks_depend_on_content_only():
    a = notices.chunk_spans("thequickbrownfoxjumpsoverthelazydog" * 3)
    b = notices.chunk_spans("zz" + "thequickbrownfoxjumpsoverthelazydog" * 3)
    assert len(set(a[2].tolist()) & set(b[2].tolist())) >= len(set(a[2].tolist())) - 2
    assert a[0][0] == 0 and a[1][-1] == 105 and (a[0][1:] == a[1][:-1]).all()


@pytest.mark.parametrize(("t", "yes"), [("12", True), ("- xiv -", True), ("p. 3", True), ("57 / 67", True), ("[2]", True), ("Page 3 of 9", True), ("Chapter 3", False), ("", False), (None, False)])
def test_page_numbers(t, yes):
    assert textkeys.is_page_number(t) is yes


# 2 ---------------------------------------------------------------------------


@pytest.mark.parametrize(
    "wrong",
    [lambda t: t.encode().decode("latin-1"), lambda t: t.encode().decode("mac-roman"), lambda t: t.encode().decode("cp850"), lambda t: t.encode("cp1252").decode("mac-roman"), lambda t: t.encode().decode("latin-1").encode().decode("latin-1")],
)
def test_wrong_decodings_are_undone(wrong):
    t = "A tradução das fábulas e o colofão à margem até o pé"
    assert mojibake.judge(wrong(t))[0] == t


@pytest.mark.parametrize("layers", [1, 2, 3, 4, 5])
def test_layers_of_wrong_decoding_are_undone(layers):
    text = wrong = "O capítulo começa à luz de uma lamparina"
    for _ in range(layers):
        wrong = wrong.encode("utf-8").decode("latin-1")
    assert mojibake.restore(wrong)[0] == text


@pytest.mark.parametrize("shift", [1, -29, 31])
def test_shifted_glyph_tables(shift):
    t = "the old printing house keeps the register of tides"
    assert mojibake.judge("".join(chr(ord(c) + shift) for c in t))[0] == t


@pytest.mark.parametrize("t", ["Où est-il ?", "NÃO HÁ CÓPIA", "Привет, мир", "日本語のテキスト。", "«El río»", "(α = 3)", "caffè", "", None, "Straße", "a 5 °C", "x² + y²", "كتاب قديم"])
def test_correct_text_is_left_alone(t):
    best, _, _, damaged = mojibake.judge(t)
    assert best == t and not damaged


def test_damage_is_reported():
    assert mojibake.judge("a gr?fica")[3] and mojibake.judge("a gr�fica")[3]


def test_garbled_spans(spark):
    rows = [("b", 0, 0, 0, i, t, f) for i, (t, f) in enumerate([("relÃ³gio", "A"), ("relógio", "SertÃ£o-Roman"), ("relógio", "Sertão"), (None, None), ("", ""), ("relÃ³gio " * 3000, "A")])]
    df = spark.createDataFrame(rows + rows, "book_id string, page int, block_seq int, line_seq int, span_seq int, text string, font string").withColumn("cost", F.lit(1))
    assert keys(mojibake.garbled_spans(df), "span_seq") == [(0,), (1,), (5,)]
    r = mojibake.restored_spans(df).where("span_seq = 1").first()
    assert r["font_restored"] == "Sertão-Roman" and r["text_restored"] == "relógio" and r["fully_restored"]


def test_jvm_filter_misses_no_costly_text(spark):
    texts = ["relÃ³gio", "silΩncio", "gr?fica", "ujqpt!hbtupt", "ОЙЛПНХ ОЕ УЛБЪБЧ", "√∫ltima", "a\x03b", "plain text", "Où ?"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mojibake.is_suspect(F.col("t")).alias("s"))
    for r in df.collect():
        assert r["s"] or mojibake.cost(r["t"]) == 0


# 3 ---------------------------------------------------------------------------

SAME_LOOK = [
    ("ｄａｔａ １２", "data 12"), ("pa\u0301ginas", "p\u00e1ginas"), ("g\u00adas\u200btos", "gastos"), ("a\u00a0b\u2003c", "a b c"), ("lіsta", "lista"), ("rоom", "room"), ("oﬀ ﬁne", "off fine"),
    ("𝐡𝐞𝐥𝐥𝐨", "hello"), ("пyнктa", "пункта"), ("⽇付", "日付"), ("αvαγvώστης", "αναγνώστης"), ("ｶﾞｲﾄﾞ", "ガイド"), ("o\u031b\u0323", "\u1ee3"), ("o\u0323\u031b", "\u1ee3"), ("Wait！", "Wait!"),
]
PLAIN = ["data", "“quoted” — it’s", "нет слов", "第二版，第３".replace("３", "3"), "もう行くな！", "２".replace("２", "2"), "α = 3", "n.º 2.ª", "काग़ज़", None, ""]


def test_consistent_forms(spark):
    rows = [(i, t) for i, (t, _) in enumerate(SAME_LOOK)] + [(100 + i, t) for i, t in enumerate(PLAIN)]
    df = spark.createDataFrame(rows, "i int, text string").withColumn("ch", F.lit("x"))
    got = {r["i"]: r["plain"] for r in lookalike.consistent(df, ["i"]).collect()}
    for i, (_, plain) in enumerate(SAME_LOOK):
        assert got[i] == plain
    for i, t in enumerate(PLAIN):
        assert got.get(100 + i, t) == t


def test_hangul_is_composed(spark):
    import unicodedata

    plain = ["한국어 문장", "가각", "값이 없다", "학교"]
    d = spark.createDataFrame([(i, unicodedata.normalize("NFD", t)) for i, t in enumerate(plain)] + [(9, "가\u11a8")], "i int, text string")
    assert keys(lookalike.consistent(d, ["i"]), "i", "plain") == [*enumerate(plain), (9, "각")]


def test_places_leave_garbled_spans_out(spark):
    s = spark.createDataFrame([("b", 0, 0, 0, 0, "ｄａｔａ", "F"), ("b", 0, 0, 0, 1, "relÃ³gio ｄａｔａ", "F"), ("b", 0, 0, 0, 2, "data", "F")], "book_id string, page int, block_seq int, line_seq int, span_seq int, text string, font string")
    e = spark.createDataFrame([("b", 3, [("plain", False, False), ("rоom", False, False)]), ("b", 4, None), ("b", 3, [("plain", False, False), ("rоom", False, False)])], "book_id string, el_seq int, runs array<struct<text:string,bold:boolean,italic:boolean>>")
    assert keys(lookalike.lookalike_places(s, e), *lookalike.PLACE_KEY) == [("run", "b", 3, 1, 0, 0), ("span", "b", 0, 0, 0, 0)]


# 4 ---------------------------------------------------------------------------


VERDICTS = [
    ("The old printing house keeps the register of tides in the back room.", True), ("THE OLD HOUSE IS IN THE TOWN AND IT WAS COLD", True), ("How odd!", True),
    ("the old\nhouse was in\nthe town and it\nwas cold", True), ("第二版，在灯光下保存着弄脏的书页。", True), ("Лодочник объясняет сноски. Кегль вырос с 3,2 до 5 пункта.", True),
    ("footnotes faded bridge worn-out register caption every numbering stray", False), ("word word word word word word", False), ("12,3 45.6 78,9 10.1 22,3", False),
    ("hyphen, 229, 103; story, 250, 299; every, 140", False), ("A chapter . . . . . . . 12\nAnother ________ 45", False), ('">| _ :*" ->/-* ^-;l , !"I I=|1', False),
    ("aHsJPoiCI98cNmdzTsDJ7AvvBkO6YS3I8I37erPdqJG1AjxTJ1EhDEQ2FVY76Hzk0", False), ("1. stained footnotes 2) translation chart 3) caption initials", False),
    ("the cat sat on the mat " * 6, False), ("All rights of this book are reserved by the house.\n" * 5 + "It was the end.", False),
]


def elements_of(spark, texts):
    run = "array<struct<text:string,bold:boolean,italic:boolean>>"
    return spark.createDataFrame([("b", i, "paragraph", [(t, False, False)]) for i, t in enumerate(texts)], f"book_id string, el_seq int, kind string, runs {run}")


def test_verdicts(spark, common):
    got = keys(quality.not_prose(elements_of(spark, [t for t, _ in VERDICTS]), common), "el_seq")
    assert [i for (i,) in got] == [i for i, (_, prose) in enumerate(VERDICTS) if not prose]


def test_repetition_decides(spark, common, monkeypatch):
    repeated = [t for t, prose in VERDICTS[-2:]]
    assert quality.not_prose(elements_of(spark, repeated), common).count() == 2
    monkeypatch.setattr(quality, "repetitive", lambda: F.lit(False))  # without its statistics both pass for prose
    assert quality.not_prose(elements_of(spark, repeated), common).count() == 0


def test_statistics_of_odd_elements(spark, common):
    run = "array<struct<text:string,bold:boolean,italic:boolean>>"
    rows = [("b", 0, "paragraph", None), ("b", 1, "paragraph", [(None, None, None)]), ("b", 2, "paragraph", [("the end of ", False, False), ("it was near.", True, False)]), ("b", 3, "image", []), ("b", 4, "paragraph", [("x " * 20000, False, False)])]
    e = spark.createDataFrame(rows + rows, f"book_id string, el_seq int, kind string, runs {run}").withColumn("text", F.lit("clash"))
    got = {r["el_seq"]: r for r in quality.text_statistics(e, common).collect()}
    assert len(got) == 5 and got[0]["verdict"] == got[1]["verdict"] == got[3]["verdict"] == "blank"
    assert got[2]["words"] == 6 and got[2]["verdict"] == "prose"
    assert keys(quality.not_prose(e, common), "el_seq") == [(4,)]
    assert quality.not_prose(e.limit(0), common).count() == 0


# 5 ---------------------------------------------------------------------------


def split(t, lang="en", abbreviations=(), starters=("the", "a", "o", "in", "der")):
    m = sentences.Model()
    m.abbreviations[lang] = dict(abbreviations)
    m.starters[lang] = set(starters)
    ends = sentences.sentence_ends(t, m, lang)
    return [t[a:b].strip() for a, b in zip([0, *ends], ends, strict=False)]


ABBR = {"mr": 0.0, "p": 0.0, "etc": 0.98, "a.m": 0.0, "z": 0.0, "b": 0.0}


@pytest.mark.parametrize(
    "parts",
    [
        ["It rained.", "The house stood."], ["Mr. Smith paid 9.8 crowns.", "The end."], ["There was ink, etc.", "The boat left at 3 a.m. on Monday."], ["“Where is it?” asked the boy.", "The end."],
        ["“The river rose.", "The bridge fell.”", "In winter it froze."], ["She waited... and nobody came.", "The end..."], ["— Go! — shouted the man.", "The end"], ["See p. 12 of it.", "The end!"],
    ],
)
def test_sentences(parts):
    assert split(" ".join(parts), "en", ABBR) == parts


@pytest.mark.parametrize(
    ("parts", "lang", "glue"),
    [(["第二版。", "“河水涨了。桥塌了。”摆渡人说。", "还缺多少页呢？"], "han", ""), (["もう行くな！", "「川が増えた。橋が落ちた。」と渡し守は言った。"], "kana", ""), (["मत जाओ!", "डॉ. नरवेल ने पृ. 24 देखा।"], "devanagari", " "), (["Πόσα έλειπαν;", "Ο βαρκάρης."], "greek", " "), (["كم ورقة؟", "سأل المصحح: «أين الدفتر؟»"], "arabic", " ")],
)
def test_scripts(parts, lang, glue):
    assert split(glue.join(parts), lang) == parts


def test_element_sentences(spark, common):
    run = "array<struct<text:string,bold:boolean,italic:boolean>>"
    rows = [("b", 0, "paragraph", [("It rained. ", False, False), ("The end", False, False)]), ("b", 1, "note", None), ("b", 2, "heading", [("No. Not this.", False, False)]), ("c", 0, "paragraph", [("Other book.", False, False)])]
    e = spark.createDataFrame(rows + rows, f"book_id string, el_seq int, kind string, runs {run}")
    s = spark.createDataFrame([("b",), ("b",), (None,)], "book_id string")
    assert keys(sentences.element_sentences(e, s, common), "book_id", "el_seq", "sent_end") == [("b", 0, 10), ("b", 0, 18), ("b", 1, 0)]


def test_abbreviations_are_learned(spark, common):
    rng = random.Random(1)
    texts = [f"the {words(rng, 4)} of it {words(rng, 1)}. In the house Mr. {words(rng, 1).title()} was on p. {rng.randint(1, 99)} with it of {words(rng, 1)}." for _ in range(300)]
    m = sentences.learn(spark.createDataFrame([(t,) for t in texts], "text string"), common)
    assert {"mr", "p"} <= set(m.abbreviations["en"]) and "it" not in m.abbreviations["en"]
    assert "in" in m.starters["en"]


# 6 ---------------------------------------------------------------------------


def scan(spark):
    rng = random.Random(2)
    vocabulary = ["machine", "printing", "library", "chapter", "register", "mountain", "quietly", "notebook", "portrait", "standard"]
    rows = []
    for p in range(30):
        rows.append(line(p, 0, "A running head", 7.0, top=20.0))
        rows += [line(p, n, " ".join(rng.choice(vocabulary) for _ in range(7))) for n in range(1, 9)]
        rows.append(line(p, 9, " ".join(rng.choice(vocabulary) for _ in range(5)) + " library and the regis-"))
        rows.append(line(p, 10, "ter of the mountain " + " ".join(rng.choice(vocabulary) for _ in range(5)) + "."))
        rows.append(line(p, 11, f"- {p} -", 8.0, top=560.0))
    rows.append(line(0, 50, "the m@chine and the libiary of it"))
    rows.append(line(1, 50, "the note book and printingmachine"))
    return lines(spark, rows + rows[:5])


def test_scan_noise(spark):
    got = {(r["page"], r["block_seq"], r["noise"]) for r in scans.scan_noise(scan(spark)).collect()}
    assert {(p, 0, "margin") for p in range(30)} | {(p, 11, "margin") for p in range(2, 30)} <= got
    assert {(p, 9, "broken_word") for p in range(30)} == {x for x in got if x[2] == "broken_word"}
    assert (0, 50, "misread") in got
    assert not {x for x in got if x[2] == "misread" and x[1] < 50}


def test_paragraphs_are_mended(spark):
    text = " ".join(r["text"] for r in scans.reflowed_paragraphs(scan(spark)).collect())
    assert "register of the mountain" in text and "running head" not in text and "regis-" not in text and "machine and the library" in text


def test_scan_noise_of_nothing(spark):
    assert scans.scan_noise(lines(spark, [])).count() == 0
    assert scans.scan_noise(lines(spark, [line(0, 0, None, None), line(0, 1, "", 9.0)])).where("noise = 'misread'").count() == 0


def elements(spark, rows):
    run = "array<struct<text:string,bold:boolean,italic:boolean>>"
    return spark.createDataFrame([(b, s, k, [(t, False, False) for t in ts]) for b, s, k, ts in rows], f"book_id string, el_seq int, kind string, runs {run}")


def test_sentences_of_all_elements_and_lines(spark, common):
    e = elements(spark, [("b", 0, "heading", ["No. Not this."]), ("d", 0, "paragraph", ["It rained. ", "The end"]), ("d", 1, "image", [])])
    b = scan(spark).limit(0).unionByName(lines(spark, [line(0, 1, "It was cold in the house. The"), line(0, 2, "river froze.")]))
    got = keys(sentences.all_sentences(e, b, common), "place", "book_id", "seq", "sent_end")
    assert got == [("element", "b", 0, 3), ("element", "b", 0, 13), ("element", "d", 0, 10), ("element", "d", 0, 18), ("paragraph", "b", 1, 25), ("paragraph", "b", 1, 42)]


def test_sentence_model_knows_all_texts(spark, common):
    rng = random.Random(1)
    e = elements(spark, [("a", 0, "paragraph", ["In the house it was of Mr. Nobody and of it."])])
    b = lines(spark, [line(p, n, f"the {words(rng, 2)} of it. In the house Mr. {words(rng, 1).title()} was with {words(rng, 1)}.", 10.0) for p in range(30) for n in range(10)])
    s = spark.createDataFrame([("a",)], "book_id string")
    assert keys(sentences.element_sentences(e, s, common, b), "sent_end") == [(44,)]
    assert len(keys(sentences.element_sentences(e, s, common), "sent_end")) == 2


def test_runs_of_scanned_books_are_mended(spark):
    e = elements(spark, [("b", 0, "paragraph", ["The m@chine and the regis- ter, the libi", "ary of the mountain"]), ("c", 0, "paragraph", ["the m@chine"]), ("b", 1, "image", [])])
    got = keys(scans.repaired_runs(e, scan(spark)), "book_id", "el_seq", "run", "text")
    assert got == [("b", 0, 0, "The machine and the register, the library"), ("b", 0, 1, " of the mountain")]


def test_rare_pairs_keep_their_true_counts(spark, monkeypatch):
    rng = random.Random(3)
    rows = [line(p, n, "a notebook lies here " + words(rng, 2)) for p in range(15) for n in range(10)]
    rows += [line(p, 20, "one note book of " + words(rng, 2)) for p in range(9)]
    rows += [line(p, 30 + n, f"{w} stands there " + words(rng, 2)) for p in range(15) for n, w in enumerate(("note", "book"))]
    sound = lambda: not {r["block_seq"] for r in scans.scan_noise(lines(spark, rows)).where("noise = 'misread'").collect()} & {20}
    assert sound()
    monkeypatch.setattr(scans, "PAIR_SHARE", 0.011)  # as in a corpus so large that nine is below the limit
    assert sound()


# 7 ---------------------------------------------------------------------------

needs_ranks = pytest.mark.skipif(not os.path.exists(tokens.RANK_FILE), reason="no rank file")


@needs_ranks
def test_ids_round_trip_and_pieces(spark):
    rng = random.Random(3)
    texts = ["", None, " ", "hello world", "<|endoftext|> is text", "日本語 😀 ​", "a" * 3000, (words(rng, 12) + "\n  ") * 2500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, "hello world")], "doc_id long, text string").withColumn("ids", F.lit(1))
    out = tokens.corpus_ids(df)
    got = {r["doc_id"]: r for r in out.withColumn("raw", tokens.decode_bytes(F.col("ids"))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert bytes(got[i]["raw"]).decode() == (t or "")
        assert list(got[i]["ids"]) == (tokens.encoding(tokens.RANK_FILE).encode_ordinary(t) if t else [])
    assert 50256 not in got[4]["ids"]


# 8 ---------------------------------------------------------------------------

ITEM = "According to the inventory at Ferstiville counted 318 crates of amber wax for Ulmvata yet Morbelus denied the debt of 705 florins to Corndomar near the quay"


def leaks(*texts):
    return {t: n for t, _, n in leakage.leaked_items(leakage.ItemIndex([(1, ITEM)]), list(texts))}


def test_passages_are_found():
    w = ITEM.split()
    twelve = " ".join(w[6:18])
    changed = twelve.replace("amber", "always")
    assert leaks(f"Before it. {ITEM} After it.")[0] == len(w)
    assert leaks(f"some words {twelve} and more words")[0] == 12
    assert leaks(f"some words {twelve.upper().replace(' ', '  ')} and")[0] == 12
    assert leaks(twelve.replace("crates", "cra-\n> tes").replace("wax", "w​ах"))[0] == 12
    assert leaks(f"x {changed} y")[0] == 12
    assert leaks(" ".join(w[6:14])).get(0, 0) < 12
    assert leaks("", "nothing of it here at all") == {}


def test_every_allowed_pattern_of_changes_is_found():
    w, rng = ITEM.split(), random.Random(8)
    for start in range(len(w) - 13):
        for size, at in [(12, [c]) for c in range(1, 11)] + [(14, [c, c + 10]) for c in (1, 2)]:
            piece = w[start : start + size]
            for c in at:
                piece[c] = "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", rng.randint(8, 12)))
            assert leaks(f"some other words {' '.join(piece)} and more of them").get(0, 0) >= 12, (start, at)
    assert leaks(" ".join(w[2:8] + ["other", "words"] + w[10:16])).get(0, 0) < 12


def test_leaking_documents(spark):
    d = spark.createDataFrame([(1, f"a {ITEM} b"), (1, f"a {ITEM} b"), (2, None), (3, "  "), (4, "free of it"), (5, "pad " * 20000 + ITEM)], "doc_id long, text string").withColumn("item_id", F.lit(7))
    e = spark.createDataFrame([(9, ITEM), (8, None), (9, ITEM)], "item_id long, text string")
    assert keys(leakage.leaking_documents(d, e), "doc_id", "item_id") == [(1, 9), (5, 9)]
    assert leakage.leaking_documents(d, e.limit(0)).count() == 0


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 2**64, 300, dtype=np.uint64)
    near = np.array([int(f) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for f in fp for k in (0, 3, 13, 14, 15)], dtype=np.uint64)
    left, right = leakage.Tables(fp).hits(near)
    want = {(i, j) for i in range(len(near)) for j in np.flatnonzero(np.bitwise_count(fp ^ near[i]) <= leakage.RADIUS).tolist()}
    assert set(zip(left.tolist(), right.tolist(), strict=True)) == want and len(want) >= 1200


def test_passages_come_by_near_fingerprints(monkeypatch):
    piece = ITEM.split()[6:18]
    piece[6] = "otherwise"  # no window of the passage is without a change then
    text = f"quite other words before {' '.join(piece)} and quite other words after"
    assert leaks(text)[0] == 12
    monkeypatch.setattr(leakage, "RADIUS", 0)
    assert leaks(text) == {}


def test_short_items_are_found_whole(spark):
    e = spark.createDataFrame([(1, "The amber harbour sleeps"), (2, "Harbour")], "item_id long, text string")
    d = spark.createDataFrame([(1, "now THE AMBER HARBOUR sleeps."), (2, "the amber harbour"), (3, "none of it")], "doc_id long, text string")
    assert keys(leakage.leaking_documents(d, e), "doc_id", "item_id") == [(1, 1), (1, 2), (2, 2)]


# 9 ---------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("t", "unset"),
    [
        ("Hello {{ name }}, welcome", True), ("Obra: [TITULO] / ${autor}", True), ("by undefined on null", True), ("by [object Object]", True), ("null and void", False),
        ("The manual explains that the field “{{titulo}}” is replaced by the name.", False), ("x = y_1 ** 2 // (a[i] - b[j]);", False), ("The old house stands [3].", False), ("", False),
    ],
)
def test_placeholders(t, unset):
    assert residue.unfilled(t) == unset


RESIDUE = [
    (1, "A story of the sea.\nPlease enable JavaScript to read this book.\nThe end."), (2, "A story of the sea."), (3, None), (4, " "), (5, "A {{title}} of the sea."),
    (6, "Plese enable JavaScript to read this book."), (7, "Proofreader Ann recalls the day everyone saw “error 404” on the library door and laughed."), (8, "pad. " * 9000 + "Internal server error (500)."),
]


def test_residue_documents(spark):
    d = spark.createDataFrame(RESIDUE + RESIDUE[:2], "doc_id long, text string").withColumn("words", F.lit("clash"))
    assert keys(residue.residue_documents(d), "doc_id") == [(1,), (5,), (6,), (8,)]
    assert residue.without_residue(d).count() == 5
    assert residue.residue_documents(d.limit(0)).count() == 0


def test_residue_comes_by_fingerprints(spark, monkeypatch):
    d = spark.createDataFrame(RESIDUE, "doc_id long, text string")
    monkeypatch.setattr(residue, "near_duplicates", lambda found, tables, frontier: frontier.select("words", "fingerprint").limit(0))
    monkeypatch.setattr(residue, "SEEDS", ("no such text",))
    assert keys(residue.residue_documents(d), "doc_id") == [(5,)]  # without links only the placeholder is left


def test_residue_wordings(spark):
    yes = ["Erro 404: a página não foi encontrada", "xxxxx xxxxx xxxxx", "Your text goes here.", "Lorem ipsum dolor sit amet, consectetur", "ESTE LECTOR NECESITA LOS SCRIPTS\nHABILITADOS EN EL NAVEGADOR.", "Too mány requests"]
    no = ["Older readers, says Ann, asked people to enable JavaScript, and the essay discusses why that drove them away.", "The year was\n1984", "The lost ledger of the harbour at night", "1 2 3"]
    d = spark.createDataFrame(list(enumerate(yes + no)), "doc_id long, text string")
    assert keys(residue.residue_documents(d), "doc_id") == [(i,) for i in range(len(yes))]


def test_residue_spreads_from_unit_to_unit(spark, monkeypatch):
    w = words(random.Random(2), 30).split()
    chain = [" ".join(w[:k] + [x[::-1] + "q" for x in w[k:]]) for k in (30, 28, 26, 24)]  # each is near to the next only
    d = spark.createDataFrame([*enumerate(chain), (9, " ".join(w[::-1][:9])), (10, f"Prose before it.\n{chain[3]}")], "doc_id long, text string")
    near = lambda a, b: len(residue.shingles(a) & residue.shingles(b)) / len(residue.shingles(a) | residue.shingles(b))
    assert near(chain[0], chain[1]) >= residue.SIMILARITY > near(chain[0], chain[3])
    monkeypatch.setattr(residue, "SEEDS", (chain[0],))
    assert keys(residue.residue_documents(d), "doc_id") == [(0,), (1,), (2,), (3,), (10,)]


def test_fingerprint_tables_against_brute_force(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(-(2**63), 2**63, 20, dtype=np.int64)
    near = [int(np.int64(s)) ^ sum(1 << int(b) for b in rng.choice(63, k, replace=False)) for s in seeds for k in (0, 1, 8, 14, 15, 16, 17)]
    frame = lambda values: spark.createDataFrame([(int(v),) for v in values], "fingerprint long")
    got = keys(residue.within_radius(residue.block_tables(frame(near)), frame(seeds)), "fingerprint", "of_fingerprint")
    want = sorted({(a, int(b)) for a in near for b in seeds if bin((a ^ int(b)) & (2**64 - 1)).count("1") <= residue.RADIUS})
    assert got == want and len(want) >= 20 * 5


def test_radius_covers_the_similarity():
    rng, known = random.Random(6), residue.Words()
    near = seen = 0
    while near < 400:
        a = words(rng, rng.randint(3, 12)).split()
        b = list(a)
        b[rng.randrange(len(b))] = words(rng, 1)
        a, b = sorted(set(a)), sorted(set(b))
        x, y = residue.shingles(" ".join(a)), residue.shingles(" ".join(b))
        if len(x & y) < residue.SIMILARITY * len(x | y):
            continue
        f = known.fingerprints([a, b])
        near += 1
        seen += bin(int(f[0] ^ f[1]) & (2**64 - 1)).count("1") <= residue.RADIUS
    assert seen >= 0.95 * near
