"""The registered queries in ANSI-style SQL, for comparison on the same tables.

Common table expressions are kept by name with what they need; ``query`` puts
the needed ones in front of a final statement.  Patterns and constants are
spelled out here anew, so that a wrong one in the library shows.
"""

from __future__ import annotations

import unicodedata

_Q = "'"


class X:
    """What decides about texts (fixed values), in the syntax of RE2."""

    WS = r"\x09-\x0d\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
    CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{fffe}\x{ffff}]"
    BULLET = rf"^[{WS}]*([-•·▪◦‣∙*–—])[{WS}]+"
    ENUMERATOR = rf"(?i)^[{WS}]*(\(?(?:[0-9]{{1,3}}|[a-z]|[ivxlcdm]{{1,5}})[.)])[{WS}]+"
    CHAPTER = (
        rf"(?i)^[{WS}]*(?:cap[ií]tulo|chapter|parte|section|livro|book|ato|ap[eê]ndice|anexo|ep[ií]logo|pr[oó]logo|se[cç][aã]o|introdu[cç][aã]o|"
        rf"conclus[aã]o|pref[aá]cio|part)(?:$|[^\p{{L}}\p{{M}}\p{{N}}_])"
    )
    NUMBERED = rf"^[{WS}]*[0-9]{{1,2}}(?:\.[0-9]{{1,2}}){{0,2}}[{WS}]+[^{WS}]"
    TOC_LEADER = rf"(?:[.·][{WS}]?){{4,}}"
    TOC_TAIL = rf"[{WS}]{{2,}}[0-9]{{1,4}}[{WS}]*$"
    TOC_SHORT_TAIL = rf"[{WS}][0-9]{{1,3}}[{WS}]*$"
    NOTE_MARKER = rf"^[{WS}]*(?:\[?[0-9]{{1,3}}\]?[.)]?|\*{{1,3}})[{WS}]+[^{WS}]"
    SENTENCE_END = "[.!?…:;»”\"')\\]]$"
    PARAGRAPH_END = "[.!?…][\"'»”’)\\]]?$"
    ROMAN = r"(?i)^[ivxlcdm]{1,7}$"
    PAGE_OF = rf"(?i)^(?:p[aá]g(?:ina)?\.?)?[{WS}]*#?[{WS}]*[0-9]+[{WS}]*(?:de|/)[{WS}]*[0-9]+$"


def _p(pattern: str) -> str:
    """A pattern as an SQL string literal."""
    return _Q + pattern.replace(_Q, _Q * 2) + _Q


def _trim(c: str) -> str:
    return f"regexp_replace({c}, {_p(f'^[{X.WS}]+|[{X.WS}]+$')}, '', 'g')"


def _rtrim(c: str) -> str:
    return f"regexp_replace({c}, {_p(f'[{X.WS}]+$')}, '')"


def _has(c: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({c}, {_p(pattern)}), false)"


def _sanitize(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), {_p(X.CONTROL)}, '', 'g')"


def _clean(c: str) -> str:
    t = _sanitize(c)
    for lig, letters in X.LIGATURES.items():
        t = f"replace({t}, '{lig}', '{letters}')"
    t = f"replace(replace(replace({t}, '’', ''''), '­', ''), '﻿', '')"
    return f"regexp_replace(nfc_normalize({t}), '[ \\t\\xa0]+', ' ', 'g')"


def _key(c: str) -> str:
    t = rf"regexp_replace(lower({c}), '\p{{Nd}}+', '#', 'g')"
    return _trim(f"regexp_replace({t}, {_p(f'[{X.WS}]+')}, ' ', 'g')")


def _page_number(c: str) -> str:
    t = rf"regexp_replace({c}, '^[ .\-–—\[\]()]+|[ .\-–—\[\]()]+$', '', 'g')"
    return f"coalesce({t} = '' OR regexp_matches({t}, '^[0-9]{{1,4}}$') OR {_has(t, X.ROMAN)} OR {_has(t, X.PAGE_OF)}, false)"


def _all_caps(c: str) -> str:
    n, u = rf"length(regexp_replace({c}, '[^\p{{L}}]', '', 'g'))", rf"length(regexp_replace({c}, '[^\p{{Lu}}]', '', 'g'))"
    return f"({n} >= 3 AND {u} / greatest({n}, 1) > 0.85)"


def _half(c: str) -> str:
    return f"(round_even({c} * 2, 0) / 2)"


def _leader(c: str) -> str:
    return _has(c, X.TOC_LEADER)


def _entry(c: str) -> str:
    return f"({_leader(c)} OR {_has(c, X.TOC_TAIL)} OR (length({c}) < 70 AND {_has(c, X.TOC_SHORT_TAIL)}))"


_SOLID = rf"[^{X.WS}]"
_BULLET, _ENUM = X.BULLET + _SOLID, X.ENUMERATOR + _SOLID


def _marker(c: str) -> str:
    return f"CASE WHEN {_has(c, _BULLET)} THEN regexp_extract({c}, {_p(X.BULLET)}, 1) WHEN {_has(c, _ENUM)} THEN regexp_extract({c}, {_p(X.ENUMERATOR)}, 1) END"


def _rest(c: str) -> str:
    return f"CASE WHEN {_has(c, _BULLET)} THEN regexp_replace({c}, {_p(X.BULLET)}, '') WHEN {_has(c, _ENUM)} THEN regexp_replace({c}, {_p(X.ENUMERATOR)}, '') ELSE {c} END"


def _heading(p: str = "") -> str:
    """The heading test on the columns of an alias, given with its dot."""
    t = f"{p}text"
    ratio = f"(CASE WHEN {p}body <> 0 THEN {p}size / {p}body ELSE 1.0 END)"
    numbered = f"({_has(t, X.CHAPTER)} OR {_has(t, X.NUMBERED)})"
    return (
        f"(length({t}) > 0 AND length({t}) <= 200 AND {p}n_lines <= 4 AND NOT {_has(t, '[,;]$')} AND NOT (length({t}) > 70 AND {p}x1 - {p}x0 > {p}width * 0.62)"
        f" AND ({ratio} >= 1.12 OR ({p}bold AND {ratio} >= 0.97 AND length({t}) <= 120) OR ({_all_caps(t)} AND length({t}) <= 90 AND {p}n_lines <= 2)"
        f" OR ({numbered} AND ({p}bold OR {ratio} >= 1.05)))"
        f" AND NOT ({_has(t, X.SENTENCE_END)} AND {ratio} < 1.2 AND NOT {numbered} AND length({t}) > 60))"
    )


def _one_heading(m: str, s: str) -> str:
    """Whether piece ``s`` carries on the heading grown to ``m``."""
    below = f"({s}.top - {m}.bottom BETWEEN 0 AND 1.2 * {s}.size AND least({m}.x1, {s}.x1) > greatest({m}.x0, {s}.x0))"
    level = f"(least({m}.bottom, {s}.bottom) - greatest({m}.top, {s}.top) > 0.5 * least({m}.bottom - {m}.top, {s}.bottom - {s}.top))"
    beside = f"({level} AND {s}.x0 >= {m}.x1 AND {s}.x0 - {m}.x1 < 3 * {s}.size)"
    alike = f"{m}.col = {s}.col AND abs({m}.size - {s}.size) <= 0.15 * greatest({m}.size, {s}.size)"
    return f"coalesce({s}.hd AND {alike} AND ({below} OR {beside}) AND NOT {_has(m + '.text', X.PARAGRAPH_END)} AND {_heading(m + '.')}, false)"


def _compatible(c: str) -> str:
    """Compatibility characters as the letters they stand for: tables by rule from
    the Unicode database, letters of one character by ``translate``."""
    one, many = {}, {}
    for o in (*range(0xA0, 0x3400), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFFEF), *range(0x1D400, 0x1D800)):
        ch = chr(o)
        if unicodedata.decomposition(ch).startswith("<"):
            plain = "".join(x for x in unicodedata.normalize("NFKD", ch) if x == "_" or x.isalnum())
            (one if len(plain) == 1 else many)[ch] = plain
    many = {ch: plain for ch, plain in many.items() if plain and ord(ch) < 0x2190}
    t = f"translate({c}, {_p(''.join(one))}, {_p(''.join(one.values()))})"
    for ch, plain in many.items():
        t = f"replace({t}, {_p(ch)}, {_p(plain)})"
    return t


def _fold(c: str) -> str:
    return rf"lower(regexp_replace(strip_accents({_compatible(c)}), '[^\p{{L}}\p{{N}}_]', '', 'g'))"


def _note() -> str:
    return f"(size < body * 0.92 AND top >= height * 0.55 AND ({_has('text', X.NOTE_MARKER)} OR size < body * 0.8))"


def _stem(c: str) -> str:
    """File stem with underscores as blanks, or a fixed word."""
    t = _trim(rf"replace(regexp_replace(regexp_extract({c}, '([^/]*)$', 1), '(.)\.[^./]*$', '\1'), '_', ' ')")
    return f"CASE WHEN coalesce({t}, '') = '' THEN 'Documento' ELSE {t} END"


_BOX = "l_x0, l_y0, l_x1, l_y1, b_x0, b_y0, b_x1, b_y1"
_LINE = "book_id, page, block_seq, line_seq"

#: name -> (needed names, statement)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "sp": ((), f"""SELECT DISTINCT {_LINE}, span_seq, nfc_normalize(text) AS text, coalesce(round(size, 2), 0.0) AS size,
        ((coalesce(flags, 0) & 16) <> 0 OR regexp_matches(lower(coalesce(font, '')), 'bold|black')) AS bold,
        ((coalesce(flags, 0) & 2) <> 0 OR regexp_matches(lower(coalesce(font, '')), 'italic|oblique')) AS italic,
        abs(coalesce(dir_x, 1.0)) < 0.7 AS vertical, {_BOX} FROM span_facts WHERE text IS NOT NULL AND text <> ''"""),
    "ln0": (("sp",), f"""SELECT {_LINE}, string_agg(text, '' ORDER BY span_seq) AS raw, sum(size * length(text)) / sum(length(text)) AS size,
        sum(CASE WHEN bold THEN length({_trim('text')}) ELSE 0 END) > 0.6 * sum(length({_trim('text')})) AS bold,
        min(l_x0) AS x0, min(l_y0) AS top, min(l_x1) AS x1, min(l_y1) AS bottom, min(b_x0) AS b_x0, min(b_y0) AS b_y0, min(b_x1) AS b_x1, min(b_y1) AS b_y1
        FROM sp WHERE NOT vertical GROUP BY ALL"""),
    "ln": (("ln0",), f"SELECT * EXCLUDE (raw, size), {_trim('raw')} AS text, round(size, 4) AS size FROM ln0 WHERE {_trim('raw')} <> ''"),
    "pg": ((), "SELECT book_id, page, max(width) AS width, max(height) AS height FROM page_info GROUP BY ALL"),
    "pages": (("ln",), """SELECT book_id, CAST(coalesce(said, seen) AS BIGINT) AS pages FROM (SELECT book_id, max(page_count) AS said FROM books GROUP BY 1) b
        FULL JOIN (SELECT book_id, max(page) + 1 AS seen FROM ln GROUP BY 1) l USING (book_id)"""),
    "sized": (("ln", "pg"), f"""SELECT *, (top < 0.075 * height OR bottom > 0.925 * height) AS in_margin FROM (SELECT ln.*, {_key('text')} AS running_key,
        coalesce(width, 595.0) AS width, coalesce(height, 842.0) AS height FROM ln LEFT JOIN pg USING (book_id, page))"""),
    "running": (("sized", "pages"), """SELECT book_id, running_key, count(DISTINCT page) AS n_pages FROM sized JOIN pages USING (book_id) WHERE in_margin AND running_key <> ''
        GROUP BY book_id, running_key, pages HAVING count(DISTINCT page) >= greatest(3, floor(pages * 0.35))"""),
    "kept": (("sized", "running"), f"""SELECT sized.* FROM sized LEFT JOIN running r USING (book_id, running_key)
        WHERE NOT (in_margin AND (r.n_pages IS NOT NULL OR {_page_number('text')}))"""),
    "tx": (("ln", "pages"), """SELECT book_id, pages, coalesce(n, 0) AS text_chars, coalesce(n, 0) / greatest(1, pages) AS per FROM pages
        LEFT JOIN (SELECT book_id, sum(length(text)) AS n FROM ln GROUP BY 1) USING (book_id)"""),
    "im0": (("pg",), """SELECT *, (x1 - x0) * (y1 - y0) > 0.8 * width * height AS full_page FROM (SELECT DISTINCT book_id, page, block_seq, x0, y0, x1, y1, ext, sha1(image) AS digest,
        coalesce(width, 595.0) AS width, coalesce(height, 842.0) AS height FROM image_facts LEFT JOIN pg USING (book_id, page) WHERE image IS NOT NULL AND octet_length(image) > 0)
        WHERE x1 - x0 >= 40 AND y1 - y0 >= 40 AND (x1 - x0) * (y1 - y0) >= 0.01 * width * height"""),
    "im": (("im0", "tx"), """SELECT * FROM (SELECT im0.*, pages, count(*) OVER (PARTITION BY book_id, digest) AS n_same FROM im0 JOIN tx USING (book_id) WHERE NOT (full_page AND per >= 200))
        WHERE NOT (pages >= 4 AND n_same >= greatest(3, floor(pages * 0.3)))"""),
    "tb": (("ln",), "SELECT book_id, page, block_seq, min(b_x0) AS x0, min(b_y0) AS y0, min(b_x1) AS x1, min(b_y1) AS y1 FROM ln GROUP BY ALL"),
    "nb": (("tb", "pg"), """SELECT * FROM (SELECT tb.*, coalesce(width, 595.0) AS width FROM tb LEFT JOIN pg USING (book_id, page))"""),
    "narrow": (("nb",), """SELECT *, greatest(0, least(199, CAST(floor(x0 / width * 200) AS INT))) AS a, greatest(0, least(199, CAST(floor(x1 / width * 200) AS INT))) AS b
        FROM nb WHERE x1 - x0 < 0.7 * width"""),
    "able": (("nb", "narrow"), """SELECT book_id, page, width FROM (SELECT book_id, page, max(width) AS width, count(*) AS n FROM nb GROUP BY ALL)
        JOIN (SELECT book_id, page, count(*) AS k FROM narrow GROUP BY ALL) USING (book_id, page) WHERE n >= 4 AND k >= 4"""),
    "bins": (("able", "narrow"), """SELECT p.book_id, p.page, p.width, i FROM able p, range(200) t(i)
        WHERE NOT EXISTS (SELECT 1 FROM narrow n WHERE n.book_id = p.book_id AND n.page = p.page AND n.a <= i AND i <= n.b)"""),
    "cands": (("bins",), """SELECT book_id, page, c * width AS s FROM (SELECT book_id, page, width, min(i) AS a, max(i) AS b, (min(i) + max(i) + 1) / 2.0 / 200 AS c
        FROM (SELECT *, i - row_number() OVER (PARTITION BY book_id, page ORDER BY i) AS g FROM bins) GROUP BY book_id, page, width, g)
        WHERE a > 0 AND b < 199 AND b - a + 1 >= 7 AND c > 0.2 AND c < 0.8"""),
    "bands": (("cands",), """SELECT book_id, page, lo, lead(lo, 1, 'Infinity'::DOUBLE) OVER (PARTITION BY book_id, page ORDER BY lo) AS hi FROM
        (SELECT book_id, page, s AS lo FROM cands UNION ALL SELECT DISTINCT book_id, page, '-Infinity'::DOUBLE FROM cands)"""),
    "splits": (("bands", "narrow", "cands"), """SELECT book_id, page, s FROM cands WHERE (book_id, page) NOT IN (SELECT (b.book_id, b.page) FROM bands b LEFT JOIN narrow n
        ON n.book_id = b.book_id AND n.page = b.page AND (n.x0 + n.x1) / 2 >= b.lo AND (n.x0 + n.x1) / 2 <= b.hi GROUP BY b.book_id, b.page, b.lo HAVING count(n.x0) < 2)"""),
    "boxes": (("tb", "im"), "SELECT * FROM tb UNION ALL SELECT book_id, page, block_seq, min(x0), min(y0), min(x1), min(y1) FROM im GROUP BY ALL"),
    "col": (("boxes", "splits"), """SELECT x.book_id, x.page, x.block_seq, x.x0, x.y0, x.x1, x.y1,
        CAST(CASE WHEN bool_or(coalesce(x.x0 < s AND s < x.x1, false)) THEN 0 ELSE count(CASE WHEN (x.x0 + x.x1) / 2 > s THEN 1 END) END AS INT) AS col
        FROM boxes x LEFT JOIN splits USING (book_id, page) GROUP BY ALL"""),
    "blk": (("col",), "SELECT *, CAST(row_number() OVER (PARTITION BY book_id, page ORDER BY col, round(y0, 1), x0, block_seq) - 1 AS INT) AS read_seq FROM col"),
    "lines": (("kept", "blk"), "SELECT k.*, b.col, b.read_seq FROM kept k JOIN blk b USING (book_id, page, block_seq)"),
    "body": (("lines", "sp"), f"""SELECT book_id, bucket AS body FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY n DESC, p, r, l, s) AS rn FROM
        (SELECT book_id, {_half('sp.size')} AS bucket, sum(length({_trim('sp.text')})) AS n, min((page, read_seq, line_seq, span_seq)) AS f, f[1] AS p, f[2] AS r, f[3] AS l, f[4] AS s
        FROM sp JOIN lines USING (book_id, page, block_seq, line_seq) WHERE NOT vertical AND length({_trim('sp.text')}) > 0 GROUP BY 1, 2)) WHERE rn = 1"""),
    "brk0": (("lines", "body"), """SELECT lines.*, coalesce(body, 10.0) AS body, greatest(0.0, top - lag(bottom) OVER w) AS gap, lag(x1) OVER w AS px1, lag(size) OVER w AS psize, lag(bold) OVER w AS pbold,
        min(x0) OVER b AS lft, max(x1) OVER b AS rgt, lag(line_seq) OVER w IS NULL AS opening
        FROM lines LEFT JOIN body USING (book_id) WINDOW w AS (PARTITION BY book_id, page, block_seq ORDER BY line_seq), b AS (PARTITION BY book_id, page, block_seq)"""),
    "brk1": (("brk0",), """SELECT * EXCLUDE (gap), CASE WHEN opening THEN NULL ELSE gap END AS gap, coalesce(median(CASE WHEN opening THEN NULL ELSE gap END) OVER (PARTITION BY book_id, page, block_seq), 0.0) AS mg FROM brk0"""),
    "brk": (("brk1",), """SELECT *, sum(CASE WHEN NOT opening AND (gap > greatest(mg * 1.6, mg + greatest(size, body) * 0.45)
        OR (px1 < rgt - greatest(1.0, rgt - lft) * 0.12 AND x0 <= lft + greatest(1.0, rgt - lft) * 0.06) OR (x0 > lft + greatest(1.0, rgt - lft) * 0.025 AND px1 > rgt - greatest(1.0, rgt - lft) * 0.08)
        OR abs(size - psize) > 1.0 OR bold <> pbold) THEN 1 ELSE 0 END) OVER (PARTITION BY book_id, page, block_seq ORDER BY line_seq) AS para FROM brk1"""),
    "pr": (("brk",), f"""SELECT * FROM (SELECT book_id, page, block_seq, read_seq, col, CAST(para AS BIGINT) AS para, {_trim(_clean("string_agg(text, ' ' ORDER BY line_seq)"))} AS text,
        count(*) AS n_lines, max(size) AS size, bool_and(bold) AS bold, min(x0) AS x0, max(x1) AS x1, min(top) AS top, max(bottom) AS bottom,
        max(width) AS width, max(height) AS height, max(body) AS body FROM brk GROUP BY book_id, page, block_seq, read_seq, col, para) WHERE text <> ''"""),
    "tocp": (("pr",), f"""SELECT book_id, page, count(*) FILTER ({_entry('text')}) AS n_entries, count(*) FILTER ({_leader('text')}) AS n_leaders FROM pr
        GROUP BY ALL HAVING n_entries >= 3 AND n_leaders >= 1"""),
    "pr2": (("pr", "tocp"), f"SELECT pr.* FROM pr LEFT JOIN tocp t USING (book_id, page) WHERE NOT (t.n_entries IS NOT NULL AND ({_entry('text')} OR length({_trim('text')}) < 80))"),
    "hd": (("pr2",), f"SELECT *, {_heading()} AS hd, {_half('size')} AS bucket, {_has('text', X.CHAPTER)} AS chapter FROM pr2"),
    "hb": (("hd",), "SELECT *, n >= greatest(2, sum(n) OVER (PARTITION BY book_id) * 0.02) AS often FROM (SELECT book_id, bucket, count(*) AS n, bool_or(chapter) AS chapter FROM hd WHERE hd GROUP BY 1, 2)"),
    "anch": (("hb",), """SELECT book_id, CASE WHEN base IS NOT NULL THEN [base] || list_slice(list_filter(sig, lambda s: s < base), 1, 2) ELSE list_slice(sig, 1, 3) END AS anchors FROM
        (SELECT book_id, base, CASE WHEN len(o) > 0 THEN o ELSE a END AS sig FROM (SELECT book_id, max(CASE WHEN chapter THEN bucket END) AS base,
        list(bucket ORDER BY bucket DESC) AS a, coalesce(list(bucket ORDER BY bucket DESC) FILTER (often), []) AS o FROM hb GROUP BY 1))"""),
    "seqd": (("hd",), "SELECT *, row_number() OVER (PARTITION BY book_id, page ORDER BY read_seq, para) AS rn FROM hd"),
    "mg": (("seqd",), f"""SELECT book_id, page, rn, rn AS g, read_seq, para, col, text, n_lines, size, bold, x0, x1, top, bottom, width, height, body FROM seqd WHERE rn = 1
        UNION ALL SELECT s.book_id, s.page, s.rn, CASE WHEN j THEN m.g ELSE s.rn END, CASE WHEN j THEN m.read_seq ELSE s.read_seq END, CASE WHEN j THEN m.para ELSE s.para END, s.col,
        CASE WHEN j THEN {_trim(_clean("m.text || ' ' || s.text"))} ELSE s.text END, CASE WHEN j THEN m.n_lines + s.n_lines ELSE s.n_lines END,
        CASE WHEN j THEN greatest(m.size, s.size) ELSE s.size END, CASE WHEN j THEN m.bold AND s.bold ELSE s.bold END, CASE WHEN j THEN least(m.x0, s.x0) ELSE s.x0 END,
        CASE WHEN j THEN greatest(m.x1, s.x1) ELSE s.x1 END, CASE WHEN j THEN least(m.top, s.top) ELSE s.top END, CASE WHEN j THEN greatest(m.bottom, s.bottom) ELSE s.bottom END, s.width, s.height, s.body
        FROM mg m JOIN seqd s ON s.book_id = m.book_id AND s.page = m.page AND s.rn = m.rn + 1, LATERAL (SELECT {_one_heading('m', 's')} AS j)"""),
    "mh": (("mg",), "SELECT * EXCLUDE (z) FROM (SELECT *, row_number() OVER (PARTITION BY book_id, page, g ORDER BY rn DESC) AS z FROM mg) WHERE z = 1"),
    "mt": (("mh",), f"""SELECT *, (top < height * 0.09 OR bottom > height * 0.93) AND n_lines <= 2 AND count(*) OVER (PARTITION BY book_id, fold) > 1 AS runs FROM
        (SELECT *, {_fold('text')} AS fold FROM mh)"""),
    "hd2": (("mt",), f"SELECT *, {_heading()} AS hd, {_half('size')} AS bucket, {_has('text', X.CHAPTER)} AS chapter FROM mt WHERE NOT runs"),
    "hb2": (("hd2",), "SELECT *, n >= greatest(2, sum(n) OVER (PARTITION BY book_id) * 0.02) AS often FROM (SELECT book_id, bucket, count(*) AS n, bool_or(chapter) AS chapter FROM hd2 WHERE hd GROUP BY 1, 2)"),
    "anch2": (("hb2",), """SELECT book_id, CASE WHEN base IS NOT NULL THEN [base] || list_slice(list_filter(sig, lambda s: s < base), 1, 2) ELSE list_slice(sig, 1, 3) END AS anchors FROM
        (SELECT book_id, base, CASE WHEN len(o) > 0 THEN o ELSE a END AS sig FROM (SELECT book_id, max(CASE WHEN chapter THEN bucket END) AS base,
        list(bucket ORDER BY bucket DESC) AS a, coalesce(list(bucket ORDER BY bucket DESC) FILTER (often), []) AS o FROM hb2 GROUP BY 1))"""),
    "cl": (("hd2", "anch2"), f"""SELECT * EXCLUDE (k0), k0 AS kind, CAST(CASE WHEN k0 = 'heading' THEN CASE WHEN chapter THEN 1 ELSE least(3, 1 + len(list_filter(coalesce(anchors, []), lambda a: a > bucket))) END
        WHEN k0 = 'list_item' THEN CASE WHEN {_has('text', _ENUM)} THEN 1 ELSE 0 END ELSE 0 END AS INT) AS level, CASE WHEN k0 = 'list_item' THEN {_marker('text')} ELSE '' END AS marker FROM
        (SELECT hd2.*, anchors, CASE WHEN {_note()} THEN 'note' WHEN hd THEN 'heading' WHEN {_marker('text')} IS NOT NULL AND length(text) < 1200 THEN 'list_item' ELSE 'paragraph' END AS k0
        FROM hd2 LEFT JOIN anch2 USING (book_id))"""),
    # lines of the merged paragraphs in order, their spans, and the runs these make
    "ml": (("brk", "seqd", "mg", "cl"), """SELECT b.book_id, b.page, b.block_seq, b.line_seq, m.g, c.kind, row_number() OVER w AS lo, count(*) OVER (PARTITION BY b.book_id, b.page, m.g) AS n_l,
        lead(b.text) OVER w AS nxt FROM brk b JOIN seqd s USING (book_id, page, block_seq, para) JOIN mg m ON m.book_id = s.book_id AND m.page = s.page AND m.rn = s.rn
        JOIN cl c ON c.book_id = m.book_id AND c.page = m.page AND c.g = m.g WINDOW w AS (PARTITION BY b.book_id, b.page, m.g ORDER BY s.rn, b.line_seq)"""),
    "ms0": (("ml", "sp"), f"""SELECT ml.*, sp.span_seq, sp.bold, sp.italic, {_clean('sp.text')} AS t, sp.span_seq = max(sp.span_seq) OVER (PARTITION BY book_id, page, block_seq, line_seq) AS ends
        FROM ml JOIN sp USING (book_id, page, block_seq, line_seq) WHERE NOT vertical"""),
    "ms": (("ms0",), rf"""SELECT *, CASE WHEN NOT ends OR lo = n_l THEN t WHEN {_has('t', f'[-‐][{X.WS}]*$')} AND {_has('nxt', r'^\p{Ll}')} THEN regexp_replace(t, {_p(f'[-‐][{X.WS}]*$')}, '')
        ELSE {_rtrim('t')} || ' ' END AS v, coalesce(lag(bold) OVER w <> bold OR lag(italic) OVER w <> italic, true) AS opens FROM ms0 WINDOW w AS (PARTITION BY book_id, page, g ORDER BY lo, span_seq)"""),
    "rj": (("ms",), """SELECT book_id, page, g, rid, any_value(bold) AS bold, any_value(italic) AS italic, string_agg(v, '' ORDER BY lo, span_seq) AS t FROM
        (SELECT *, sum(opens::INT) OVER (PARTITION BY book_id, page, g ORDER BY lo, span_seq) AS rid FROM ms) GROUP BY ALL"""),
    "rt": (("rj",), f"""SELECT *, row_number() OVER (PARTITION BY book_id, page, g ORDER BY rid) AS i FROM
        (SELECT * EXCLUDE (t), CASE WHEN rid = max(rid) OVER (PARTITION BY book_id, page, g) THEN {_rtrim('t')} ELSE t END AS t FROM rj) WHERE t <> ''"""),
    "rs": (("rt", "cl"), f"SELECT rt.* EXCLUDE (t), CASE WHEN kind = 'list_item' AND i = 1 THEN {_rest('t')} ELSE t END AS t FROM rt JOIN cl USING (book_id, page, g)"),
    "ord": (("cl", "rs", "im", "blk"), """SELECT *, CAST(row_number() OVER (PARTITION BY book_id ORDER BY page, read_seq, part, kind, digest) - 1 AS INT) AS seq FROM
        (SELECT book_id, page, read_seq, para AS part, kind, level, marker, g, CAST(NULL AS VARCHAR) AS digest, coalesce(x, '') AS text FROM cl
        LEFT JOIN (SELECT book_id, page, g, string_agg(t, '' ORDER BY i) AS x FROM rs GROUP BY ALL) USING (book_id, page, g)
        UNION ALL SELECT book_id, page, read_seq, 0, 'image', 0, '', NULL, digest, '' FROM im JOIN blk USING (book_id, page, block_seq))"""),
    "isl": (("ord",), rf"""SELECT *, sum((NOT joins)::INT) OVER w AS island, coalesce(lead(joins) OVER w, false) AS more FROM
        (SELECT *, kind = 'paragraph' AND coalesce(pk = 'paragraph', false) AND coalesce((pt <> '' AND {_trim('text')} <> '' AND NOT {_has('pt', X.PARAGRAPH_END)} AND NOT {_has(_trim('text'), r'^[\p{Lu}\p{Nd}]')})
        OR ({_has('pt', '-$')} AND {_has(_trim('text'), r'^\p{Ll}')}), false) AS joins FROM (SELECT *, lag(kind) OVER v AS pk, {_rtrim('lag(text) OVER v')} AS pt FROM ord WHERE kind <> 'note'
        WINDOW v AS (PARTITION BY book_id ORDER BY seq))) WINDOW w AS (PARTITION BY book_id ORDER BY seq)"""),
    "er": (("isl", "rs"), f"""SELECT e.book_id, e.island, e.seq, r.i, r.bold, r.italic, CASE WHEN NOT e.more OR r.i < max(r.i) OVER (PARTITION BY e.book_id, e.seq) THEN r.t
        WHEN {_has(_rtrim('e.text'), '-$')} THEN regexp_replace({_rtrim('r.t')}, '-$', '') ELSE {_rtrim('r.t')} || ' ' END AS t FROM isl e JOIN rs r USING (book_id, page, g)"""),
    "fe": (("isl", "er"), f"""SELECT * FROM (SELECT i.*, coalesce(x, '') AS text FROM (SELECT book_id, island, min(seq) AS seq, arg_min(kind, seq) AS kind, arg_min(level, seq) AS level,
        arg_min(marker, seq) AS marker, arg_min(page, seq) AS page FROM isl GROUP BY ALL) i LEFT JOIN (SELECT book_id, island, string_agg(t, '' ORDER BY seq, i) AS x FROM er GROUP BY ALL) USING (book_id, island))
        WHERE kind = 'image' OR length({_trim('text')}) > 2"""),
    "bk": ((), """SELECT book_id, max(page_count) AS page_count, max(metadata['title']) AS m_title, max(metadata['author']) AS m_author, max(path) AS path FROM books GROUP BY 1"""),
    "ti": (("bk", "fe"), f"""SELECT bk.book_id, CASE WHEN length({_trim(_sanitize('m_title'))}) > 3 AND NOT lower({_trim(_sanitize('m_title'))}) LIKE '%.pdf' THEN {_trim(_sanitize('m_title'))}
        ELSE coalesce(oh, op, {_stem('path')}) END AS title, {_trim(_sanitize('m_author'))} AS said, front FROM bk LEFT JOIN (SELECT book_id,
        arg_min(text, rn) FILTER (kind = 'heading' AND length(text) > 3 AND length(text) < 120) AS oh,
        arg_min(text, rn) FILTER (kind = 'paragraph' AND rn <= 6 AND length(text) > 3 AND length(text) < 120) AS op,
        list({_trim('text')} ORDER BY rn) FILTER (rn <= 6 AND page = 0) AS front
        FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY seq) AS rn FROM fe) WHERE rn <= 12 GROUP BY 1) USING (book_id)"""),
    "el": ((), """SELECT * FROM (SELECT DISTINCT book_id, el_seq, kind, level, marker, page, image_ext, image_w, image_h, array_to_string(list_transform(coalesce(runs, []), lambda r: coalesce(r.text, '')), '') AS text FROM elements)"""),
}


def query(final: str, *needs: str) -> str:
    """``final`` behind the expressions it needs, each once, in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n not in order:
            for m in CTES[n][0]:
                visit(m)
            order.append(n)

    for n in needs:
        visit(n)
    # what several others read is worked out once; the fold over a page is recursive
    kept = {"sp", "ln", "lines", "pr", "seqd", "mg", "cl", "rs", "ord", "isl", "fe"}
    head = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in kept and n != 'mg' else ''}({CTES[n][1]})" for n in order)
    return f"WITH {'RECURSIVE ' if 'mg' in order else ''}{head}\n{final}" if head else final


K = "book_id, page, block_seq"

ORACLES: dict[str, str] = {
    "span_decode": query(f"SELECT {_LINE}, span_seq, text, size, bold, italic FROM sp", "sp"),
    "lines_built": query(f"SELECT {_LINE}, text, size, bold, x0, top, x1, bottom FROM ln", "ln"),
    "lines_normalized": query(f"SELECT {_LINE}, running_key FROM sized", "sized"),
    "page_number_lines": query(f"SELECT {_LINE}, text FROM sized WHERE in_margin AND {_page_number('text')}", "sized"),
    "running_lines": query("SELECT * FROM running", "running"),
    "lines_without_running": query(f"SELECT {_LINE}, text FROM kept", "kept"),
    "blocks_recomputed": query(f"SELECT {K}, min(x0) AS x0, min(top) AS y0, max(x1) AS x1, max(bottom) AS y1, count(*) AS n_lines FROM kept GROUP BY ALL", "kept"),
    "column_splits": query("SELECT book_id, page, round(s, 6) AS split FROM splits", "splits"),
    "reading_order": query(f"SELECT {K}, col, read_seq FROM blk", "blk"),
    "images_kept": query(f"SELECT {K}, digest, ext, full_page, x1 - x0 AS w, y1 - y0 AS h FROM im", "im"),
    "scanned_flags": query("SELECT book_id, pages, CAST(text_chars AS BIGINT) AS text_chars, round(per, 4) AS chars_per_page, per < 80 AS scanned FROM tx", "tx"),
    "text_layer_sampling": query("""SELECT book_id, count(*) AS sampled, round(avg(coalesce(n, 0)), 4) AS mean_chars, round(avg(coalesce(n, 0)), 4) >= 100 AS has_text FROM
        (SELECT DISTINCT book_id, CAST(floor(i * (pages - 1) / greatest(1, least(10, pages) - 1)) AS INT) AS page FROM pages, range(10) t(i) WHERE pages > 0 AND i < least(10, pages)) s
        LEFT JOIN (SELECT book_id, page, sum(length(text)) AS n FROM ln GROUP BY ALL) USING (book_id, page) GROUP BY 1""", "pages", "ln"),
    "body_font_size": query("SELECT book_id, body FROM body", "body"),
    "paragraph_split": query(f"SELECT {_LINE}, CAST(para AS BIGINT) AS para FROM brk", "brk"),
    "paragraph_stats": query("SELECT book_id, page, read_seq, para, text, n_lines, size, bold, x0, x1, top, bottom FROM pr", "pr"),
    "toc_pages": query("SELECT * FROM tocp", "tocp"),
    "paragraphs_without_toc": query("SELECT book_id, page, read_seq, para, text FROM pr2", "pr2"),
    "heading_candidates": query("SELECT book_id, page, read_seq, para, text FROM hd WHERE hd", "hd"),
    "heading_levels": query("""SELECT book_id, page, read_seq, para, CASE WHEN chapter THEN 1 ELSE CAST(least(3, 1 + len(list_filter(anchors, lambda a: a > bucket))) AS INT) END AS level
        FROM hd JOIN anch USING (book_id) WHERE hd""", "hd", "anch"),
    "footnotes": query(f"SELECT book_id, page, read_seq, para, text FROM pr2 WHERE {_note()}", "pr2"),
    "all_caps_lines": query(f"SELECT {_LINE}, text FROM ln WHERE {_all_caps('text')}", "ln"),
    "list_items": query(f"SELECT book_id, page, read_seq, para, {_marker('text')} AS marker, {_rest('text')} AS rest FROM pr WHERE {_marker('text')} IS NOT NULL AND length(text) < 1200", "pr"),
    "chapter_lines": query(f"SELECT {_LINE}, text FROM ln WHERE {_has('text', X.CHAPTER)}", "ln"),
    "sanitize_clean": f"SELECT DISTINCT doc_id, {_trim(_clean('text'))} AS text FROM documents",
    "element_counts": query("""SELECT book_id, count(*) AS elements, count(*) FILTER (kind = 'heading') AS headings, count(*) FILTER (kind = 'paragraph') AS paragraphs,
        count(*) FILTER (kind = 'image') AS images, count(*) FILTER (kind = 'note') AS notes FROM el GROUP BY 1""", "el"),
    "toc_outline": query("SELECT book_id, el_seq, greatest(1, least(3, CASE WHEN coalesce(level, 0) = 0 THEN 1 ELSE level END)) AS level, text FROM el WHERE kind = 'heading'", "el"),
    "style_selection": query("""SELECT book_id, el_seq, CASE kind WHEN 'heading' THEN 'Heading ' || lv WHEN 'paragraph' THEN CASE WHEN pk IS NULL OR pk IN ('heading', 'image') THEN 'Body First' ELSE 'Body' END
        WHEN 'list_item' THEN CASE WHEN level = 1 THEN 'List Number' ELSE 'List Bullet' END WHEN 'note' THEN 'Note' ELSE 'Figure' END AS style, kind = 'heading' AND (rn = 1 OR lv = 1) AS page_break FROM
        (SELECT *, lag(kind) OVER w AS pk, row_number() OVER w AS rn, greatest(1, least(3, CASE WHEN coalesce(level, 0) = 0 THEN 1 ELSE level END)) AS lv FROM el
        WHERE kind <> 'image' OR lower(coalesce(image_ext, '')) IN ('png', 'jpeg', 'jpg', 'gif', 'bmp', 'tiff', 'tif') WINDOW w AS (PARTITION BY book_id ORDER BY el_seq))""", "el"),
    "image_widths": query("""SELECT book_id, el_seq, round(CASE WHEN coalesce(image_w, 0) <= 0 THEN 12.0 ELSE least(12.0, image_w / 72 * 2.54) END, 6) AS width_cm,
        coalesce(lower(image_ext) IN ('png', 'jpeg', 'jpg', 'gif', 'bmp', 'tiff', 'tif'), false) AS accepted FROM el WHERE kind = 'image'""", "el"),
    "notes_section": query("SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY el_seq) AS note_no, '[p. ' || (page + 1) || '] ' || text AS text FROM el WHERE kind = 'note'", "el"),
    "continuations": query(rf"""SELECT book_id, el_seq FROM (SELECT *, lag(kind) OVER w AS pk, {_rtrim('lag(text) OVER w')} AS pt, {_trim('text')} AS t FROM el WHERE kind <> 'note'
        WINDOW w AS (PARTITION BY book_id ORDER BY el_seq)) WHERE kind = 'paragraph' AND pk = 'paragraph' AND ((pt <> '' AND t <> '' AND NOT {_has('pt', X.PARAGRAPH_END)} AND NOT {_has('t', r'^[\p{Lu}\p{Nd}]')})
        OR ({_has('pt', '-$')} AND {_has('t', r'^\p{Ll}')}))""", "el"),
    "metadata_titles": f"""SELECT book_id, {_trim(_sanitize("max(metadata['title'])"))} AS title, {_trim(_sanitize("max(metadata['author'])"))} AS author,
        CASE WHEN {_trim(r"replace(regexp_replace(regexp_extract(max(path), '([^/]*)$', 1), '(.)\.[^./]*$', '\1'), '_', ' ')")} = '' THEN 'Documento'
        ELSE {_trim(r"replace(regexp_replace(regexp_extract(max(path), '([^/]*)$', 1), '(.)\.[^./]*$', '\1'), '_', ' ')")} END AS fallback FROM books GROUP BY 1""",
    "safe_names": r"""SELECT DISTINCT job_id, CASE WHEN regexp_replace(regexp_extract(name, '([^/\\]*)$', 1), '[^\p{L}\p{N}_.\- ]', '_', 'g') = '' THEN 'documento.pdf'
        ELSE regexp_replace(regexp_extract(name, '([^/\\]*)$', 1), '[^\p{L}\p{N}_.\- ]', '_', 'g') END AS safe_name FROM convert_jobs WHERE name IS NOT NULL""",
    "job_windows": """SELECT date_trunc('hour', created) AS start, count(*) AS jobs, count(*) FILTER (lower(trim(coalesce(status, ''))) = 'done') AS done,
        count(*) FILTER (lower(trim(coalesce(status, ''))) IN ('error', 'failed')) AS failed FROM (SELECT DISTINCT * FROM convert_jobs) GROUP BY 1""",
    "document_lines": f"""SELECT book_id, count(DISTINCT page) AS pages, count(*) AS lines, max(length(t) * 5 + 40.0) AS widest FROM (SELECT book_id, page, {_trim('unnest(string_split(text, chr(10)))')} AS t FROM
        (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY doc_id) AS page FROM (SELECT doc_id, max(text) AS text, max(source) AS book_id FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY 1)))
        WHERE t <> '' GROUP BY 1""",
    "fold_keys": query(f"SELECT book_id, page, read_seq, para, {_fold('text')} AS fold FROM pr", "pr"),
    "running_titles": query("SELECT book_id, page, read_seq, para, text FROM mt WHERE runs", "mt"),
    "split_headings_merged": query("SELECT book_id, page, read_seq, para, text, CAST(n_lines AS INT) AS n_lines FROM mh", "mh"),
    "classified": query("SELECT book_id, page, read_seq, para, kind, level, marker FROM cl", "cl"),
    "converted_elements": query("SELECT book_id, seq, kind, level, marker, text, page FROM fe", "fe"),
    "converted_runs": query("""SELECT fe.book_id, fe.seq, CAST(row_number() OVER (PARTITION BY book_id, island ORDER BY er.seq, i) - 1 AS INT) AS run_no, t AS text, bold, italic
        FROM fe JOIN er USING (book_id, island)""", "fe", "er"),
    "title_author": query(rf"""SELECT book_id, title, CASE WHEN said <> '' THEN said WHEN len(front) BETWEEN 2 AND 4 THEN
        coalesce(list_filter(front[2:], lambda t: length(t) > 3 AND length(t) <= 60 AND NOT {_has('t', '[.!?]$')} AND t <> title)[1], '') ELSE '' END AS author FROM ti""", "ti"),
    "book_stats": query(f"""SELECT book_id, coalesce(p.pages, 0) AS pages, coalesce(elements, 0) AS elements, coalesce(headings, 0) AS headings, coalesce(paragraphs, 0) AS paragraphs,
        coalesce(images, 0) AS images, coalesce(notes, 0) AS notes, coalesce(body, 10.0) AS body_font_size, coalesce(toc, 0) AS toc_pages_dropped, per < 80 AS scanned,
        coalesce(titles, 0) AS running_titles_dropped, coalesce(covering, 0) AS full_page_images_dropped, 0::BIGINT AS recognised_pages, 0::BIGINT AS failed_pages FROM bk LEFT JOIN pages p USING (book_id)
        LEFT JOIN (SELECT book_id, count(*) AS titles FROM mt WHERE runs GROUP BY 1) USING (book_id)
        LEFT JOIN (SELECT book_id, count(*) AS covering FROM im0 JOIN tx USING (book_id) WHERE full_page AND per >= 200 GROUP BY 1) USING (book_id)
        LEFT JOIN (SELECT book_id, count(*) AS elements, count(*) FILTER (kind = 'heading') AS headings, count(*) FILTER (kind = 'paragraph') AS paragraphs, count(*) FILTER (kind = 'image') AS images FROM fe GROUP BY 1) USING (book_id)
        LEFT JOIN (SELECT book_id, count(*) AS notes FROM ord WHERE kind = 'note' AND length({_trim('text')}) > 2 GROUP BY 1) USING (book_id)
        LEFT JOIN body USING (book_id) LEFT JOIN (SELECT book_id, count(*) AS toc FROM tocp GROUP BY 1) USING (book_id) LEFT JOIN tx USING (book_id)""", "bk", "pages", "fe", "ord", "body", "tocp", "tx", "mt", "im0"),
    "image_digests": query("SELECT book_id, digest, count(*) AS n, count(DISTINCT page) AS n_pages FROM im0 GROUP BY ALL", "im0"),
    "page_coverage": """SELECT book_id, page, round(max(width), 4) AS width, round(max(height), 4) AS height FROM page_info GROUP BY ALL""",
    "recognition_plan": query("""SELECT p.book_id, p.page, CAST(coalesce(n, 0) AS BIGINT) AS chars, NOT coalesce(has_text, false) AND coalesce(n, 0) < 100 AS recognise FROM
        (SELECT book_id, CAST(i AS INT) AS page, pages FROM (SELECT book_id, pages, unnest(range(pages)) AS i FROM pages WHERE pages > 0)) p
        LEFT JOIN (SELECT book_id, page, sum(length(text)) AS n FROM ln GROUP BY ALL) c USING (book_id, page)
        LEFT JOIN (SELECT book_id, avg(coalesce(n, 0)) >= 100 AS has_text FROM
        (SELECT DISTINCT book_id, CAST(floor(i * (pages - 1) / greatest(1, least(10, pages) - 1)) AS INT) AS page FROM pages, range(10) t(i) WHERE pages > 0 AND i < least(10, pages)) s
        LEFT JOIN (SELECT book_id, page, sum(length(text)) AS n FROM ln GROUP BY ALL) USING (book_id, page) GROUP BY 1) h USING (book_id)""", "pages", "ln"),
}
