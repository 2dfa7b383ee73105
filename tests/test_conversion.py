import io
import zipfile

import pytest

from leafmill.operators import layout as L
from leafmill.options import Options
from leafmill.plans.pipeline import Conversion
from leafmill.sinks import docx
from tests.sample import SPAN_TYPES, Book, frames, sample

PNG = b"\x89PNG\r\n\x1a\n" + b"0" * 30


@pytest.fixture(scope="module")
def done(spark):
    book = sample()
    figure = book.block[5] + 1
    images = [("sample", 5, figure, 40.0, 320.0, 280.0, 410.0, PNG, "png"), ("sample", 5, figure + 1, 40.0, 320.0, 60.0, 330.0, PNG, "png")]
    return Conversion(frames(spark, book, images))


def texts(done, kind):
    return [r["text"] for r in done.elements.where(f"kind = '{kind}'").orderBy("seq").collect()]


def test_running_lines_and_numbers_are_gone(done):
    everything = " ".join(r["text"] for r in done.lines.select("text").collect())
    assert "Example Press" not in everything
    assert "- 3 -" not in everything
    assert [r["running_key"] for r in done.running.orderBy("running_key").collect()] == ["- # -", "an example press"]


def test_columns_read_left_first(done):
    lines = [r["text"] for r in done.lines.where("page = 4 and text like '%column text%'").orderBy("read_seq", "line_seq").collect()]
    assert lines == [f"Left column text {n}." for n in range(4)] + [f"Right column text {n}." for n in range(4)]


def test_headings_and_levels(done):
    got = [(r["text"], r["level"]) for r in done.elements.where("kind = 'heading' and page > 0").orderBy("seq").collect()]
    assert got == [("Chapter 1 - Departure", 1), ("1.1 The harbour", 2), ("Chapter 2 - Columns", 1), ("Chapter 3 - The end", 1)]


def test_paragraph_over_pages_and_hyphen(done):
    paras = texts(done, "paragraph")
    assert any(p.endswith("the whole crew was still asleep when the storm came.") for p in paras)
    assert any("invariably fine print." in p for p in paras)


def test_list_notes_and_figure(done):
    assert texts(done, "list_item") == [f"item number {n}" for n in range(3)]
    assert [r["text"] for r in done.notes.collect()] == ["1 A note at the foot."]
    assert done.elements.where("kind = 'image'").count() == 1


def test_contents_page_and_running_titles_are_dropped(done):
    assert done.stats.first()["toc_pages_dropped"] == 1
    assert "Contents" not in texts(done, "heading")
    assert done.elements.where("text = 'Chapter 1 - Departure'").count() == 1


def test_runs_keep_their_style(done):
    r = done.elements.where("text like 'A plain start%'").first()["runs"]
    assert [(x["text"], x["bold"]) for x in r] == [("A plain start and a ", False), ("bold end", True), (".", False)]


def test_title_and_author(done):
    r = done.titles.first()
    assert (r["title"], r["author"]) == ("The Salt Road", "Ada Ferryman")


def test_metadata_wins_unless_it_says_nothing(spark):
    c = Conversion(frames(spark, sample(), metadata={"title": "Told Title", "author": " A. U. Thor "}))
    assert tuple(c.titles.first())[1:] == ("Told Title", "A. U. Thor")
    c = Conversion(frames(spark, sample(), metadata={"title": "scan.pdf"}))
    assert c.titles.first()["title"] == "The Salt Road"
    assert Conversion(frames(spark, sample()), Options(title="Mine")).titles.first()["title"] == "Mine"


@pytest.mark.parametrize(("policy", "inline", "end"), [("end", 0, 1), ("inline", 1, 0), ("drop", 0, 0)])
def test_note_policies(spark, policy, inline, end):
    c = Conversion(frames(spark, sample()), Options(footnotes=policy))
    assert c.elements.where("kind = 'note'").count() == inline
    assert c.notes.count() == end


def test_rendered_file(done):
    pictures = done.inputs.images.selectExpr("sha1(image) as digest", "image")
    data = docx.documents(done.styled(), done.notes, done.titles, pictures).first()["docx"]
    z = zipfile.ZipFile(io.BytesIO(bytes(data)))
    xml = z.read("word/document.xml").decode()
    assert 'w:val="Heading1"' in xml and "TOC \\o" in xml and "[p. 6] " in xml
    assert "\t" not in xml and "<w:br" not in xml and "<w:tbl" not in xml
    assert xml.index("Notas") > xml.index("item number 2")
    assert xml.count("The Salt Road") == 1  # the title page's; the front page repeats it not
    assert any(n.startswith("word/media/") for n in z.namelist())
    assert "<dc:title>The Salt Road</dc:title>" in z.read("docProps/core.xml").decode()
    assert "updateFields" in z.read("word/settings.xml").decode()


def test_notes_keep_their_runs(spark):
    k = sample()
    k.add(5, [[("2 A note with ", 0), ("bold words", 16), (" in it.", 2)]], top=500, size=7)
    c = Conversion(frames(spark, k))
    data = docx.documents(c.styled(), c.notes, c.titles).first()["docx"]
    xml = zipfile.ZipFile(io.BytesIO(bytes(data))).read("word/document.xml").decode()
    assert '<w:rPr><w:b/></w:rPr><w:t xml:space="preserve">bold words</w:t>' in xml and '<w:rPr><w:i/></w:rPr><w:t xml:space="preserve"> in it.</w:t>' in xml


def test_body_size_weighs_spans_not_lines(spark):
    k = Book("m")
    for n in range(3):
        k.add(0, [[("small words of the body text", 0), ("BIG", 0)]], top=100 + 30 * n)
    rows = [(*r[:6], 10.0 if "small" in r[5] else 30.0, *r[7:]) for r in k.rows]
    k.rows = rows
    assert Conversion(frames(spark, k, pages=1)).body.first()["body"] == 10.0


def test_figures_by_old_paragraph_numbers(spark):
    k = Book("f")
    for n in range(6):
        k.add(0, [f"Part {n} . . . . . . . {n + 3}"], top=100 + 22 * n)
    k.add(1, ["The first paragraph of the text."], top=100)
    k.add(1, ["The second paragraph of the text."], top=160)
    image = [("f", 1, 0, 40.0, 60.0, 240.0, 90.0, PNG, "png"), ("f", 1, 9, 40.0, 130.0, 280.0, 155.0, PNG + b"2", "png")]
    image = [(*i[:4], i[4], i[5], i[4] + 60, *i[7:]) for i in image]
    kinds = lambda o: [r["kind"] for r in Conversion(frames(spark, k, image, pages=2), o).elements.orderBy("seq").collect()]
    assert kinds(Options()) != kinds(Options(compat_image_anchor=True))
    assert kinds(Options(compat_image_anchor=True))[-1] == "image"


def test_options_change_the_file(done):
    plain = Options(toc=False, title_page=False, justify=False, font="Arial", body_pt=14)
    data = docx.documents(done.styled(), done.notes, done.titles, None, plain).first()["docx"]
    z = zipfile.ZipFile(io.BytesIO(bytes(data)))
    assert "TOC" not in z.read("word/document.xml").decode()
    styles = z.read("word/styles.xml").decode()
    assert 'w:ascii="Arial"' in styles and '<w:sz w:val="28"/>' in styles and '<w:jc w:val="left"/>' in styles


def test_options_are_checked():
    with pytest.raises(ValueError, match="footnotes"):
        Options(footnotes="no")


def scan(spark, with_text):
    k = Book("scan")
    for p in range(3):
        if with_text:
            k.add(p, ["many words of text " * 15])
    k.add(0, ["x"], top=300)
    images = [("scan", p, 50, 0.0, 0.0, 420.0, 595.0, bytes([p]) * 9, "png") for p in range(3)]
    return Conversion(frames(spark, k, images, pages=3))


def test_page_bitmaps_go_only_where_there_is_text(spark):
    assert scan(spark, True).images.count() == 0
    assert scan(spark, False).images.count() == 3


def test_scanned_flag(spark):
    assert scan(spark, False).text.first()["scanned"]


def test_repeated_image_is_dropped_from_four_pages(spark):
    for pages, left in ((3, 3), (6, 0)):
        images = [("sample", p, 90, 40.0, 300.0, 140.0, 400.0, b"logo", "png") for p in range(pages)]
        assert Conversion(frames(spark, sample(), images, pages=pages)).images.count() == left


def heads(spark, *pieces):
    k = Book("h")
    k.add(0, ["Body text of some length that tells the size of the body. " * 2], top=400)
    for text, x0, top, size, width in pieces:
        k.add(0, [text], x0=x0, top=top, size=size, flags=16, width=width)
    c = Conversion(frames(spark, k, pages=1))
    return [r["text"] for r in c.elements.where("kind = 'heading'").orderBy("seq").collect()]


def test_split_headings(spark):
    assert heads(spark, ("Chapter 2 -", 40.0, 58.0, 17.0, 110.0), ("The columns", 40.0, 84.0, 17.0, 110.0)) == ["Chapter 2 - The columns"]
    assert heads(spark, ("Chapter 2 -", 40.0, 80.0, 17.0, 110.0), ("The columns", 155.0, 80.0, 17.0, 120.0)) == ["Chapter 2 - The columns"]
    assert heads(spark, ("A large one", 40.0, 58.0, 22.0, 110.0), ("A small one", 40.0, 90.0, 14.0, 110.0)) == ["A large one", "A small one"]


def test_vertical_blank_and_null_spans(spark):
    k = Book("v")
    k.add(0, ["upright text"])
    k.add(0, ["sideways"], dir_x=0.0)
    k.add(0, ["   "])
    rows = [*k.rows, *k.rows]  # every row repeated
    lines = L.lines_of(spark.createDataFrame(rows, SPAN_TYPES))
    assert [(r["text"], len(r["spans"])) for r in lines.collect()] == [("upright text", 1)]


def test_empty_book(spark):
    c = Conversion(frames(spark, sample(), pages=6))
    empty = c.inputs.spans.limit(0)
    c = Conversion(type(c.inputs)(empty, c.inputs.images, c.inputs.page_info, c.inputs.books))
    r = c.stats.first()
    assert (r["elements"], r["paragraphs"], r["pages"]) == (0, 0, 6)
