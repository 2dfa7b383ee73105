"""Reflowable .docx files, one a book, written with zip and XML alone."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators.document import SECTION_TITLES
from leafmill.options import Options

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_CM = 567  # twentieths of a point
_STYLE_ID = {"Body": "Body", "Body First": "BodyFirst", "Note": "Note", "Figure": "Figure", "List Number": "ListNumber", "List Bullet": "ListBullet"}
_HEADING_PT = {1: 20, 2: 15, 3: 13}  # fixed values
_TYPES = {"png": "image/png", "jpeg": "image/jpeg", "jpg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tiff": "image/tiff", "tif": "image/tiff"}


def run(text: str, bold: bool = False, italic: bool = False) -> str:
    if not text:
        return ""
    props = ("<w:b/>" if bold else "") + ("<w:i/>" if italic else "")
    return f'<w:r>{f"<w:rPr>{props}</w:rPr>" if props else ""}<w:t xml:space="preserve">{escape(text)}</w:t></w:r>'


def paragraph(style: str, runs: str, page_break: bool = False, centred: bool = False) -> str:
    props = f'<w:pStyle w:val="{style}"/>' + ("<w:pageBreakBefore/>" if page_break else "") + ('<w:jc w:val="center"/>' if centred else "")
    return f"<w:p><w:pPr>{props}</w:pPr>{runs}</w:p>"


def toc_field() -> str:
    parts = ['<w:fldChar w:fldCharType="begin"/>', '<w:instrText xml:space="preserve"> TOC \\o "1-3" \\h \\z \\u </w:instrText>', '<w:fldChar w:fldCharType="separate"/>', "<w:t>…</w:t>", '<w:fldChar w:fldCharType="end"/>']
    return "<w:r>" + "</w:r><w:r>".join(parts) + "</w:r>"


def styles_xml(o: Options) -> str:
    half = lambda pt: int(round(pt * 2))
    jc = "both" if o.justify else "left"
    font = f'<w:rFonts w:ascii={quoteattr(o.font)} w:hAnsi={quoteattr(o.font)} w:cs={quoteattr(o.font)} w:eastAsia={quoteattr(o.font)}/>'
    lang = f"<w:lang w:val={quoteattr(o.lang)}/>"

    def style(name: str, sid: str, ppr: str = "", rpr: str = "", base: str = "Normal") -> str:
        based = f'<w:basedOn w:val="{base}"/>' if sid != "Normal" else ""
        default = ' w:default="1"' if sid == "Normal" else ""
        return f'<w:style w:type="paragraph"{default} w:styleId="{sid}"><w:name w:val="{name}"/>{based}<w:qFormat/><w:pPr>{ppr}</w:pPr><w:rPr>{rpr}</w:rPr></w:style>'

    indent = lambda cm: f'<w:ind w:firstLine="{int(cm * _CM)}"/>'
    out = [
        style("Normal", "Normal", f'<w:widowControl w:val="1"/><w:suppressAutoHyphens w:val="0"/><w:spacing w:before="0" w:after="0" w:line="{int(240 * o.line_spacing)}" w:lineRule="auto"/><w:jc w:val="{jc}"/>', f'{font}<w:color w:val="000000"/><w:sz w:val="{half(o.body_pt)}"/>{lang}'),
        style("Body", "Body", indent(0.5)),
        style("Body First", "BodyFirst", indent(0), base="Body"),
        style("Note", "Note", '<w:spacing w:after="80"/>' + indent(0) + '<w:jc w:val="left"/>', f'<w:sz w:val="{half(max(8, o.body_pt - 2))}"/>'),
        style("Figure", "Figure", '<w:spacing w:before="200" w:after="200"/>' + indent(0) + '<w:jc w:val="center"/>'),
        style("List Number", "ListNumber", '<w:ind w:left="360" w:hanging="360"/>'),
        style("List Bullet", "ListBullet", '<w:ind w:left="360" w:hanging="360"/>'),
        style("Title", "Title", '<w:jc w:val="center"/>', f'{font}<w:color w:val="000000"/><w:sz w:val="56"/>'),
    ]
    for level, pt in _HEADING_PT.items():
        ppr = f'<w:keepNext/><w:spacing w:before="{360 if level == 1 else 280}" w:after="160"/>{indent(0)}<w:jc w:val="left"/><w:outlineLvl w:val="{level - 1}"/>'
        out.append(style(f"heading {level}", f"Heading{level}", ppr, f'{font}<w:b/><w:i w:val="0"/><w:color w:val="000000"/><w:sz w:val="{half(pt)}"/>{lang}'))
    return f"{_HEAD}<w:styles {_NS}>{''.join(out)}</w:styles>"


def picture(rid: str, number: int, width_cm: float, ratio: float) -> str:
    cx = int(width_cm * 360000)
    cy = int(cx * ratio)
    return (
        '<w:r><w:drawing><wp:inline xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing">'
        f'<wp:extent cx="{cx}" cy="{cy}"/><wp:docPr id="{number}" name="figure{number}"/><a:graphic xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main">'
        '<a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/picture"><pic:pic xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture">'
        f'<pic:nvPicPr><pic:cNvPr id="{number}" name="figure{number}"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="{rid}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill>'
        f'<pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{cx}" cy="{cy}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r>'
    )


def render(title: str, author: str, elements: list[dict], notes: list[dict], o: Options) -> bytes:
    """One document; ``elements`` in order with style, page_break, runs and, of
    images, bytes, ext and width; ``notes`` with runs and page."""
    body, media, number = [], [], 0
    title = title or "Documento"
    if o.title_page:
        body.append(paragraph("Title", run(title)))
        if author:
            body.append(paragraph("Normal", run(author, italic=True), centred=True))
    if o.toc:
        body.append(paragraph("Heading1", run(SECTION_TITLES["toc"]), page_break=True))
        body.append(paragraph("Normal", toc_field()))
    for e in elements:
        if e["kind"] == "image":
            if not e.get("image"):
                continue
            number += 1
            ext = (e["ext"] or "png").lower()
            media.append((f"image{number}.{ext}", bytes(e["image"])))
            ratio = (e["image_h"] or 1.0) / (e["image_w"] or 1.0)
            body.append(paragraph("Figure", picture(f"rIdImg{number}", number, e["width_cm"], ratio)))
            continue
        runs = "".join(run(r["text"], r["bold"], r["italic"]) for r in e["runs"])
        if runs:
            sid = _STYLE_ID.get(e["style"], e["style"].replace(" ", ""))
            body.append(paragraph(sid, runs, bool(e["page_break"])))
    if notes:
        body.append(paragraph("Heading1", run(SECTION_TITLES["notes"]), page_break=True))
        for n in notes:
            runs = "".join(run(r["text"], r["bold"], r["italic"]) for r in n["runs"])
            body.append(paragraph("Note", run(f"[p. {n['page'] + 1}] ", bold=True) + runs))
    sect = f'<w:sectPr><w:pgSz w:w="{15 * _CM}" w:h="{21 * _CM}"/><w:pgMar w:top="{int(1.5 * _CM)}" w:right="{int(1.5 * _CM)}" w:bottom="{int(1.5 * _CM)}" w:left="{int(1.5 * _CM)}"/></w:sectPr>'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rels = [f'<Relationship Id="rId1" Type="{rel}/styles" Target="styles.xml"/>', f'<Relationship Id="rId2" Type="{rel}/settings" Target="settings.xml"/>']
    rels += [f'<Relationship Id="rIdImg{k}" Type="{rel}/image" Target="media/{name}"/>' for k, (name, _) in enumerate(media, 1)]
    pkg = "http://schemas.openxmlformats.org/package/2006"
    defaults = {"rels": f"{pkg.replace('http://schemas.openxmlformats.org/package/2006', 'application/vnd.openxmlformats-package')}.relationships+xml", "xml": "application/xml"}
    defaults |= {name.rsplit(".", 1)[1]: _TYPES[name.rsplit(".", 1)[1]] for name, _ in media}
    word = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    types = "".join(f'<Default Extension="{k}" ContentType="{v}"/>' for k, v in defaults.items())
    types += f'<Override PartName="/word/document.xml" ContentType="{word}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{word}.styles+xml"/>'
    types += f'<Override PartName="/word/settings.xml" ContentType="{word}.settings+xml"/><Override PartName="/docProps/core.xml" ContentType="application/vnd.openxmlformats-package.core-properties+xml"/>'
    by = f"<dc:creator>{escape(author)}</dc:creator>" if author else ""
    core = f'<cp:coreProperties xmlns:cp="{pkg}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title>{by}<dc:language>{escape(o.lang)}</dc:language></cp:coreProperties>'
    files = {
        "[Content_Types].xml": f'<Types xmlns="{pkg}/content-types">{types}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="word/document.xml"/><Relationship Id="rId2" Type="{pkg}/relationships/metadata/core-properties" Target="docProps/core.xml"/></Relationships>',
        "docProps/core.xml": core,
        "word/settings.xml": f'<w:settings {_NS}><w:updateFields w:val="true"/></w:settings>',
        "word/_rels/document.xml.rels": f'<Relationships xmlns="{pkg}/relationships">{"".join(rels)}</Relationships>',
        "word/document.xml": f"<w:document {_NS}><w:body>{''.join(body)}{sect}</w:body></w:document>",
    }
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in files.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), _HEAD + xml)
        z.writestr(zipfile.ZipInfo("word/styles.xml", (1980, 1, 1, 0, 0, 0)), styles_xml(o))
        for name, data in media:
            z.writestr(zipfile.ZipInfo(f"word/media/{name}", (1980, 1, 1, 0, 0, 0)), data)
    return buffer.getvalue()


def documents(styled: DataFrame, notes: DataFrame, titles: DataFrame, images: DataFrame | None = None, options: Options | None = None) -> DataFrame:
    """``book_id, file_name, docx``: one finished file a book.

    A file holds its whole book, so a book is the unit of work here; images are
    joined by digest only now.  ``images`` has ``digest, image``.
    """
    from leafmill.operators.document import image_width_cm

    o = options or Options()
    e = styled.withColumn("width_cm", image_width_cm(F.col("image_w")))
    if images is not None:
        e = e.join(images.groupBy("digest").agg(F.first("image").alias("image")), "digest", "left")
    else:
        e = e.withColumn("image", F.lit(None).cast("binary"))
    item = F.struct("seq", "kind", "style", "page_break", "runs", "image", "ext", "image_w", "image_h", "width_cm")
    els = e.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct(F.col("seq").alias("at"), item.alias("e"))).cast(_element_type())).alias("els"))
    ns = notes.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("seq", "runs", "page"))).alias("notes"))
    j = titles.join(els, "book_id", "left").join(ns, "book_id", "left")

    def write(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                els_ = [x["e"] for x in (r["els"] if r["els"] is not None else [])]
                notes_ = list(r["notes"]) if r["notes"] is not None else []
                out.append((r["book_id"], f"{r['book_id']}.docx", render(r["title"], r["author"], els_, notes_, o)))
            yield pd.DataFrame(out, columns=["book_id", "file_name", "docx"])

    return j.mapInPandas(write, "book_id string, file_name string, docx binary")


def _element_type() -> str:
    run_type = "array<struct<text:string,bold:boolean,italic:boolean>>"
    e = f"struct<seq:int,kind:string,style:string,page_break:boolean,runs:{run_type},image:binary,ext:string,image_w:double,image_h:double,width_cm:double>"
    return f"array<struct<at:int,e:{e}>>"


def save(files: DataFrame, folder: str) -> None:
    """Write each document as its own file into a shared folder."""

    def put(rows):
        import os

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            tmp = os.path.join(folder, f".{r['file_name']}.part")
            with open(tmp, "wb") as f:
                f.write(r["docx"])
            os.replace(tmp, os.path.join(folder, r["file_name"]))

    files.foreachPartition(put)


__all__ = ["documents", "render", "save"]
