"""Parts of word-processor files."""

import io
import zipfile

from spindrift.sources import files as S

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
KIND = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def paragraph(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def word_file():
    cell = lambda *texts: f"<w:tc>{''.join(map(paragraph, texts))}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('a')}{cell('b', 'c')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    first = '<w:sectPr><w:headerReference w:type="default" r:id="h1"/><w:headerReference w:type="first" r:id="h2"/><w:footerReference w:type="default" r:id="f1"/></w:sectPr>'
    document = f"<w:document {W}><w:body>{paragraph('Text')}{table}<w:p><w:pPr>{first}</w:pPr></w:p>{paragraph('More')}<w:sectPr/></w:body></w:document>"
    rel = lambda i, kind, target, more="": f'<Relationship Id="{i}" Type="{KIND}/{kind}" Target="{target}" {more}/>'
    rels = "<Relationships>" + rel("h1", "header", "header1.xml") + rel("h2", "header", "header2.xml") + rel("f1", "footer", "footer1.xml") + rel("i1", "image", "media/one.png") + rel("i2", "image", "http://x/y.png", 'TargetMode="External"') + "</Relationships>"
    core = '<c:coreProperties xmlns:c="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:d="http://purl.org/dc/elements/1.1/" xmlns:t="http://purl.org/dc/terms/"><d:title>A title</d:title><d:creator>Someone</d:creator><c:revision>3</c:revision><t:created>2024-01-02T03:04:05Z</t:created></c:coreProperties>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in {"word/document.xml": document, "word/_rels/document.xml.rels": rels, "docProps/core.xml": core, "word/header1.xml": f"<w:hdr {W}>{paragraph('Head')}</w:hdr>", "word/header2.xml": f"<w:hdr {W}>{paragraph('Other')}</w:hdr>", "word/footer1.xml": f"<w:ftr {W}>{paragraph('Foot')}</w:ftr>", "word/media/one.png": "data"}.items():
            z.writestr(name, text)
    return out.getvalue()


def test_parts(spark):
    bare = io.BytesIO()
    with zipfile.ZipFile(bare, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}/>")
    files = spark.createDataFrame([("a.docx", bytearray(word_file())), ("b.docx", bytearray(b"no zip")), ("c.docx", bytearray(bare.getvalue()))], "path string, content binary")
    rows = {r["path"]: r for r in S.word_parts(files).collect()}
    a, b, c = rows["a.docx"], rows["b.docx"], rows["c.docx"]
    assert (a["title"], a["author"], a["created"], a["modified"], a["revision"], a["error"]) == ("A title", "Someone", "2024-01-02T03:04:05Z", None, "3", None)
    assert a["tables"] == [[["a", "b\nc"], ["1", "2"]]] and [(i["name"], bytes(i["data"])) for i in a["images"]] == [("one.png", b"data")]
    assert a["headers"] == ["Head", "Head"] and a["footers"] == ["Foot", "Foot"]
    assert b["error"].startswith("BadZipFile") and b["tables"] is None and c["tables"] == c["images"] == c["headers"] == [] and c["error"] is None
    less = S.word_parts(files, tables=False, images=False, headers=False).filter("path = 'a.docx'").first()
    assert less["tables"] is None and less["images"] is None and less["headers"] is None and less["title"] == "A title"
    assert S.word_parts(files.limit(0)).count() == 0
