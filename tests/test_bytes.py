import gzip
import io
import json
import tarfile
import zipfile

from pyspark.sql import functions as F

from sheafline.operators import archives as A
from sheafline.operators import classify as C
from sheafline.operators import extract as X


def zipped(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, c in files.items():
            z.writestr(n, c)
    return b.getvalue()


def tarred(files):
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode="w") as t:
        for n, c in files.items():
            i = tarfile.TarInfo(n)
            i.size = len(c)
            t.addfile(i, io.BytesIO(c))
    return b.getvalue()


def test_encodings():
    assert C.decode("héé".encode("utf-16")) == "héé"
    assert C.decode("plain text, long enough".encode("utf-16-le")) == "plain text, long enough"
    assert C.decode("plain text, long enough".encode("utf-16-be")) == "plain text, long enough"
    assert C.decode(b"\xef\xbb\xbfab\xff") == "ab�"
    assert C.decode(b"") == "" and C.decode(None) is None


def test_routes(spark):
    docx = zipped({"[Content_Types].xml": "x", "word/document.xml": "<x/>"})
    rows = [
        ("png", b"\x89PNG\r\n\x1a\n" + b"text" * 9, "binary", "png"), ("riff", b"RIFF1234WEBPVP8", "binary", "webp"), ("word", b"RIFFs are a musical figure", "unknown", None), ("pdf", b"%PDF-1.7", "extract", "pdf"),
        ("docx", docx, "extract", "docx"), ("zip", zipped({"a": "b"}), "expand", None), ("tar", tarred({"a": b"b"}), "expand", None), ("gz", gzip.compress(b"x"), "expand", None), ("vtt", b"WEBVTT\n\n", "extract", "vtt"),
        ("srt", b"1\n00:00:01,000 --> 00:00:02,000\nhi", "extract", "srt"), ("nb", b'{"cells": [], "nbformat": 4}', "extract", "ipynb"), ("eml", b"From: a@b.c\nMIME-Version: 1.0\n\nhi", "extract", "eml"),
        ("config", b"From: a\nto: b\n\nx", "unknown", None), ("text", b"just words", "unknown", None), ("empty", b"", "unknown", None),
    ]
    df = spark.createDataFrame([(n, bytearray(b), k, f) for n, b, k, f in rows], "name string, head binary, kind string, format string")
    for r in C.routed(df).collect():
        assert (r.route.kind, r.route.format) == (r.kind, r.format), r.name


def test_classes(spark):
    rows = [("clean", "a\tb\n" * 9, "text"), ("few", "a" * 90 + "\x01" * 10, "ambiguous"), ("many", "a" * 50 + "\x00" * 50, "binary"), ("vt", "\x0b" * 4 + "a" * 6, "binary"), ("ff", "\x0c" * 9, "text"), ("empty", "", "text")]
    df = spark.createDataFrame([(n, bytearray(t.encode()), bytearray(t.encode()[:8192]), e) for n, t, e in rows], "name string, content binary, head binary, expected string")
    for r in C.classified(df).collect():
        assert r.classification == r.expected, r.name


def test_archives(spark):
    rows = [
        (1, "p/a.zip", bytearray(zipped({"./x/y.txt": "1", "__MACOSX/z": "2", ".DS_Store": "3", "d/": ""})), "zip"), (2, "b.tar.gz", bytearray(gzip.compress(tarred({"q": b"4", "empty": b""}))), "gz"),
        (3, "c.gz", bytearray(gzip.compress(b"5")), "gz"), (4, "bad.zip", bytearray(b"PK\x03\x04junk"), "zip"), (5, "x.rar", bytearray(b"Rar!"), "rar"), (6, None, None, "zip"),
    ]
    got = {(r.ord, r.path): (bytes(r.content) if r.content is not None else None, r.depth) for r in A.expanded(spark.createDataFrame(rows, "ord long, path string, content binary, archive string")).collect()}
    assert got[1, "p/a/x/y.txt"] == (b"1", 1) and got[2, "b/q"] == (b"4", 1) and got[3, "c"] == (b"5", 1)
    assert got[4, "bad.zip"][1] == 0 and got[5, "x.rar"][1] == 0 and got[6, None] == (None, 0) and len(got) == 6


def test_notebook_captions_mail():
    nb = {"metadata": {"kernelspec": {"name": "python3"}}, "cells": [{"cell_type": "markdown", "source": ["# A\n", "b"], "attachments": {"i": {}}}, {"cell_type": "code", "source": "x", "outputs": [{"output_type": "stream", "text": "1\n"}, {"output_type": "display_data", "data": {"image/png": "z"}}, {"output_type": "error", "ename": "E", "evalue": "v", "traceback": ["\x1b[31mt"]}]}]}
    text, notes = X.notebook(json.dumps(nb).encode())
    assert text == "# A\nb\n\n```python\nx\n```\n\nOutput:\n```\n1\nE: v\nt\n```" and notes == [("attachments-skipped", 2, None)]
    assert X.notebook(b"no") == ("", []) and X.notebook(b"{}") == ("", [])
    vtt = b"WEBVTT\n\nNOTE x\n\nintro\n00:01.000 --> 00:02.000\n<v.loud Ann>Hi &amp; <b>bye</b>\n\n00:03.000 --> 00:04.000\n42\n\n00:05.000 --> 00:06.000\n42\n"
    assert X.subtitles(vtt)[0] == "Ann: Hi & bye\n42" and X.subtitles(b"WEBVTT\n\n00:01.000 --> 00:02.000\n")[0] == ""
    eml = b"From: Ann <a@x.test>\nTo: b@x.test\nSubject: S\nMIME-Version: 1.0\nContent-Type: text/html\n\n<p>one</p><script>x</script><p>two&nbsp;3</p>"
    assert X.message(eml)[0] == "From: Ann <a@x.test>\nTo: b@x.test\nSubject: S\n\none\n\ntwo 3"


def test_office(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    styles = f'<w:styles {w}><w:style w:styleId="H"><w:name w:val="heading 2"/></w:style></w:styles>'
    b = zipped({"[Content_Types].xml": "", "word/document.xml": doc, "word/styles.xml": styles})
    assert X.office(b) == ("## Top\n\nBody\n\n| c |  |", [])
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    x = zipped({"[Content_Types].xml": "", "xl/workbook.xml": f'<workbook {s}><sheets><sheet name="T"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst {s}><si><t>a,b</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row></sheetData></worksheet>'})
    assert X.office(x)[0] == '# T\n"a,b",,3'
    odt = zipped({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": '<o xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><text:h text:outline-level="1">H</text:h><text:p>a<text:s text:c="2"/>b</text:p></o>'})
    assert X.office(odt)[0] == "# H\n\na  b"
    assert X.office(rb"{\rtf1{\fonttbl x}A\par \'e9\u233?{\b c}}")[0] == "A\nééc"
    assert X.office(b"%PDF-1")[1] == [("parser-unavailable", None, None)] and X.office(b"PK\x03\x04bad")[1][0][0] == "extract-failed"
    df = spark.createDataFrame([("office", bytearray(b)), ("epub", bytearray(b"x")), (None, None)], "parser_id string, content binary")
    got = [(r.extraction.text[:6], [n.kind for n in r.extraction.notes]) for r in X.extracted(df).collect()]
    assert got == [("## Top", []), ("", ["parser-unavailable"]), ("", ["parser-unavailable"])]


def test_page_lines(spark):
    pages = "\n".join(f"# Page {k}\nHEAD\nbody {k}\nbad\x01line longer than body\n- {k} -" for k in range(1, 5))
    df = spark.createDataFrame([(1, pages)], "id long, t string")
    cut_ = {r.pos for r in X.running_furniture(df, "id", "t").collect()}
    lines = pages.split("\n")
    assert {lines[p] for p in cut_} == {"HEAD", "- 1 -", "- 2 -", "- 3 -", "- 4 -"} and sum(lines[p] == "HEAD" for p in cut_) == 3
    r = X.undecodable(df, "id", "t").first()
    assert r.lost == 4 and r.pages == [1, 2, 3, 4] and "\x01" not in r.text
    new = X.replaced_pages(df, "id", "t", spark.createDataFrame([(1, 2, "NEW")], "id long, page int, new_text string")).first().text
    assert "# Page 2\n\nNEW\n" in new and "body 2" not in new and "body 3" in new
    f = spark.createDataFrame([(1, "a [Image: x] b [Image: y]"), (2, "[Image: x]")], "file_id long, content string")
    i = spark.createDataFrame([(1, 1, "x", " read "), (2, 1, "y", None)], "image_id long, file_id long, name string, ocr_text string")
    assert {r.file_id: r.text for r in X.filled_placeholders(f, i).collect()} == {1: "a read b ", 2: ""}


def test_json_values():
    assert list(X.iter_json_values({"a": [{"k": 1}, {"b": {"k": 2}}], "k": 3}, "k")) == [1, 2, 3]
    assert F is not None
