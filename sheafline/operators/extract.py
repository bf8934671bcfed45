"""Documents to text: notebooks, captions, mail, office files; and the line work on extracted pages."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from email import policy
from email.parser import BytesParser
from email.utils import getaddresses
from itertools import groupby
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .classify import decode

Result = tuple[str, list[tuple[str, int | None, list[int] | None]]]

# -- notebooks (E2) ---------------------------------------------------------------------------


def _source(x: object) -> str:
    return x if isinstance(x, str) else "".join(map(str, x)) if isinstance(x, list) else ""


_ANSI = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")


def _output(o: dict) -> str | None:
    kind = o.get("output_type")
    if kind == "stream":
        text = _source(o.get("text"))
    elif kind == "error":
        head = ": ".join(str(o[k]) for k in ("ename", "evalue") if o.get(k))
        text = "\n".join(x for x in (head, "\n".join(_ANSI.sub("", str(t)) for t in o.get("traceback") or [])) if x.strip())
    elif kind in ("execute_result", "display_data"):
        text = _source((o.get("data") or {}).get("text/plain"))
    else:
        return None
    return text.rstrip() if text.strip() else None


def notebook(b: bytes) -> Result:
    """Cells as Markdown; what text can't carry is counted."""
    try:
        nb = json.loads(decode(b) or "")
        cells = nb["cells"]
        assert isinstance(cells, list)
    except (ValueError, KeyError, TypeError, AssertionError):
        return "", []
    meta = nb.get("metadata") or {}
    kernel = meta.get("kernelspec") or {}
    lang = (meta.get("language_info") or {}).get("name") or kernel.get("language") or re.sub(r"\d+$", "", kernel.get("name") or "")
    parts, dropped = [], 0
    for cell in cells:
        body = _source(cell.get("source")).rstrip()
        dropped += len(cell.get("attachments") or {})
        if cell.get("cell_type") != "code":
            parts += [body] * bool(body)
            continue
        parts += [f"```{lang}\n{body}\n```"] * bool(body)
        texts = [_output(o) for o in cell.get("outputs") or []]
        dropped += texts.count(None)
        if kept := [t for t in texts if t is not None]:
            parts.append("Output:\n```\n" + "\n".join(kept) + "\n```")
    return "\n\n".join(parts).strip(), [("attachments-skipped", dropped, None)] if dropped else []


# -- captions (E3) ----------------------------------------------------------------------------

# fixed values: markup of captions, and the references they define
_VOICE = re.compile(r"<v(?:\.[^\s>]+)*\s+([^>]+)>")
_MARKUP = re.compile(r"<[^>]*>|\{\\[^}]*\}")
_CAPTION_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "nbsp": " ", "lrm": "", "rlm": ""}


def caption_line(line: str) -> str:
    line = _MARKUP.sub("", _VOICE.sub(r"\1: ", line))
    line = re.sub(r"&(amp|lt|gt|nbsp|lrm|rlm);", lambda m: _CAPTION_ENTITIES[m[1]], line)
    return re.sub(r"\s+", " ", line).strip()


# fixed values: first words of caption blocks without speech
_METADATA = re.compile(r"\s*(?:WEBVTT|NOTE|STYLE|REGION)\b")
#: A timing line and the identifier that may stand directly above it.
_SCAFFOLD = re.compile(r"^(?:[^\n]*\S[^\n]*\n)?[^\n]*-->[^\n]*$", re.M)


def subtitles(b: bytes) -> Result:
    """Spoken lines; cue scaffolding, metadata blocks and repeats of the line before are dropped."""
    blocks = re.split(r"\n{2,}", re.sub(r"\r\n?", "\n", decode(b) or ""))
    cues = "\n\n".join(x for x in blocks if not _METADATA.match(x))
    lines = (caption_line(x) for x in _SCAFFOLD.sub("", cues).split("\n"))
    return "\n".join(line for line, _ in groupby(x for x in lines if x)), []


# -- mail (E4, E5) ----------------------------------------------------------------------------

# fixed values: tags that end a line of HTML mail, and the entities it is decoded with
_BLOCK = re.compile(r"</?(?:p|div|br|tr|li|h[1-6]|blockquote|table)\b[^>]*>", re.I)
_NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " "}


def html_to_text(markup: str) -> str:
    t = re.sub(r"<(script|style)\b[^>]*>.*?</\1>", "", markup, flags=re.S | re.I)
    t = re.sub(r"<[^>]+>", "", _BLOCK.sub("\n", t))
    t = re.sub(r"&#(\d+);", lambda m: chr(int(m[1])) if int(m[1]) < 0x110000 else "�", t)
    t = re.sub(r"&[a-z#0-9]+;", lambda m: _NAMED.get(m[0].lower(), m[0]), t, flags=re.I)
    t = re.sub(r" ?\n ?", "\n", re.sub(r"[ \t]+", " ", t))
    return re.sub(r"\n{3,}", "\n\n", t).strip()


def _addresses(values: list[str]) -> str:
    return ", ".join(f"{n} <{a}>" if n else a for n, a in getaddresses(values) if n or a)


def message(b: bytes) -> Result:
    """Present headers, the plain body or the flattened HTML, and the names of attachments."""
    try:
        m = BytesParser(policy=policy.default).parsebytes(b)
    except (ValueError, TypeError, IndexError):
        return "", []
    head = [f"{k}: {_addresses([str(x) for x in m.get_all(k)])}" for k in ("From", "To", "Cc") if m.get_all(k)]
    head += [f"{k}: {m[k]}" for k in ("Date", "Subject") if m[k]]
    part = m.get_body(("plain",))
    body = part.get_content().strip() if part else ""
    if not body and (part := m.get_body(("html",))):
        body = html_to_text(part.get_content())
    names = [a.get_filename() or "unnamed" for a in m.iter_attachments()]
    if not body and not head:
        return "", []
    out = ["\n".join(head)] * bool(head) + [body] * bool(body)
    if names:
        out.append("Attachments: " + ", ".join(names))
    return "\n\n".join(out).strip(), [("attachments-skipped", len(names), None)] if names else []


# -- office files (E6-E12, E14) ---------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_T = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
_TB = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_X = "{http://www.w3.org/1999/xlink}"


def _links(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, _, name = part.rpartition("/")
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.namelist():
        return {}
    return {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read(rels)) if r.get("TargetMode") == "External"}


def _word_runs(p: ET.Element, links: dict[str, str], notes: list[str]) -> str:
    out = ""
    for e in p:
        if e.tag == _W + "hyperlink":
            shown = _word_runs(e, links, notes)
            url = links.get(e.get(_R + "id") or "")
            out += shown + (f" ({url})" if url and url not in shown else "")
        elif e.tag in (_W + "r", _W + "ins", _W + "smartTag", _W + "sdt", _W + "sdtContent"):
            out += _word_runs(e, links, notes)
        elif e.tag == _W + "t":
            out += e.text or ""
        elif e.tag == _W + "tab":
            out += "\t"
        elif e.tag in (_W + "br", _W + "cr"):
            out += "\n"
        elif e.tag == _W + "footnoteReference":
            notes.append(e.get(_W + "id"))
            out += f"[^{len(notes)}]"
    return out


def _word_blocks(body: ET.Element, links: dict[str, str], levels: dict[str, int], notes: list[str]) -> list[str]:
    out = []
    for e in body:
        if e.tag == _W + "p":
            text = _word_runs(e, links, notes).strip()
            style = e.find(f"{_W}pPr/{_W}pStyle")
            level = levels.get(style.get(_W + "val")) if style is not None else None
            if text:
                out.append(f"{'#' * level} {text}" if level else text)
        elif e.tag == _W + "tbl":
            rows = []
            for r in e.iter(_W + "tr"):
                cells = []
                for c in r.findall(_W + "tc"):
                    span = c.find(f"{_W}tcPr/{_W}gridSpan")
                    cells.append(" ".join(_word_blocks(c, links, levels, notes)))
                    cells += [""] * (int(span.get(_W + "val")) - 1 if span is not None else 0)
                rows.append("| " + " | ".join(cells) + " |")
            out.append("\n".join(rows))
        elif e.tag in (_W + "sdt", _W + "sdtContent"):
            out += _word_blocks(e, links, levels, notes)
    return out


def _docx(z: zipfile.ZipFile) -> str:
    levels = {}
    if "word/styles.xml" in z.namelist():
        for s in ET.fromstring(z.read("word/styles.xml")).iter(_W + "style"):
            o = s.find(f"{_W}pPr/{_W}outlineLvl")
            name = s.find(_W + "name")
            m = re.match(r"heading (\d)", (name.get(_W + "val") if name is not None else "").lower())
            if o is not None or m:
                levels[s.get(_W + "styleId")] = min(6, int(o.get(_W + "val")) + 1 if o is not None else int(m[1]))
    notes: list[str] = []
    links = _links(z, "word/document.xml")
    out = _word_blocks(ET.fromstring(z.read("word/document.xml")).find(_W + "body"), links, levels, notes)
    for kind in ("header", "footer"):
        seen = []
        for n in sorted(x for x in z.namelist() if re.fullmatch(rf"word/{kind}\d*\.xml", x)):
            t = " ".join(_word_blocks(ET.fromstring(z.read(n)), {}, {}, [])).strip()
            if t and t not in seen:
                seen.append(t)
        out += [f"{kind.capitalize()}: {t}" for t in seen]
    if notes and "word/footnotes.xml" in z.namelist():
        bodies = {f.get(_W + "id"): " ".join(_word_blocks(f, {}, {}, [])) for f in ET.fromstring(z.read("word/footnotes.xml"))}
        out += [f"[^{k}]: {bodies.get(i, '')}" for k, i in enumerate(notes, 1)]
    return "\n\n".join(out)


def _pptx(z: zipfile.ZipFile) -> str:
    out = []
    names = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    for k, (number, name) in enumerate(names, 1):
        links = _links(z, name)
        lines = []
        for p in ET.fromstring(z.read(name)).iter(_A + "p"):
            text = ""
            for r in p.iter(_A + "r"):
                shown = "".join(t.text or "" for t in r.iter(_A + "t"))
                h = r.find(f"{_A}rPr/{_A}hlinkClick")
                url = links.get(h.get(_R + "id") or "") if h is not None else None
                text += shown + (f" ({url})" if url and url not in shown else "")
            lines += [text.strip()] * bool(text.strip())
        note = f"ppt/notesSlides/notesSlide{number}.xml"
        if note in z.namelist():
            said = ["".join(t.text or "" for t in p.iter(_A + "t")).strip() for p in ET.fromstring(z.read(note)).iter(_A + "p")]
            said = [s for s in said if s and s != str(k)]
            if said:
                lines.append("Notes: " + " ".join(said))
        out.append("\n".join([f"# Slide {k}", *lines]))
    return "\n\n".join(out)


def csv_row(cells: list[str]) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' if re.search(r'[",\n]', c) else c for c in cells)


def _xlsx(z: zipfile.ZipFile) -> str:
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(_S + "si")]
    names = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(_S + "sheet")]
    sheets = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
    out = []
    for title, (_, name) in zip(names, sheets):
        rows = []
        for r in ET.fromstring(z.read(name)).iter(_S + "row"):
            cells: list[str] = []
            for c in r.findall(_S + "c"):
                letters = re.match(r"[A-Z]+", c.get("r") or "")
                if letters:
                    at = 0
                    for ch in letters[0]:
                        at = at * 26 + ord(ch) - 64
                    cells += [""] * (at - 1 - len(cells))
                v = c.find(_S + "v")
                raw = v.text or "" if v is not None else "".join(t.text or "" for t in c.iter(_S + "t"))
                cells.append(shared[int(raw)] if c.get("t") == "s" and raw else raw)
            rows.append(csv_row(cells))
        out.append("\n".join([f"# {title}", *rows]))
    return "\n\n".join(out)


def _odf_text(e: ET.Element, notes: list[str]) -> str:
    out = e.text or ""
    for c in e:
        if c.tag == _T + "s":
            out += " " * int(c.get(_T + "c") or 1)
        elif c.tag == _T + "tab":
            out += "\t"
        elif c.tag == _T + "line-break":
            out += "\n"
        elif c.tag == _T + "note":
            notes.append(" ".join(_odf_text(p, []) for p in c.iter(_T + "p")))
            out += f"[^{len(notes)}]"
        elif c.tag == _T + "a":
            shown, url = _odf_text(c, notes), c.get(_X + "href") or ""
            out += shown + (f" ({url})" if re.match(r"[a-z]+:", url) and url not in shown else "")
        else:
            out += _odf_text(c, notes)
        out += c.tail or ""
    return out


def _odf(z: zipfile.ZipFile, kind: str) -> str:
    out, notes = [], []

    def walk(e: ET.Element) -> None:
        for c in e:
            if c.tag == _T + "h":
                out.append("#" * min(6, int(c.get(_T + "outline-level") or 1)) + " " + _odf_text(c, notes).strip())
            elif c.tag == _T + "p":
                out.extend([t] if (t := _odf_text(c, notes).strip()) else [])
            elif c.tag == _TB + "table":
                rows = []
                for r in c.iter(_TB + "table-row"):
                    cells: list[str] = []
                    for x in r:
                        if x.tag in (_TB + "table-cell", _TB + "covered-table-cell"):
                            text = "" if x.tag.endswith("covered-table-cell") else " ".join(_odf_text(p, notes).strip() for p in x.iter(_T + "p"))
                            cells += [text] * min(int(x.get(_TB + "number-columns-repeated") or 1), 1000 if text else 1)
                    while cells and not cells[-1]:
                        cells.pop()
                    if cells:
                        rows.append(csv_row(cells) if kind == "ods" else "| " + " | ".join(cells) + " |")
                out.append("\n".join([f"# {c.get(_TB + 'name')}", *rows] if kind == "ods" else rows))
            elif c.tag.endswith("}page") and kind == "odp":
                out.append(f"# Slide {sum(x.startswith('# Slide') for x in out) + 1}")
                walk(c)
            else:
                walk(c)

    walk(ET.fromstring(z.read("content.xml")))
    out += [f"[^{k}]: {n}" for k, n in enumerate(notes, 1)]
    return "\n\n".join(x for x in out if x)


def rtf_text(b: bytes) -> str:
    """Text of RTF: groups of tables and destinations dropped, escapes resolved."""
    s, out, stack, skip, i = b.decode("latin-1"), [], [], False, 0
    while i < len(s):
        c = s[i]
        if c == "{":
            stack.append(skip)
            if re.match(r"\{\\(?:\*|fonttbl|colortbl|stylesheet|info|pict|header|footer)", s[i : i + 14]):
                skip = True
        elif c == "}":
            skip = stack.pop() if stack else False
        elif c == "\\":
            m = re.match(r"\\(?:'([0-9a-fA-F]{2})|([a-z]+)(-?\d+)? ?|(.))", s[i:], re.S)
            if m:
                if not skip:
                    if m[1]:
                        out.append(bytes([int(m[1], 16)]).decode("cp1252", "replace"))
                    elif m[2] in ("par", "line"):
                        out.append("\n")
                    elif m[2] == "tab":
                        out.append("\t")
                    elif m[2] == "u" and m[3]:
                        out.append(chr(int(m[3]) % 65536))
                        i += 1 if s[i + m.end() : i + m.end() + 1] == "?" else 0
                    elif m[4] in ("\\", "{", "}"):
                        out.append(m[4])
                i += m.end() - 1
        elif not skip and c not in "\r\n":
            out.append(c)
        i += 1
    return "".join(out).strip()


def office(b: bytes) -> Result:
    """OOXML, ODF and RTF; a PDF needs a reader that isn't there, which is said in a note."""
    from .classify import container

    if b[:5] == b"%PDF-":
        return "", [("parser-unavailable", None, None)]
    try:
        if b[:5] == b"{\\rtf":
            return rtf_text(b), []
        with zipfile.ZipFile(io.BytesIO(b)) as z:
            kind = container(b[:8192])
            if kind in (None, "zip"):
                kind = next((k for d, k in (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx")) if any(n.startswith(d) for n in z.namelist())), "zip")
            if kind in ("odt", "ods", "odp"):
                return _odf(z, kind), []
            if kind in ("docx", "pptx", "xlsx"):
                return {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx}[kind](z), []
    except RuntimeError as e:  # an encrypted entry
        return "", [("password-protected" if "password" in str(e).lower() else "extract-failed", None, None)]
    except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, AttributeError):
        return "", [("extract-failed", None, None)]
    return "", []


#: Parser of each id; a caller may pass another table.
READERS: dict[str, Callable[[bytes], Result]] = {"notebook": notebook, "subtitles": subtitles, "email": message, "office": office}


def extracted(files: DataFrame, content: str = "content", parser: str = "parser_id", readers: dict[str, Callable[[bytes], Result]] | None = None) -> DataFrame:
    """``files`` with ``extraction``: text and notes; an id without a reader gives a note, never an error."""
    table = readers or READERS

    def run(pid: str | None, b: bytes | None) -> dict:
        reader = table.get(pid or "")
        text, notes = reader(bytes(b or b"")) if reader else ("", [("parser-unavailable", None, None)])
        return {"text": text, "notes": [{"kind": k, "count": n, "pages": p} for k, n, p in notes]}

    @F.pandas_udf("struct<text: string, notes: array<struct<kind: string, count: int, pages: array<int>>>>")
    def each(pids: pd.Series, contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([run(p, b) for p, b in zip(pids, contents)], columns=["text", "notes"])

    return files.withColumn("extraction", each(F.col(parser), F.col(content)))


# -- lines of extracted pages (E13, E15-E18) --------------------------------------------------


def page_lines(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(id, pos, page, line)``: lines with the page they are on, by ``# Page n`` markers."""
    rows = docs.select(id_col, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    mark = F.regexp_extract("line", r"^# Page (\d+)\s*$", 1)
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("page", F.last(F.when(mark != "", mark.cast("int")), ignorenulls=True).over(w))


def undecodable(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(id, text, lost, pages)``: lines with control characters dropped, and pages that lost more than they kept."""
    rows = page_lines(docs, id_col, text).withColumn("bad", F.col("line").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    mark = F.col("line").rlike(r"^# (?:Page|Slide) \d+\s*$")
    size = F.length("line")
    per = rows.groupBy(id_col, "page").agg(
        F.sum(F.when(F.col("bad"), size).otherwise(0)).alias("l"), F.sum(F.when(F.col("bad") | mark, 0).otherwise(size)).alias("k"), F.count_if("bad").alias("n"), F.array_sort(F.collect_list(F.when(~F.col("bad"), F.struct("pos", "line")))).alias("kept")
    )
    doc = per.groupBy(id_col).agg(
        F.sum("n").alias("lost"), F.array_sort(F.collect_list(F.when((F.col("l") > F.col("k")) & F.col("page").isNotNull(), F.col("page")))).alias("pages"), F.array_sort(F.flatten(F.collect_list("kept"))).alias("kept"), F.sum("k").alias("k")
    )
    joined = F.array_join(F.transform("kept", lambda s: s["line"]), "\n")
    return doc.select(id_col, F.when(F.col("k") == 0, "").otherwise(joined).alias("text"), "lost", "pages")


def running_furniture(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(id, pos)`` of lines at page edges that only number pages, or repeat an edge line kept before.

    From three pages on: an edge whose digits-only form stands on all pages but one is
    page numbering; of other edge lines that repeat three times the first stays.
    """
    rows = page_lines(docs, id_col, text).where(F.col("page").isNotNull() & (F.trim("line") != "") & ~F.col("line").rlike(r"^# Page \d+\s*$"))
    up, down = (Window.partitionBy(id_col, "page").orderBy(o) for o in (F.col("pos"), F.col("pos").desc()))
    edges = rows.withColumn("u", F.row_number().over(up)).withColumn("d", F.row_number().over(down)).where("u = 1 OR d = 1")
    edges = edges.withColumn("edge", F.when(F.col("u") == 1, "top").otherwise("bottom")).withColumn("shape", F.regexp_replace(F.trim("line"), r"\d+", "#")).withColumn("said", F.trim("line"))
    n = rows.groupBy(id_col).agg(F.count_distinct("page").alias("n_pages"))
    shapes = edges.groupBy(id_col, "edge", "shape").agg(F.count(F.lit(1)).alias("k"))
    said = edges.groupBy(id_col, "edge", "said").agg(F.count(F.lit(1)).alias("m"), F.min("pos").alias("first"))
    e = edges.join(n, id_col).join(shapes, [id_col, "edge", "shape"]).join(said, [id_col, "edge", "said"])
    number = F.col("shape").contains("#") & (F.length("said") <= 80) & (F.col("k") >= F.col("n_pages") - 1)
    again = (F.col("m") >= 3) & (F.col("pos") > F.col("first"))
    return e.where((F.col("n_pages") >= 3) & (number | again)).select(id_col, "pos")


def replaced_pages(docs: DataFrame, id_col: str, text: str, pages: DataFrame) -> DataFrame:
    """Documents with the text under ``# Page n`` replaced where ``pages (id, page, new_text)`` has one."""
    rows = page_lines(docs, id_col, text)
    mark = F.col("line").rlike(r"^# Page \d+\s*$")
    new = rows.join(pages.select(id_col, "page", "new_text"), [id_col, "page"], "left")
    kept = new.where(F.col("new_text").isNull() | mark).select(id_col, "pos", F.when(F.col("new_text").isNotNull(), F.concat(F.col("line"), F.lit("\n\n"), F.col("new_text"), F.lit("\n"))).otherwise(F.col("line")).alias("line"))
    return kept.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n").alias("text"))


def filled_placeholders(files: DataFrame, images: DataFrame, id_col: str = "file_id", text: str = "content", order: str = "image_id") -> DataFrame:
    """``(file_id, text)``: ``[Image: name]`` replaced by what was read of it, or by nothing."""
    read = F.struct(F.col(order).alias("o"), F.concat(F.lit("[Image: "), "name", F.lit("]")).alias("mark"), F.coalesce(F.trim("ocr_text"), F.lit("")).alias("said"))
    per = images.where(F.col("name").isNotNull()).groupBy(id_col).agg(F.array_sort(F.collect_list(read)).alias("reads"))
    filled = F.aggregate(F.coalesce("reads", F.array().cast("array<struct<o: bigint, mark: string, said: string>>")), F.col(text), lambda acc, r: F.replace(acc, r["mark"], r["said"]))
    return files.join(per, id_col, "left").select(id_col, F.regexp_replace(filled, r"\[Image: [^\]\n]*\]", "").alias("text"))


# fixed values: reader warnings by the closed kinds they are told as
WARNING_KINDS = {"images": "images-skipped", "charts": "charts-skipped", "embedded": "attachments-skipped", "comments": "comments-skipped", "encrypted": "password-protected"}


def warning_notes(warnings: DataFrame, id_col: str, code: str, order: str) -> DataFrame:
    """``(id, kind, count)`` in the order kinds were first seen."""
    kinds = F.create_map(*(F.lit(x) for kv in WARNING_KINDS.items() for x in kv))
    rows = warnings.withColumn("kind", F.element_at(kinds, F.col(code))).where("kind IS NOT NULL")
    return rows.groupBy(id_col, "kind").agg(F.count(F.lit(1)).alias("count"), F.min(order).alias("first"))


def password_protected(error: Column) -> Column:
    return F.coalesce(F.lower(error).contains("password"), F.lit(False))


def iter_json_values(node: object, key: str) -> Iterator[object]:
    """Every value under ``key`` at any depth."""
    if isinstance(node, dict):
        for k, v in node.items():
            if k == key:
                yield v
            yield from iter_json_values(v, key)
    elif isinstance(node, list):
        for v in node:
            yield from iter_json_values(v, key)


def json_values(rows: DataFrame, id_col: str, text: str, key: str) -> DataFrame:
    """``(id, pos, value)``: every value under ``key`` at any depth of a JSON column, as JSON, in order (C27); broken JSON has none."""

    def found(raw: str | None) -> list[str]:
        try:
            return [json.dumps(v, ensure_ascii=False) for v in iter_json_values(json.loads(raw or ""), key)]
        except ValueError:
            return []

    @F.pandas_udf("array<string>")
    def values(texts: pd.Series) -> pd.Series:
        return pd.Series([found(t) for t in texts], dtype="object")

    return rows.select(id_col, F.posexplode(values(F.col(text))).alias("pos", "value"))
