"""What bytes are: signatures, encodings, decoding, text or binary, and routes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD_BYTES = 8192
# fixed values: leading bytes of binary media, as hexadecimal
MEDIA = (
    ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("474946383761", "gif"), ("474946383961", "gif"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("00000100", "ico"), ("00000200", "cur"), ("38425053", "psd"),
)
RIFF_FORMS = (("57454250", "webp"), ("57415645", "wave"), ("41564920", "avi"))
RECOGNISABLE = ("png", "jpeg", "gif", "tiff", "webp")
# fixed values: parser of a document format, and what is an archive
PARSERS = {**dict.fromkeys("pdf docx xlsx pptx odt ods odp rtf".split(), "office"), "epub": "epub", "ipynb": "notebook", "srt": "subtitles", "vtt": "subtitles", "eml": "email"}
ARCHIVES = ("zip", "tar", "gz", "tar.gz", "rar", "7z")
# fixed values: characters that text rarely holds
SUSPICIOUS = r"[\x00-\x08\x0B\x0E-\x1F�]"


def media_format(head: Column) -> Column:
    """Format of binary media by signature, else null."""
    h = F.hex(F.substring(head, 1, 16))
    out = F.lit(None).cast("string")
    for tag, name in reversed(RIFF_FORMS):
        out = F.when(h.startswith("52494646") & (F.substring(h, 17, 8) == tag), name).otherwise(out)
    out = F.when(F.substring(h, 9, 8) == "66747970", "iso-bmff").otherwise(out)
    for magic, name in reversed(MEDIA):
        out = F.when(h.startswith(magic), name).otherwise(out)
    return out


def detect_encoding(b: bytes) -> str:
    """``utf-16-le``, ``utf-16-be`` or ``utf-8`` by byte-order mark or the parity of NUL bytes (R2)."""
    if b[:2] == b"\xff\xfe":
        return "utf-16-le"
    if b[:2] == b"\xfe\xff":
        return "utf-16-be"
    scan = b[:1024]
    pairs = len(scan) // 2
    if pairs:
        even, odd = scan[0 : 2 * pairs : 2].count(0), scan[1 : 2 * pairs : 2].count(0)
        if odd > 0.3 * pairs and odd > 4 * even:
            return "utf-16-le"
        if even > 0.3 * pairs and even > 4 * odd:
            return "utf-16-be"
    return "utf-8"


def decode(b: bytes | None) -> str | None:
    """Text of any bytes: malformed parts become U+FFFD, the byte-order mark goes."""
    if b is None:
        return None
    return b.decode(detect_encoding(b), "replace").removeprefix("﻿")


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    return pd.Series([decode(None if b is None else bytes(b)) for b in content], dtype="object")


def suspicion(text: Column) -> Column:
    """Share of replacement, NUL and control characters among the first 8,192."""
    s = F.substring(text, 1, HEAD_BYTES)
    return F.when(F.length(s) == 0, F.lit(0.0)).otherwise((F.length(s) - F.length(F.regexp_replace(s, SUSPICIOUS, ""))) / F.length(s))


def classification(media: Column, ratio: Column) -> Column:
    """``binary``, ``ambiguous`` or ``text``."""
    return F.when(media.isNotNull() | (ratio > 0.30), "binary").when(ratio > 0.05, "ambiguous").otherwise("text")


def validation(path: Column, kind: Column) -> Column:
    """Why a file is left out, or null."""
    hidden = F.element_at(F.split(path, "/"), -1).startswith(".")
    return F.when(hidden, "Hidden file").when(kind == "binary", "Binary file")


# -- text-shaped formats -----------------------------------------------------------------------

# fixed values: how a subtitle cue and a notebook begin, and headers only mail carries
_SRT = r"^﻿?\s*\d{1,6}[ \t]*\r?\n[ \t]*\d{1,3}:\d{2}:\d{2}[.,]\d{1,3}[ \t]*-->[ \t]*\d{1,3}:\d{2}:\d{2}[.,]\d{1,3}"
_CELLS = r'^﻿?\s*\{[\s\S]{0,2048}?"cells"\s*:\s*\['
ENVELOPE = ("received", "message-id", "mime-version", "return-path", "delivered-to")


def is_message(text: Column) -> Column:
    """A header block of well-formed fields with a sender and a field only mail has."""
    lines = F.transform(F.split(F.regexp_extract(text, r"(?s)\A(.*?)(?:\r?\n\r?\n|\z)", 1), "\n"), lambda x: F.regexp_replace(x, r"\r$", ""))
    fields = F.filter(lines, lambda x: ~x.rlike(r"^[ \t]") & (x != ""))
    names = F.transform(fields, lambda x: F.lower(F.substring_index(x, ":", 1)))
    formed = F.forall(fields, lambda x: x.rlike(r"^[!-9;-~]+:"))
    return formed & F.array_contains(names, "from") & F.arrays_overlap(names, F.array(*(F.lit(e) for e in ENVELOPE)))


def textual_format(head_text: Column) -> Column:
    """``vtt``, ``srt``, ``ipynb``, ``eml`` or null for the first 4,096 characters."""
    t = F.substring(head_text, 1, 4096)
    nul = F.substring(head_text, 1, 512).rlike(r"\x00")
    return (
        F.when(nul, F.lit(None).cast("string"))
        .when(t.rlike(r"^﻿?WEBVTT(?:[\s-]|$)"), "vtt")
        .when(t.rlike(_SRT), "srt")
        .when(t.rlike(_CELLS) & t.rlike(r'"(?:cell_type|nbformat)"\s*:'), "ipynb")
        .when(is_message(t), "eml")
    )


# -- containers ----------------------------------------------------------------------------------


def is_tar(head: bytes) -> bool:
    """The header checksum of the first block, its own field read as spaces."""
    if len(head) < 512 or not any(head[:512]):
        return False
    digits = re.match(rb"\s*([0-7]+)", head[148:156].replace(b"\0", b" "))
    return bool(digits) and int(digits[1], 8) == sum(head[:148]) + 8 * 32 + sum(head[156:512])


def container(head: bytes) -> str | None:
    """Documents and archives by magic number and, for the zip family, their first entries."""
    if head[:5] == b"%PDF-":
        return "pdf"
    if head[:5] == b"{\\rtf":
        return "rtf"
    if head[:2] == b"\x1f\x8b":
        return "gz"
    if head[:6] == b"Rar!\x1a\x07":
        return "rar"
    if head[:6] == b"7z\xbc\xaf\x27\x1c":
        return "7z"
    if head[:4] == b"PK\x03\x04":
        if (m := re.search(rb"mimetypeapplication/(epub\+zip|vnd\.oasis\.opendocument\.(text|spreadsheet|presentation))", head[:256])) is not None:
            return "epub" if m[1].startswith(b"epub") else {b"text": "odt", b"spreadsheet": "ods", b"presentation": "odp"}[m[2]]
        for mark, name in ((b"word/", "docx"), (b"xl/", "xlsx"), (b"ppt/", "pptx")):
            if mark in head:
                return name
        return "zip"
    if head[:4] in (b"PK\x05\x06", b"PK\x07\x08"):
        return "zip"
    return "tar" if is_tar(head) else None


@F.pandas_udf(T.StringType())
def container_format(head: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else container(bytes(b)) for b in head], dtype="object")


def routed(files: DataFrame, head: str = "head") -> DataFrame:
    """``files`` with ``route``: kind, format, parser and archive.

    Media signatures and text shapes are expressions; only what neither tells goes to
    Python, and of it only the head.
    """
    h = F.col(head)
    df = files.withColumn("__media", media_format(h)).withColumn("__box", F.when(F.col("__media").isNull(), container_format(h)))
    valid = F.call_function("make_valid_utf8", h.cast("string"))
    df = df.withColumn("__text", F.when(F.col("__media").isNull() & F.col("__box").isNull(), textual_format(valid)))
    parsers = F.create_map(*(F.lit(x) for kv in PARSERS.items() for x in kv))
    doc = F.coalesce(F.col("__text"), F.when(~F.coalesce(F.col("__box").isin(*ARCHIVES), F.lit(False)), F.col("__box")))
    archive = F.when(F.col("__box").isin(*ARCHIVES), F.col("__box"))
    kind = F.when(F.col("__media").isNotNull(), "binary").when(archive.isNotNull(), "expand").when(doc.isNotNull(), "extract").otherwise("unknown")
    route = F.struct(kind.alias("kind"), F.coalesce("__media", doc).alias("format"), F.element_at(parsers, doc).alias("parser_id"), archive.alias("archive"))
    return df.withColumn("route", route).drop("__media", "__box", "__text")


def classified(files: DataFrame, content: str = "content", head: str = "head") -> DataFrame:
    """``files`` with ``text`` and ``classification``."""
    df = files.withColumn("text", decoded(F.col(content)))
    return df.withColumn("classification", classification(media_format(F.col(head)), suspicion(F.col("text"))))
