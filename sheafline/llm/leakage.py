"""Evaluation passages inside a training corpus.

The test items' word n-grams, paragraph by paragraph, become one broadcast table of
sorted hashes. Every document is scanned once, window by window, on the executors: no
shuffle, no join, and a document's cost is linear in its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..session import cut
from .text import WORD, plain, words

PARAGRAPH = re.compile(r"\n[ \t\r\f\v]*\n")
#: Bytes of test paragraphs whose n-grams are broadcast at once; longer sets are scanned for in several pieces, with the same result.
PIECE_BYTES = 16_000_000


def _paragraphs(text: str) -> list[str]:
    return [p for p in PARAGRAPH.split(text.replace("\r\n", "\n")) if p.strip()]


def window_hashes(found: list[str], n: int) -> np.ndarray:
    """A 64-bit hash of every run of ``n`` successive words."""
    if len(found) < n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter((xxh64_intdigest(w) for w in found), dtype=np.uint64, count=len(found))
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = (out ^ h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Grams:
    """Windows of ``n`` words of test paragraphs: sorted hashes, each with the place it stands at."""

    def __init__(self, paragraphs: list[tuple[str, list[int]]], n: int):
        self.n = n
        self.texts = [p for p, _ in paragraphs]
        self.items = [sorted(ids) for _, ids in paragraphs]
        parts = [window_hashes(p.split(" "), n) for p in self.texts]
        sizes = [len(x) for x in parts]
        hashes = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.paragraph = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        self.offset = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])[order] if sizes else np.zeros(0, dtype=np.int32)
        self.split: dict[int, list[str]] = {}

    def hits(self, found: list[str]) -> Iterator[tuple[int, int]]:
        """(window start, paragraph) of every window of ``found`` that is one of a paragraph, word for word."""
        n, m = self.n, len(self.hashes)
        h = window_hashes(found, n)
        if not m or not len(h):
            return
        at = np.searchsorted(self.hashes, h)
        for i in np.nonzero(self.hashes[np.minimum(at, m - 1)] == h)[0].tolist():
            j = int(at[i])
            while j < m and self.hashes[j] == h[i]:
                k, o = int(self.paragraph[j]), int(self.offset[j])
                w = self.split.get(k)
                if w is None:
                    w = self.split[k] = self.texts[k].split(" ")
                if w[o : o + n] == found[i : i + n]:
                    yield i, k
                j += 1


def _pieces(items: DataFrame, item_col: str, text_col: str, n: int, shared: int) -> Iterator[Grams]:
    """Test sets are small by nature; one over ``PIECE_BYTES`` of paragraphs is scanned for piece by piece.

    Which paragraphs ``shared`` items share is counted over the whole set.
    """

    @F.pandas_udf("array<string>")
    def normal(texts: pd.Series) -> pd.Series:
        return pd.Series([list(dict.fromkeys(" ".join(w) for p in _paragraphs(t or "") if len(w := words(p)) >= n)) for t in texts], dtype="object")

    rows = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL AND item IS NOT NULL")
    pairs = rows.select("item", F.explode(normal("text")).alias("p")).distinct()
    few = pairs.groupBy("p").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") < shared).select("p")
    # fewer than ``shared`` items a paragraph are left
    kept = cut(pairs.join(few, "p").groupBy("p").agg(F.collect_set("item").alias("items")))
    size = kept.agg(F.sum(F.octet_length("p"))).first()[0] or 0
    pieces = max(1, -(-size // PIECE_BYTES))
    for k in range(pieces):
        part = kept if pieces == 1 else kept.where(F.pmod(F.xxhash64("p"), F.lit(pieces)) == k)
        yield Grams(sorted((r.p, r.items) for r in part.collect()), n)


def leaked(
    documents: DataFrame,
    items: DataFrame,
    doc_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = 8,
    shared: int = 10,
) -> DataFrame:
    """One row ``(doc_id, item_id)`` for each document and item that share ``n`` successive words of one item paragraph.

    Words are runs of letters and digits after folding case, compatibility forms,
    markup and invisible characters. A paragraph of ``shared`` or more items is an
    instruction and proves nothing. Hash hits are verified word by word. Null or empty
    texts, and items shorter than ``n`` words, match nothing; an empty table on either
    side gives an empty result; two rows of one document id give each pair once.
    """
    docs = documents.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    sc = documents.sparkSession.sparkContext
    out = None
    for grams in _pieces(items, item_col, item_text_col, n, shared):
        table = sc.broadcast(grams)

        def scan(batches: Iterator[pd.DataFrame], table=table) -> Iterator[pd.DataFrame]:
            g = table.value
            for b in batches:
                ids, its = [], []
                for doc, text in zip(b["doc_id"], b["t"]):
                    hit = {k for _, k in g.hits(words(text))}
                    pairs = {i for k in hit for i in g.items[k]}
                    ids += [doc] * len(pairs)
                    its += sorted(pairs)
                yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="Int64"), "item_id": pd.Series(its, dtype="int64")})

        part = docs.mapInPandas(scan, "doc_id long, item_id long")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def passages(items: DataFrame, n: int = 8, shared: int = 10, item_col: str = "item_id", text_col: str = "text") -> list:
    """Broadcast tables (:class:`Grams`) of the items' passages."""
    sc = items.sparkSession.sparkContext
    return [sc.broadcast(g) for g in _pieces(items, item_col, text_col, n, shared)]


def without_leaks(
    documents: DataFrame,
    items: DataFrame,
    doc_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = 8,
    shared: int = 10,
    drop_share: float = 0.5,
) -> DataFrame:
    """``documents`` with leaked spans cut out of ``text_col`` and a column ``leaked_words``.

    The lines that hold words of a verified window are removed from the text, and a
    document whose leaked words are more than ``drop_share`` of its words is dropped as
    a whole. Null texts pass unchanged with 0 leaked words. The windows of all pieces of
    the test set are found in the text as it came, and it is cut once.
    """
    marks = [_marked(table)(F.col(text_col)) for table in passages(items, n, shared, item_col, item_text_col)]

    @F.pandas_udf("struct<text: string, leaked: long, dropped: boolean>")
    def cleaned(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_cut(t, () if s is None else s, n, drop_share) for t, s in zip(texts, starts)], columns=["text", "leaked", "dropped"])

    starts = F.flatten(F.array(*(F.coalesce(m, F.array().cast("array<int>")) for m in marks)))
    done = documents.withColumn("__starts", starts).withColumn("__c", cleaned(F.col(text_col), F.col("__starts")))
    return done.where(~F.col("__c.dropped")).withColumn(text_col, F.col("__c.text")).withColumn("leaked_words", F.col("__c.leaked")).drop("__starts", "__c")


def _marked(table):
    """A column function: the window starts of a text that one table of passages holds."""

    @F.pandas_udf("array<int>")
    def marked(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else sorted({i for i, _ in table.value.hits(_by_line(t)[0])}) for t in texts], dtype="object")

    return marked


def _by_line(text: str) -> tuple[list[str], list[int]]:
    """Words of a text, and the line each stands on."""
    found: list[str] = []
    line_of: list[int] = []
    for k, line in enumerate(text.split("\n")):
        w = WORD.findall(plain(line).casefold())
        found += w
        line_of += [k] * len(w)
    return found, line_of


def _cut(text: str | None, starts, n: int, drop_share: float) -> tuple[str | None, int, bool]:
    """``text`` without the lines of the windows at ``starts``, their words, and whether too many are."""
    if text is None or not len(starts):
        return text, 0, False
    found, line_of = _by_line(text)
    hit = {j for i in starts for j in range(int(i), int(i) + n)}
    gone = {line_of[j] for j in hit}
    return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone), len(hit), len(hit) > drop_share * len(found)
