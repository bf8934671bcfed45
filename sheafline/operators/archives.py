"""Archives as rows: one file in, its entries out."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classify import is_tar

OPENABLE = ("zip", "tar", "gz", "tar.gz")
_SUFFIX = r"(?i)\.(?:tar\.gz|tgz|tar|zip|gz|rar|7z)$"


def without_suffix(path: Column) -> Column:
    """An archive's path without its ending, case aside (A4)."""
    return F.regexp_replace(path, _SUFFIX, "")


def _cruft(name: str) -> bool:
    return name.endswith("/") or name.startswith("__MACOSX/") or "/__MACOSX/" in name or name.rpartition("/")[2] == ".DS_Store"


def _clean(name: str) -> str:
    return re.sub(r"^(?:\./)+", "", name.replace("\\", "/"))


def untar(b: bytes) -> Iterator[tuple[str, bytes]]:
    """Regular files with content; long names and prefixes resolved (A2)."""
    with tarfile.open(fileobj=io.BytesIO(b), mode="r:") as t:
        for m in t:
            if m.isreg() and m.size and (f := t.extractfile(m)):
                yield m.name, f.read()


def entries(path: str, kind: str, b: bytes) -> list[tuple[str, bytes]]:
    """Entries of an archive, rooted at its name without the ending (A1, A3); corrupt bytes raise."""
    root = re.sub(_SUFFIX, "", path)
    if kind in ("gz", "tar.gz"):
        inner = gzip.decompress(b)
        if not is_tar(inner[:512]):
            return [(root, inner)]
        kind, b = "tar", inner
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(b)) as z:
            found = [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
    elif kind == "tar":
        found = list(untar(b))
    else:
        raise ValueError(f"{kind} can't be opened")
    return [(f"{root}/{_clean(n)}", c) for n, c in found if not _cruft(_clean(n))]


def expanded(files: DataFrame, id_col: str = "ord") -> DataFrame:
    """Rows ``(ord, path, archive_path, content, depth, error)`` of archives, one level deep (A5).

    ``files`` has ``path``, ``content`` and ``archive``. What can't be opened stays one
    row with its path, its bytes and the error, so nothing is lost from sight.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, path, kind, content in b[["i", "path", "archive", "content"]].itertuples(index=False, name=None):
                try:
                    out += [(i, p, path, c, 1, None) for p, c in entries(path or "archive", kind, bytes(content or b""))]
                except (ValueError, OSError, EOFError, zipfile.BadZipFile, tarfile.TarError, zlib.error, RuntimeError, NotImplementedError) as e:
                    out.append((i, path, path, content, 0, type(e).__name__))
            yield pd.DataFrame(out, columns=["ord", "path", "archive_path", "content", "depth", "error"])

    src = files.select(F.col(id_col).cast("long").alias("i"), "path", "archive", "content")
    return src.mapInPandas(each, "ord long, path string, archive_path string, content binary, depth int, error string")


def opened(files: DataFrame, expand: bool = True, id_col: str = "ord") -> tuple[DataFrame, DataFrame]:
    """Entries of archives, and the archives that stay as they are.

    Where ``expand`` is off every archive stays a file. Kinds that can't be opened are
    never dropped: they stay visible, with a count beside what they would have held.
    """
    can = F.col("archive").isin(*OPENABLE)
    if not expand:
        return expanded(files.limit(0), id_col), files
    return expanded(files.where(can), id_col), files.where(~F.coalesce(can, F.lit(False)))
