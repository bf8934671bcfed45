"""Source files nobody wrote by hand: generated, minified, bundled, vendored, data saved as code.

A file becomes a sequence of tokens without comments and spacing. With its identifiers,
strings and numbers masked, five successive tokens are a shingle; a shingle that stands
``k`` times in a file counts ``k`` times. Files of equal masked tokens are one class, short
ones those of equal tokens, as their names tell which are copies.
Classes are bucketed by MinHash bands, of their shingles in each repository and of what
proves a copy everywhere, and the members of a bucket are linked where the similarity of
their shingles is verified.

* a class that spans repositories, or is linked to one of another repository or to a library
  that says so in its header, is vendored, whatever its identifiers were renamed to;
* a family of linked texts inside one repository is generated;
* texts that hold nearly nothing but literals, in a form that others share, are blobs.

Marks that tools leave in their output (headers, lock-file keys, source maps, very long
lines) are read in the same pass, for the files that have nobody to be compared with.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

SHINGLE = 5
SIMILAR = 0.8
#: Two sets of that similarity share no band with a probability of 5e-6, more similar ones with less.
BANDS, ROWS = 40, 6
#: Bytes of a sketch, and the estimate from which a pair is verified: more than five deviations below ``SIMILAR``.
SKETCH, WORTH = BANDS * ROWS, 0.65
#: Members up to which all pairs of a bucket are compared, whatever they are linked to.
CROWD = 100
#: Tokens below which a file is too short to prove a copy by itself, and below which its names have to be the same too.
LEAST_TOKENS, LONG_TOKENS = 40, 120
#: Members from which look-alikes in one repository are a family.
FAMILY = 4

# fixed values: file endings of source code, and of files only tools write
CODE = frozenset("bas c cc cjs clj cpp cs css cxx dart ex exs go h hh hpp hs html java js jsx kt kts less lua m mjs php pl pm ps1 py pyi r rb rs sass scala scss sh sql swift ts tsx vb vue zsh bash".split())
MACHINE_ENDINGS = (".map", ".lock", ".min.js", ".min.css", ".bundle.js", ".chunk.js", ".snap")
GENERATED_PATH = re.compile(r"\.(?:gen|g|generated|designer)\.\w+$|_pb2(?:_grpc)?\.py$|\.pb\.(?:go|cc|h|c)$|outerclass\.java$|(?:^|/)(?:__generated__|generated|autogen)/")
MACHINE_NAMES = frozenset("package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml poetry.lock pipfile.lock cargo.lock composer.lock gemfile.lock go.sum packages.lock.json".split())
# fixed values: directories that hold third-party code
VENDOR_DIRS = frozenset("vendor vendored third_party third-party thirdparty node_modules bower_components deps extern external site-packages jspm_packages".split())
DOCUMENTS = frozenset("md rst txt adoc pdf docx odt tiff doc rtf ipynb eml".split())

# fixed values: what generators write at the top of their output; a statement about this file, not about some other
GENERATED = re.compile(
    r"^\W*(?:<auto-?generated\b|@generated\b|auto-?generated\b(?! (?:files?|code) (?:are|is|must|should))|automatically generated\b|machine[- ]generated\b|"
    r"(?:code |this (?:file|code|module|class|source)? ?(?:was|is|has been) |file )?(?:auto(?:matically|-)? ?)?(?:generated|produced|created|written)(?: automatically)? (?:by|from|using)\b|"
    r"this (?:file|code|source|module|class) (?:is|was|has been) (?:auto(?:matically|-)? ?)?(?:generated|produced|created|built)|"
    r"(?:diese?r? (?:code|datei|quelltext) wurde|cette? (?:fichier|code) (?:a été|est)|este (?:archivo|código) (?:fue|ha sido)) (?:automati\w+|auto\w* |gener\w+|généré\w*)|ce fichier (?:a été|est) (?:automatiquement )?généré|"
    r"(?:fichier|code) généré (?:automatiquement|par)|(?:archivo|código) generado (?:automáticamente|por)|(?:automatisch|maschinell) (?:erzeugt|generiert)|"
    r"do not (?:edit|modify)(?: this file| by hand|\W*$))",
    re.I,
)
# fixed values: headers of distributed libraries
LIBRARY = re.compile(r"^\W*(?:[\w@/.-]+,? (?:release |version )?v?\d+\.\d+(?:\.\d+)?\S*\.? (?:\|.*\b(?:contributors|license|\(c\))|.*\bupstream\b)|@license\b|@preserve\b|bundled license information)", re.I)
_COMMENT = re.compile(r"\s*(?://|#(?!include|define|if|endif|else|pragma)|/\*|\*|--|<!--|;;)")
_BLOCKS = {"/*": "*/", "<!--": "-->", "(*": "*)", "{-": "-}", "--[[": "]]"}
#: Lines that may stand before the comments at the beginning of a file.
_PROLOGUE = re.compile(r"<\?(?:php|xml)\b[^>]*(?:\?>)?$|<!doctype\b|[\"']use strict[\"'];?$|@(?:charset|echo off)\b|%|;|rem\b|\ufeff$", re.I)
_TEXTUAL = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`\n]*`")
_NUMBER = re.compile(r"(?<![\w$])-?\d[\w.]*")
_IDENT = re.compile(r"[A-Za-z_$][\w$]*")
_SPACE = re.compile(r"[ \t\r\f\v]+")
_TOKEN = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`|\d[\w.]*|[^\W\d][\w$]*|\$[\w$]*|[^\s\w$]")
# fixed values: words of programming languages that are no identifiers
KEYWORDS = frozenset(
    "and as assert async await begin break case catch class const continue def default defer del do elif else end enum except export extends extern final finally fn for foreach from func function global go goto if implements "
    "import in include instanceof interface is lambda let match module namespace new nil none not null or override package pass private protected public raise range require return select self sizeof static struct super switch "
    "then this throw throws trait true try type typedef typeof unless until use using var virtual void volatile when where while with yield false".split()
)
#: Odd factors: each puts the 32-bit hashes in another order.
_ORDERS = np.random.default_rng(20240229).integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: What a bucket's members have in common, in the last bits of its key: shingles in one repository, bound identifiers, names.
HOME, TIED, NAMED = 0, 1, 2


def ending(path: str) -> str:
    name = path.rpartition("/")[2].lower()
    return name.rpartition(".")[2] if "." in name else ""


def words(text: str) -> list[str]:
    """Raw words: lines of code without comments, blank lines and spacing."""
    return [w for line in text.split("\n") if not _COMMENT.match(line) and (w := _SPACE.sub("", line))]


def masked(raw: str) -> str:
    """Raw words, joined by line ends, with strings as S, numbers as 0 and identifiers as I."""
    return _IDENT.sub("I", _NUMBER.sub("0", _TEXTUAL.sub("\x01", raw))).replace("\x01", "S")


def tokens(text: str) -> list[str]:
    """Identifiers, literals and signs of the lines of code."""
    return _TOKEN.findall("\n".join(line for line in text.split("\n") if not _COMMENT.match(line)))


def mask(token: str) -> str:
    """A token with what a copy may rename taken out."""
    c = token[0]
    if c in "\"'`":
        return "S" if len(token) > 1 else c
    if c.isdigit():
        return "0"
    if c.isalpha() or c in "_$":
        return token if token.lower() in KEYWORDS else "I"
    return token


class Masker(dict):
    """Hashes of tokens, masked and as they are; what was seen is kept, up to a bounded number of tokens."""

    def __init__(self):
        super().__init__()
        self.hashes = np.zeros((2, 1 << 18), dtype=np.uint64)

    def __missing__(self, t: str) -> int:
        k = self[t] = len(self)
        if k >= self.hashes.shape[1]:
            self.hashes = np.hstack([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[:, k] = xxhash.xxh64_intdigest(mask(t)), xxhash.xxh64_intdigest(t)
        return k

    def __call__(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > 200_000:
            self.clear()
        at = np.fromiter(map(self.__getitem__, found), dtype=np.int64, count=len(found))
        return self.hashes[0, at], self.hashes[1, at]


_LITERALS = np.array([xxhash.xxh64_intdigest("S"), xxhash.xxh64_intdigest("0")], dtype=np.uint64)
_NAME = np.uint64(xxhash.xxh64_intdigest("I"))


def bound(masked_: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Masked tokens, each identifier with the distance to where it stood last.

    A consistent renaming leaves these as they are, while code of the same shape about
    other things repeats its identifiers at other distances.
    """
    at = np.flatnonzero(masked_ == _NAME)
    names = own[at]
    order = np.argsort(names, kind="stable")
    same = np.concatenate([[False], names[order][1:] == names[order][:-1]]) if len(at) else np.zeros(0, dtype=bool)
    back = np.zeros(len(at), dtype=np.uint64)
    back[order[same]] = (at[order][same] - at[order][np.flatnonzero(same) - 1]).astype(np.uint64)
    out = masked_.copy()
    out[at] ^= back * np.uint64(0xD6E8FEB86659FD93)
    return out


def windows(h: np.ndarray) -> np.ndarray:
    """Hashes of ``SHINGLE`` successive tokens; a shorter sequence is one shingle."""
    if len(h) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(h.tobytes())], dtype=np.uint64)
    out = np.zeros(len(h) - SHINGLE + 1, dtype=np.uint64)
    for k in range(SHINGLE):
        out = (out ^ h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def shingles(h: np.ndarray) -> np.ndarray:
    """Sorted 32-bit hashes of the shingles, the ``k``-th time a shingle stands there as one of its own."""
    s = np.sort(windows(h))
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    k = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    x = (s + k.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
    return np.unique((x >> np.uint64(32)).astype(np.uint32))


def minima(sh: np.ndarray) -> np.ndarray:
    """The least hash in each of ``BANDS * ROWS`` orders."""
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(sh), 256):
        np.minimum(low, (sh[k : k + 256, None] * _ORDERS).min(axis=0), out=low)
    return low


def bands(sh: np.ndarray, kind: int = HOME) -> tuple[np.ndarray, bytes]:
    """``BANDS`` keys of ``ROWS`` minima each, and a sketch of single bytes of all minima."""
    low = minima(sh)
    out = np.arange(BANDS, dtype=np.uint64)
    for x in low.astype(np.uint64).reshape(BANDS, ROWS).T:
        out = (out ^ x) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(33)
    out = out & np.uint64(0xFFFFFFFFFFFFFFFC) | np.uint64(kind)
    return out.view(np.int64), ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def form(h: np.ndarray) -> int:
    """A hash of the fewest shingles that nine tenths of a text consist of: what a table of literals has in common with another."""
    s, n = np.unique(windows(h), return_counts=True)
    order = np.lexsort((s, -n))
    kept = order[: int(np.searchsorted(np.cumsum(n[order]), 0.9 * n.sum())) + 1]
    return xxhash.xxh64_intdigest(np.sort(s[kept]).tobytes()) - 2**63


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _headers(text: str) -> Iterator[str]:
    """Comment lines among the first twelve lines, and all lines of the comments that a file begins with."""
    close = ""
    leading = True
    for k, line in enumerate(text.split("\n")):
        if not leading and k >= 12:
            return
        bare = line.strip()
        if close:
            yield line
            if close in bare:
                leading, close = leading and not bare.partition(close)[2].strip(), ""
            continue
        if _COMMENT.match(line):
            yield line
        if block := next((o for o in _BLOCKS if bare.startswith(o)), ""):
            before, found, after = bare[len(block) :].partition(_BLOCKS[block])
            if not found:
                # past the first lines only comments that are still at the file's beginning are followed
                close = _BLOCKS[block] if leading else ""
            elif after.strip():
                leading = False
        elif bare and not _COMMENT.match(line) and not _PROLOGUE.match(bare):
            leading = False


def marks(path: str, text: str) -> str | None:
    """What a file says of itself: ``lock``, ``map``, ``generated``, ``library``, ``minified`` or nothing."""
    low = path.lower()
    name = low.rpartition("/")[2]
    if name in MACHINE_NAMES or low.endswith(MACHINE_ENDINGS):
        return "map" if low.endswith(".map") else "lock" if "lock" in name or name == "go.sum" else "minified"
    end = ending(path)
    if end in DOCUMENTS:
        return None
    if end == "json" or name.endswith(".map"):
        if re.search(r'"lockfileVersion"|"_integrity"|"resolved":\s*"', text):
            return "lock"
        if re.match(r'\s*\{\s*"version"\s*:\s*3\s*,\s*"(?:sources|file|sourceRoot|mappings)"', text):
            return "map"
        return None
    if end not in CODE:
        return None
    if GENERATED_PATH.search(low):
        return "generated"
    for line in _headers(text):
        if GENERATED.match(line):
            return "generated"
        if LIBRARY.match(line):
            return "library"
    if end in ("js", "mjs", "cjs", "css", "html", "ts", "jsx"):
        lines = [x for x in text.split("\n") if x.strip() and not x.startswith("//#")]
        if lines and sum(map(len, lines)) / len(lines) > 160 and sum(x.count(" ") + x.count("\t") for x in lines) < 0.12 * sum(map(len, lines)):
            return "minified"
        if "//# sourceMappingURL=" in text or "/*# sourceMappingURL=" in text or "__webpack_require__" in text:
            return "minified"
    return None


def literal_only(raw: str, mask: str) -> bool:
    """Whether a file's words hold nearly nothing but literals."""
    names = mask.count("I")
    literals = mask.count("S") + mask.count("0")
    if names == 0 and literals == 0:
        return False
    kept = len(_TEXTUAL.sub("", raw)) if literals else len(raw)
    lines = mask.split("\n")
    if len(lines) >= 12:
        # rows of a table: nearly all words look alike and differ in their literals
        word, k = Counter(x.rstrip(",;") for x in lines).most_common(1)[0]
        if k >= 0.8 * len(lines) and ("0" in word or "S" in word):
            return True
    return (literals >= 24 and names <= 0.12 * (names + literals)) or (len(raw) > 400 and literals > 0 and kept < 0.15 * len(raw) and sum("I" in x for x in lines) <= max(1, 0.2 * len(lines)))


def _has_names(n: int) -> bool:
    """Whether a text is short, or not longer than the longest that may be similar to a short one."""
    return n * SIMILAR <= LONG_TOKENS + SHINGLE


_FEATURES = "file_id long, bundle_id long, path string, mark string, form long, n_tokens int, raw_hash long, mask_hash long, digest long, bands array<long>, sketch binary, copies array<long>, tied binary, named binary, n_shingles int"


def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a file tells by itself, and the buckets it belongs to (none for documents, data and short files).

    Files with a header's mark have buckets too, since a copy without the header is told by
    its link to them. Minified files and tables of literals have none: every copy of one
    is told by itself, and all of them are alike once their names are masked.
    """
    hashed = Masker()
    for b in batches:
        out = []
        for file_id, bundle_id, path, text in b[["file_id", "bundle_id", "path", "content"]].itertuples(index=False, name=None):
            path, text = path or "", text or ""
            mark = marks(path, text)
            n, literal, raw_hash, mask_hash, digest, keys, sketch, copies, tied, named, size = 0, None, None, None, None, None, None, None, None, None, 0
            if ending(path) in CODE and mark not in ("lock", "map"):
                found = tokens(text)
                n = len(found)
                if n:
                    h, own = hashed(found)
                    raw_hash = xxhash.xxh64_intdigest("\0".join(found)) - 2**63
                    mask_hash = xxhash.xxh64_intdigest(h.tobytes()) - 2**63 if n >= LONG_TOKENS else raw_hash
                    digest = xxhash.xxh64_intdigest(text) - 2**63
                    if mark is None and np.isin(h, _LITERALS).sum() >= 0.1 * n:
                        raw = "\n".join(words(text))
                        literal = form(h) if literal_only(raw, masked(raw)) else None
                    if n >= LEAST_TOKENS and mark != "minified" and literal is None:
                        s = shingles(h)
                        keys, sketch = bands(s)
                        keys, size, copies = keys.tolist(), len(s), []
                        if n >= LONG_TOKENS:
                            more, tied = bands(shingles(bound(h, own)), TIED)
                            copies += more.tolist()
                        if _has_names(n):
                            more, named = bands(shingles(own), NAMED)
                            copies += more.tolist()
            out.append((file_id, bundle_id, path, mark, literal, n, raw_hash, mask_hash, digest, keys, sketch, copies, tied, named, size))
        pdf = pd.DataFrame(out, columns=["file_id", "bundle_id", "path", "mark", "form", "n_tokens", "raw_hash", "mask_hash", "digest", "bands", "sketch", "copies", "tied", "named", "n_shingles"])
        whole = ["file_id", "bundle_id", "form", "raw_hash", "mask_hash", "digest"]
        pdf[whole] = pdf[whole].astype("Int64")
        some = ["bands", "sketch", "copies", "tied", "named"]
        pdf[some] = pdf[some].astype("object")
        yield pdf


_SETS = "class long, same boolean, n_tokens int, shingles binary, bindings binary, names binary"


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sets of shingles of classes, each from one of its texts."""
    hashed = Masker()
    for b in batches:
        out = []
        for wanted, text in zip(b["class"], b["content"]):
            found = tokens(text or "")
            h, own = hashed(found)
            names = shingles(own).tobytes() if _has_names(len(found)) else None
            own_class = xxhash.xxh64_intdigest(h.tobytes() if len(found) >= LONG_TOKENS else "\0".join(found)) - 2**63
            out.append((wanted, own_class == wanted, len(found), shingles(h).tobytes(), shingles(bound(h, own)).tobytes(), names))
        cols = (("class", "int64"), ("same", "bool"), ("n_tokens", "int32"), ("shingles", "object"), ("bindings", "object"), ("names", "object"))
        yield pd.DataFrame({c: pd.Series([r[k] for r in out], dtype=t) for k, (c, t) in enumerate(cols)})


def _copied(n: int, tied: tuple[bytes, bytes], named: tuple[bytes | None, bytes | None]) -> float:
    """The similarity that proves a copy: with bound identifiers, or with the names themselves where a text is short."""
    x, y = named if n < LONG_TOKENS and None not in named else tied
    return similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32))


def _verified(pairs: DataFrame, feats: DataFrame, files: DataFrame) -> DataFrame:
    """``(a, b, alike, copy)`` of the pairs of classes that are similar."""
    needed = cut(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct())
    reps = feats.groupBy(F.col("mask_hash").alias("class")).agg(F.min("file_id").alias("file_id")).join(needed, "class", "left_semi")
    # a file_id may stand in several rows; the one with the tokens of the class is meant
    reps = cut(reps)
    # few classes are broadcast, so that the texts stay where they are
    few = reps.count() <= 500_000
    sets = files.select("file_id", "content").join(F.broadcast(reps) if few else reps, "file_id").select("class", "content").mapInPandas(_sets, _SETS)
    sets = cut(sets.groupBy("class").agg(F.max(F.struct("same", "n_tokens", "shingles", "bindings", "names")).alias("m")).select("class", "m.*").drop("same"))

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(np.frombuffer(i, np.uint32), np.frombuffer(j, np.uint32)) for i, j in zip(a, b)], dtype="float64")

    @F.pandas_udf("double")
    def copied(x: pd.Series, y: pd.Series, p: pd.Series, q: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([_copied(k, (x[i], y[i]), (p[i], q[i])) for i, k in enumerate(n)], dtype="float64")

    own = sets.select("class", "shingles")
    links = cut(pairs.join(own.toDF("a", "set_a"), "a").join(own.toDF("b", "set_b"), "b").select("a", "b", alike("set_a", "set_b").alias("alike")).where(F.col("alike") >= SIMILAR))
    proofs = sets.select("class", "n_tokens", "bindings", "names")
    both = links.join(proofs.toDF("a", "n_a", "tied_a", "names_a"), "a").join(proofs.toDF("b", "n_b", "tied_b", "names_b"), "b")
    return cut(both.select("a", "b", "alike", copied("tied_a", "tied_b", "names_a", "names_b", F.least("n_a", "n_b")).alias("copy")))


@F.pandas_udf(T.DoubleType())
def _estimate(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of bytes that two sketches have in common."""
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(-1, SKETCH) for s in (a, b))
    return pd.Series((x == y).mean(axis=1))


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs ``(a, b, kind)`` of about one size of each bucket, from members sorted by bucket.

    Of a bucket of more than ``CROWD`` members each is given with the first one and with
    the ``key``. No bucket is held: of a crowded one, its first member alone is kept.
    """

    def told(key: np.ndarray, a: np.ndarray, b: np.ndarray, crowded: bool) -> pd.DataFrame:
        keys = pd.Series(key, dtype="Int64") if crowded else pd.Series(pd.NA, index=range(len(key)), dtype="Int64")
        return pd.DataFrame({"a": a, "b": b, "kind": (key & 3).astype(np.int32), "key": keys})

    key, cls, n = (np.zeros(0, np.int64) for _ in range(3))
    crowd = None
    for batch in chain(batches, [None]):
        if batch is not None:
            key, cls, n = (np.concatenate([x, batch[c].to_numpy(np.int64)]) for x, c in ((key, "key"), (cls, "class"), (n, "n")))
        if crowd is not None:
            end = int(np.searchsorted(key, crowd[0], side="right"))
            yield told(key[:end], np.full(end, crowd[1], np.int64), cls[:end], True)
            key, cls, n = key[end:], cls[end:], n[end:]
        if not len(key):
            continue
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        # of the last bucket more may follow
        crowd = (key[-1], cls[first[-1]]) if size[-1] > CROWD else None
        whole = len(key) if batch is None or crowd else int(first[-1])
        many = np.repeat(size > CROWD, size)
        yield told(key[many], cls[np.repeat(first, size)[many]], cls[many], True)
        at = np.flatnonzero(~many[:whole])
        k, c, m = key[at], cls[at], n[at]
        for off in range(1, CROWD):
            x = np.flatnonzero(k[off:] == k[:-off])
            if not len(x):
                break
            y = x + off
            fit = (np.minimum(m[x], m[y]) >= (SIMILAR - 1e-9) * np.maximum(m[x], m[y])) & (c[x] != c[y])
            x, y = x[fit], y[fit]
            yield told(k[x], np.minimum(c[x], c[y]), np.maximum(c[x], c[y]), False)
        key, cls, n = key[whole:], cls[whole:], n[whole:]


def linked(feats: DataFrame, files: DataFrame) -> DataFrame:
    """Verified links ``(a, b, alike, copy)`` between different classes.

    Looked for are look-alikes in one repository, in the buckets of the bands of their
    shingles there, and copies anywhere, in those of the bands of what proves a copy (a
    copy is a look-alike, too). All pairs of a bucket are compared. Of a crowded bucket
    each member is compared with the first one, the hub: those verified to be linked to
    it, by what the bucket is for, hang together through it, as a family of that
    repository or as copies; every other member is compared with all members. Sketches
    tell which pairs are worth verifying; the sets of those alone are made, from their
    texts.
    """
    some = feats.where("bands IS NOT NULL")
    one = F.min(F.struct("file_id", "raw_hash", "bands", "copies", "sketch", "tied", "named", "n_shingles")).alias("m")
    classes = cut(some.groupBy(F.col("mask_hash").alias("class")).agg(one).select("class", "m.bands", "m.copies", "m.sketch", "m.tied", "m.named", F.col("m.n_shingles").alias("n")))
    homes = some.where("bundle_id IS NOT NULL").select("bundle_id", F.col("mask_hash").alias("class")).distinct()
    at_home = homes.join(classes.select("class", "bands", "n"), "class").select("bundle_id", "class", "n", F.explode("bands").alias("band"))
    here = at_home.select(F.xxhash64("bundle_id", "band").bitwiseAND(F.lit(~3)).alias("key"), "class", "n")
    keys = here.union(classes.select(F.explode("copies").alias("key"), "class", "n"))
    met = cut(keys.repartition("key").sortWithinPartitions("key", "class").mapInPandas(_met, "a long, b long, kind int, key long"))
    # in the order of kinds
    sketches = F.posexplode(F.array("sketch", "tied", "named")).alias("kind", "sketch")
    told = classes.select("class", sketches).where("sketch IS NOT NULL")

    def worth(pairs: DataFrame) -> DataFrame:
        """Pairs ``(a, b)`` of those with a kind that the sketches of that kind tell to be similar."""
        both = pairs.join(told.toDF("a", "kind", "sketch_a"), ["a", "kind"]).join(told.toDF("b", "kind", "sketch_b"), ["b", "kind"])
        return cut(both.where(_estimate("sketch_a", "sketch_b") >= WORTH).select("a", "b").distinct())

    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    links = _verified(worth(met.where("a <> b").select(*ends, "kind").distinct()), feats, files)
    crowds = met.where("key IS NOT NULL AND a <> b").select("key", "kind", F.col("b").alias("member"), *ends)
    if crowds.isEmpty():
        return links
    bonds = links.select("a", "b", (F.col("copy") >= SIMILAR).alias("copies"))
    tied = F.coalesce(F.when(F.col("kind") == HOME, F.col("copies").isNotNull()).otherwise(F.col("copies")), F.lit(False))
    placed = crowds.join(bonds, ["a", "b"], "left").select("key", "kind", F.col("member").alias("class"), tied.alias("tied")).join(classes.select("class", "n"), "class")
    placed = cut(placed.select("key", "kind", "class", "tied", "n"))
    x, y = placed.where("NOT tied").select("key", "kind", F.col("class").alias("x"), F.col("n").alias("n_x")), placed.select("key", F.col("class").alias("y"), "tied", F.col("n").alias("n_y"))
    can = ((F.col("x") < F.col("y")) | F.col("tied")) & (F.col("x") != F.col("y")) & (F.least("n_x", "n_y") >= (SIMILAR - 1e-9) * F.greatest("n_x", "n_y"))
    rest = x.join(y, "key").where(can).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "kind").distinct()
    return cut(links.union(_verified(worth(rest.join(links, ["a", "b"], "left_anti")), feats, files)))


def _homes(feats: DataFrame, by: str) -> DataFrame:
    """Per class: where its files are, how long they are, and whether they are more than one file read twice."""
    return feats.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.min("bundle_id").alias("low"),
        F.max("bundle_id").alias("high"),
        F.max("n_tokens").alias("n_tokens"),
        F.max("mask_hash").alias("class"),
        # one file read for two repositories is the same path and the same bytes twice, not a copy in another place
        ((F.count(F.lit(1)) > 2) | (F.min("path") != F.max("path")) | (F.min("digest") != F.max("digest"))).alias("spread"),
        F.max(F.coalesce(F.col("mark") == "library", F.lit(False))).alias("known"),
    )


def _families(feats: DataFrame, links: DataFrame) -> DataFrame:
    """``(bundle_id, mask_hash)`` of connected look-alikes, ``FAMILY`` texts or more, of one repository."""
    at = feats.where("bands IS NOT NULL AND bundle_id IS NOT NULL").groupBy("bundle_id", "mask_hash").agg(F.count_distinct("raw_hash").alias("k"))
    at = cut(at)
    ends = at.select(F.col("bundle_id").alias("home"), F.col("mask_hash").alias("a")), at.select(F.col("bundle_id").alias("home"), F.col("mask_hash").alias("b"))
    kin = links.select("a", "b").join(ends[0], "a").join(ends[1], ["home", "b"]).select("home", "a", "b")
    both = cut(kin.union(kin.select("home", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(at.select(F.col("bundle_id").alias("home"), F.col("mask_hash").alias("a"), F.col("mask_hash").alias("l")))
    while True:
        near = both.join(label.select("home", F.col("a").alias("b"), "l"), ["home", "b"]).select("home", "a", "l").union(label).groupBy("home", "a").agg(F.min("l").alias("l"))
        # the label of the label is of the same family
        more = cut(near.join(label.select("home", F.col("a").alias("l"), F.col("l").alias("ll")), ["home", "l"]).select("home", "a", F.least("l", "ll").alias("l")))
        if more.join(label.withColumnRenamed("l", "old"), ["home", "a"]).where("l <> old").isEmpty():
            break
        label = more
    sized = label.join(at.select(F.col("bundle_id").alias("home"), F.col("mask_hash").alias("a"), "k"), ["home", "a"])
    large = sized.groupBy("home", "l").agg(F.sum("k").alias("n")).where(F.col("n") >= FAMILY)
    return label.join(large, ["home", "l"], "left_semi").select(F.col("home").alias("bundle_id"), F.col("a").alias("mask_hash"))


def _vendored(feats: DataFrame, links: DataFrame) -> DataFrame:
    """Classes with copies, exact, changed or renamed, in several repositories, and copies of what a library's header names."""
    homes = cut(_homes(feats, "mask_hash"))
    ends = homes.select("mask_hash", "low", "high")
    copies = cut(links.where(F.col("copy") >= SIMILAR).select("a", "b"))
    placed = copies.join(ends.toDF("a", "low_a", "high_a"), "a").join(ends.toDF("b", "low_b", "high_b"), "b")
    across = placed.where(F.least("low_a", "low_b") != F.greatest("high_a", "high_b"))
    # by chance two short files may be equal, or two of some length but for their names
    apart = (F.col("low") != F.col("high")) & F.col("spread")
    spans = homes.where(apart & (F.col("n_tokens") >= LONG_TOKENS)).select("mask_hash")
    equal = _homes(feats, "raw_hash").where(apart & (F.col("n_tokens") >= LEAST_TOKENS)).select("class")
    known = homes.where(F.col("known") & (F.col("n_tokens") >= LEAST_TOKENS)).select("mask_hash")
    found = cut(spans.union(equal).union(known).union(across.select("a")).union(across.select("b")).distinct())
    n = found.count()
    both = copies.select("a", "b").union(copies.select("b", "a"))
    while True:
        more = cut(found.union(both.join(found, both["a"] == found["mask_hash"], "left_semi").select(F.col("b"))).distinct())
        if (k := more.count()) == n:
            return more
        found, n = more, k


def machine_files(files: DataFrame) -> DataFrame:
    """One row ``(file_id, reason)`` for each file nobody wrote by hand.

    ``reason`` is the first that holds of ``lock``, ``map`` (by name or keys), ``blob``
    (literals alone, in a form that other files share), ``vendored`` (a copy that several
    repositories hold, or one of a library that names itself), ``family`` (look-alikes
    within a repository), and of what a file without company is told by: ``generated`` or
    ``library`` (its header), ``minified``, ``literals``, ``third-party`` (its directory).
    Null paths and contents count as empty, and an empty file is nobody's; a file read
    twice in one repository is one file; rows of one id give one row; an empty table
    gives an empty result.
    """
    src = files.select(F.col("file_id").cast("long").alias("file_id"), F.col("bundle_id").cast("long").alias("bundle_id"), "path", "content").where("file_id IS NOT NULL")
    feats = cut(src.mapInPandas(features, _FEATURES))
    links = linked(feats, src)
    vendored = _vendored(feats, links).withColumn("vendored", F.lit(True))
    family = _families(feats, links).withColumn("family", F.lit(True))
    forms = feats.where("form IS NOT NULL").groupBy("form").agg((F.count_distinct("raw_hash") > 1).alias("shared_form"))
    own = F.lower(F.concat(F.lit("/"), F.regexp_replace("path", r"[^/]*$", ""))).rlike("/(" + "|".join(sorted(VENDOR_DIRS)) + ")/")
    told = feats.select("file_id", "bundle_id", "mark", "form", "mask_hash", (own & F.col("raw_hash").isNotNull()).alias("own"))
    out = told.join(vendored, "mask_hash", "left").join(family, ["bundle_id", "mask_hash"], "left").join(forms, "form", "left")
    reason = (
        F.when(F.col("mark").isin("lock", "map"), F.col("mark"))
        .when(F.col("shared_form"), F.lit("blob"))
        .when(F.col("vendored"), F.lit("vendored"))
        .when(F.col("family"), F.lit("family"))
        .when(F.col("mark").isNotNull(), F.col("mark"))
        .when(F.col("form").isNotNull(), F.lit("literals"))
        .when(F.col("own"), F.lit("third-party"))
    )
    return out.select("file_id", reason.alias("reason")).where("reason IS NOT NULL").groupBy("file_id").agg(F.min("reason").alias("reason"))
