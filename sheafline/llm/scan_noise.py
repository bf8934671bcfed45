"""Noise of scanned pages: words broken across lines, misread glyphs, running furniture.

The corpus itself is the dictionary. A first pass over all pages counts words, the pairs
of halves at line ends, and pairs of a word's parts (hashed runs of its letters) with the
words around it. From the pairs skip-gram vectors are trained with negative sampling; as a
word's vector is that of its parts, a misread word lies near the one it was. Each rare
word is linked to the frequent word that a plausible glyph edit and nearness in the vector
space lead to (or split into two frequent words), and halves are judged by whether the
corpus knows them joined or with their own hyphen. A second pass takes up the words that
have a link, line by line; where frequency leaves a link open, the vectors decide in the
context of each occurrence. Then furniture is dropped and paragraphs are reflowed.

Words and their links stay in tables that are joined; what is broadcast (vectors, and
bitmaps of the words worth asking for) has a fixed size.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest, xxh64_intdigest

from ..session import cut

DOCUMENT_ENDINGS = ("pdf", "docx", "odt", "tiff")
#: Letters beyond which a run of characters is no word but a code or an address.
LONGEST_WORD = 40
#: Hashed parts of words and hashed contexts that vectors are learned of, their length, the window, and negative samples a pair.
PARTS, CONTEXTS, LENGTH, WINDOW, NEGATIVES = 4096, 128, 24, 2, 5
#: What nearness in the vector space counts against the logarithm of a frequency.
NEARNESS = 2.0
#: Bits of a bitmap of words.
BITMAP_BITS = 1 << 26
#: A target occurs so many times, and so many times as often as what is linked to it.
TARGET_LEAST, RATIO, SURE_RATIO = 12, 12, 60

# fixed values: what a glyph or pair of glyphs is misread as -> what it was
GLYPHS = [
    ("c", "e"), ("e", "c"), ("+", "t"), ("f", "t"), ("t", "f"), ("0", "o"), ("l", "i"), ("i", "l"), ("ri", "n"), ("n", "ri"), ("cl", "d"), ("d", "cl"), ("5", "s"), ("!", "i"), ("!", "l"),
    ("1", "l"), ("1", "i"), ("|", "l"), ("|", "i"), ("rn", "m"), ("m", "rn"), ("ii", "u"), ("u", "ii"), ("b", "h"), ("h", "b"), ("9", "g"), ("q", "g"), ("v", "y"), ("y", "v"), ("vv", "w"), ("w", "vv"),
    ("6", "b"), ("8", "b"), ("m", "in"), ("in", "m"), ("h", "li"), ("li", "h"), ("m", "ni"), ("nn", "m"), ("ni", "m"), ("$", "s"), ("@", "a"), ("4", "a"), ("3", "e"), ("7", "t"), ("2", "z"), ("u", "n"), ("n", "u"),
    ("o", "a"), ("a", "o"), ("o", "c"), ("tl", "d"), ("lc", "k"), ("fi", "h"), ("ll", "u"), ("(", "c"), ("j", "i"), ("i", "j"), ("€", "e"), ("é", "e"), ("á", "a"), ("ó", "o"), ("í", "i"), ("ü", "u"), ("ö", "o"),
]
_INVERSE: dict[str, list[str]] = {}
for _seen, _true in GLYPHS:
    _INVERSE.setdefault(_seen, []).append(_true)
#: Set for the hyphen of a word that was found broken, until its halves are joined.
BROKEN = "\x01"
HYPHENS = "-\u2010\u00ad\u00ac\u2011" + BROKEN
_HY = r"\-\u2010\u00ad\u00ac\u2011\x01"

_PAGE_MARK = re.compile(r"\s*# Page \d+\s*$")
_PLACEHOLDER = re.compile(r"\s*\[Image: [^\]]*\]\s*$")
_BREAK = re.compile(rf"([^\W\d_][\w'’{_HY}]*)[{_HY}]\s*$")
_EDGE = ".,;:?\"()[]{}“”„‘’«»…*_~"
_PARTS = re.compile(r"[\-\u2010\u2011\u00ad\u2013\u2014/]+")
_NUMBER = r"(?:[\dlIOoSBZ|]{1,5}|[ivxlc]{1,8}|[IVXLC]{2,8})"
_NUMERIC = re.compile(rf"^(?=.*\d)(?=.*[lIOoSBZ|])[\dlIOoSBZ|]+(?:[.,:][\dlIOoSBZ|]+)*%?$|^(?=.*[lI|])(?=.*[Oo])[lIOo|]{{2,}}$|^(?:S[lS]|lS|ll)$")
_MIXED = re.compile(r"[^\W\d_][0-9!+@$|][^\W\d_]|^[0-9!+@$|][^\W\d_]{2,}$|^[^\W\d_]{2,}[0-9+@$|]$")
_BARE = re.compile(rf"\s*({_NUMBER})\s*$")
_DRESSED = re.compile(
    rf"\s*(?:[-–—~•·*=]+\s*({_NUMBER})\s*[-–—~•·*=]+|[\[(<{{]\s*({_NUMBER})\s*[\])>}}]|(?:p|pp|pg|[Pp]age|PAGE|[Ss]eite|[Pp]ágina|S|Bl)\.?\s*({_NUMBER})(?:\s*(?:of|/|von|de|sur|out of)\s*{_NUMBER})?|({_NUMBER})\s*(?:/|of|von)\s*{_NUMBER})\s*$"
)
_WITH_NUMBER = re.compile(rf"\s*(?:(?P<n>{_NUMBER})\s*(?:\||[-–—:·]|\s)\s*(?P<t>\S.*?)|(?P<u>\S.*?)\s*(?:\||[-–—:·]|\s)\s*(?P<m>{_NUMBER}))\s*$")
#: A title in capitals set off from its number, or one divided from it by a bar.
_SET_OFF = re.compile(rf"\s*(?:{_NUMBER}\s{{2,}}[^a-z]*|[^a-z]*\s{{2,}}{_NUMBER}|.*\s\|\s*{_NUMBER}|{_NUMBER}\s*\|\s.*)\s*$")
_ROW = re.compile(rf"\s*{_NUMBER}(?:[.,]{_NUMBER})*(?:\s{{2,}}{_NUMBER}(?:[.,]{_NUMBER})*)+\s*$")
#: A word in capitals that another ran into.
_RUN_IN = re.compile(r"([a-z]{1,12})([A-Z][a-z]{2,})")
_TO_DIGIT = str.maketrans({"l": "1", "I": "1", "|": "1", "O": "0", "o": "0", "S": "5", "B": "8", "Z": "2"})
_SMALL = frozenset("a an and as at by de der des die du et for from in la le les of on or the to und vs with y".split())


_ROMAN = re.compile(r"(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")


def page_number(s: str | None) -> int:
    """The value of a page number, Roman or with letters read for digits; -1 if it has none."""
    t = (s or "").translate(_TO_DIGIT)
    if t.isdigit():
        return int(t)
    r = (s or "").lower()
    if not r or not _ROMAN.fullmatch(r):
        return -1
    values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in r]
    return sum(-v if any(w > v for w in values[k + 1 : k + 2]) else v for k, v in enumerate(values))


def titled(s: str) -> bool:
    """Whether a line is set like a heading: capitals, or a capital to each word, and no end of sentence."""
    if len(s) > 90 or re.search(r"[.;:?!,]$", s):
        return False
    w = [x for x in re.split(r"[\s,|–—-]+", s) if x]
    if not 2 <= len(w) <= 12:
        return False
    letters = [c for c in s if c.isalpha()]
    if len(letters) < 5:
        return False
    if sum(c.isupper() for c in letters) >= 0.85 * len(letters):
        return True
    return sum(x[0].isupper() or not x[0].isalpha() for x in w if x.lower() not in _SMALL) == sum(x.lower() not in _SMALL for x in w) and w[0][0].isupper()


class Candidate(NamedTuple):
    """A line that may be furniture. ``form``: dressed or bare number, title with number, title.

    ``beside``: a table's row stands next to it; ``alone``: blank lines around it, or set in far.
    """

    line: int
    form: str
    value: int
    words: tuple[str, ...]
    edge: bool
    beside: bool
    alone: bool


def _fold(w: str) -> str:
    return w.casefold().translate(str.maketrans("01|!5689$", "olliabggs"))


def candidates(lines: list[str], starts: set[int]) -> list[Candidate]:
    """Lines that may be furniture; ``starts`` are numbers of lines at which a page begins, if known."""
    full = [i for i, x in enumerate(lines) if x.strip() and not _PAGE_MARK.match(x) and not _PLACEHOLDER.match(x)]
    edges = set()
    if full:
        edges |= {full[0], full[-1]}
    for p in starts:
        k = bisect_left(full, p)
        edges |= set(full[max(0, k - 1) : k + 1])
    out = []
    for k, i in enumerate(full):
        raw = lines[i].strip("\x0c\r")
        s = raw.strip()
        if len(s) > 90:
            continue
        indent = len(raw) - len(raw.lstrip(" "))
        alone = indent >= 8 or all(not 0 <= j < len(lines) or not lines[j].strip() for j in (i - 1, i + 1))
        beside = any(0 <= j < len(full) and abs(full[j] - i) == 1 and _ROW.match(lines[full[j]]) for j in (k - 1, k + 1))
        if m := _DRESSED.match(raw):
            out.append(Candidate(i, "dressed", page_number(m[1] or m[2] or m[3] or m[4]), (), i in edges, beside, alone))
        elif (m := _BARE.match(raw)) and page_number(m[1]) >= 0:
            out.append(Candidate(i, "bare", page_number(m[1]), (), i in edges, beside, alone))
        elif _ROW.match(raw):
            continue
        else:
            m = _WITH_NUMBER.match(raw)
            if m and titled((m["t"] or m["u"]).strip(" |–—-:·")):
                t = (m["t"] or m["u"]).strip(" |–—-:·")
                out.append(Candidate(i, "numbered", page_number(m["n"] or m["m"]), tuple(_fold(w) for w in re.findall(r"\w{3,}", t)), i in edges, beside, alone))
            elif titled(s):
                out.append(Candidate(i, "title", -1, tuple(_fold(w) for w in re.findall(r"\w{3,}", s)), i in edges, beside, alone))
    return out


def _repeated(titles: list[Candidate]) -> set[int]:
    """Lines of titles that stand more than once: half of their words do, or one half of their letters.

    Counted by word and by half, so that a document may have any number of them.
    """
    words: Counter = Counter()
    halves: Counter = Counter()
    for c in titles:
        words.update(set(c.words))
        halves.update(_halves(c))
    found = set()
    for c in titles:
        own = set(c.words)
        if own and (2 * sum(words[w] > 1 for w in own) >= len(own) or any(halves[h] > 1 for h in _halves(c))):
            found.add(c.line)
    return found


def _halves(c: Candidate) -> list[tuple[int, str]]:
    x = " ".join(c.words)
    return [(len(x), x[: len(x) // 2]), (-len(x), x[len(x) // 2 :])] if len(x) >= 8 else []


def _in_row(numbers: list[Candidate]) -> set[int]:
    """Lines of page numbers that go on, by one or two, from one some lines before or to one after."""
    first: dict[tuple[str, int], int] = {}
    last: dict[tuple[str, int], int] = {}
    for c in numbers:
        first.setdefault((c.form, c.value), c.line)
        last[c.form, c.value] = c.line
    return {c.line for c in numbers if any(last.get((c.form, c.value + k), -9) >= c.line + 4 or first.get((c.form, c.value - k), c.line) <= c.line - 4 for k in (1, 2))}


def furniture(lines: list[str], starts: set[int]) -> set[int]:
    """Indices of a whole document's running headers, footers and page numbers."""
    cands = candidates(lines, starts)
    numbers = [c for c in cands if c.form in ("dressed", "bare", "numbered") and c.value >= 0]
    in_row = _in_row(numbers)
    found = {c.line for c in cands if c.form == "dressed"}
    for c in cands:
        # a number beside rows of a table may be what is left of a row
        if c.form == "bare" and (c.line in in_row or c.alone or (c.edge and (not c.beside or c.value < 20))):
            found.add(c.line)
    titles = [c for c in cands if c.form in ("numbered", "title")]
    again = _repeated(titles)
    for c in titles:
        if c.line in again or (c.form == "numbered" and (c.line in in_row or c.edge or _SET_OFF.match(lines[c.line].strip("\x0c\r")))):
            found.add(c.line)
    # a title seen once is furniture where it stands against a page number or page start that is
    text = [i for i, x in enumerate(lines) if x.strip() and not _PAGE_MARK.match(x)]
    at = {i: k for k, i in enumerate(text)}
    several = any(c.line in found for c in titles)
    for c in titles:
        if c.line in found or c.form != "title":
            continue
        near = [text[j] for j in (at[c.line] - 1, at[c.line] + 1) if 0 <= j < len(text)]
        if any(n in found for n in near) or (several and c.edge and starts):
            found.add(c.line)
    return found


def page_starts(lines: list[str]) -> set[int]:
    return {i + 1 for i, x in enumerate(lines) if _PAGE_MARK.match(x)} | {i for i, x in enumerate(lines) if "\x0c" in x}


# -- words -------------------------------------------------------------------------------


class Token(NamedTuple):
    line: int
    raw: str
    word: str


class Page:
    """The words of a document line by line, and its broken words; furniture left out."""

    def __init__(self, text: str, skip: set[int] | None = None):
        self.lines = text.split("\n")
        self.skip = furniture(self.lines, page_starts(self.lines)) if skip is None else skip
        self.tokens: list[Token] = []
        self.broken: list[tuple[int, str, str]] = []
        half = None
        for i, line in enumerate(self.lines):
            if i in self.skip or not line.strip() or _PAGE_MARK.match(line) or _PLACEHOLDER.match(line):
                continue
            parts = line.split()
            if half is not None and parts:
                right = parts[0].strip(_EDGE)
                self.broken.append((half[0], half[1], right.rstrip(HYPHENS) if right else ""))
                parts = parts[1:]
            half = None
            # looked for only where a line ends in a hyphen: a search from every letter of a long run takes too long
            m = _BREAK.search(parts[-1]) if parts and parts[-1][-1] in HYPHENS else None
            if m and parts:
                half = (i, m[1])
                parts = parts[:-1]
            for p in parts:
                if w := p.strip(_EDGE).rstrip("!" if len(p) > 2 else ""):
                    self.tokens.append(Token(i, p, w))
        if half is not None:
            self.broken.append((half[0], half[1], ""))


def _pieces(w: str) -> list[str]:
    return [p.lower() for p in _PARTS.split(w) if p]


def key_of(left: str, right: str) -> str:
    return f"{left.lower()}\x00{right.lower()}"


def run_in_key(m: re.Match) -> str:
    return f"\x01{m[1]}\x01{m[2]}"


def count_page(page: Page, c: Counter) -> None:
    for t in page.tokens:
        w = t.word.lower()
        if w.isalpha():
            c[w] += 1
            if m := _RUN_IN.fullmatch(t.word):
                c[run_in_key(m)] += 1
            continue
        if _PARTS.search(w):
            c[re.sub(rf"[{_HY}]", "-", w)] += 1
        for p in _pieces(w):
            c[p] += 1
    for _, a, b in page.broken:
        c[key_of(a, b)] += 1


def edits(w: str) -> set[str]:
    """What ``w`` may have been: one plausible glyph edit undone."""
    out = set()
    n = len(w)
    for i in range(n):
        for k in (1, 2):
            for true in _INVERSE.get(w[i : i + k], ()) if i + k <= n else ():
                out.add(w[:i] + true + w[i + k :])
    out.discard(w)
    return out


class Linker:
    """Links rare words to frequent ones, and judges broken words, by the corpus's own counts and vectors."""

    def __init__(self, known: dict[str, int], vectors: Vectors | None = None):
        self.n, self.vectors = known, vectors

    def best(self, w: str, found: set[str]) -> str | None:
        """The nearest of the frequent words, with regard to how frequent they are."""
        if len(found) < 2 or self.vectors is None:
            return max(found, key=lambda v: (self.n[v], v), default=None)
        own = self.vectors.word(w)
        return max(found, key=lambda v: (np.log(self.n[v]) + NEARNESS * cosine(own, self.vectors.word(v)), v))

    def link(self, w: str, n: int) -> tuple[str, str, bool] | None:
        """``(kind, what it was, sure)`` for a word that is not what was printed."""
        if len(w) > LONGEST_WORD:
            return None
        known = self.n
        floor = max(TARGET_LEAST, RATIO * n)
        odd = bool(_MIXED.search(w))
        if odd:
            floor = max(2, n)
        if len(w) >= 2 and not w.isdigit():
            best = self.best(w, {v for v in edits(w) if known.get(v, 0) >= floor and v.isalpha()})
            if best is None and len(w) >= 4:
                best = self.best(w, {x for x in edits_of_edits(w) if known.get(x, 0) >= (floor if odd else 4 * floor) and x.isalpha()})
            if best is not None and (len(w) > 2 or odd or known[best] >= 200 * n):
                return "glyph", best, odd or known[best] >= SURE_RATIO * n
        if w.isalpha() and len(w) >= 3:
            cut_at = None
            for a, b in halves(w):
                low = min(known.get(a, 0), known.get(b, 0))
                if low >= max(TARGET_LEAST, 8 * n) and (cut_at is None or low > cut_at[0]):
                    cut_at = (low, f"{a} {b}")
            if cut_at and max(known.get(x, 0) for x in cut_at[1].split()) >= 60 * n:
                return "joined", cut_at[1], True
        if odd and sum(ch.isalpha() for ch in w) >= 3:
            return "glyph", w, True
        return None

    def judge(self, left: str, right: str) -> bool:
        """Whether ``left`` and ``right`` are halves of one word rather than of a compound."""
        known = self.n
        base = _PARTS.split(left)[-1]
        if not right:
            return known.get(base, 0) < 5
        joined, compound = known.get(base + right, 0), known.get(f"{left}-{right}", 0)
        if joined or compound:
            return joined >= compound
        if len(base + right) <= LONGEST_WORD and any(known.get(v, 0) >= 5 for v in edits(base + right)):
            return True
        # the corpus knows neither: two words of their own make a compound
        return not (known.get(base, 0) >= 5 and known.get(right, 0) >= 5)

    def verdict(self, key: str, n: int) -> tuple[str, str, bool] | None:
        """On any key that :func:`count_page` counts."""
        if "\x00" in key:
            left, _, right = key.partition("\x00")
            return ("broken", left + right, True) if self.judge(left, right) else None
        if key.startswith("\x01"):
            _, a, b = key.split("\x01")
            run_in = self.n.get(a, 0) >= 50 and self.n.get((a + b).lower(), 0) * 4 < self.n.get(b.lower(), 0)
            return ("joined", f"{a} {b}", True) if run_in else None
        return self.link(key, n)


def halves(w: str) -> Iterator[tuple[str, str]]:
    for i in range(1, len(w)):
        a, b = w[:i], w[i:]
        if not ((len(a) == 1 and a not in ("a", "i")) or (len(b) < 2 and (b != "a" or len(a) < 2))):
            yield a, b


def edits_of_edits(w: str) -> set[str]:
    out = {x for v in edits(w) for x in edits(v)}
    out.discard(w)
    return out


def asked_of(key: str, known: Bitmap) -> list[str]:
    """The words whose counts a verdict on ``key`` depends on, as far as the corpus may know them."""
    if "\x00" in key:
        left, _, right = key.partition("\x00")
        base = _PARTS.split(left)[-1]
        return [v for v in {base, right, base + right, f"{left}-{right}"} | (edits(base + right) if len(base + right) <= LONGEST_WORD else set()) if v in known]
    if key.startswith("\x01"):
        _, a, b = key.split("\x01")
        return [v for v in {a, (a + b).lower(), b.lower()} if v in known]
    if len(key) < 2 or len(key) > LONGEST_WORD or key.isdigit():
        return []
    out = {v for v in edits(key) if v.isalpha() and v in known}
    if len(key) >= 4:
        out |= {v for v in edits_of_edits(key) if v.isalpha() and v in known}
    if key.isalpha():
        out |= {x for a, b in halves(key) if a in known and b in known for x in (a, b)}
    return list(out)


class Bitmap:
    """A set of words as bits at their hashes: what is in the set is found, and little else."""

    def __init__(self, blocks: np.ndarray, bits: np.ndarray):
        self.words = np.zeros(BITMAP_BITS // 64, dtype=np.int64)
        self.words[blocks] = bits

    def __contains__(self, w: str) -> bool:
        h = xxh64_intdigest(w, 42) % BITMAP_BITS
        return bool((int(self.words[h >> 6]) >> (h & 63)) & 1)


def bitmap(words: DataFrame) -> Bitmap:
    """Of a column ``word``; at most ``BITMAP_BITS / 64`` rows reach the driver, however many words there are."""
    at = F.pmod(F.xxhash64("word"), F.lit(BITMAP_BITS))
    bits = words.select(at.alias("h")).groupBy(F.call_function("shiftright", "h", F.lit(6)).alias("block"))
    rows = bits.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("h", F.lit(64)).cast("int"))).alias("bits")).toPandas()
    return Bitmap(rows["block"].to_numpy("int64"), rows["bits"].to_numpy("int64"))


# -- vectors ------------------------------------------------------------------------------


def context(w: str) -> int:
    return xxh32_intdigest(w) % CONTEXTS


def parts(w: str) -> list[int]:
    """The word itself and its runs of three and four letters, hashed."""
    x = f"<{w[:LONGEST_WORD]}>"
    return list({xxh32_intdigest(p, 7) % PARTS for p in (x, *(x[i : i + k] for k in (3, 4) for i in range(len(x) - k + 1)))})


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float(a @ b / (np.sqrt((a @ a) * (b @ b)) + 1e-9))


def pair_counts(runs: list[list[str]]) -> np.ndarray:
    """How often each part stands within the window of each context, as one row of cells; runs are texts' words."""
    ids: dict[str, int] = {}
    flat = []
    for words in runs:
        flat += [ids.setdefault(w, len(ids)) for w in words]
        flat += [-1] * WINDOW
    at = np.array(flat, dtype=np.int64)
    keys = []
    for k in range(1, WINDOW + 1):
        a, b = at[:-k], at[k:]
        on = (a >= 0) & (b >= 0)
        keys += [a[on] * len(ids) + b[on], b[on] * len(ids) + a[on]]
    out = np.zeros(PARTS * CONTEXTS, dtype=np.int64)
    pairs, n = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(pairs):
        words = list(ids)
        near = np.array([context(w) for w in words])[pairs % len(ids)]
        rows = [np.array(parts(w)) for w in words]
        own, size = pairs // len(ids), np.array([len(r) for r in rows])
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        k = size[own]
        inner = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        cell = np.concatenate(rows)[np.repeat(start[own], k) + inner] * CONTEXTS + np.repeat(near, k)
        out += np.bincount(cell, weights=np.repeat(n, k), minlength=len(out)).astype(np.int64)
    return out


class Vectors:
    """Skip-gram vectors of parts of words, trained with negative sampling.

    The loss of skip-gram depends on the corpus only through the counts of pairs, and the
    expected loss of negative samples only through the counts of words. So it is minimised
    over the counts, step by step over all pairs at once: the work does not grow with the
    corpus, and the same corpus always gives the same vectors.
    """

    def __init__(self, counts: np.ndarray, steps: int = 150):
        n = counts.reshape(PARTS, CONTEXTS).astype(np.float64)
        row, col, total = n.sum(axis=1, keepdims=True), n.sum(axis=0, keepdims=True), n.sum()
        rng = np.random.default_rng(5)
        self.u = rng.normal(0, 0.1, (PARTS, LENGTH))
        self.v = rng.normal(0, 0.1, (CONTEXTS, LENGTH))
        if total:
            seen = n / (row + 1.0)
            drawn = NEGATIVES * (row / (row + 1.0)) * (col / total)
            weight = np.sqrt(row + 1.0)
            weight /= weight.mean()
            moments = [np.zeros_like(self.u), np.zeros_like(self.u), np.zeros_like(self.v), np.zeros_like(self.v)]
            for t in range(1, steps + 1):
                s = 1 / (1 + np.exp(-self.u @ self.v.T))
                g = drawn * s - seen * (1 - s)
                for k, (x, d) in enumerate(((self.u, g @ self.v), (self.v, (weight * g).T @ self.u / PARTS))):
                    m, q = moments[2 * k], moments[2 * k + 1]
                    m += 0.1 * (d - m)
                    q += 0.01 * (d * d - q)
                    x -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.99**t)) + 1e-8)
        self.u, self.v = self.u.astype(np.float32), self.v.astype(np.float32)

    def word(self, w: str) -> np.ndarray:
        return self.u[parts(w)].mean(axis=0)

    def fits(self, w: str, around) -> float:
        """How well a word goes with hashed contexts."""
        return float((self.v[np.asarray(around, dtype=np.int64)] @ self.word(w)).mean()) if len(around) else 0.0


# -- on tables ------------------------------------------------------------------------------


def pages(files: DataFrame | None, images: DataFrame | None) -> DataFrame:
    """``(row, rec_kind, rec_id, text, skip)`` of documents and page images; ``skip`` holds the lines that are furniture."""

    @F.pandas_udf("array<int>")
    def skipped(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(furniture(x := t.split("\n"), page_starts(x))) for t in texts], dtype="object")

    parts = []
    if files is not None:
        end = F.lower(F.element_at(F.split(F.coalesce("path", F.lit("")), r"\."), -1))
        f = files.where(end.isin(*DOCUMENT_ENDINGS) & F.col("content").isNotNull() & F.col("file_id").isNotNull())
        parts.append(f.select(F.lit("file").alias("rec_kind"), F.col("file_id").cast("long").alias("rec_id"), F.col("content").alias("text"), skipped(F.col("content")).alias("skip")))
    if images is not None:
        i = images.where(F.col("ocr_text").isNotNull() & F.col("image_id").isNotNull()).withColumn("image_id", F.col("image_id").cast("long"))
        skip = image_furniture(i).groupBy("image_id").agg(F.collect_list("line").alias("skip"))
        i = i.join(skip, "image_id", "left")
        parts.append(i.select(F.lit("image").alias("rec_kind"), F.col("image_id").alias("rec_id"), F.col("ocr_text").alias("text"), F.coalesce("skip", F.array().cast("array<int>")).alias("skip")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return cut(out.withColumn("row", F.monotonically_increasing_id()))


def image_furniture(images: DataFrame) -> DataFrame:
    """``(image_id, line)`` of furniture: an image is a page, the images of a file are its pages.

    What repeats is found by counting words of titles per file, so that a file may have
    any number of images. An image without a file is a document of its own.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for image, doc, text in zip(b["image_id"], b["doc"], b["ocr_text"]):
                lines = text.split("\n")
                cs = candidates(lines, page_starts(lines))
                sure = [c for c in cs if c.form == "dressed" or (c.form == "bare" and (c.alone or (c.edge and (not c.beside or c.value < 20))))]
                numbered = bool(sure) or any(c.form == "numbered" and c.edge for c in cs)
                for c in cs:
                    ok = c in sure or (c.form == "numbered" and c.edge) or (c.form == "title" and c.edge and numbered)
                    out.append((image, doc, c.line, ok, c.edge, c.form in ("title", "numbered"), list(dict.fromkeys(c.words))))
            yield pd.DataFrame(out, columns=["image_id", "doc", "line", "ok", "edge", "is_title", "words"])

    doc = F.coalesce(F.col("file_id").cast("string"), F.concat(F.lit("image "), F.col("image_id")))
    cands = cut(images.select("image_id", doc.alias("doc"), "ocr_text").mapInPandas(each, "image_id long, doc string, line int, ok boolean, edge boolean, is_title boolean, words array<string>"))
    words = cands.where("is_title AND edge").select("image_id", "doc", "line", F.explode("words").alias("w"))
    again = words.groupBy("doc", "w").agg(F.min("image_id").alias("a"), F.max("image_id").alias("z")).where("a <> z").select("doc", "w")
    share = words.join(again.withColumn("again", F.lit(1)), ["doc", "w"], "left").groupBy("image_id", "line").agg((F.sum(F.coalesce("again", F.lit(0))) / F.count(F.lit(1))).alias("share"))
    repeated = share.where("share >= 0.5").select("image_id", "line")
    return cands.where("ok").select("image_id", "line").unionByName(repeated).distinct()


def _page(text: str, skip) -> Page:
    return Page(text, {int(x) for x in skip})


#: Words of pages whose pairs are counted at once.
BLOCK_WORDS = 100_000


def statistics(src: DataFrame) -> tuple[DataFrame, Vectors]:
    """``(word, n)`` over all pages, with halves of broken words as pairs, and the vectors learned from all pages."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        runs: list[list[str]] = []
        cells, size = np.zeros(PARTS * CONTEXTS, dtype=np.int64), 0
        for b in batches:
            for text, skip in zip(b["text"], b["skip"]):
                page = _page(text, skip)
                count_page(page, c)
                runs.append([t.word.lower() for t in page.tokens])
                size += len(runs[-1])
                if size > BLOCK_WORDS:
                    cells += pair_counts(runs)
                    runs, size = [], 0
            if len(c) > 500_000:
                yield _counted(list(c), -1, list(c.values()))
                c = Counter()
        cells += pair_counts(runs)
        at = np.flatnonzero(cells)
        yield _counted(list(c), -1, list(c.values()))
        yield _counted([None] * len(at), at, cells[at])

    sums = cut(src.select("text", "skip").mapInPandas(each, "word string, cell int, n long").groupBy("word", "cell").agg(F.sum("n").alias("n")))
    # a cell for each part and context, however many pages there are
    rows = sums.where("cell >= 0").select("cell", "n").toPandas()
    cells = np.zeros(PARTS * CONTEXTS, dtype=np.int64)
    cells[rows["cell"].to_numpy("int64")] = rows["n"].to_numpy("int64")
    return sums.where("cell < 0").select("word", "n"), Vectors(cells)


def _counted(words: list, cells, n) -> pd.DataFrame:
    size = len(words)
    return pd.DataFrame({"word": pd.Series(words, dtype="object"), "cell": pd.Series(np.broadcast_to(cells, size), dtype="int32"), "n": pd.Series(n, dtype="int64")})


def verdicts(counts: DataFrame, vectors) -> DataFrame:
    """``(word, n, kind, correction, sure)`` on every word and pair of halves that isn't what was printed.

    A word asks for the counts of the words it may have been, in a join; asked for are
    only those that a bitmap of all words seen twice doesn't rule out.
    """
    spark: SparkSession = counts.sparkSession
    words = counts.where((F.col("n") >= 2) & ~F.col("word").contains("\x00") & ~F.col("word").startswith("\x01"))
    shared = spark.sparkContext.broadcast(bitmap(words))
    most = counts.agg(F.max("n")).first()[0] or 0

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            out = []
            for w, n in zip(b["word"], b["n"]):
                odd = "\x00" in w or w.startswith("\x01") or bool(_MIXED.search(w))
                if odd or max(TARGET_LEAST, 8 * n) <= most:
                    keys = asked_of(w, known)
                    out += [(w, n, k) for k in keys]
                    if not keys and odd:
                        out.append((w, n, None))
            yield pd.DataFrame({c: pd.Series([r[k] for r in out], dtype=t) for k, (c, t) in enumerate((("word", "object"), ("n", "int64"), ("key", "object")))})

    asked = counts.repartition("word").mapInPandas(ask, "word string, n long, key string")
    found = asked.join(words.select(F.col("word").alias("key"), F.col("n").alias("k")), "key", "left")
    # a word asks for a bounded number of others
    per = found.groupBy("word", "n").agg(F.collect_list(F.struct("key", "k")).alias("known"))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for w, n, known in zip(b["word"], b["n"], b["known"]):
                v = Linker({x["key"]: int(x["k"]) for x in known if x["k"] is not None and not pd.isna(x["k"])}, vectors.value).verdict(w, n)
                if v:
                    out.append((w, n, *v))
            kinds = (("word", "object"), ("n", "int64"), ("kind", "object"), ("correction", "object"), ("sure", "bool"))
            yield pd.DataFrame({c: pd.Series([r[k] for r in out], dtype=t) for k, (c, t) in enumerate(kinds)})

    return cut(per.mapInPandas(judged, "word string, n long, kind string, correction string, sure boolean"))


_OCCURRENCE = "row long, rec_kind string, rec_id long, line int, defect string, k int, raw string, word string, around array<int>, first boolean, correction string"


def occurrences(src: DataFrame) -> DataFrame:
    """``(row, rec_kind, rec_id, line, defect, k, raw, piece, correction)`` of all defects.

    ``k`` counts a page's words, ``raw`` is the word as it stands there and ``piece`` the
    part of it that ``correction`` replaces.
    """
    spark: SparkSession = src.sparkSession
    counts, learned = statistics(src)
    vectors = spark.sparkContext.broadcast(learned)
    known = verdicts(counts, vectors)
    shared = spark.sparkContext.broadcast(bitmap(known))

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = shared.value
        for b in batches:
            out = []
            for row, kind, rec, text, skip in zip(b["row"], b["rec_kind"], b["rec_id"], b["text"], b["skip"]):
                page = _page(text, skip)
                out += [(row, kind, rec, i, "furniture", -1, None, None, None, False, None) for i in sorted(page.skip)]
                out += [(row, kind, rec, i, "hyphen", -1, None, key, None, False, None) for i, left, right in page.broken if (key := key_of(left, right)) in at]
                toks = page.tokens
                for k, t in enumerate(toks):
                    if _NUMERIC.match(t.word):
                        out.append((row, kind, rec, t.line, "misread", k, t.word, None, None, False, t.word.translate(_TO_DIGIT)))
                        continue
                    m = _RUN_IN.fullmatch(t.word)
                    asked = [w for w in (*([run_in_key(m)] if m else ()), *([t.word.lower()] if t.word.isalpha() else _pieces(t.word))) if w in at]
                    if asked:
                        around = [context(x.word.lower()) for x in toks[max(0, k - WINDOW) : k] + toks[k + 1 : k + 1 + WINDOW]]
                        # the first word of an image may be the rest of one that the page before broke
                        first = kind == "image" and k == 0 and t.word[0].islower() and t.word.isalpha()
                        out += [(row, kind, rec, t.line, "misread", k, t.word, w, around, first, None) for w in asked]
            kinds = ("int64", "object", "int64", "int32", "object", "int32", "object", "object", "object", "bool", "object")
            yield pd.DataFrame({c.split()[0]: pd.Series([r[k] for r in out], dtype=t) for k, (c, t) in enumerate(zip(_OCCURRENCE.split(", "), kinds))})

    @F.pandas_udf("boolean")
    def fits(w: pd.Series, true: pd.Series, around: pd.Series) -> pd.Series:
        v = vectors.value
        return pd.Series([v.fits(b, c) >= v.fits(a, c) - 0.7 for a, b, c in zip(w, true, around)], dtype="bool")

    rows = cut(src.mapInPandas(seen, _OCCURRENCE))
    cols = ("row", "rec_kind", "rec_id", "line", "defect", "k", "raw")
    sure = rows.where("word IS NULL").select(*cols, F.col("word").alias("piece"), "correction")
    told = rows.where("word IS NOT NULL").drop("correction").join(known, "word").where(~(F.col("first") & (F.col("n") <= 5)))
    plain_ = told.where("sure").select(*cols, F.col("word").alias("piece"), "correction")
    open_ = told.where("NOT sure").where(fits("word", "correction", "around")).select(*cols, F.col("word").alias("piece"), "correction")
    return sure.unionByName(plain_).unionByName(open_)


def defects(files: DataFrame | None, images: DataFrame | None) -> DataFrame:
    """``(rec_kind, rec_id, line_no, defect)`` of every defect line of documents and page images.

    ``defect`` is ``hyphen``, ``misread`` or ``furniture``; a furniture line has no other.
    Null, empty and blank texts have no rows; rows of one id are told once; extra columns
    are ignored. Word statistics are those of all pages given. A run of more than
    ``LONGEST_WORD`` characters is no word and never misread.
    """
    found = occurrences(pages(files, images))
    return found.select("rec_kind", "rec_id", (F.col("line") + 1).cast("long").alias("line_no"), "defect").distinct()


def corrected(page: Page, fixes) -> str:
    """The text with its words corrected line by line, and the hyphens of broken words marked."""
    words: dict[int, str] = {}
    broken = set()
    for f in fixes:
        if f["defect"] == "hyphen":
            broken.add(f["line"])
            continue
        k = f["k"]
        if (piece := f["piece"]) is None or piece.startswith("\x01"):
            words[k] = f["correction"]
            continue
        at = words.get(k, f["raw"])
        i = at.lower().find(piece)
        if i >= 0:
            new = f["correction"].capitalize() if at[i : i + 1].isupper() else f["correction"]
            words[k] = at[:i] + new + at[i + len(piece) :]
    lines = list(page.lines)
    for k in sorted(words):
        t = page.tokens[k]
        if words[k] != t.word:
            lines[t.line] = lines[t.line].replace(t.word, words[k], 1)
    for i, _, right in page.broken:
        if right and i in broken:
            lines[i] = re.sub(rf"[{_HY}]\s*$", BROKEN, lines[i])
    return "\n".join(lines)


def reflowed(page: Page) -> str:
    """Continuous paragraphs: furniture gone, marked halves joined, lines of a paragraph on one line."""
    paragraphs: list[str] = []
    current, pending, gap = "", "", False
    for i, line in enumerate(page.lines):
        s = " ".join(line.replace("\x0c", " ").split())
        if i in page.skip:
            continue
        if not s:
            gap = True
            continue
        alone = bool(_PAGE_MARK.match(line) or _PLACEHOLDER.match(line) or _ROW.match(line) or re.match(r"\s*(?:[-*•]|\d+[.)])\s", line))
        ended = bool(re.search(r"[.!?:\"”)]$", current))
        if current and (alone or pending == "alone" or (ended and (gap or line.startswith("   ")))):
            paragraphs.append(current)
            current = ""
        if current.endswith(BROKEN):
            current = current[:-1] + s
        else:
            current = f"{current} {s}" if current else s
        pending, gap = ("alone" if alone else "text"), False
    if current:
        paragraphs.append(current)
    return "\n\n".join(paragraphs).replace(BROKEN, "-")


def repaired(files: DataFrame | None, images: DataFrame | None) -> DataFrame:
    """``(rec_kind, rec_id, text)``: every document and page image as continuous paragraphs."""
    src = pages(files, images)
    found = occurrences(src).where("defect <> 'furniture'")
    # the defects of one text
    fixes = found.groupBy("row").agg(F.collect_list(F.struct("line", "defect", "k", "raw", "piece", "correction")).alias("fixes"))

    @F.pandas_udf("string")
    def mended(text: pd.Series, skip: pd.Series, fix: pd.Series) -> pd.Series:
        out = []
        for t, s, f in zip(text, skip, fix):
            page = _page(t, s)
            if f is not None:
                page = _page(corrected(page, f), s)
            out.append(reflowed(page))
        return pd.Series(out, dtype="object")

    return src.join(fixes, "row", "left").select("rec_kind", "rec_id", mended("text", "skip", "fixes").alias("text"))
