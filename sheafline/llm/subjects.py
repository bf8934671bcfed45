"""Subject areas of documents from weak labelling functions.

A lexicon is induced first: words of labelled documents and of the subjects'
descriptions seed it, and expectation-maximisation over the sentences of *all*
documents extends and corrects it, in whatever languages the corpus is written in.
Four functions then vote on each document - its sentences' lexicon words, the
addresses in it, its headings, and the source it comes from - and a latent model
learns from their agreements alone how accurate each is. Its posterior is the prior
of the subjects of a document's sentences; from the posteriors of the sentences follows,
for each subject, the probability that a given share of them is about it, and a document
gets the subjects for which that is more likely than not.

After one pass over the texts all words are numbers: words are hashed into a fixed number
of places, a part of them for each language, so that lexicon and broadcasts have a fixed
size whatever the corpus holds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from ..session import cut
from .leakage import Grams, passages
from .text import WORD, plain

#: Places of words, divided among the languages; and of sources.
PLACES = 1 << 20
#: Labelled rows the seeds are read from, and documents that languages are learned from (those of lowest hash).
LABELLED_ROWS, LANGUAGE_ROWS = 1_000_000, 10_000
#: Documents that have to claim a language for it to be learned.
LANGUAGE_LEAST = 5
ROUNDS = 5
#: Share of a document's sentences that a subject takes to be one of its subjects.
LEAST_SHARE = 0.25
#: Successive words of an evaluation item that make a sentence a passage of it; shorter than a leak, as quotes are cut short.
PASSAGE_WORDS = 5

_FENCE = re.compile(r"^\s*(```|~~~)")
_HEADING = re.compile(r"^\s{0,3}#{1,6}\s+\S|^\s*(?:title|source|date|author|lang(?:uage)?|tags|url|captured|byline)\s*:\s", re.I)
_BULLET = re.compile(r"^\s*(?:[-*+•>|]|\d+[.)])\s")
_SPEAKER = re.compile(r"^\s*(?:>\s*)*(?:\*\*[^*\n]{1,60}\*\*(?:\s*[·|–—-]\s*[\d:/. -]{4,20})?|[^\W\d_][\w'’-]{1,30}:(?=\s))\s*")
_END = re.compile(r"(?<=[.!?…])[\"'”’)]*\s+")
_LETTERS = re.compile(r"[^\W\d_]{2,}")
_ADDRESS = re.compile(r"https?://[^\s<>\"')\]]+|\bwww\.[^\s<>\"')\]]+")


class Parsed(NamedTuple):
    """Sentences, headings and addresses of a document; code is in neither."""

    sentences: list[str]
    heads: list[str]
    links: list[str]


def sentences(text: str) -> tuple[list[str], list[str], list[str]]:
    return tuple(parsed(text))


def parsed(text: str) -> Parsed:
    body: list[str] = []
    heads: list[str] = []
    fence = front = False
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if lines and lines[0].strip() == "---" and any(x.strip() == "---" for x in lines[1:30]):
        front = True
    for k, line in enumerate(lines):
        t = line.strip()
        if front and k:
            if t == "---":
                front = False
            elif re.match(r"title\s*:", t, re.I):
                heads.append(t.partition(":")[2])
            continue
        if _FENCE.match(line):
            fence = not fence
            continue
        if fence or (front and k == 0):
            continue
        speaker = _SPEAKER.match(line)
        if speaker:  # who speaks is not what is spoken of
            t = line[speaker.end() :].strip()
            body.append("")
        if not t:
            body.append("")
        elif _HEADING.match(line):
            if t.startswith("#"):
                heads.append(t.lstrip("# "))
            body.append("")
        elif body and body[-1] and not re.search(r"[.!?:…\"”]$", body[-1]) and not _BULLET.match(line):
            body[-1] += " " + t  # a wrapped line
        else:
            body.append(t)
    out = [s for p in body if p for s in _END.split(plain(p)) if s.strip()]
    return Parsed(out, heads, _ADDRESS.findall(text))


def tokens(s: str) -> list[str]:
    return list(dict.fromkeys(w for w in _LETTERS.findall(s.casefold())))


def worded(parts: list[str]) -> list[list[str]]:
    """The words of each of the sentences that have any."""
    return [w for s in parts if (w := tokens(s))]


def flat(sents: list[list[int]]) -> np.ndarray:
    return np.array([i for s in sents for i in s], dtype=np.int32)


#: Documents a scan holds as arrays at once.
BLOCK = 400


class Lexicon:
    """Per place of a word the share of each subject, as if all subjects were equally common."""

    def __init__(self, places: np.ndarray, shares: np.ndarray):
        self.n = shares.shape[1]
        self.at = np.full(PLACES, len(places), dtype=np.int32)
        self.at[places] = np.arange(len(places), dtype=np.int32)
        # the last row stands for words without a subject
        self.log = np.vstack([np.log(shares + 0.02), np.zeros(self.n)])
        self.size = len(places)


def posterior(scores: np.ndarray, prior: np.ndarray | None = None) -> np.ndarray:
    """Rows of log-likelihoods as probabilities."""
    x = scores if prior is None else scores + np.log(prior + 1e-3)
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


class Block:
    """Some documents as arrays: the places of words, the sentence of each, the document of each sentence."""

    def __init__(self, ids, sizes, lex: Lexicon):
        self.n_docs = len(ids)
        lengths = np.concatenate(list(sizes)).astype(np.int64) if len(sizes) else np.zeros(0, dtype=np.int64)
        self.doc = np.repeat(np.arange(len(sizes)), [len(x) for x in sizes])
        self.ids = np.concatenate(list(ids)).astype(np.int64) if len(ids) else np.zeros(0, dtype=np.int64)
        self.sent = np.repeat(np.arange(len(lengths)), lengths)
        if len(self.ids):
            index = lex.at[self.ids]
            starts = np.cumsum(lengths) - lengths
            self.scores = np.add.reduceat(lex.log[index], starts, axis=0)
            self.known = np.add.reduceat((index < lex.size).astype(np.int64), starts)
        else:
            self.scores, self.known = np.zeros((0, lex.n)), np.zeros(0, dtype=np.int64)
        self.has = self.known > 0
        self.own = posterior(self.scores) if len(self.scores) else self.scores

    def theta(self) -> np.ndarray:
        """Per document the sum of its sentences' subjects."""
        out = np.zeros((self.n_docs, self.own.shape[1]))
        np.add.at(out, self.doc[self.has], self.own[self.has])
        return out

    def by_word(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, and the sums over each word's occurrences of the rows of their sentences."""
        order = np.argsort(self.ids, kind="stable")
        places, starts = np.unique(self.ids[order], return_index=True)
        return places, np.add.reduceat(weights[self.sent[order]], starts, axis=0) if len(order) else np.zeros((0, weights.shape[1]))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for i in range(0, len(b), BLOCK):
            yield b.iloc[i : i + BLOCK]


def _one(parts: pd.Series, lex: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Per document the subjects of its headings (or addresses) taken together, and whether they have any."""
    block = Block(parts.tolist(), [[len(x)] if len(x) else [] for x in parts], lex)
    p, has = np.zeros((len(parts), lex.n)), np.zeros(len(parts), dtype=bool)
    p[block.doc[block.has]] = block.own[block.has]
    has[block.doc[block.has]] = True
    return p, has


class Sums:
    """Sums of rows by place, handed on whenever they are many."""

    def __init__(self, n: int):
        self.n, self.places, self.rows, self.k = n, [], [], 0

    def add(self, places: np.ndarray, rows: np.ndarray) -> None:
        self.places.append(places)
        self.rows.append(rows)
        self.k += len(places)

    def frame(self) -> pd.DataFrame:
        """``(place, subject, c)`` of what was added; the column behind the last subject holds totals."""
        places = np.concatenate(self.places) if self.places else np.zeros(0, dtype=np.int64)
        rows = np.concatenate(self.rows) if self.rows else np.zeros((0, self.n))
        at, inverse = np.unique(places, return_inverse=True)
        total = np.zeros((len(at), self.n))
        np.add.at(total, inverse, rows)
        i, j = np.nonzero(total)
        self.places, self.rows, self.k = [], [], 0
        return pd.DataFrame({"place": at[i].astype("int64"), "subject": j.astype("int32"), "c": total[i, j].astype("float64")})


def _counts(lexicon, n: int, soft: bool):
    """Expected subject counts of the words of a batch of documents.

    A word learns from the *other* sentences of its documents (and from their labels),
    so that phrases found beside every subject can't confirm themselves.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex, sums = Lexicon(*lexicon.value), Sums(n + 1)
        for b in _blocks(batches):
            block = Block(b["ids"].tolist(), b["sizes"].tolist(), lex)
            theta = block.theta()
            head, _ = _one(b["heads"], lex)
            told = 0.5 * head
            for k, labels in enumerate(b["labels"]):
                if labels is not None and len(labels):
                    told[k] = 0.0
                    told[k, labels] = 2.0
            d, has = block.doc, block.has
            around = np.maximum(theta[d] - np.where(has[:, None], block.own, 0) + told[d], 0)
            p = (around + 0.1) * (block.own + 0.05)
            w = np.minimum(1.0, 0.2 + 0.4 * around.sum(axis=1))
            lead = theta[d] + told[d]
            led = ~has & (lead.max(axis=1) > 0.6 * lead.sum(axis=1)) & (lead.sum(axis=1) > 0) if soft else np.zeros(len(d), dtype=bool)
            p = np.where(has[:, None], p, lead + 0.05)
            w = np.where(has, w, np.where(led, 0.3, 0.0))
            p = p / p.sum(axis=1, keepdims=True) * w[:, None]
            sums.add(*block.by_word(np.hstack([p, w[:, None]])))
            if sums.k > 500_000:
                yield sums.frame()
        yield sums.frame()

    return each


_SUM = "place long, subject int, c double"


def _summed(parts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and their sums; no more than ``PLACES`` of them, however many documents there are."""
    rows = parts.groupBy("place", "subject").agg(F.sum("c").alias("c")).toPandas()
    at, inverse = np.unique(rows["place"].to_numpy("int64"), return_inverse=True)
    out = np.zeros((len(at), n + 1))
    out[inverse, rows["subject"].to_numpy("int64")] = rows["c"].to_numpy("float64")
    return at, out


def _induced(places: np.ndarray, counts: np.ndarray, span: int, least: float = 4.0, share: float = 0.45) -> tuple[np.ndarray, np.ndarray]:
    """The words whose subjects differ, beyond chance, from those of all words of their language (``span`` places)."""
    n = counts.shape[1] - 1
    c, size = counts[:, :n], counts[:, n:]
    lang = places // span
    base = np.zeros((int(lang.max()) + 1 if len(lang) else 0, n))
    np.add.at(base, lang, c)
    base = (base / (base.sum(axis=1, keepdims=True) + 1e-9) + 0.02) / (1 + 0.02 * n)
    b = base[lang]
    smooth = (c + 0.5 * b) / (size + 0.5)
    lifts = smooth / b
    gain = size[:, 0] * (smooth * np.log(lifts)).sum(axis=1)
    q = lifts / lifts.sum(axis=1, keepdims=True)
    kept = (size[:, 0] >= 1.5) & (q.max(axis=1, initial=0) >= share) & (gain >= least)
    return places[kept], q[kept]


class Hashes(dict):
    """Places of words within the part of a language; what was seen is kept."""

    def __init__(self, span: int):
        super().__init__()
        self.span = span

    def __missing__(self, w: str) -> int:
        k = self[w] = xxh64_intdigest(w) % self.span
        return k

    def __reduce__(self):
        return Hashes, (self.span,)


class Tongues:
    """Languages of sentences by naive Bayes over words."""

    def __init__(self, langs: list[str], words: list[str], shares: np.ndarray):
        self.langs = langs
        self.at = {w: i for i, w in enumerate(words)}
        self.log = np.vstack([np.log(shares.reshape(len(words), len(langs)) + 0.02), np.zeros(len(langs))])
        self.span = PLACES // max(1, len(langs))
        self.hashes = Hashes(self.span)

    def of(self, sents: list[list[str]]) -> list[int]:
        """The language of each sentence; one of at most one known word has that of its document."""
        if not sents:
            return []
        at, last = self.at, len(self.at)
        index = np.fromiter((at.get(w, last) for s in sents for w in s), dtype=np.int64)
        sizes = np.array([len(s) for s in sents])
        starts = np.cumsum(sizes) - sizes
        scores = np.add.reduceat(self.log[index], starts, axis=0)
        known = np.add.reduceat((index != last).astype(np.int64), starts)
        return np.where(known >= 2, scores.argmax(axis=1), scores.sum(axis=0).argmax()).tolist()

    def placed(self, sents: list[list[str]]) -> list[list[int]]:
        """Words as places, each sentence in the part of its language."""
        hashes, span = self.hashes, self.span
        if len(hashes) > 500_000:
            hashes.clear()
        return [[lang * span + hashes[w] for w in s] for s, lang in zip(sents, self.of(sents))]


def _tongues(docs: DataFrame) -> tuple[list[str], list[str], np.ndarray]:
    """Words that tell languages apart, from the languages documents claim (wrong ones are outvoted)."""
    claimed = docs.withColumn("l", F.lower(F.substring(F.trim("lang"), 1, 2))).where(F.col("l").rlike("^[a-z]{2}$") & (F.col("l") != "un"))
    known = cut(claimed.select("l", "text", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(LANGUAGE_ROWS).drop("h"))
    size = {r.l: r["count"] for r in known.groupBy("l").count().collect() if r["count"] >= LANGUAGE_LEAST}
    langs = sorted(size, key=lambda x: (-size[x], x))
    if len(langs) < 2:
        return langs or ["xx"], [], np.zeros((0, max(1, len(langs))))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: Counter = Counter()
            for lang, text in zip(b["l"], b["text"]):
                c.update((w, lang) for w in {w for s in parsed(text).sentences for w in tokens(s)})
            yield pd.DataFrame({"word": pd.Series([w for w, _ in c], dtype="object"), "l": pd.Series([x for _, x in c], dtype="object"), "c": pd.Series(list(c.values()), dtype="int64")})

    # one row a word and language of a bounded number of documents
    rows = known.where(F.col("l").isin(langs)).mapInPandas(each, "word string, l string, c long").groupBy("word", "l").agg(F.sum("c").alias("c")).toPandas()
    words, index = np.unique(rows["word"].to_numpy(dtype="U" if len(rows) else "U1"), return_inverse=True)
    counts = np.zeros((len(words), len(langs)))
    counts[index, rows["l"].map({x: i for i, x in enumerate(langs)}).to_numpy("int64")] = rows["c"]
    lifts = (counts + 0.01) / np.array([float(size[x]) for x in langs])
    q = lifts / lifts.sum(axis=1, keepdims=True)
    kept = (counts.sum(axis=1) >= 3) & (q.max(axis=1, initial=0) >= 0.6)
    return langs, words[kept].tolist(), q[kept]


class LabelModel:
    """One-coin accuracies per function and subject, learned by EM from vote patterns."""

    def __init__(self, n: int, functions: int):
        self.n, self.f = n, functions
        self.prior = np.full(n, 1.0 / n)
        self.acc = np.full((functions, n), 0.7)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Rows of votes (-1 abstains) to rows of subject probabilities."""
        lp = np.tile(np.log(self.prior), (len(votes), 1))
        for k in range(self.f):
            v = votes[:, k]
            on = v >= 0
            wrong = np.log((1 - self.acc[k]) / max(1, self.n - 1))
            add = np.tile(wrong, (on.sum(), 1))
            add[np.arange(on.sum()), v[on]] = np.log(self.acc[k])[v[on]]
            lp[on] += add
        lp -= lp.max(axis=1, keepdims=True)
        p = np.exp(lp)
        return p / p.sum(axis=1, keepdims=True)

    def fit(self, votes: np.ndarray, counts: np.ndarray, rounds: int = 30) -> LabelModel:
        if not len(votes):
            return self
        for _ in range(rounds):
            p = self.posterior(votes) * counts[:, None]
            self.prior = (p.sum(axis=0) + 1) / (p.sum() + self.n)
            for k in range(self.f):
                v = votes[:, k]
                on = v >= 0
                right = np.zeros(self.n)
                np.add.at(right, v[on], p[on, v[on]])
                self.acc[k] = np.clip((right + 3.5) / (p[on].sum(axis=0) + 5), 0.12, 0.99)
        return self


def subject_shares(
    documents: DataFrame,
    subjects: DataFrame,
    labels: DataFrame,
    items: DataFrame | None = None,
    rounds: int = ROUNDS,
    labelled_rows: int = LABELLED_ROWS,
    least: float = LEAST_SHARE,
) -> DataFrame:
    """``(doc_id, subject, share, probability)`` of each subject some sentence of a document is about.

    ``share`` is that of the sentences that have a subject; ``probability`` is that of at
    least ``least`` of them being about it. ``items`` are evaluation items whose passages
    don't count. Blank and null texts, and documents without a sentence on any subject,
    have no rows; documents of one id are one document (the longest text); labels of
    unknown documents or subjects are ignored; empty tables give an empty result. The
    subjects are a list that fits a driver.
    """
    spark = documents.sparkSession
    sc = spark.sparkContext
    described = [(r.subject, r.description) for r in subjects.select("subject", "description").where("subject IS NOT NULL").distinct().collect()]
    names = sorted({x for x, _ in described})
    n, at = len(names), {s: i for i, s in enumerate(names)}
    if not n:
        return spark.createDataFrame([], "doc_id long, subject string, share double, probability double")
    src = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    src = src.where("doc_id IS NOT NULL AND text IS NOT NULL AND trim(text) <> ''")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "subject").where(F.col("subject").isin(names) & F.col("doc_id").isNotNull()).dropDuplicates()
    # a bounded sample of the labelled rows: those of lowest hash
    known = known.orderBy(F.xxhash64("doc_id", "subject")).limit(labelled_rows)
    known = known.groupBy("doc_id").agg(F.collect_set("subject").alias("labels")).toPandas()
    order = np.argsort(known["doc_id"].to_numpy("int64"))
    shared = sc.broadcast((known["doc_id"].to_numpy("int64")[order], [[at[x] for x in known["labels"].iloc[k]] for k in order]))
    tables = passages(items, PASSAGE_WORDS) if items is not None else []
    tongues = Tongues(*_tongues(src))
    speak = sc.broadcast(tongues)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        speaker = speak.value
        labelled, told = shared.value
        for b in batches:
            out = []
            for doc, source, text in zip(b["doc_id"], b["source"], b["text"]):
                body, heads, links = parsed(text)
                for t in tables:
                    body = _without(t.value, body)
                sents = speaker.placed(worded(body))
                k = int(np.searchsorted(labelled, doc))
                out.append(
                    (
                        doc, -1 if source is None else xxh64_intdigest(source) % PLACES, told[k] if k < len(labelled) and labelled[k] == doc else None,
                        flat(sents), np.array([len(s) for s in sents], dtype=np.int32),
                        flat(speaker.placed(worded(heads))), flat(speaker.placed(worded([re.sub(r"https?|www", " ", x) for x in links]))),
                    )
                )
            cols = ("doc_id", "source", "labels", "ids", "sizes", "heads", "links")
            yield pd.DataFrame({c: pd.Series([r[k] for r in out], dtype="int64" if k < 2 else "object") for k, c in enumerate(cols)})

    docs = cut(src.select("doc_id", "source", "text").mapInPandas(read, "doc_id long, source long, labels array<int>, ids array<int>, sizes array<int>, heads array<int>, links array<int>"))

    # seeds: words of labelled documents and of descriptions
    def seeded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = Sums(n + 1)
        for b in batches:
            for ids, ls in zip(b["ids"], b["labels"]):
                p = np.zeros(n + 1)
                p[list(ls)] = 1.0 / len(ls)
                p[-1] = 1.0
                own = np.unique(ids)
                sums.add(own, np.tile(p, (len(own), 1)))
            if sums.k > 500_000:
                yield sums.frame()
        yield sums.frame()

    seeds = docs.where("labels IS NOT NULL").mapInPandas(seeded, _SUM)
    places, shares = _induced(*_summed(seeds, n), tongues.span, 5.0, 0.6)
    stated: dict[int, set[int]] = {}
    for name, text in described:
        for place in {i for s in tongues.placed([tokens(f"{name} {text or ''}")]) for i in s}:
            stated.setdefault(place, set()).add(at[name])
    own = {place: s for place, s in stated.items() if len(s) == 1}
    rows = np.full((len(own), n), 0.01)
    rows[np.arange(len(own)), [next(iter(s)) for s in own.values()]] = 1.0
    new = ~np.isin(places, list(own))
    lexicon = np.concatenate([places[new], np.array(list(own), dtype=np.int64)]).astype(np.int64), np.vstack([shares[new], rows / rows.sum(axis=1, keepdims=True)])
    for k in range(rounds):
        parts = docs.mapInPandas(_counts(sc.broadcast(lexicon), n, soft=k >= 1), _SUM)
        more = _induced(*_summed(parts, n), tongues.span, 6.0)
        lexicon = more if len(more[0]) else lexicon
    return _assigned(docs, lexicon, names, least)


def _without(g: Grams, body: list[str]) -> list[str]:
    """The sentences that hold no word of an evaluation passage."""
    found: list[str] = []
    of: list[int] = []
    for k, s in enumerate(body):
        w = WORD.findall(s.casefold())  # markup is gone from sentences already
        found += w
        of += [k] * len(w)
    gone = {of[j] for i, _ in g.hits(found) for j in range(i, i + g.n)}
    return [s for k, s in enumerate(body) if k not in gone] if gone else body


VOTES = ("v_lex", "v_addr", "v_head", "v_src")


def _assigned(docs: DataFrame, lexicon: tuple[np.ndarray, np.ndarray], names: list[str], least: float) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    n = len(names)
    lex = sc.broadcast(lexicon)

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Lexicon(*lex.value)
        for b in _blocks(batches):
            block = Block(b["ids"].tolist(), b["sizes"].tolist(), words)
            theta = block.theta()
            head, has_head = _one(b["heads"], words)
            link, has_link = _one(b["links"], words)
            ends = np.searchsorted(block.doc[block.has], np.arange(1, len(b)))
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"].to_numpy(),
                    "source": b["source"].to_numpy(),
                    "v_lex": np.where(theta.sum(axis=1) > 0, theta.argmax(axis=1), -1).astype("int32"),
                    "v_addr": np.where(has_link, link.argmax(axis=1), -1).astype("int32"),
                    "v_head": np.where(has_head & (head.max(axis=1) >= 0.5), head.argmax(axis=1), -1).astype("int32"),
                    "scores": pd.Series([x.ravel() for x in np.split(block.scores[block.has].astype(np.float32), ends)], dtype="object"),
                }
            )

    voted = cut(docs.mapInPandas(votes, "doc_id long, source long, v_lex int, v_addr int, v_head int, scores array<float>"))
    # a row for each place of a source and subject, however many sources there are
    per = voted.where("v_lex >= 0 AND source >= 0").groupBy("source", "v_lex").count().toPandas()
    tally = np.zeros((0, n)) if per.empty else np.zeros((per["source"].nunique(), n))
    places, inverse = np.unique(per["source"].to_numpy("int64"), return_inverse=True)
    np.add.at(tally, (inverse, per["v_lex"].to_numpy("int64")), per["count"].to_numpy("float64"))
    says = np.full(PLACES, -1, dtype=np.int16)
    clear = (tally.sum(axis=1) >= 5) & (tally.max(axis=1, initial=0) >= 0.5 * tally.sum(axis=1))
    says[places[clear]] = tally[clear].argmax(axis=1)
    source = sc.broadcast(says)

    @F.pandas_udf("int")
    def by_source(s: pd.Series) -> pd.Series:
        k = s.to_numpy("int64")
        return pd.Series(np.where(k >= 0, source.value[np.maximum(k, 0)], -1).astype("int32"))

    voted = voted.withColumn("v_src", by_source("source"))
    cols = list(VOTES)
    # patterns of four votes: at most (subjects + 1) ** 4, whatever the number of documents
    patterns = voted.groupBy(*cols).count().toPandas()
    model = LabelModel(n, len(cols)).fit(patterns[cols].to_numpy(int).reshape(-1, 4), patterns["count"].to_numpy(float))
    shared = sc.broadcast((model, names))

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, subjects = shared.value
        for b in batches:
            post = m.posterior(b[cols].to_numpy(int).reshape(-1, 4)) if len(b) else np.zeros((0, m.n))
            out = []
            for doc, scores, p in zip(b["doc_id"], b["scores"], post):
                if not len(scores):
                    continue
                # a sentence is about the document's subject, or about any other
                q = posterior(np.asarray(scores, dtype=np.float64).reshape(-1, m.n), 0.5 * p + 0.5 / m.n)
                about = np.bincount(q.argmax(axis=1), minlength=m.n)
                likely = at_least(q, least)
                out += [(doc, subjects[i], about[i] / len(q), likely[i], len(q)) for i in np.nonzero((about > 0) | (likely >= 0.01))[0]]
            kinds = (("doc_id", "int64"), ("subject", "object"), ("share", "float64"), ("probability", "float64"), ("k", "int32"))
            yield pd.DataFrame({c: pd.Series([r[k] for r in out], dtype=t) for k, (c, t) in enumerate(kinds)})

    rows = voted.mapInPandas(final, "doc_id long, subject string, share double, probability double, k int")
    # several rows of one id: those of the row with the most sentences
    best = rows.groupBy("doc_id", "subject").agg(F.max(F.struct("k", "share", "probability")).alias("m"))
    return best.select("doc_id", "subject", F.col("m.share").alias("share"), F.col("m.probability").alias("probability"))


def at_least(q: np.ndarray, share: float) -> np.ndarray:
    """Per subject the probability that at least ``share`` of the sentences are about it, from their posteriors.

    Sentences that are as good as certain are counted; the number among the others is the
    sum of independent trials, by convolution, or normal where they are many.
    """
    need = math.ceil(share * len(q) - 1e-9)
    out = np.zeros(q.shape[1])
    for i in range(q.shape[1]):
        p = q[:, i]
        open_ = p[(p > 1e-3) & (p < 1 - 1e-3)]
        left = need - int((p >= 1 - 1e-3).sum())
        if left <= 0:
            out[i] = 1.0
        elif left > len(open_):
            out[i] = 0.0
        elif len(open_) > 400:
            spread = math.sqrt(float((open_ * (1 - open_)).sum()))
            out[i] = 0.5 * math.erfc((left - 0.5 - float(open_.sum())) / (spread * math.sqrt(2)))
        else:
            d = np.ones(1)
            for x in open_:
                d = np.convolve(d, (1 - x, x))
            out[i] = float(d[left:].sum())
    return out


def subjects_of(shares: DataFrame) -> DataFrame:
    """``(doc_id, subject)`` of the subjects that a document more likely than not has."""
    return shares.where(F.col("probability") >= 0.5).select("doc_id", "subject")


def composition(shares: DataFrame) -> DataFrame:
    """Per subject ``n_docs`` and its ``share`` of all assignments."""
    per = subjects_of(shares).groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"))
    # one row a subject, so the total over all of them is a small sum
    return per.withColumn("share", F.col("n_docs") / F.sum("n_docs").over(Window.partitionBy()))
