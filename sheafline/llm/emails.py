"""Only what its sender newly wrote, line by line of an email body.

A body is parsed by a recursive layout grammar over its lines::

    message := (authored | notice | signature | quote)*
    quote   := intro? (prefixed | container | rest)   each holding a message again
    intro   := "On ... wrote:" and its kin | separator? header-block
    signature := (closing | rule)? name? role? contact* device?

Prefixed quotes are lines behind ``>`` (or initials before it), containers are the
quote elements of an HTML body, and an intro followed by neither opens a quote that
takes the rest of its message. Serialising the tree keeps authored nodes of the top
message only.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# -- HTML body to lines -------------------------------------------------------------

#: Private-use marks that stand for the start and end of a possible quote element while tags are removed.
OPEN, CLOSE = "\ue000", "\ue001"
_DROP = re.compile(r"<(script|style)\b[^>]*>.*?</\1>", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|tr|li|h[1-6]|blockquote|table)\b[^>]*>", re.I)
_ANY = re.compile(r"<[^>]+>")
_ELEMENT = re.compile(r"<(/?)(blockquote|div)\b([^>]*)>", re.I)
_NUMERIC = re.compile(r"&#(\d+);")
_NAMED = re.compile(r"&[a-z#0-9]+;", re.I)
# fixed values: the entities an HTML body is decoded with
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " "}


def _code_point(m: re.Match) -> str:
    n = int(m[1])
    return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else "�"


def _flat(markup: str) -> str:
    t = _ANY.sub("", _BREAK.sub("\n", markup))
    t = _NUMERIC.sub(_code_point, t)
    t = _NAMED.sub(lambda m: ENTITIES.get(m[0].lower(), m[0]), t)
    t = re.sub(r"[ \t]+", " ", t)
    t = re.sub(r" ?\n ?", "\n", t)
    return re.sub(r"\n{3,}", "\n\n", t)


def html_text(markup: str) -> str:
    """Flattened HTML: scripts gone, block tags as line ends, other tags gone, spaces collapsed."""
    return _flat(_DROP.sub("", markup)).strip()


def _marked(markup: str) -> str:
    """``markup`` with OPEN and CLOSE around blockquotes and around divs that hold several lines."""
    out, last, stack = [], 0, []
    for m in _ELEMENT.finditer(markup):
        out.append(markup[last : m.start()])
        last = m.end()
        if m[1]:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == m[2].lower()), None)
            if at is not None:
                for kind, slot, inner in reversed(stack[at:]):
                    if kind == "blockquote" or re.search(r"<(?:br|p|tr|div|li)\b", markup[inner : m.start()], re.I):
                        out[slot] += OPEN
                        out.append(CLOSE)
                del stack[at:]
            out.append(m[0])
        else:
            out.append(m[0])
            stack.append((m[2].lower(), len(out) - 1, last))
    out.append(markup[last:])
    return "".join(out)


@dataclass
class Line:
    """A line with the element depth it stands in; ``number`` counts lines with text from 1."""

    text: str
    depth: int = 0
    number: int = 0


def body_lines(text: str | None, markup: str | None) -> list[Line]:
    """Lines of the plain part, or of the flattened HTML where there is no plain text."""
    if text is not None and text.strip():
        found = [Line(x.removesuffix("\r")) for x in text.split("\n")]
    elif markup is not None and markup.strip():
        found, depth = [], 0
        for raw in _flat(_marked(_DROP.sub("", markup.replace(OPEN, "").replace(CLOSE, "")))).split("\n"):
            # a line belongs to the depth at which its text starts
            kept = []
            at = None
            for c in raw:
                if c == OPEN:
                    depth += 1
                elif c == CLOSE:
                    depth = max(0, depth - 1)
                else:
                    if at is None and not c.isspace():
                        at = depth
                    kept.append(c)
            found.append(Line("".join(kept), depth if at is None else at))
    else:
        return []
    n = 0
    for line in found:
        if line.text.strip():
            n += 1
            line.number = n
    return found


# -- what single lines are ------------------------------------------------------------

_NAME = r"(?:[^\W\d_][\w'’.-]*\s+){0,3}[^\W\d_][\w'’.-]*"
_ADDR = r"<?[\w.+-]+@[\w.-]+>?"
_WHO = rf"(?:{_NAME}(?:\s+{_ADDR})?|{_ADDR})"
_WHEN = r"[^<>@\[\]]*\d[^<>@\[\]]{2,60}"
# fixed values: phrasings of the line that introduces an earlier message
INTROS = re.compile(
    "|".join(
        (
            rf"On {_WHEN},\s+{_WHO} wrote:",
            rf"{_WHO} wrote on {_WHEN}:",
            rf"Le {_WHEN},\s+{_WHO} a écrit ?:",
            rf"Am {_WHEN} schrieb {_WHO}:",
            rf"El {_WHEN},\s+{_WHO} escribió:",
            rf"Il giorno {_WHEN},?\s+{_WHO} ha scritto:",
            rf"Op {_WHEN},?\s+schreef {_WHO}:",
            rf"Em {_WHEN},?\s+{_WHO} escreveu:",
            rf"{_WHO} (?:skrev|schrieb am|schreef op|escreveu em) {_WHEN}:",
            rf"Quoting {_WHO}:",
            rf"\* {_WHO} \[{_WHEN}\]:",
        )
    )
)
_INTRO_START = re.compile(r"(?:On|Le|Am|El|Il|Op|Em|Quoting|\*)\s|[^\W\d_][^.!?]*(?:wrote|skrev|schrieb|schreef|escreveu|<[\w.+-]+@)")
# fixed values: names of header fields, by what they hold
FROM_FIELDS = "From|De|Von|Da|Van|Från|Fra"
OTHER_FIELDS = "Date|Sent|To|Cc|Bcc|Subject|Reply-To|Gesendet|Datum|An|Betreff|Kopie|Envoyé|À|Objet|Enviado|Fecha|Para|Asunto|Inviato|A|Oggetto|Verzonden|Aan|Onderwerp|Skickat|Till|Ämne"
_FIELD = re.compile(rf"\s*\*?(?:(?P<f>{FROM_FIELDS})|(?P<o>{OTHER_FIELDS}))\s?:\*?\s*(?P<v>\S.*)?$")
_SEPARATOR = re.compile(r"\s*(?:[-_=]{2,}\s*[^\W\d_][\w ’']{4,40}\s*[-_=]{2,}|_{5,}|-{5,}|Begin forwarded message:|Anfang der weitergeleiteten Nachricht:|Début du message réexpédié\s?:|Inicio del mensaje reenviado:)\s*$")
_PREFIX = re.compile(r"\s{0,3}(?:(?:[A-Z]{1,4})?>|\|(?!\|))\s?")
# fixed values: closing phrases
CLOSINGS = re.compile(
    r"(?:(?:many |with |very )?(?:kind(?:est)?|best|warm(?:est)?) (?:regards|wishes)|regards|with regards|best|sincerely(?: yours)?|yours(?: (?:sincerely|faithfully|truly))?|cheers|"
    r"(?:many )?thanks(?: and (?:best wishes|regards|kind regards))?|thank you|many thanks and best wishes|all the best|take care|"
    r"(?:mit )?(?:freundlichen|besten|herzlichen|lieben) grüßen|(?:viele|liebe|beste|herzliche|schöne) grüße|mfg|lg|gruß|"
    r"(?:bien )?cordialement|bien à vous|salutations(?: distinguées)?|amicalement|merci|"
    r"(?:un )?(?:cordial )?saludos?|(?:saludos )?cordiales|atentamente|gracias|un abrazo|"
    r"cordiali saluti|met vriendelijke groet|med vänlig hälsning)\s*[,.!]?",
    re.I,
)
# fixed values: lines a device or mail program adds
DEVICES = re.compile(
    r"(?:sent from (?:my|outlook|mail|yahoo|samsung|proton)\b(?! \w+, so)|get (?:outlook|the .{2,30}) (?:for|app)|get the .{2,40} app|von mein\w+ .{2,40} gesendet|gesendet von mein|"
    r"envoyé (?:depuis|de) mon|enviado desde mi|inviato da|verzonden vanaf|skickat från|download .{2,30} app|diese nachricht wurde von mein)",
    re.I,
)
# fixed values: openings of disclaimers, legal notices and list footers
NOTICES = re.compile(
    r"(?:(?:confidentiality|legal|privacy|disclaimer) ?(?:notice|note)?\s?:|this (?:message|e-?mail|communication|transmission)(?: and any attachments?)?,? (?:is|are|may|and|contains?)\b.*|"
    r"if you (?:have |are )?(?:received|not the intended)|(?:the information|the contents?) (?:in|of) this (?:message|e-?mail)|please consider (?:whether|the environment|before)|think before you print|"
    r"any (?:views|opinions) (?:or opinions )?(?:expressed|presented)|\S+(?: \S+){0,3} accepts no (?:liability|responsibility)|registered office\s?:|registered in |company (?:no|number|registration)|"
    r"diese (?:e-?mail|nachricht) (?:kann|enthält|ist)|wenn sie nicht der richtige|bitte (?:prüfen|denken) sie.{0,40}druck|"
    r"ce (?:message|courriel)(?: et .{3,40})? (?:est|peut|contient)|si vous n'êtes pas le destinataire|este (?:mensaje|correo) (?:es|puede|contiene)|si no es (?:usted )?el destinatario|"
    r"you (?:receive|received|are receiving) this (?:because|message|e-?mail)|to (?:stop|unsubscribe|leave|opt out|manage)\b|unsubscribe\b|manage (?:your )?subscription|.{0,60}mailing list\b|"
    r"view (?:this|it) (?:in|online)|list archives?:|um diese .{3,40} abzubestellen|pour (?:se désabonner|ne plus recevoir)|para (?:darse de baja|dejar de recibir))",
    re.I,
)
_RULE = re.compile(r"\s*(?:-{1,3}|[—–‐-―]{1,40}|_{2,60}|={2,60}|~{2,60}|\*{2,60}|-{4,60})\s*$")
_CONTACT = re.compile(r"\s*(?:tel|phone|mobile|mob|fax|cell|t|m|p|tél|telefon|teléfono|web|www|e-?mail)\b[.:]?\s*[+\w(].*\d|\s*[\w.+-]+@[\w-]+(?:\.[\w-]+)+\s*$|\s*(?:https?://|www\.)\S+\s*$|\s*\+?[\d(][\d ()./-]{6,}$", re.I)


@dataclass
class Node:
    kind: str
    lines: list[Line] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)


class Sender:
    """What a signature of this sender can be made of."""

    def __init__(self, name: str | None, address: str | None):
        local, _, domain = (address or "").partition("@")
        parts = [p for p in re.split(r"[\s._+-]+", name or "") if p] + [p for p in re.split(r"[._+-]+", local) if p]
        self.names = {p.casefold() for p in parts}
        self.address = (address or "").casefold()
        self.org = domain.split(".")[0].casefold()

    def named(self, s: str) -> bool:
        w = [x.casefold() for x in re.findall(r"[^\W\d_][\w'’-]*", s)]
        return 0 < len(w) <= 4 and bool(self.names) and sum(x in self.names for x in w) >= max(1, len(w) - 1) and not re.search(r"[.!?:]$", s.strip())

    def role(self, s: str) -> bool:
        w = s.strip().casefold()
        return bool(self.org) and len(w) < 70 and bool(re.search(rf"(?:,|\bat|@|\|)\s*{re.escape(self.org)}$|^{re.escape(self.org)}$", w))

    def contact(self, s: str) -> bool:
        return bool(_CONTACT.match(s)) or (bool(self.address) and self.address in s.casefold() and len(s) < 90)


def _name_like(s: str) -> bool:
    w = s.split()
    return 0 < len(w) <= 4 and len(s) < 50 and all(x[:1].isupper() for x in w) and not re.search(r"[.!?,:;]$", s)


# -- the grammar ------------------------------------------------------------------------


class Parser:
    """One message: a list of lines at one quoting level, from one sender if known."""

    def __init__(self, lines: list[Line], sender: Sender, level: int = 0, gap: int = 0):
        #: blank lines that may stand between two lines that belong together; block tags leave one
        self.gap = gap
        self.lines, self.sender, self.level = lines, sender, level
        self.base = min((x.depth for x in lines if x.text.strip()), default=0)

    def _next(self, i: int) -> int:
        while i < len(self.lines) and not self.lines[i].text.strip():
            i += 1
        return i

    def _intro(self, i: int) -> int:
        """End of the intro that starts at line ``i``, or ``i``."""
        first = self.lines[i].text.strip()
        if _INTRO_START.match(first):
            joined, j = "", i
            for _ in range(4):
                t = self.lines[j].text.strip()
                if _PREFIX.match(t):
                    break
                joined = f"{joined} {t}".strip()
                if t.endswith(":") and len(joined) < 200 and INTROS.fullmatch(joined):
                    return j + 1
                if (j := self._after(j)) is None:
                    break
        j, needed = i, 3
        if _SEPARATOR.match(first):
            j, needed = self._next(i + 1), 2
        end, seen, has_from = j, 0, False
        while j is not None and j < len(self.lines):
            m = _FIELD.match(self.lines[j].text)
            if m and (m["v"] or seen):
                seen += 1
                has_from |= bool(m["f"])
            elif not (seen and (k := self._after(j)) and _FIELD.match(self.lines[k].text) and not re.search(r"[.!?]$", self.lines[j].text.strip())):
                break  # else it is a header value that was wrapped
            end = j + 1
            j = self._after(j)
        return end if seen >= needed and has_from else i

    def _after(self, i: int) -> int | None:
        """The next line with text if it belongs together with line ``i``."""
        j = self._next(i + 1)
        return j if j < len(self.lines) and j - i - 1 <= self.gap and self.lines[j].depth == self.lines[i].depth else None

    def _quote(self, i: int) -> int:
        """End of the quote whose intro ended before ``i``."""
        lines, n = self.lines, len(self.lines)
        j = self._next(i)
        if j >= n:
            return n
        if lines[j].depth > self.base:
            return self._container(j)
        if _PREFIX.match(lines[j].text):
            return self._prefixed(j)
        return n  # a message that isn't set off goes on to the end, whatever it quotes itself

    def _container(self, j: int) -> int:
        while j < len(self.lines) and (self.lines[j].depth > self.base or not self.lines[j].text.strip()):
            j += 1
        return j

    def _prefixed(self, j: int) -> int:
        lines, n = self.lines, len(self.lines)
        while j < n:
            if m := _PREFIX.match(lines[j].text):
                j += 1
                # a mail program that wraps a quoted line leaves the rest of it without a prefix
                left = lines[j - 1].text[m.end() :].strip()
                while j < n and _unfinished(left, t := lines[j].text.strip()) and not _PREFIX.match(lines[j].text):
                    left = "" if re.search(r"[.!?:>]$", t) else t
                    j += 1
            elif not lines[j].text.strip() and (k := self._next(j)) < n and _PREFIX.match(lines[k].text):
                j = k
            else:
                break
        return j

    def parse(self) -> Node:
        root = Node("message")
        i, own, quoted = 0, [], False
        lines = self.lines
        while i < len(lines):
            end, intro = i, []
            if lines[i].text.strip():
                if _PREFIX.match(lines[i].text):
                    end = self._prefixed(i)
                elif lines[i].depth > self.base and quoted:
                    end = self._container(i)
                elif (k := self._intro(i)) > i:
                    intro = lines[i:k]
                    end = self._quote(k)
            if end > i:
                root.children += self._authored(own, quoted)
                own, quoted = [], True
                root.children.append(Node("intro", intro))
                root.children.append(self._nested(lines[i + len(intro) : end]))
                i = end
            else:
                own.append(lines[i])
                i += 1
        root.children += self._authored(own, quoted)
        return root

    def _nested(self, lines: list[Line]) -> Node:
        """A quote is a message again, one level down.

        Nothing in a quote is newly written, so that levels below the eighth, which stay
        lines of their quote, change no result.
        """
        inner = []
        for x in lines:
            m = _PREFIX.match(x.text)
            inner.append(Line(x.text[m.end() :] if m else x.text, x.depth, x.number))
        node = Node("quote", lines)
        if self.level < 8 and any(_PREFIX.match(x.text) for x in inner):
            node.children = [Parser(inner, Sender(None, None), self.level + 1, self.gap).parse()]
        return node

    def _authored(self, lines: list[Line], quoted: bool) -> list[Node]:
        """Authored text, signatures and notices of a run of lines outside quotes."""
        s, n = self.sender, len(lines)
        kind = ["authored"] * n
        text = [x.text.strip() for x in lines]
        full = [i for i in range(n) if text[i]]
        i = 0
        while i < len(full):
            at = full[i]
            t = text[at]
            rest = [text[k] for k in full[i + 1 : i + 6]]
            if DEVICES.match(t) and len(t) < 80:
                kind[at] = "signature"
            elif NOTICES.match(t):
                kind[at] = "notice"
                # a wrapped notice goes on until its sentence ends
                while not re.search(r"[.!?:]\W*$", text[full[i]]) and i + 1 < len(full) and full[i + 1] - full[i] - 1 <= self.gap:
                    i += 1
                    kind[full[i]] = "notice"
            elif _RULE.match(lines[at].text) and any(s.named(x) or s.contact(x) or s.role(x) for x in rest[:4]):
                i = self._signed(full, text, kind, i)
                continue
            elif CLOSINGS.fullmatch(t) and (not rest or s.named(rest[0]) or _name_like(rest[0]) or _RULE.match(rest[0]) or s.contact(rest[0]) or DEVICES.match(rest[0]) or NOTICES.match(rest[0])):
                i = self._signed(full, text, kind, i)
                continue
            elif s.contact(t) and i > 0 and (s.role(text[full[i - 1]]) or s.named(text[full[i - 1]]) or kind[full[i - 1]] == "signature"):
                kind[at] = "signature"
                k = i - 1
                while k >= 0 and (s.role(text[full[k]]) or s.named(text[full[k]]) or CLOSINGS.fullmatch(text[full[k]]) or _RULE.match(text[full[k]])):
                    kind[full[k]] = "signature"
                    k -= 1
            elif s.named(t) and all(kind_ok(x) for x in rest) and (i > 0 or quoted):
                kind[at] = "signature"
            i += 1
        out: list[Node] = []
        for line, k in zip(lines, kind):
            if out and out[-1].kind == k:
                out[-1].lines.append(line)
            else:
                out.append(Node(k, [line]))
        return out

    def _signed(self, full: list[int], text: list[str], kind: list[str], i: int) -> int:
        """Marks the signature that starts at ``full[i]`` and returns where it ends."""
        s = self.sender
        kind[full[i]] = "signature"
        i += 1
        names = 0
        while i < len(full):
            t = text[full[i]]
            near = full[i] - full[i - 1] <= 2
            if s.named(t) or s.role(t) or s.contact(t) or _RULE.match(t) or CLOSINGS.fullmatch(t) or (DEVICES.match(t) and len(t) < 80):
                pass
            elif names == 0 and near and _name_like(t):
                names += 1
            elif near and len(t) < 60 and not re.search(r"[.!?:]$", t) and i + 1 < len(full) and s.contact(text[full[i + 1]]):
                pass
            else:
                break
            kind[full[i]] = "signature"
            i += 1
        return i


def _unfinished(quoted: str, after: str) -> bool:
    """Whether ``after``, which has no prefix, is the wrapped rest of the quoted line before it."""
    if not quoted or not after or (re.search(r"[.!?:]\W*$", quoted) and not re.search(r"\b[Nn]o\.$", quoted)) or CLOSINGS.fullmatch(after):
        return False
    if quoted.endswith(">"):
        return after.endswith(":") and after[0].islower()
    text = _PREFIX.sub("", quoted)
    return (len(text) >= 45 or after[0].islower() or after[0] == "<") and not _RULE.match(text) and not _SEPARATOR.match(text)


def kind_ok(s: str) -> bool:
    """A line that may follow a bare name at the end of a message."""
    return bool(NOTICES.match(s) or DEVICES.match(s) or _CONTACT.match(s))


def parse(text: str | None, markup: str | None, name: str | None = None, address: str | None = None) -> Node:
    return _parser(body_lines(text, markup), text, name, address).parse()


def _parser(lines: list[Line], text: str | None, name: str | None, address: str | None) -> Parser:
    return Parser(lines, Sender(name, address), gap=0 if text is not None and text.strip() else 1)


def new_lines(text: str | None, markup: str | None, name: str | None = None, address: str | None = None) -> set[int]:
    """Numbers of the lines that are newly written."""
    return {x.number for node in parse(text, markup, name, address).children if node.kind == "authored" for x in node.lines if x.number}


def new_text(text: str | None, markup: str | None, name: str | None = None, address: str | None = None) -> str:
    """The newly written lines, runs of blank lines reduced to one."""
    kept = [x.text for node in parse(text, markup, name, address).children if node.kind == "authored" for x in node.lines]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()


# -- on tables ------------------------------------------------------------------------


def _columns(emails: DataFrame, *names: str) -> DataFrame:
    have = set(emails.columns)
    return emails.select(*(F.col(n) if n in have else F.lit(None).cast("string").alias(n) for n in names))


def old_lines(emails: DataFrame) -> DataFrame:
    """One row ``(email_id, line_no)`` for each line of a body that is not newly written.

    The body is ``text`` unless null or blank, else the flattened ``html``; an email
    with neither has no rows. Missing sender columns only make signatures harder to
    tell. A message delivered twice under two ids has its rows under both; rows of one
    id are told once.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, numbers = [], []
            for e, text, markup, name, address in b[["email_id", "text", "html", "from_name", "from_address"]].itertuples(index=False, name=None):
                lines = body_lines(text, markup)
                tree = _parser(lines, text, name, address).parse()
                new = {x.number for node in tree.children if node.kind == "authored" for x in node.lines}
                old = [x.number for x in lines if x.number and x.number not in new]
                ids += [e] * len(old)
                numbers += old
            yield pd.DataFrame({"email_id": pd.Series(ids, dtype="Int64"), "line_no": pd.Series(numbers, dtype="int64")})

    rows = _columns(emails, "email_id", "text", "html", "from_name", "from_address").withColumn("email_id", F.col("email_id").cast("long"))
    return rows.mapInPandas(scan, "email_id long, line_no long").distinct()


def newly_written(emails: DataFrame, out_col: str = "new_text") -> DataFrame:
    """``emails`` with ``out_col``, the newly written text (empty where there is none)."""

    @F.pandas_udf("string")
    def cleaned(text: pd.Series, markup: pd.Series, name: pd.Series, address: pd.Series) -> pd.Series:
        return pd.Series([new_text(*x) for x in zip(text, markup, name, address)], dtype="object")

    have = set(emails.columns)
    args = [F.col(c) if c in have else F.lit(None).cast("string") for c in ("text", "html", "from_name", "from_address")]
    return emails.withColumn(out_col, cleaned(*args))
