"""Credentials inside source and configuration files.

A file is scanned for tokens of known shape, for literals that are given to a name,
header, URL or login that grants something, and for key containers. Every run of
characters that may be an encoding (base64, hex, percent, backslash escapes) - quoted or
not, wrapped over lines or put together from several literals - is decoded layer by layer,
and what comes out is scanned again; binary layers are parsed by the grammar of their
container (DER, PKCS#12, OpenSSH). A hit inside an encoding marks the enclosing literal,
so that redaction replaces literals as wholes and the code around them still parses.

A layer is always shorter than what it is decoded from, so any depth is followed.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REDACTED = "REDACTED"

# fixed values: shapes of issued tokens
TOKENS = re.compile(
    r"(?<![A-Za-z0-9_-])(?:"
    r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w-]{16,}|npm_[A-Za-z0-9]{30,}|AIza[\w-]{30,}|ya29\.[\w-]{20,}|"
    r"xox[abeoprs]-[\w-]{16,}|(?:sk|rk|whsec)_(?:live_)?[A-Za-z0-9]{20,}|sk-(?:proj-|ant-)?[\w-]{24,}|SG\.[\w-]{16,}\.[\w-]{16,}|hf_[A-Za-z0-9]{30,}|pypi-[\w-]{40,}|dop_v1_[0-9a-f]{40,}|"
    r"eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,}|[a-z][a-z0-9]{1,15}_(?:live|prod|key|secret|token|pat)_[A-Za-z0-9]{18,}"
    r")(?![A-Za-z0-9_-])"
)
_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BODY = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}|(?<=\\n)[A-Za-z0-9+/]+={0,2}(?=\\n)")
_FILLED = re.compile(r"[^\n]")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,15}://([^\s:/@\"'`]*):((?:(?!://)[^\s@\"'`])+)@(?=[\w\[])")
_PARAM = re.compile(r"[?&](?:[\w.-]*(?:token|key|secret|password|passwd|pwd|auth|signature|sig))=([^&\s\"'`#]{8,})", re.I)
_HEADER = re.compile(r"\b(?:proxy-)?authorization[\"']?\s*[:=,]\s*[\"']?(bearer|basic|token|apikey|digest)\s+([^\s\"'`,;]+)|\bx-(?:api-key|auth-token|access-token|amz-security-token|vault-token)[\"']?\s*[:=,]\s*[\"']?([^\s\"'`,;]+)", re.I)
_LOGIN = re.compile(r"\bmachine\s+\S+\s+login\s+\S+\s+pass(?:wd|word)\s+(\S+)|^\s*pass(?:wd|word)\s+(\S+)\s*$", re.I)
#: Statements and commands that take a password as they are.
_GIVEN = re.compile(
    r"\bidentified\s+(?:with\s+\S+\s+)?by\s+(?:password\s+)?(?P<q1>['\"])(?P<v1>[^'\"\n]+)(?P=q1)|\b(?:with|user|role)\b[^;\n]*?\bpassword\s+(?P<q2>['\"])(?P<v2>[^'\"\n]+)(?P=q2)|"
    r"\b(?:mysql|mysqldump|mysqladmin|mariadb|mongo|mongosh|mongodump)\b[^|;\n]*?\s(?:-p(?!\w*\s*=)|--password[= ])(?P<q3>['\"]?)(?P<v3>[^\s'\"|;<>-][^\s'\"|;<>]*)(?P=q3)|"
    r"\bsshpass\s+-p\s*(?P<q4>['\"]?)(?P<v4>[^\s'\"]+)(?P=q4)|\bredis-cli\b[^|;\n]*?\s-a\s+(?P<q5>['\"]?)(?P<v5>[^\s'\"]+)(?P=q5)|\bcurl\b[^|;\n]*?\s(?:-u|--user)[ =](?P<q6>['\"]?)[^\s:'\"]+:(?P<v6>[^\s'\"]+)(?P=q6)",
    re.I,
)
#: A login told in words: as whom, and with what.
_TOLD = re.compile(r"\b(?:log(?:ged)?|sign(?:ed)?)[ -]?(?:in|on)\s+(?:as|with)\s+[`\"']?[^\s`\"']+[`\"']?\s+(?:with|and|using|/)\s+(?:(?:the )?(?:password|passphrase|secret)\s+)?([`\"'])([^`\"'\n]{4,80})\1", re.I)
_GIVEN_HINT = re.compile(r"identified|mysql|mariadb|mongo|sshpass|redis-cli|curl |password")
#: Cheap test, on lower-cased text, of the lines that are looked at at all.
_HINT = re.compile(r"identified|mysql|mariadb|mongo|sshpass|redis-cli|curl |log ?in |logged|sign ?in |pass|pwd|_pw|secret|token|key|cred|auth|seed|://|akia|asia|gh[pousr]_|github_pat|glpat-|npm_|aiza|xox|_live_|_prod_|eyj|hf_|pypi-|sk-|sg\.|[^a-z]pw[^a-z]")
_NAMES = re.compile(r"pass|pwd|pw(?![a-z])|secret|token|key|cred|auth|seed", re.I)
_PIECES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

# fixed values: parts of names that hold credentials, of those that may, and ends that make them something else
STRONG = frozenset("password passwd passphrase passwort passcode pwd pw pass secret secrets cred creds credential credentials apikey authtoken accesskey secretkey privatekey".split())
WEAK = frozenset("token tokens key keys auth seed authkey bearer".split())
#: Ends of names written in one piece, as in ``Adminpassword``.
_STRONG_END = re.compile(r".+(?:password|passwd|passphrase|secret|apikey|accesskey|secretkey|privatekey|credentials?)$")
_WEAK_END = re.compile(r".{2,}(?:token|auth)$|.{4,}key$")
OTHER_END = frozenset(
    "hint label count question policy length id ids name names url uri file path dir field column header prefix suffix type kind min max size limit ttl expiry expires expiration rotation reset attempts "
    "index idx version algorithm alg format pattern regex placeholder text title message prompt strength score required enabled visible manager provider store ref arn age input form page icon event".split()
)
OTHER_PART = frozenset("public pub keyboard tokenizer keyword keywords monkey author authors foreign primary sort cache partition".split())

# fixed values: values that stand for a credential without being one
_PLACEHOLDER = re.compile(
    r"(?:change[-_ ]?(?:me|this|it)|replace[-_ ]?(?:me|this|with.*)|insert[-_ ].*|enter[-_ ].*|your[-_ ].*|my[-_ ]?(?:password|secret|token|key)|put[-_ ].*here|add[-_ ].*here|some[-_ ].*|"
    r"examples?(?:[-_ ].*)?|samples?(?:[-_ ].*)?|dummy.*|fake.*|mock.*|test(?:ing)?(?:[-_ ]?(?:password|secret|token|key|pass|user))?|placeholder.*|redacted|removed|hidden|masked|censored|secret|password|passwd|pass|pwd|token|"
    r"api[-_]?key|none|null|nil|undefined|empty|default|todo|tbd|fixme|n/?a|true|false|yes|no|on|off|not[-_ ]a[-_ ]real.*|no[-_ ]?(?:password|secret)|x+|\*+|\.+|-+|_+|#+|\?+|0+|1234\d*|abc123|foo|bar|foobar|"
    r"<[^>]*>|\[[^\]]*\]|\(.*\)|\{.*\}|\$\w+|\$\{.*|\$\(.*|%\w+%|%\(.*|%s|@\w+@|:\w+|\{\{.*|<%.*|#\{.*|&\w+;|!(?:vault|ref|sub|env)\b.*|"
    r"(?:os\.|process\.|env\.|env:|vault:|secrets?:|ssm:|op://|file:|aws:|gcp:|azure:|keyring:|var\.|local\.|data\.|module\.|config\.|settings\.).*|\w+\(.*)",
    re.I,
)
_BARE_OK = frozenset("sh bash zsh env ini cfg conf properties toml yml yaml netrc pgpass npmrc pypirc dockerfile makefile md txt rst tf tfvars envrc htpasswd example".split())
_CODE = frozenset("py ts tsx js jsx mjs cjs java go c h cc cpp rb php cs kt rs swift scala sql css scss vue pl lua".split())
_COMMENTED = re.compile(r"\s*(?://|#|/\*|\*|--|;|<!--)")
_ASSIGN = re.compile(
    r"(?P<close>[\"'`]?)\s*\]?\s*(?::\s*(?:string|str|char\s*\*)\s*(?==))?(?P<op>\|\|=|\?\?=|\?=|:=|=>|=(?![=~])|:(?!:|//|=)|,|[ \t]+(?=[\"'`\w])|>)[ \t]*(?P<q>\"\"\"|'''|[\"'`])?"
)
#: A pass phrase written without quotes, and words that make it a sentence instead.
_WORDS = re.compile(r"([a-z]{2,}(?: [a-z]{2,}){2,5})\s*(?:\*/|-->|#.*)?\s*$")
_STOP = frozenset("a an the is are be was were of to in on at by for from with and or not no your you this that it as if least must should may can will".split())
#: A name and its value on lines of their own, as in lists of environment variables.
_NAME_LINE = re.compile(r"[\s{\[-]*[\"']?name[\"']?\s*:\s*[\"']?([\w.-]+)[\"']?\s*,?\s*$")
_VALUE_LINE = re.compile(r"\s*[\"']?value[\"']?\s*:\s*(?:([\"'])(?P<v>.*)\1|(?P<w>[^\s\"'#][^#\n]*?))\s*,?\s*(?:#.*)?$")
_JOIN = re.compile(r"\s*(?:\+|\.|\\?\n)?\s*([\"'`])")
#: Runs that may be an encoding: of one alphabet, with percent escapes, and literals with backslash escapes.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
_PERCENT = re.compile(r"(?<![^\s\"'`<>=])[^\s\"'`<>=%]*(?:%[0-9A-Fa-f]{2}[^\s\"'`<>=%]*){3,}")
_ESCAPED = re.compile(r"([\"'])((?:[^\"'\\\n]|\\.)*?\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|[0-7]{2,3})(?:[^\"'\\\n]|\\.)*)\1")
#: One encoding in several pieces: lines of base64, and literals side by side or joined by a sign.
_WRAPPED = re.compile(r"(?:^[ \t]*(?:#|//|\*)?[ \t]*[A-Za-z0-9+/]{40,}[ \t]*\r?\n)+[ \t]*(?:#|//|\*)?[ \t]*[A-Za-z0-9+/]{4,}={0,2}[ \t]*\r?$", re.M)
_JOINED = re.compile(r"([\"'])[A-Za-z0-9+/_=-]{8,}\1(?:\s*[+.,\\]?\s*([\"'])[A-Za-z0-9+/_=-]{2,}\2)+")
_PIECE = re.compile(r"[A-Za-z0-9+/_=-]{2,}")


class Finding(NamedTuple):
    start: int
    end: int
    kind: str
    spans: tuple[tuple[int, int], ...]


def entropy(s: str) -> float:
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in Counter(s).values()) if n else 0.0


def random_looking(v: str) -> bool:
    """Long, without spaces, of mixed kinds of characters: issued by a machine rather than written."""
    if len(v) < 14 or any(c.isspace() for c in v) or "://" in v or v.startswith("data:"):
        return False
    digit = any(c.isdigit() for c in v)
    kinds = any(c.islower() for c in v) + any(c.isupper() for c in v) + digit
    mixed = len(v) >= 24 and len(re.findall(r"[a-z][A-Z]|[A-Z][a-z]", v)) >= len(v) // 4
    return kinds >= 2 and (digit or mixed) and entropy(v) >= 2.8


def placeholder(v: str) -> bool:
    v = v.strip()
    return len(v) < 4 or v.startswith("data:") or bool(_PLACEHOLDER.fullmatch(v)) or len(set(v)) <= 2 or "${" in v or "{{" in v


def name_strength(name: str) -> int:
    """2 where a name holds a credential, 1 where it may, 0 where it doesn't."""
    parts = [p.lower() for p in _PIECES.findall(name)]
    if not parts or parts[-1] in OTHER_END or any(p in OTHER_PART for p in parts):
        return 0
    if any(p in STRONG or _STRONG_END.match(p) for p in parts):
        return 2
    return 1 if any(p in WEAK or _WEAK_END.match(p) for p in parts) else 0


# -- layers ---------------------------------------------------------------------------


def _der(b: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """Tag, start and end of the element at ``at``."""
    if at + 2 > len(b):
        return None
    tag, n, p = b[at], b[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or p + k > len(b):
            return None
        n, p = int.from_bytes(b[p : p + k], "big"), p + k
    return (tag, p, p + n) if p + n <= len(b) else None


def _openssh(b: bytes) -> bool:
    """Whether ``b`` is cipher, derivation and its options, as many public keys as are counted, and the private section."""
    at = len(b"openssh-key-v1\0")

    def field(at: int) -> int:
        n = int.from_bytes(b[at : at + 4], "big")
        return at + 4 + n if at + 4 <= len(b) and at + 4 + n <= len(b) else -1

    for _ in range(3):
        if (at := field(at)) < 0:
            return False
    n = int.from_bytes(b[at : at + 4], "big")
    at += 4
    if not 1 <= n <= len(b):
        return False
    for _ in range(n + 1):
        if (at := field(at)) < 0:
            return False
    return True


def private_container(b: bytes) -> str | None:
    """``pkcs8``, ``pkcs1``, ``sec1``, ``pkcs12`` or ``openssh`` if the bytes are a private key of that grammar."""
    if b.startswith(b"openssh-key-v1\0"):
        return "openssh" if _openssh(b) else None
    top = _der(b)
    if not top or top[0] != 0x30:
        return None
    kids, p = [], top[1]
    while p < top[2] and (e := _der(b, p)):
        kids.append((e[0], b[e[1] : e[2]]))
        p = e[2]
    tags = [t for t, _ in kids]
    if tags[:3] == [0x02, 0x30, 0x04] and kids[0][1] in (b"\0", b"\1"):
        return "pkcs8"
    if tags[:1] == [0x02] and len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return "pkcs1"
    if tags[:2] == [0x02, 0x04] and kids[0][1] == b"\1":
        return "sec1"
    if tags[:2] == [0x02, 0x30] and len(tags) in (2, 3) and set(tags[2:]) <= {0x30} and kids[0][1] == b"\3" and kids[1][1].startswith(b"\x06\x09\x2a\x86\x48\x86\xf7\x0d\x01\x07"):
        return "pkcs12"
    if tags[:2] == [0x30, 0x04] and len(tags) == 2 and b"\x2a\x86\x48\x86\xf7\x0d\x01\x05\x0d" in kids[0][1]:
        return "pkcs8"
    return None


def decoded(s: str) -> Iterator[bytes]:
    """Every reading of ``s`` as one layer of an encoding."""
    if "%" in s and re.search(r"%[0-9A-Fa-f]{2}", s):
        yield unquote_to_bytes(s)
    if re.search(r"\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|[0-7]{2,3})", s):
        try:
            yield s.encode("latin-1", "replace").decode("unicode_escape").encode("utf-8", "replace")
        except UnicodeDecodeError:
            pass
    if len(s) >= 16 and len(s) % 2 == 0 and re.fullmatch(r"[0-9A-Fa-f]+", s):
        yield bytes.fromhex(s)
    if len(s) >= 16 and re.fullmatch(r"[A-Za-z0-9+/_-]+={0,2}", s):
        t = s.rstrip("=").replace("-", "+").replace("_", "/")
        if len(t) % 4 != 1:
            try:
                yield base64.b64decode(t + "=" * (-len(t) % 4))
            except (binascii.Error, ValueError):
                pass


def _printable(b: bytes) -> str | None:
    try:
        s = b.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return s if len(s) >= 8 and all(c.isprintable() or c in "\t\r\n" for c in s) else None


def hidden(s: str) -> str | None:
    """The kind of credential under the encodings of ``s``.

    A value that stands in ``s`` as it is was there for the plain scan to judge; only what
    gives its form to it (a URL, a key, a token) may have been hidden around it.
    """
    for b in decoded(s):
        if kind := private_container(b):
            return kind
        text = _printable(b)
        if text is None or text == s:
            continue
        text = f" {text}"
        for f in scan("", text):
            if f.kind != "assigned" or text[f.start : f.end] not in s:
                return f.kind
        if len(b) < len(s) and (kind := hidden(text.strip())):
            return kind
    return None


# -- one file ---------------------------------------------------------------------------


def _config(path: str) -> bool:
    name = path.rpartition("/")[2].lower()
    end = name.rpartition(".")[2]
    return end in _BARE_OK or name.startswith((".env", "dockerfile", "makefile")) or (end not in _CODE and end != "json")


def _closing(text: str, at: int, q: str, limit: int) -> int:
    """Where the literal that opened before ``at`` ends, or -1."""
    while True:
        e = text.find(q, at, limit)
        if e < 0:
            return -1
        k = e - 1
        while k >= 0 and text[k] == "\\":
            k -= 1
        if (e - k) % 2:
            return e
        at = e + 1


def _basic(v: str) -> bool:
    """Whether ``v`` encodes ``user:password`` with a real password."""
    for b in decoded(v):
        s = _printable(b + b"       ")
        if s and ":" in s:
            pw = s.strip().partition(":")[2]
            return bool(pw) and not placeholder(pw)
    return False


def _assigned(text: str, hit: int, line_start: int, line_end: int, bare_ok: bool) -> Finding | None:
    """The literal given to the name around ``hit``."""
    s, e = hit, hit
    while s > line_start and (text[s - 1].isalnum() or text[s - 1] in "_-$"):
        s -= 1
    while e < line_end and (text[e].isalnum() or text[e] in "_-"):
        e += 1
    strength = name_strength(text[s:e])
    m = _ASSIGN.match(text, e, line_end) if strength else None
    if not m:
        return None
    op, q = m["op"], m["q"]
    quoted_name = bool(m["close"]) and s > line_start and text[s - 1] == m["close"]
    if op == "," and not (quoted_name and q):
        return None
    if op.isspace() and not (text[s : s + 2] == "--" or re.match(r"\s*(?:#\s*define|ENV|ARG|export|set)\s", text[line_start:s] + " ", re.I)):
        return None
    if op == ">" and not text[line_start:s].rstrip("/").endswith("<"):
        return None
    parts: list[tuple[int, int]] = []
    at = m.end()
    if q:
        limit = line_end if len(q) == 1 and q != "`" else len(text)
        end = _closing(text, at, q, limit)
        if end < 0:
            return None
        parts.append((at, end))
        at = end + len(q)
        while (j := _JOIN.match(text, at)) and j[0].strip(" \t\r\n\\")[:1] in "+." and (end := _closing(text, j.end(), j[1], len(text))) >= 0:
            parts.append((j.end(), end))
            at = end + 1
    else:
        if op == ">":
            b = re.compile(r"[^<\s]+(?=</)").match(text, at, line_end)
        elif not bare_ok and not _COMMENTED.match(text, line_start, line_end):
            return None
        else:
            b = re.compile(r"[^\s\"'`,;]+(?:,(?=\S)[^\s\"'`;]+)*").match(text, at, line_end)
            if b and op == ":" and at == m.start("op") + 1:
                return None
        if b and strength == 2 and (w := _WORDS.match(text, b.start(), line_end)) and not _STOP & set(w[1].split()):
            return Finding(w.start(1), w.end(1), "assigned", ((w.start(1), w.end(1)),))
        if not b or re.match(r"\s+[^\s#*/;<-]", text[b.end() : line_end]):
            return None
        parts.append((b.start(), b.end()))
    v = "".join(text[a:z] for a, z in parts)
    if placeholder(v) or re.fullmatch(r"[A-Za-z][\w+.-]*://\S*", v) or _BEGIN.search(v):
        return None
    return Finding(parts[0][0], parts[-1][1], "assigned", tuple(parts)) if _grants(v, strength) else None


def _grants(v: str, strength: int) -> bool:
    """Whether a literal, given to a name of that strength, is a credential."""
    if strength == 2:
        return len(v) >= 6 and (len(v) >= 40 or not re.fullmatch(r"[a-z]+|[A-Z]+|\d{1,5}|[a-z]+(?:[_-][a-z]+)*|[A-Z]+(?:_[A-Z]+)*", v))
    return random_looking(v) or _basic(v)


def _key_end(text: str, at: int) -> int:
    """Where the key that begins before ``at`` ends: at its END marker, or, without one, behind its last line in a row."""
    stop, other = _END.search(text, at), _BEGIN.search(text, at)
    limit = other.start() if other else len(text)
    if stop and stop.start() < limit:
        return stop.start()
    end, body = at, False
    while end < limit:
        e = text.find("\n", end)
        e = limit if e < 0 else min(e, limit)
        if _BODY.search(text, end, e):
            body = True
        elif body:
            break
        end = e + 1
    return min(end, limit)


def scan(path: str, text: str, layers: bool = True) -> Iterator[Finding]:
    """Every credential of a file; findings may overlap. ``layers``: whether encodings are looked into."""
    bare_ok = _config(path) if path else True
    low = text.lower()
    if len(low) != len(text):  # lower-casing changed positions
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    at, n = 0, len(text)
    while hit := _HINT.search(low, at):
        s = low.rfind("\n", 0, hit.start()) + 1
        e = low.find("\n", hit.start())
        e = n if e < 0 else e
        line = text[s:e]
        at = e + 1
        for m in TOKENS.finditer(line):
            yield Finding(s + m.start(), s + m.end(), "token", ((s + m.start(), s + m.end()),))
        for m in _BEGIN.finditer(line) if "PRIVATE KEY" in line else ():
            start = s + m.end()
            limit = _key_end(text, start)
            spans = tuple((b.start(), b.end()) for b in _BODY.finditer(text, start, limit))
            if sum(z - a for a, z in spans) >= 40:
                yield Finding(s + m.start(), limit, "private key", spans)
                # what stands before and behind the key is scanned like any other text
                blank = _FILLED.sub("\0", text[start:limit])
                text, low = text[:start] + blank + text[limit:], low[:start] + blank + low[limit:]
        line = text[s:e]
        if "://" in line:
            for m in _URL.finditer(line):
                if not placeholder(m[2]) and not (m[1].lower() in ("user", "username") and m[2].lower().startswith("pass")):
                    yield Finding(s + m.start(2), s + m.end(2), "url", ((s + m.start(2), s + m.end(2)),))
            for m in _PARAM.finditer(line):
                if random_looking(m[1]):
                    yield Finding(s + m.start(1), s + m.end(1), "url", ((s + m.start(1), s + m.end(1)),))
        lowered = low[s:e]
        if "authorization" in lowered or "x-" in lowered:
            for m in _HEADER.finditer(line):
                k = 2 if m[2] else 3
                v = m[k]
                if _basic(v) if (m[1] or "").lower() == "basic" else not placeholder(v) and (random_looking(v) or len(v) >= 20):
                    yield Finding(s + m.start(k), s + m.end(k), "header", ((s + m.start(k), s + m.end(k)),))
        if "pass" in lowered and (m := _LOGIN.search(line)):
            k = 1 if m[1] else 2
            if not placeholder(m[k]) and (k == 1 or bare_ok):
                yield Finding(s + m.start(k), s + m.end(k), "login", ((s + m.start(k), s + m.end(k)),))
        if (m := _NAME_LINE.match(line)) and name_strength(m[1]):
            z = low.find("\n", e + 1)
            v = _VALUE_LINE.match(text, e + 1, n if z < 0 else z)
            if v and not placeholder(value := v["v"] or v["w"] or "") and _grants(value, name_strength(m[1])):
                k = "v" if v["v"] is not None else "w"
                yield Finding(v.start(k), v.end(k), "assigned", ((v.start(k), v.end(k)),))
        for m in _GIVEN.finditer(line) if _GIVEN_HINT.search(lowered) else ():
            k = next(g for g in ("v1", "v2", "v3", "v4", "v5", "v6") if m[g] is not None)
            if not placeholder(m[k]):
                yield Finding(s + m.start(k), s + m.end(k), "login", ((s + m.start(k), s + m.end(k)),))
        if "in" in lowered and (m := _TOLD.search(line)) and not placeholder(m[2]) and len(m[2]) >= 6:
            yield Finding(s + m.start(2), s + m.end(2), "login", ((s + m.start(2), s + m.end(2)),))
        done = -1
        for m in _NAMES.finditer(line):
            if m.start() < done:
                continue
            if f := _assigned(text, s + m.start(), s, e, bare_ok):
                yield f
                done = f.end - s
    if path.rpartition("/")[2].lower().endswith("pgpass"):
        for m in re.finditer(r"^(?![#\s])(?:[^:\n]*:){4}([^:\s]+)\s*$", text, re.M):
            if not placeholder(m[1]):
                yield Finding(m.start(1), m.end(1), "login", ((m.start(1), m.end(1)),))
    if layers:
        yield from _encoded(text)


def _encoded(text: str) -> Iterator[Finding]:
    """Encodings with a credential inside; ``text`` has the keys already found blanked."""
    taken: list[tuple[int, int]] = []
    # the longest readings first: what is part of one isn't read again
    for pattern in (_WRAPPED, _JOINED):
        for m in pattern.finditer(text):
            spans = tuple((m.start() + p.start(), m.start() + p.end()) for p in _PIECE.finditer(m[0]))
            whole = "".join(text[a:z] for a, z in spans)
            if len(spans) > 1 and hidden(whole):
                taken.append((m.start(), m.end()))
                yield Finding(spans[0][0], spans[-1][1], "encoded", spans)
    for pattern, k in ((_ESCAPED, 2), (_PERCENT, 0), (_RUN, 0)):
        for m in pattern.finditer(text):
            a, z = m.span(k)
            if text[a : a + 7] in ("sha256-", "sha384-", "sha512-") or any(x <= a and z <= y for x, y in taken):
                continue
            if hidden(m[k]):
                taken.append((a, z))
                yield Finding(a, z, "encoded", ((a, z),))


def lines_with_credentials(path: str | None, text: str | None) -> list[int]:
    """Numbers, from 1, of the lines on which a credential begins."""
    if not text:
        return []
    found = [f.start for f in scan(path or "", text)]
    if not found:
        return []
    ends = [i for i, c in enumerate(text) if c == "\n"]
    return sorted({bisect_right(ends, p - 1) + 1 if p else 1 for p in found})


def redact(path: str | None, text: str | None) -> str | None:
    """``text`` with every credential replaced; everything else stays as it was, byte for byte."""
    if not text:
        return text
    spans = sorted({s for f in scan(path or "", text) for s in f.spans if s[1] > s[0]})
    out, last = [], 0
    for a, z in spans:
        if z <= last:
            continue
        out += [text[last : max(a, last)], REDACTED]
        last = z
    out.append(text[last:])
    return "".join(out)


# -- on tables ------------------------------------------------------------------------


def credential_lines(files: DataFrame, id_col: str = "file_id", path_col: str = "path", text_col: str = "content") -> DataFrame:
    """One row ``(file_id, line_no)`` for each line on which a credential begins.

    Null or empty contents have none; a null path only leaves the kind of file unknown;
    rows of one id are told once; an empty table gives an empty result.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, numbers = [], []
            for i, path, text in zip(b["i"], b["p"], b["t"]):
                k = lines_with_credentials(path, text)
                ids += [i] * len(k)
                numbers += k
            yield pd.DataFrame({"file_id": pd.Series(ids, dtype="Int64"), "line_no": pd.Series(numbers, dtype="int64")})

    src = files.select(F.col(id_col).cast("long").alias("i"), F.col(path_col).alias("p"), F.col(text_col).alias("t"))
    return src.mapInPandas(each, "file_id long, line_no long").distinct()


def redacted(files: DataFrame, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """``files`` with the credentials in ``text_col`` replaced; nulls stay null."""

    @F.pandas_udf("string")
    def each(paths: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([redact(p, t) for p, t in zip(paths, texts)], dtype="object")

    return files.withColumn(text_col, each(F.col(path_col), F.col(text_col)))
