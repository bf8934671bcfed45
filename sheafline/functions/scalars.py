"""Scalar functions as Column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1024 * 1024
#: Unicode white space and the byte-order mark.
TRIM = r"^[\s   -     　﻿]+|[\s   -     　﻿]+$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, TRIM, "")


def canonical_key(name: Column) -> Column:
    """Lower case; only letters, digits, dots and single dashes stay."""
    t = F.regexp_replace(F.lower(name), r"[^a-z0-9.\s_-]", "")
    return F.regexp_replace(F.regexp_replace(t, r"[\s_-]+", "-"), r"^-+|-+$", "")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def bundle_tokens(total_chars: Column, n_files: Column) -> Column:
    """Estimate for contents joined by line ends."""
    return F.ceil((total_chars + F.greatest(n_files - 1, F.lit(0))) / 4).cast("long")


def format_size(n: Column) -> Column:
    """Bytes in 1024 steps with at most two decimals, trailing zeros cut (C6); huge sizes stay in GB."""
    exp = F.least(F.floor(F.log(1024.0, F.greatest(n, F.lit(1)).cast("double"))), F.lit(3))
    value = F.round(n / F.pow(F.lit(1024.0), exp), 2)
    shown = F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")
    unit = F.element_at(F.array(*(F.lit(u) for u in ("Bytes", "KB", "MB", "GB"))), (exp + 1).cast("int"))
    return F.when(n == 0, F.lit("0 Bytes")).otherwise(F.concat_ws(" ", shown, unit))


def report_bytes(n: Column) -> Column:
    """Bytes for reports: one decimal below ten of a unit, none else; null is a dash."""
    out = F.lit("-")
    for k, unit in enumerate(("B", "KB", "MB", "GB")):
        v = n / float(1024**k)
        text = F.format_string("%.0f", v) if k == 0 else F.when(v < 10, F.format_string("%.1f", v)).otherwise(F.format_string("%.0f", v))
        upper = F.lit(True) if k == 3 else n < 1024 ** (k + 1)
        out = F.when(n.isNotNull() & (n >= (1024**k if k else 0)) & upper, F.concat(text, F.lit(unit))).otherwise(out)
    return out


def xml_attribute(c: Column) -> Column:
    """Ampersand, angles and double quotes escaped (C11)."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def safe_filename(title: Column) -> Column:
    """A title as a file name of at most 120 characters."""
    t = F.regexp_replace(title, r'[<>:"/\\|?*\x00-\x1f]', "-")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"-{2,}", "-")
    t = F.regexp_replace(F.substring(F.regexp_replace(t, r"^[. -]+|[. -]+$", ""), 1, 120), r"[. -]+$", "")
    return F.when(F.coalesce(F.length(t), F.lit(0)) == 0, F.lit("untitled")).otherwise(t)


def clip_path(folder: Column, title: Column) -> Column:
    return F.concat(safe_filename(folder), F.lit("/"), safe_filename(title), F.lit(".md"))


def yaml_string(c: Column) -> Column:
    """A double-quoted YAML scalar."""
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.regexp_replace(c, r"\s*[\r\n]+\s*", " "), F.lit('"'))


def iso_day(stamp: Column) -> Column:
    """The first ten characters of an ISO stamp, never re-zoned."""
    return F.when(stamp.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(stamp, 1, 10))


def label_value(c: Column) -> Column:
    """A counter label: lower case, disallowed characters gone, 1 to 32 long, else null."""
    t = F.regexp_replace(F.lower(c), r"[^a-z0-9._/+-]", "")
    return F.when(F.length(t).between(1, 32), t)


def amount(c: Column) -> Column:
    """A rounded quantity in ``[0, 1e12]``, else null."""
    t = F.floor(c.cast("double") + 0.5)
    return F.when(t.between(0, 10**12), t.cast("long"))


def surface_label(path: Column) -> Column:
    """A page path as a label: ``/`` is ``home``, slashes trimmed, 32 characters."""
    t = F.regexp_replace(path, r"^/+|/+$", "")
    return F.when(t == "", F.lit("home")).otherwise(F.substring(t, 1, 32))


def url_filename(url: Column) -> Column:
    """The last path segment of a URL, or ``file.txt`` (C20)."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.coalesce(F.length(name), F.lit(0)) == 0, F.lit("file.txt")).otherwise(name)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)", 1))


def without_ansi(c: Column) -> Column:
    """Terminal colour codes gone."""
    return F.regexp_replace(c, "\x1b" + r"\[[0-9;]*[A-Za-z]", "")


def capped_list(paths: Column, cap: int = 10) -> Column:
    """The first ``cap`` joined by commas, and how many more there are."""
    shown = F.array_join(F.slice(paths, 1, cap), ", ")
    rest = F.size(paths) - cap
    return F.when(rest > 0, F.concat(shown, F.lit(" +"), rest.cast("string"), F.lit(" more"))).otherwise(shown)


def file_extension(path: Column) -> Column:
    """Lower-case extension of the last segment, a leading dot not counting; ``none`` without."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))
    return F.when(ext == "", F.lit("none")).otherwise(ext)


def size_scale(n: Column) -> Column:
    """``small`` below 1 MiB, ``medium`` below 32 MiB, else ``large``."""
    return F.when(n < MIB, "small").when(n < 32 * MIB, "medium").otherwise("large")


def size_severity(n: Column) -> Column:
    return F.when(n >= 500 * 1024, "high").when(n >= 100 * 1024, "medium").when(n >= 20 * 1024, "low").otherwise("none")


def confidence_band(c: Column) -> Column:
    """Tens from 0 to 90."""
    return F.least(F.lit(90), F.floor(F.greatest(F.lit(0), c) / 10) * 10).cast("int")


def recognition_floor(confidence: Column, text: Column) -> Column:
    """Confidence of 55 and eight letters or digits of any script (P20)."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return F.coalesce((confidence >= 55) & (letters >= 8), F.lit(False))


def code_points(c: Column, pattern: str) -> Column:
    """``c`` with what ``pattern`` finds - its group a decimal number - as the character of that number."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    n = lambda x: F.coalesce(x.try_cast("int"), F.lit(0x110000))
    char = lambda x: F.when((n(x) >= 0x110000) | n(x).between(0xD800, 0xDFFF), F.lit("\ufffd")).otherwise(F.decode(F.unhex(F.lpad(F.hex(n(x)), 8, "0")), "UTF-32"))
    pieces = F.split(c, re.sub(r"\((?!\?)", "(?:", pattern))
    return F.array_join(F.transform(pieces, lambda x, i: F.concat(x, F.when(F.get(found, i).isNull(), "").otherwise(char(F.get(found, i))))), "")


# fixed values: block tags that end a line, and named entities, of HTML bodies
HTML_BREAKS = r"(?i)</?(?:p|div|br|tr|li|h[1-6]|blockquote|table)\b[^>]*>"
HTML_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def html_text(c: Column) -> Column:
    """Flattened HTML: block tags as line ends, other tags gone, numeric and named entities of any case decoded (E5)."""
    t = F.regexp_replace(c, r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>", "")
    t = F.regexp_replace(F.regexp_replace(t, HTML_BREAKS, "\n"), r"<[^>]+>", "")
    t = code_points(t, r"&#(\d+);")
    for a, b in HTML_ENTITIES:
        t = F.regexp_replace(t, f"(?i){a}", b)
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n ?", "\n")
    return trimmed(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def comment_text(c: Column) -> Column:
    """A forum comment's HTML (C12): breaks kept, paragraphs two line ends apart."""
    t = F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", "\n"), r"(?i)<p\b[^>]*>", "\n\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#x2F;", "/"), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return trimmed(t)


def numbered_lines(text: Column) -> Column:
    """Each line behind its number, at least four wide."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x, i: F.concat(F.format_string("%4d", i + 1), F.lit(" | "), x)), "\n")


def fuzzy_score(query: Column, text: Column) -> Column:
    """0 where the text holds the query; else 2 plus the edit distance to its nearest word, if close; else null."""
    q, t = canonical_key(query), canonical_key(text)
    near = F.array_min(F.transform(F.split(t, "[-.]"), lambda w: F.levenshtein(w, q)))
    limit = F.greatest(F.lit(2), F.floor(F.length(q) * 0.4))
    return F.when(F.contains(t, q), F.lit(0)).when(near <= limit, near + 2)


def rate(part: Column, whole: Column) -> Column:
    """A whole percentage, a dash where there is nothing."""
    return F.when(whole == 0, F.lit("-")).otherwise(F.concat(F.floor(part / whole * 100 + 0.5).cast("string"), F.lit("%")))


def frontmatter(text: Column) -> Column:
    """``key: value`` pairs of a leading block between dashes, quotes gone (C17)."""
    block = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    pairs = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^\w[\w-]*\s*:"))
    clean = F.transform(
        pairs,
        lambda x: F.struct(
            F.regexp_extract(x, r"^(\w[\w-]*)", 1).alias("k"),
            F.regexp_replace(F.trim(F.regexp_extract(x, r"^\w[\w-]*\s*:(.*)$", 1)), "^['\"]|['\"]$", "").alias("v"),
        ),
    )
    # a key that is given twice keeps its last value
    keys = F.array_distinct(F.transform(clean, lambda s: s["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(clean, lambda s: s["k"] == k), -1)["v"]))


def lead_paragraph(text: Column) -> Column:
    """The first paragraph after the first heading; none if a heading or fence comes first."""
    body = F.regexp_extract(text, r"(?s)(?:\A|\n)# [^\n]*\n(.*)\z", 1)
    first = F.try_element_at(F.filter(F.split(body, r"\n\s*\n"), lambda p: F.trim(p) != ""), F.lit(1))
    return F.when(~F.coalesce(first, F.lit("#")).rlike(r"^\s*(#|```)"), F.regexp_replace(trimmed(first), r"\s*\n\s*", " "))


# fixed values: error names that are told as they are
ERROR_NAMES = (
    "error", "typeerror", "rangeerror", "referenceerror", "syntaxerror", "urierror", "evalerror", "aggregateerror", "quotaexceedederror", "notallowederror", "aborterror", "securityerror",
    "networkerror", "notsupportederror", "datacloneerror",
)
# fixed values: messages of a script that didn't load, and of another origin's script
CHUNK_MESSAGE = r"(?i)dynamically imported module|importing a module script|loading chunk"
FOREIGN_MESSAGE = "Script error."


def error_kind(message: Column, name: Column) -> Column:
    """``chunk`` for a script that didn't load, ``foreign`` for another origin's, a known name, or ``other``."""
    m = F.coalesce(message, F.lit(""))
    return F.when(m.rlike(CHUNK_MESSAGE), "chunk").when(m == FOREIGN_MESSAGE, "foreign").when(F.lower(name).isin(*ERROR_NAMES), F.lower(name)).otherwise("other")


def error_label(source: Column, message: Column, name: Column) -> Column:
    """Where an error surfaced, and its kind."""
    return F.concat(source, F.lit("/"), error_kind(message, name))


# -- prices and limits of models ---------------------------------------------------------------


def fixed(x: Column, places: int) -> Column:
    """A number with so many decimals, halves away from zero."""
    return F.format_string(f"%.{places}f", F.round(x, places))


def format_cost(x: Column) -> Column:
    """An amount with more decimals the smaller it is."""
    d = F.lit("$")
    return F.when(x == 0, "$0.00").when(x < 0.001, F.concat(d, fixed(x, 6))).when(x < 0.01, F.concat(d, fixed(x, 4))).when(x < 1, F.concat(d, fixed(x, 3))).otherwise(F.concat(d, fixed(x, 2)))


def format_limit(n: Column) -> Column:
    """Tokens in millions with a decimal, in whole thousands, or as they are."""
    return F.when(n >= 1_000_000, F.concat(fixed(n / 1e6, 1), F.lit("M"))).when(n >= 1000, F.concat(fixed(n / 1000.0, 0), F.lit("K"))).otherwise(n.cast("string"))


def format_price(price_in: Column, price_out: Column) -> Column:
    """A model's input price for a list."""
    d = F.lit("$")
    return F.when((price_in == 0) & (price_out == 0), "Pricing N/A").when(price_in == 0, "Free").when(price_in < 0.01, F.concat(d, fixed(price_in, 4))).otherwise(F.concat(d, fixed(price_in, 2)))


def best_score(query: Column, *fields: Column) -> Column:
    """The fuzzy score of the first of several fields that has one."""
    return F.coalesce(*(fuzzy_score(query, f) for f in fields))


# fixed values: hosts that answer requests from other sites
RAW_HOSTS = ("raw.githubusercontent.com", "gist.githubusercontent.com", "gitlab.com", "pastebin.com", "hastebin.com", "cdn.jsdelivr.net", "unpkg.com", "cdnjs.cloudflare.com")


def may_refuse_other_sites(url: Column) -> Column:
    """Whether a host isn't known to answer requests from other sites; an address that can't be read may not."""
    h = F.coalesce(host(url), F.lit(""))
    known = F.lit(False)
    for x in RAW_HOSTS:
        known = known | h.contains(x)
    return ~known


# fixed values: recognition model of a locale
RECOGNITION_MODELS = {
    "af": "afr", "ar": "ara", "az": "aze", "be": "bel", "bg": "bul", "bn": "ben", "bs": "bos", "ca": "cat", "cs": "ces", "cy": "cym", "da": "dan", "de": "deu", "el": "ell", "en": "eng", "es": "spa", "et": "est",
    "eu": "eus", "fa": "fas", "fi": "fin", "fr": "fra", "ga": "gle", "gl": "glg", "he": "heb", "hi": "hin", "hr": "hrv", "hu": "hun", "hy": "hye", "id": "ind", "is": "isl", "it": "ita", "ja": "jpn", "ka": "kat",
    "kk": "kaz", "ko": "kor", "lt": "lit", "lv": "lav", "mk": "mkd", "ms": "msa", "mt": "mlt", "nb": "nor", "nl": "nld", "nn": "nor", "no": "nor", "pl": "pol", "pt": "por", "ro": "ron", "ru": "rus", "sk": "slk",
    "sl": "slv", "sq": "sqi", "sr": "srp", "sv": "swe", "sw": "swa", "ta": "tam", "te": "tel", "th": "tha", "tr": "tur", "uk": "ukr", "ur": "urd", "vi": "vie", "zh": "chi_sim", "zh-hant": "chi_tra", "zh-tw": "chi_tra",
    "zh-hk": "chi_tra", "zh-mo": "chi_tra",
}
# fixed values: fence language of a file fetched by its address
URL_LANGUAGES = {
    ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".py": "python", ".rb": "ruby", ".go": "go", ".rs": "rust", ".java": "java", ".kt": "kotlin", ".swift": "swift", ".c": "c", ".cpp": "cpp",
    ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".php": "php", ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".xml": "xml", ".html": "html", ".css": "css", ".scss": "scss",
    ".less": "less", ".md": "markdown", ".sql": "sql", ".graphql": "graphql", ".vue": "vue", ".svelte": "svelte",
}


def recognition_model(locales: Column) -> Column:
    """The model of the first locale that has one, by its longest known prefix; English without."""
    table = F.create_map(*(F.lit(x) for kv in RECOGNITION_MODELS.items() for x in kv))

    def model(tag: Column) -> Column:
        parts = F.split(F.lower(tag), "-")
        by_length = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.try_element_at(table, F.array_join(F.slice(parts, 1, n), "-")))
        return F.try_element_at(F.array_compact(by_length), F.lit(1))

    tags = F.filter(locales, lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(F.try_element_at(F.array_compact(F.transform(tags, model)), F.lit(1)), F.lit("eng"))


def url_language(name: Column) -> Column:
    """Fence language of a fetched file by its ending, ``text`` without."""
    table = F.create_map(*(F.lit(x) for kv in URL_LANGUAGES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))), F.lit("text"))
