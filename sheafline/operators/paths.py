"""Path predicates and path aggregates: globs, ignore files, languages, trees, names."""

from __future__ import annotations

import mimetypes
import re
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values: patterns of files that are noise in a bundle
DEFAULT_IGNORE = (
    ".git .hg .svn node_modules bower_components vendor package-lock.json yarn.lock pnpm-lock.yaml bun.lockb Cargo.lock Gemfile.lock composer.lock poetry.lock uv.lock Podfile.lock mix.lock flake.lock "
    "pubspec.lock packages.lock.json dist build out target .cache .parcel-cache .sass-cache .npm .yarn .eslintcache coverage .nyc_output *.log __tests__ .vscode .idea *.swp *.swo .vs .turbo .vercel .expo "
    ".next .nuxt .output .nx .DS_Store Thumbs.db tmp temp __pycache__ *.py[cod] venv .venv *.egg-info .eggs .mypy_cache .pytest_cache .ruff_cache .tox .ipynb_checkpoints .gradle .mvn .bundle Pods Carthage "
    "DerivedData xcuserdata .dart_tool .godot .import *.uid *.import .terraform _build .stack-work dist-newstyle .svelte-kit .astro .angular .docusaurus .pnp.js .pnp.cjs tsconfig.tsbuildinfo .env .env.* "
    "*.min.js *.min.css *.map *.gen.* *.generated.* *.snap *.tfstate *.tfstate.backup"
).split()
# fixed values: named pairs of patterns to include and to ignore; none of its own means the default noise
PRESETS = {
    "everything": ("", None), "source": ("src/**/*", "**/*.test.*, **/*.spec.*, **/__tests__"),
    "react": ("**/*.tsx, **/*.ts, **/*.jsx, **/*.js, **/*.css, **/*.json", "node_modules, .next, dist, build, coverage, **/*.test.*, **/*.spec.*, **/__tests__"),
    "vue": ("**/*.vue, **/*.ts, **/*.js, **/*.css, **/*.json", "node_modules, dist, .nuxt, coverage, **/*.test.*, **/*.spec.*"),
    "python": ("**/*.py, **/*.pyi, **/*.toml, **/*.yaml, **/*.yml, **/*.json", "__pycache__, .venv, venv, .pytest_cache, dist, build, *.egg-info, **/*_test.py"),
    "go": ("**/*.go, **/*.mod, **/*.sum, **/*.yaml, **/*.yml", "vendor, bin, **/*_test.go"), "rust": ("**/*.rs, **/*.toml, **/*.md", "target, **/*_test.rs"),
    "documents": ("**/*.pdf, **/*.docx, **/*.xlsx, **/*.pptx, **/*.odt, **/*.md, **/*.txt, **/*.rtf", None), "notes": ("**/*.md, **/*.mdx, **/*.txt, **/*.rst", None), "papers": ("**/*.pdf", None),
}
# fixed values: fence language of a file extension, where it isn't the extension itself
LANGUAGES = {
    "ts": "typescript", "js": "javascript", "py": "python", "rb": "ruby", "cs": "csharp", "rs": "rust", "kt": "kotlin", "sh": "bash", "ps1": "powershell", "yml": "yaml", "cfg": "ini", "md": "markdown",
    "gql": "graphql", "proto": "protobuf", "m": "matlab", "pl": "perl", "ex": "elixir", "exs": "elixir", "erl": "erlang", "hrl": "erlang", "clj": "clojure", "cljs": "clojure",
}
# fixed values: extensions that make a bundle a codebase or documents
CODE_KINDS = (
    "ts tsx js jsx mjs cjs py rb java cpp cc cxx c h hpp cs php go rs swift kt kts scala sh bash zsh fish ps1 html htm css scss sass less sql graphql gql proto r lua pl pm ex exs erl hrl clj cljs cljc dart vue "
    "svelte astro elm hs ipynb"
).split()
PROSE_KINDS = "md mdx markdown txt text rst org adoc asciidoc tex pdf docx xlsx pptx odt ods odp rtf epub srt vtt eml".split()
# fixed values: file names and endings that tell an ecosystem
MARKERS = (
    "package.json pnpm-lock.yaml yarn.lock package-lock.json bun.lockb deno.json tsconfig.json requirements.txt pyproject.toml setup.py pipfile environment.yml go.mod cargo.toml pom.xml build.gradle "
    "build.gradle.kts settings.gradle gemfile rakefile composer.json package.swift podfile cartfile pubspec.yaml mix.exs renv.lock dockerfile docker-compose.yml docker-compose.yaml chart.yaml jenkinsfile "
    ".gitlab-ci.yml makefile cmakelists.txt"
).split()
MARKER_ENDINGS = ".csproj .fsproj .vbproj .sln .gemspec .cabal .podspec".split()


# -- globs --------------------------------------------------------------------------------


def braces(pattern: str) -> list[str]:
    """``a{b,c}`` as ``ab`` and ``ac``, nested ones too; a list without a comma stays as it is."""
    depth, start = 0, -1
    for i, c in enumerate(pattern):
        if c == "{":
            if not depth:
                start = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                inner, parts, level, last = pattern[start + 1 : i], [], 0, 0
                for k, x in enumerate(inner):
                    level += (x == "{") - (x == "}")
                    if x == "," and not level:
                        parts.append(inner[last:k])
                        last = k + 1
                if parts:
                    parts.append(inner[last:])
                    return [y for p in parts for y in braces(pattern[:start] + p + pattern[i + 1 :])]
                return [pattern[: i + 1] + y for y in braces(pattern[i + 1 :])]
    return [pattern]


def _segment(seg: str) -> str:
    out, i = "", 0
    while i < len(seg):
        c = seg[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (j := seg.find("]", i + 2)) > 0:
            body = seg[i + 1 : j]
            out += "[" + ("^/" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = j
        elif c == "\\" and i + 1 < len(seg):
            out += re.escape(seg[i + 1])
            i += 1
        else:
            out += re.escape(c)
        i += 1
    return out


def glob_regex(pattern: str) -> str:
    """The expression, for the Java and Python engines alike, of what a glob matches as a whole.

    ``*``, ``?`` and sets stay within a segment; ``**`` as a whole segment spans any
    number of them.
    """
    alternatives = []
    for p in braces(pattern):
        segs, out = p.split("/"), ""
        for k, s in enumerate(segs):
            last = k == len(segs) - 1
            if s == "**":
                out += ".*" if last else "(?:[^/]+/)*"
            else:
                out += _segment(s) + ("" if last else "/")
        alternatives.append(out)
    return alternatives[0] if len(alternatives) == 1 else "(?:" + "|".join(alternatives) + ")"


def path_regex(pattern: str) -> str:
    """A pattern with a slash matches the path or any suffix of whole segments; a bare one any segment."""
    g = glob_regex(pattern)
    return f"^(?:.*/)?{g}$" if "/" in pattern else f"^(?:.*/)?{g}(?:/.*)?$"


def pattern_list(csv: str) -> list[str]:
    """Patterns of a comma-separated list; a brace list with a comma is broken apart, as in the original."""
    return [p for x in csv.split(",") if (p := x.strip())]


def path_matches(path: Column, patterns: str | Sequence[str]) -> Column:
    """Whether any pattern matches; one alternation, so a path is tested in one pass."""
    ps = pattern_list(patterns) if isinstance(patterns, str) else [p for p in patterns if p]
    if not ps:
        return F.lit(False)
    return F.coalesce(path.rlike("|".join(f"(?:{path_regex(p)})" for p in ps)) & (path != ""), F.lit(False))


def preset(name: str) -> tuple[str, str]:
    """Patterns to include and to ignore of a named preset."""
    include, ignore = PRESETS[name]
    return include, ", ".join(DEFAULT_IGNORE) if ignore is None else ignore


def is_noise(path: Column) -> Column:
    return path_matches(path, DEFAULT_IGNORE)


def walk_ignores(pattern: str) -> list[str]:
    """A pattern as a walker of directories takes it: bare names at any depth, others unchanged (P5)."""
    return [pattern] if "/" in pattern else [f"**/{pattern}", f"**/{pattern}/**"]


def is_hidden(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1).startswith(".")


# -- ignore files ---------------------------------------------------------------------------


class IgnoreRule:
    """One line of an ignore file, anchored to the file's directory."""

    def __init__(self, directory: str, line: str):
        self.negated = line.startswith("!")
        body = line[1:] if self.negated else line
        if body.startswith(("\\!", "\\#")):
            body = body[1:]
        only_dir = body.endswith("/")
        body = body.rstrip("/")
        anchored = "/" in body
        g = glob_regex(body.lstrip("/"))
        base = re.escape(directory.strip("/")) + "/" if directory.strip("/") else ""
        tail = "/.+" if only_dir else "(?:/.*)?"
        self.regex = f"^{base}{'' if anchored else '(?:.*/)?'}{g}{tail}$"


def ignore_rules(sources: Iterable[tuple[str, str]]) -> list[IgnoreRule]:
    """Rules of ``(directory, content)`` files, shallow first; comments and blank lines are none."""
    out = []
    for directory, content in sorted(sources, key=lambda s: (s[0].strip("/").count("/") + bool(s[0].strip("/")), s[0])):
        for raw in (content or "").replace("\r\n", "\n").split("\n"):
            line = raw if raw.endswith("\\ ") else raw.rstrip()
            if line and not line.startswith("#"):
                out.append(IgnoreRule(directory, line))
    return out


def ignored(path: Column, rules: Sequence[IgnoreRule]) -> Column:
    """The last rule that matches has the word.

    Runs of rules of one sign fold into one alternation, so the expression grows with
    the changes of sign, not with the rules.
    """
    out, i = F.lit(False), 0
    while i < len(rules):
        j = i
        while j < len(rules) and rules[j].negated == rules[i].negated:
            j += 1
        hit = path.rlike("|".join(f"(?:{r.regex})" for r in rules[i:j]))
        out = F.when(hit, F.lit(not rules[i].negated)).otherwise(out)
        i = j
    return F.coalesce(out, F.lit(False))


# -- what a path tells ------------------------------------------------------------------------


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def language(path: Column) -> Column:
    """Fence language (R14): the text after the last dot of the whole path, mapped, else itself, else ``text``."""
    low = F.lower(path)
    ext = F.element_at(F.split(low, r"\."), -1)
    return (
        F.when(F.contains(low, F.lit("dockerfile")), "dockerfile")
        .when(F.contains(low, F.lit("makefile")), "makefile")
        .otherwise(F.coalesce(F.element_at(_map(LANGUAGES), ext), F.when(ext != "", ext), F.lit("text")))
    )


def kind_of_file(path: Column) -> Column:
    """``code``, ``doc`` or ``other``."""
    low = F.lower(path)
    ext = F.element_at(F.split(low, r"\."), -1)
    return F.when(low.rlike("dockerfile|makefile"), "code").when(ext.isin(PROSE_KINDS), "doc").when(ext.isin(CODE_KINDS), "code").otherwise("other")


def bundle_kind(files: DataFrame, by: str, path: str = "path") -> DataFrame:
    """``codebase``, ``documents`` or ``files`` per bundle: the plurality, a tie is ``files``."""
    k = kind_of_file(F.col(path))
    per = files.groupBy(by).agg(F.count_if(k == "code").alias("code"), F.count_if(k == "doc").alias("doc"))
    kind = F.when(F.col("code") > F.col("doc"), "codebase").when(F.col("doc") > F.col("code"), "documents").otherwise("files")
    return per.select(by, kind.alias("kind"), "code", "doc")


def ecosystem_marker(path: Column) -> Column:
    """The file name that tells an ecosystem, or the ending without its dot, or null."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    out = F.when(name.isin(MARKERS), name)
    for e in MARKER_ENDINGS:
        out = out.when(name.endswith(e) & (F.length(name) > len(e)), F.lit(e[1:]))
    return out


def slug(c: Column) -> Column:
    """Only lower-case letters, digits, dashes and underscores; a dash less at either end."""
    t = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9_-]", "-"), r"-+", "-")
    return F.regexp_replace(t, r"^-|-$", "")


def project_names(files: DataFrame, by: str, path: str = "path", order: str = "ord") -> DataFrame:
    """A name per bundle from its paths.

    Counts per bundle and top directory come first, so a bundle of any size is folded
    to as many rows as it has top directories before it meets itself.
    """
    parts = F.filter(F.split(F.col(path), "/"), lambda x: x != "")
    rows = files.select(F.col(by).alias("__b"), F.col(order).alias("__o"), F.element_at(parts, 1).alias("top"), (F.size(parts) > 1).alias("deep"), F.element_at(parts, -1).alias("leaf"))
    per = rows.groupBy("__b", "top").agg(F.count(F.lit(1)).alias("n"), F.count_if("deep").alias("in_dir"), F.min(F.when(F.col("deep"), F.col("__o"))).alias("first"), F.min("leaf").alias("leaf"))
    dirs = F.filter(F.array_sort(F.collect_list(F.struct((-F.col("in_dir")).alias("m"), "first", "top"))), lambda s: s["m"] < 0)
    one = per.groupBy("__b").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("tops"), F.sum("in_dir").alias("deep"), dirs.alias("d"), F.first("top").alias("top"), F.first("leaf").alias("leaf"))
    named = (
        F.when((F.col("n") == 1) & (F.col("deep") == 0), slug(F.regexp_replace("leaf", r"\.[^/.]+$", "")))
        .when((F.col("tops") == 1), slug(F.col("top")))
        .when(F.size("d") == 0, slug(F.concat(F.col("n").cast("string"), F.lit("files"))))
        .when(-F.col("d")[0]["m"] > F.col("deep") / 2, slug(F.col("d")[0]["top"]))
        .when(F.size("d") <= 3, slug(F.array_join(F.transform("d", lambda s: s["top"]), "-")))
        .otherwise(slug(F.concat(F.col("d")[0]["top"], F.lit("-"), F.col("n").cast("string"), F.lit("files"))))
    )
    return one.select(F.col("__b").alias(by), named.alias("project"))


def ancestors(path: Column) -> Column:
    """Every directory a path lies in, from the top."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.when(F.size(parts) > k, F.array_join(F.slice(parts, 1, k), "/")))


def directory_rollup(files: DataFrame, by: str, size: str, included: str | None = None, path: str = "path") -> DataFrame:
    """Recursive size, count and inclusion state per directory."""
    inc = F.col(included) if included else F.lit(True)
    rows = files.select(F.col(by), F.explode(F.filter(ancestors(F.col(path)), lambda x: x.isNotNull())).alias("dir"), F.col(size).alias("__s"), inc.alias("__i"))
    per = rows.groupBy(by, "dir").agg(F.sum("__s").alias("bytes"), F.count(F.lit(1)).alias("files"), F.count_if("__i").alias("included"))
    state = F.when(F.col("included") == 0, "excluded").when(F.col("included") == F.col("files"), "included").otherwise("partial")
    return per.withColumn("state", state)


def tree(paths: Sequence[str]) -> str:
    """A drawing of the directories of one bundle, in order of insertion; names like integers come first (B1)."""
    root: dict = {}
    for p in paths:
        node = root
        parts = [x for x in p.split("/") if x]
        for k, part in enumerate(parts):
            if k == len(parts) - 1:
                node.setdefault(part, None)
            else:
                if node.get(part) is None:
                    node[part] = {}
                node = node[part]

    def ordered(node: dict) -> list[str]:
        ints = sorted((k for k in node if k.isdigit() and str(int(k)) == k and int(k) < 2**32 - 1), key=int)
        return ints + [k for k in node if k not in set(ints)]

    lines: list[str] = []

    def draw(node: dict, indent: str) -> None:
        names = ordered(node)
        for k, name in enumerate(names):
            last = k == len(names) - 1
            lines.append(f"{indent}{'└── ' if last else '├── '}{name}")
            if node[name]:
                draw(node[name], indent + ("    " if last else "│   "))

    draw(root, "")
    return "\n".join(lines)


def drawing(listed: Column) -> Column:
    """The drawing of an array of paths (B1)."""

    @F.pandas_udf("string")
    def drawn(paths: pd.Series) -> pd.Series:
        return pd.Series([tree(list(p)) for p in paths], dtype="object")

    return drawn(listed)


def trees(files: DataFrame, by: str, path: str = "path", order: str = "ord", tie: str = "file_id") -> DataFrame:
    """``(by, tree)``: the drawing of each bundle (B1); a drawing is one text, so a bundle's paths meet in one row."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, tie, path))), lambda s: s[path])
    return files.groupBy(by).agg(listed.alias("__p")).select(by, drawing(F.col("__p")).alias("tree"))


def listed_children(files: DataFrame, by: str, path: str = "path") -> DataFrame:
    """``(by, parent, name, directory, place)``: entries of each directory, directories first, then by name."""
    parts = F.filter(F.split(F.col(path), "/"), lambda x: x != "")
    steps = F.transform(F.sequence(F.lit(1), F.size("__s")), lambda k: F.struct(F.array_join(F.slice("__s", 1, k - 1), "/").alias("parent"), F.element_at("__s", k).alias("name"), (k < F.size("__s")).alias("directory")))
    rows = files.select(F.col(by), parts.alias("__s")).where(F.size("__s") > 0).select(by, F.inline(steps))
    one = rows.groupBy(by, "parent", "name").agg(F.max("directory").alias("directory"))
    place = F.row_number().over(Window.partitionBy(by, "parent").orderBy(F.col("directory").desc(), "name"))
    return one.withColumn("place", place)


def binary_endings() -> list[str]:
    """Endings of media, archives, office files, fonts and programs (P12), by the kinds registered for them."""
    known = mimetypes.MimeTypes(filenames=()).types_map[1]
    textual = ("text/", "application/json", "application/javascript", "application/xml", "image/svg", "message/", "application/x-sh", "application/x-csh", "application/n-", "application/trig", "application/manifest")
    texts = {"ts", "sh", "csh", "tcl", "tex", "latex", "texi", "texinfo", "roff", "t", "tr", "man", "me", "ms", "py", "m3u8", "webmanifest", "xsl", "rdf", "wsdl", "xpdl", "js", "mjs", "json", "xml", "c", "h", "ai", "eps", "ps", "src", "shar", "oda"}
    more = "7z rar xz bz2 gz tgz tbz2 lz lzma zst jar war apk dmg iso img deb rpm class dex pyd o a so dll exe bin dat db sqlite woff woff2 ttf otf eot ttc psd sketch ico icns heic heif avif mkv m4a flac epub odt ods odp docx xlsx pptx".split()
    return sorted({e.lstrip(".").lower() for e, kind in known.items() if not kind.startswith(textual)} - texts | set(more))


def binary_by_name(path: Column, endings: Sequence[str] | None = None) -> Column:
    """Whether a file's ending is on the list of those that hold no text (P12); the list is a parameter."""
    ext = F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^.+\.([^.]*)$", 1))
    return F.coalesce(ext.isin(list(endings if endings is not None else binary_endings())), F.lit(False))


# fixed values: formats of documents that may be scans, and of images whose writing can be read
SCANNABLE = ("pdf", "docx", "pptx", "odt", "odp", "rtf")
RECOGNISABLE = ("png", "jpeg", "gif", "tiff", "webp")


def may_be_read(format_: Column) -> Column:
    """``document`` or ``image`` where recognition can be offered."""
    return F.when(F.lower(format_).isin(*SCANNABLE), "document").when(F.lower(format_).isin(*RECOGNISABLE), "image")
