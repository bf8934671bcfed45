"""Remote sources: what a URL names, what a listing holds, and readers over recorded responses."""

from __future__ import annotations

import base64
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.scalars import host
from ..operators.classify import decode

Fetch = Callable[[str], tuple[int, dict[str, str], bytes]]
POOL = 12
_SHORTHAND = r"^[\w.-]+/[\w.-]+$"
_REPO_HOSTS = ("github.com", "gitlab.com", "bitbucket.org")
_BINARY_URL = r"(?i)\.(?:png|jpe?g|gif|webp|svg|ico|mp[34]|mov|avi|zip|gz|tar|rar|7z|exe|dmg|iso|woff2?|ttf|otf)$"


def parsed_source(url: Column) -> Column:
    """``(type, valid, owner, repo, branch, sub_path)`` of a source URL (R17); specific grammars before the fallback."""
    u = F.regexp_replace(F.trim(url), r"[?#].*$", "")
    gh = r"^https?://(?:www\.)?github\.com/([^/]+)/([^/]+?)(?:\.git)?(?:/(?:tree|blob)/([^/]+)(?:/(.*?))?)?/?$"
    gl = r"^https?://(?:www\.)?gitlab\.com/(.+?)/([^/]+?)(?:\.git)?(?:/-/(?:tree|blob)/([^/]+)(?:/(.*?))?)?/?$"
    bb = r"^https?://(?:www\.)?bitbucket\.org/([^/]+)/([^/]+?)(?:\.git)?(?:/src/([^/]+)(?:/(.*?))?)?/?$"
    gist = r"^https?://gist\.github\.com/(?:([\w-]+)/)?([0-9a-f]{8,})/?()()$"
    raw = r"^(https?)://([^/]+)/()(.*)$"
    grammars = (("gist", gist), ("github", gh), ("gitlab", gl), ("bitbucket", bb), ("url", raw))
    empty = lambda c: F.when(c != "", c)
    out = F.struct(F.lit("unknown").alias("type"), F.lit(False).alias("valid"), *(F.lit(None).cast("string").alias(n) for n in ("owner", "repo", "branch", "sub_path")))
    for kind, rx in reversed(grammars):
        part = lambda i, rx=rx: empty(F.regexp_extract(u, rx, i))
        found = F.struct(F.lit(kind).alias("type"), F.lit(True).alias("valid"), *((part(i) if kind != "url" else F.lit(None).cast("string")).alias(n) for i, n in enumerate(("owner", "repo", "branch", "sub_path"), 1)))
        out = F.when(u.rlike(rx), found).otherwise(out)
    return out


def classified_url(url: Column) -> Column:
    """``empty``, ``shorthand``, ``gist``, ``repo``, ``binary``, ``page`` or ``bad``."""
    t = F.trim(F.coalesce(url, F.lit("")))
    full = F.when(t.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), t).otherwise(F.concat(F.lit("https://"), t))
    h = host(full)
    bad = (h == "") | (h == "localhost") | h.endswith(".local") | h.rlike(r"^\d+\.\d+\.\d+\.\d+$") | ~h.contains(".") | ~full.rlike(r"^https?://")
    path = F.regexp_extract(full, r"^https?://[^/?#]+([^?#]*)", 1)
    return (
        F.when(t == "", "empty").when(t.rlike(_SHORTHAND) & ~F.element_at(F.split(t, "/"), 1).contains("."), "shorthand").when(bad, "bad").when(h == "gist.github.com", "gist")
        .when(F.regexp_replace(h, r"^www\.", "").isin(*_REPO_HOSTS) & path.rlike(r"^/[^/]+/[^/]+"), "repo").when(path.rlike(_BINARY_URL), "binary").otherwise("page")
    )


def in_sub_path(path: Column, sub: str | None) -> Column:
    """Tree items under a sub-path, or the file it names."""
    s = (sub or "").strip("/")
    return F.lit(True) if not s else path.startswith(s + "/") | (path == s)


def shown_path(path: Column, sub: str | None, keeps_exact: bool = False) -> Column:
    """A path without its sub-path; a file named exactly shows its last segment, unless the host keeps it."""
    s = (sub or "").strip("/")
    if not s:
        return path
    exact = path if keeps_exact else F.element_at(F.split(path, "/"), -1)
    return F.when(path == s, exact).when(path.startswith(s + "/"), F.substring(path, len(s) + 2, 2**30)).otherwise(path)


def retry_after(status: Column, header: Column, reset: Column, now: Column) -> Column:
    """Seconds to wait after a limit, from either header; null if none was hit."""
    wait = F.when(header.rlike(r"^\d+$"), header.cast("long")).when(reset.rlike(r"^\d+$"), F.greatest(F.lit(0), reset.cast("long") - now))
    return F.when(status.isin(403, 429), wait)


def error_text(status: Column, what: Column) -> Column:
    """What went wrong, for people."""
    return (
        F.when(status.isin(401, 403), F.concat(what, F.lit(" is private or access was refused"))).when(status == 404, F.concat(what, F.lit(" was not found")))
        .when(status == 429, F.lit("The host limits requests; try again later")).when(status >= 500, F.concat(F.lit("The host failed with "), status.cast("string"))).otherwise(F.concat(F.lit("Request failed with "), status.cast("string")))
    )


# -- readers ------------------------------------------------------------------------------------


def _json(fetch: Fetch, url: str) -> object:
    status, _, body = fetch(url)
    if status != 200:
        raise OSError(f"{status} {url}")
    return json.loads(body)


def list_github(fetch: Fetch, owner: str, repo: str, branch: str | None, sub: str | None) -> list[tuple[str, str]]:
    """``(path, address)`` of the blobs of a tree; a truncated tree yields the archive."""
    api = f"https://api.github.com/repos/{owner}/{repo}"
    branch = branch or _json(fetch, api)["default_branch"]
    tree = _json(fetch, f"{api}/git/trees/{quote(branch, safe='')}?recursive=1")
    if tree.get("truncated"):
        return [("", f"{api}/zipball/{quote(branch, safe='')}")]
    s = (sub or "").strip("/")
    return [(t["path"], f"https://raw.githubusercontent.com/{owner}/{repo}/{branch}/{quote(t['path'])}") for t in tree["tree"] if t["type"] == "blob" and (not s or t["path"] == s or t["path"].startswith(s + "/"))]


def list_gitlab(fetch: Fetch, owner: str, repo: str, branch: str | None, sub: str | None) -> list[tuple[str, str]]:
    """The same over a paginated listing."""
    api = f"https://gitlab.com/api/v4/projects/{quote(f'{owner}/{repo}', safe='')}"
    if not branch:
        status, _, body = fetch(api)
        branch = json.loads(body).get("default_branch", "main") if status == 200 else "main"
    out, page, pages = [], 1, 1
    while page <= pages:
        status, headers, body = fetch(f"{api}/repository/tree?recursive=true&per_page=100&page={page}&ref={quote(branch, safe='')}" + (f"&path={quote(sub)}" if sub else ""))
        if status != 200:
            raise OSError(f"{status} {api}")
        pages = int(headers.get("x-total-pages") or pages)
        out += [(t["path"], f"{api}/repository/files/{quote(t['path'], safe='')}/raw?ref={quote(branch, safe='')}") for t in json.loads(body) if t["type"] == "blob"]
        page += 1
    return out


def list_bitbucket(fetch: Fetch, owner: str, repo: str, branch: str | None, sub: str | None) -> list[tuple[str, str]]:
    """The same, following next links."""
    api = f"https://api.bitbucket.org/2.0/repositories/{owner}/{repo}"
    branch = branch or _json(fetch, api)["mainbranch"]["name"]
    url, out = f"{api}/src/{quote(branch, safe='')}/{quote(sub or '')}?pagelen=100&max_depth=50", []
    while url:
        page = _json(fetch, url)
        out += [(v["path"], v["links"]["self"]["href"]) for v in page["values"] if v["type"] == "commit_file"]
        url = page.get("next")
    return out


def list_gist(fetch: Fetch, owner: str | None, repo: str, branch: str | None = None, sub: str | None = None) -> list[tuple[str, str]]:
    """Files of a gist; inline content travels in the address unless it was cut."""
    out = []
    for name, f in _json(fetch, f"https://api.github.com/gists/{repo}")["files"].items():
        body = f.get("content") or ""
        out.append((name, f["raw_url"] if f.get("truncated") or not body else "data:;base64," + base64.b64encode(body.encode()).decode()))
    return out


def list_url(fetch: Fetch, owner: str | None, repo: str, branch: str | None, sub: str | None) -> list[tuple[str, str]]:
    """One file by its address, named by the last segment of the path."""
    path = repo.split("://", 1)[-1].split("?")[0].split("#")[0].partition("/")[2].rstrip("/")
    return [(path.rpartition("/")[2] or "index.html", repo)]


# fixed values: media types of texts
TEXT_TYPES = ("text/", "application/json", "application/javascript", "application/xml", "application/x-yaml")


def may_be_binary(media_type: Column) -> Column:
    """Whether a response's type says neither that it is text nor in which character set."""
    t, text = F.coalesce(media_type, F.lit("")), F.lit(False)
    for x in TEXT_TYPES:
        text = text | t.contains(x)
    return ~text & ~t.contains("charset")


LISTERS: dict[str, Callable[..., list[tuple[str, str]]]] = {"github": list_github, "gitlab": list_gitlab, "bitbucket": list_bitbucket, "gist": list_gist, "url": list_url}


def unzipped(b: bytes, sub: str | None = None) -> Iterator[tuple[str, str]]:
    """Texts of an archive whose single top directory is stripped."""
    s = (sub or "").strip("/")
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        for i in z.infolist():
            path = i.filename.partition("/")[2]
            if path and not i.is_dir() and (not s or path == s or path.startswith(s + "/")):
                yield path, decode(z.read(i)) or ""


class _Listing(InputPartition):
    def __init__(self, items: list[tuple[str, str]]):
        super().__init__(None)
        self.items = items


class RemoteReader(DataSourceReader):
    """Listing on the driver, bodies on the executors, a dozen at a time and in order."""

    def __init__(self, options: dict[str, str], fetch: Fetch):
        self.o, self.fetch = options, fetch

    def partitions(self) -> Sequence[InputPartition]:
        items = LISTERS[self.o["type"]](self.fetch, self.o.get("owner"), self.o["repo"], self.o.get("branch"), self.o.get("sub_path"))
        size = int(self.o.get("filesPerTask", 200))
        return [_Listing(items[i : i + size]) for i in range(0, max(len(items), 1), size)]

    def _one(self, item: tuple[str, str]) -> tuple[int, bytes]:
        url = item[1]
        if url.startswith("data:"):
            return 200, base64.b64decode(url.partition(",")[2])
        try:
            status, _, body = self.fetch(url)
            if status == 429:  # one more try; waiting is up to the fetcher
                status, _, body = self.fetch(url)
            return status, body
        except OSError:
            return 0, b""

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with ThreadPoolExecutor(POOL) as pool:
            for (path, url), (status, body) in zip(partition.items, pool.map(self._one, partition.items)):
                if status == 200 and "/zipball/" in url:
                    yield from ((p, t, 200) for p, t in unzipped(body, self.o.get("sub_path")))
                else:
                    yield path, decode(body) if status == 200 else None, status


def recorded(responses: dict[str, tuple[int, dict[str, str], bytes]]) -> Fetch:
    """A fetcher over recorded responses; what isn't recorded isn't found."""
    return lambda url: responses.get(url, (404, {}, b""))


class RemoteSource(DataSource):
    """``spark.read.format("remote")`` over a recording: option ``recording`` names a JSON file of ``url -> [status, headers, base64]``."""

    @classmethod
    def name(cls) -> str:
        return "remote"

    def schema(self) -> str:
        return "path STRING, content STRING, status INT"

    def reader(self, schema: StructType) -> DataSourceReader:
        with open(self.options["recording"], encoding="utf-8") as f:
            raw = json.load(f)
        return RemoteReader(dict(self.options), recorded({u: (s, h, base64.b64decode(b)) for u, (s, h, b) in raw.items()}))


def page_kind(url: Column) -> Column:
    """Thread, comment tree, video, playlist or page."""
    h, path = host(url), F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    return (
        F.when(h.rlike(r"(^|\.)reddit\.com$") & path.rlike(r"^/r/[^/]+/comments/"), "thread").when((h == "news.ycombinator.com") & url.rlike(r"/item\?id=\d+"), "comments")
        .when(h.rlike(r"(^|\.)youtube\.com$") & url.rlike(r"[?&]v=[\w-]+"), "video").when(h.rlike(r"(^|\.)youtube\.com$") & url.rlike(r"[?&]list=[\w-]+"), "playlist").otherwise("page")
    )


def flattened_links(markdown: Column, origin: str) -> Column:
    """Links within a site become their text, script links too; others stay."""
    own = re.escape(origin.rstrip("/"))
    t = F.regexp_replace(markdown, rf"\[([^\]]*)\]\((?:{own}(?:/[^)\s]*)?|/[^)\s]*|#[^)\s]*)\)", "$1")
    return F.regexp_replace(t, r"(?i)\[([^\]]*)\]\(javascript:[^)]*\)", "$1")
