import base64
import io
import json
import zipfile

from pyspark.sql import functions as F

from sheafline.sources import remote as R
from sheafline.sources.files import TreeSource


def test_tree(spark, tmp_path):
    for name, body in {".env": b"x", "_b.txt": b"y", "src/__init__.py": b"", "src/a.min.js": b"z", "node_modules/n.js": b"n", "src/.gitignore": b"*.x", "big.bin": b"0" * 20_000}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    spark.dataSource.register(TreeSource)
    read = lambda **o: spark.read.format("tree").options(path=str(tmp_path), **o).load()
    rows = {r.path: r for r in read().collect()}
    assert set(rows) == {".env", "_b.txt", "src/__init__.py", "src/a.min.js", "src/.gitignore", "big.bin"} and bytes(rows["_b.txt"].content) == b"y" and len(rows["big.bin"].head) == 8192
    assert {r.path for r in read(noise="drop", hidden="false").collect()} == {"_b.txt", "src/__init__.py", "big.bin"}
    assert read(read="list").columns == ["ord", "path", "size", "error"]
    capped = {r.path: r.content for r in read(maxBytes="100", bytesPerTask="10").select("path", "content").collect()}
    assert capped["big.bin"] is None and bytes(capped[".env"]) == b"x"
    (tmp_path / "none").mkdir()
    assert spark.read.format("tree").options(path=str(tmp_path / "none")).load().count() == 0


def test_urls(spark):
    cases = {
        "https://github.com/o/r": ("repo", "github", "o", "r", None, None), "https://github.com/o/r.git": ("repo", "github", "o", "r", None, None), "https://github.com/o/r/tree/main/a/b": ("repo", "github", "o", "r", "main", "a/b"),
        "https://gitlab.com/g/s/p/-/tree/dev/x": ("repo", "gitlab", "g/s", "p", "dev", "x"), "https://bitbucket.org/w/r/src/c/d": ("repo", "bitbucket", "w", "r", "c", "d"), "https://gist.github.com/u/0123456789abcdef": ("gist", "gist", "u", "0123456789abcdef", None, None),
        "https://x.test/a.png": ("binary", "url", None, None, None, None), "o/r": ("shorthand", "unknown", None, None, None, None), "http://localhost/x": ("bad", "url", None, None, None, None), "": ("empty", "unknown", None, None, None, None), "example.test/page": ("page", "unknown", None, None, None, None),
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", R.classified_url(F.col("u")).alias("k"), R.parsed_source(F.col("u")).alias("p"))
    for r in df.collect():
        assert (r.k, r.p.type, r.p.owner, r.p.repo, r.p.branch, r.p.sub_path) == cases[r.u], r.u


def test_paths_of_listings(spark):
    df = spark.createDataFrame([("docs/a.md",), ("docs",), ("docsx/a",)], "p string")
    assert [r[0] for r in df.select(R.in_sub_path(F.col("p"), "docs")).collect()] == [True, True, False]
    one = spark.createDataFrame([("docs/a.md",)], "p string").select(R.shown_path(F.col("p"), "docs"), R.shown_path(F.col("p"), "docs/a.md"), R.shown_path(F.col("p"), "docs/a.md", True)).first()
    assert tuple(one) == ("a.md", "a.md", "docs/a.md")


def ok(body, **headers):
    return 200, headers, body if isinstance(body, bytes) else json.dumps(body).encode()


def test_listings():
    api = "https://api.github.com/repos/o/r"
    tree = {"tree": [{"type": "blob", "path": "a/x.py"}, {"type": "tree", "path": "a"}, {"type": "blob", "path": "b"}]}
    fetch = R.recorded({api: ok({"default_branch": "dev"}), f"{api}/git/trees/dev?recursive=1": ok(tree), f"{api}/git/trees/big?recursive=1": ok({"truncated": True, "tree": []})})
    assert R.list_github(fetch, "o", "r", None, "a") == [("a/x.py", "https://raw.githubusercontent.com/o/r/dev/a/x.py")]
    assert R.list_github(fetch, "o", "r", "big", None)[0][1].endswith("/zipball/big")
    lab = "https://gitlab.com/api/v4/projects/g%2Fp"
    page = lambda n: f"{lab}/repository/tree?recursive=true&per_page=100&page={n}&ref=main"
    fetch = R.recorded({page(1): ok([{"type": "blob", "path": "x"}], **{"x-total-pages": "2"}), page(2): ok([{"type": "blob", "path": "y"}])})
    assert [p for p, _ in R.list_gitlab(fetch, "g", "p", None, None)] == ["x", "y"]
    gist = R.recorded({"https://api.github.com/gists/abc": ok({"files": {"a.txt": {"content": "hi", "raw_url": "u"}, "b.txt": {"content": "", "raw_url": "u2"}}})})
    assert R.list_gist(gist, None, "abc") == [("a.txt", "data:;base64," + base64.b64encode(b"hi").decode()), ("b.txt", "u2")]


def test_remote_source(spark, tmp_path):
    api = "https://api.github.com/repos/o/r"
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("top/a/x.py", "zipped")
    responses = {f"{api}/git/trees/main?recursive=1": ok({"tree": [{"type": "blob", "path": "x"}, {"type": "blob", "path": "gone"}]}), "https://raw.githubusercontent.com/o/r/main/x": ok(b"text"), f"{api}/git/trees/big?recursive=1": ok({"truncated": True, "tree": []}), f"{api}/zipball/big": ok(b.getvalue())}
    rec = tmp_path / "rec.json"
    rec.write_text(json.dumps({u: [s, h, base64.b64encode(c).decode()] for u, (s, h, c) in responses.items()}))
    spark.dataSource.register(R.RemoteSource)
    read = lambda branch: {tuple(r) for r in spark.read.format("remote").options(type="github", owner="o", repo="r", branch=branch, recording=str(rec)).load().collect()}
    assert read("main") == {("x", "text", 200), ("gone", None, 404)}
    assert read("big") == {("a/x.py", "zipped", 200)}


def test_errors_and_links(spark):
    df = spark.createDataFrame([(429, "30", None), (403, None, "1100"), (404, None, None)], "s int, a string, r string")
    assert [r[0] for r in df.select(R.retry_after(F.col("s"), F.coalesce("a", F.lit("")), F.coalesce("r", F.lit("")), F.lit(1000))).collect()] == [30, 100, None]
    assert df.select(R.error_text(F.col("s"), F.lit("It"))).collect()[2][0] == "It was not found"
    md = spark.range(1).select(R.flattened_links(F.lit("[a](/x) [b](https://me.test/y) [c](https://o.test/) [d](javascript:z) [e](mailto:q)"), "https://me.test").alias("x")).first().x
    assert md == "a b [c](https://o.test/) d [e](mailto:q)"


def test_single_address():
    fetch = R.recorded({})
    assert R.list_url(fetch, None, "https://x.test/a/b.md?v=1#top", None, None) == [("b.md", "https://x.test/a/b.md?v=1#top")] and R.list_url(fetch, None, "https://x.test", None, None)[0][0] == "index.html"


def test_remote_url_source(spark, tmp_path):
    url = "https://x.test/a/b.md"
    (tmp_path / "r.json").write_text(json.dumps({url: [200, {}, base64.b64encode(b"hello").decode()]}))
    spark.dataSource.register(R.RemoteSource)
    got = spark.read.format("remote").options(type="url", repo=url, recording=str(tmp_path / "r.json")).load().collect()
    assert [tuple(r) for r in got] == [("b.md", "hello", 200)]
    types = spark.createDataFrame([("text/plain",), ("application/json",), ("image/png",), ("x/y; charset=utf-8",), (None,)], "t string")
    assert [r[0] for r in types.select(R.may_be_binary(F.col("t"))).collect()] == [False, False, True, False, True]


def test_settings(tmp_path):
    from sheafline.sources import config as C

    assert C.settings({"style": "xml"}, str(tmp_path)) == {"style": "xml"}
    (tmp_path / C.CONFIG_FILES[0]).write_text("{broken")
    (tmp_path / C.CONFIG_FILES[1]).write_text('{"style": "plain"}')
    (tmp_path / "mine.json").write_text('{"style": "markdown"}')
    assert C.settings({"style": "xml", "k": 1}, str(tmp_path)) == {"style": "plain", "k": 1} and C.settings({}, str(tmp_path), "mine.json") == {"style": "markdown"} and C.settings({}, str(tmp_path), "none.json") == {"style": "plain"}


def test_item_trees(spark, tmp_path):
    from sheafline.operators import clips as L
    from sheafline.sources import config as C

    tree = {"id": 1, "author": "a", "text": "t", "created_at": "2026", "children": [{"id": 2, "author": None, "text": None, "children": [{"id": 4, "author": "d", "text": "x", "children": []}]}, {"id": 3, "author": "c", "text": "y"}]}
    (tmp_path / "1.json").write_text(json.dumps(tree))
    rows = C.item_tree(spark, str(tmp_path))
    assert [(r.id, r.depth, r.dead) for r in L.flattened(rows).orderBy("place").collect()] == [(1, 0, False), (2, 1, True), (4, 2, False), (3, 1, False)]


def test_archives_that_stay(spark):
    from sheafline.operators import archives as A

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("x.txt", "hi")
    df = spark.createDataFrame([(1, "a.zip", "zip", buf.getvalue()), (2, "b.rar", "rar", b"Rar!"), (3, "c.bin", None, b"z")], "ord long, path string, archive string, content binary")
    inside, stay = A.opened(df)
    assert [r.path for r in inside.collect()] == ["a/x.txt"] and {r.path for r in stay.collect()} == {"b.rar", "c.bin"}
    inside, stay = A.opened(df, expand=False)
    assert inside.count() == 0 and stay.count() == 3


def test_gathered_ignore_files(spark, tmp_path):
    from sheafline.operators import paths as P
    from sheafline.sources.files import ignore_sources

    for name, body in {".gitignore": "*.log\n", "a/.gitignore": "!keep.log\n", "x.log": "", "a/keep.log": "", "a/b.log": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    spark.dataSource.register(TreeSource)
    tree = spark.read.format("tree").options(path=str(tmp_path)).load()
    found = ignore_sources(tree)
    assert found == [("", "*.log\n"), ("a", "!keep.log\n")]
    assert {r.path for r in tree.where(P.ignored(F.col("path"), P.ignore_rules(found))).collect()} == {"x.log", "a/b.log"}


def test_json_values(spark):
    from sheafline.operators import extract as E

    df = spark.createDataFrame([(1, '{"a": {"k": 1}, "b": [{"k": "x"}, {"k": {"k": null}}]}'), (2, "{broken"), (3, None)], "id long, t string")
    assert [(r.id, r.pos, r.value) for r in E.json_values(df, "id", "t", "k").orderBy("id", "pos").collect()] == [(1, 0, "1"), (1, 1, '"x"'), (1, 2, '{"k": null}'), (1, 3, "null")]
