import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from sheafline.operators import paths as P

CASES = [
    ("src/node_modules/x.js", "node_modules", True), ("a/b.min.js", "*.min.js", True), ("x/src/a.ts", "src/*.ts", True), ("src/x/a.ts", "src/*.ts", False), ("src/x/a.ts", "src/**/*.ts", True),
    ("a.py", "*.py[cod]", False), ("a.pyc", "*.py[cod]", True), (".env.local", ".env.*", True), ("envx", ".env", False), ("a/b", "a{b,c}", False), ("q/ac", "a{b,c}", True), ("", "*", False), ("a", "", False), ("dir/x", "?", True),
]


@pytest.mark.parametrize("path,pattern,expected", CASES)
def test_cases(path, pattern, expected):
    assert bool(pattern and path and re.search(P.path_regex(pattern), path)) is expected


def test_in_spark_as_in_python(spark):
    df = spark.createDataFrame([(p, q, e) for p, q, e in CASES], "path string, pattern string, expected boolean")
    for pattern in {q for _, q, _ in CASES}:
        for r in df.where(F.col("pattern") == pattern).withColumn("got", P.path_matches(F.col("path"), [pattern])).collect():
            assert r.got is r.expected, r


def test_comma_breaks_brace_list():
    assert P.pattern_list("*.{ts,js}, a ,,") == ["*.{ts", "js}", "a"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.from_regex(r"[a-z0-9_]{1,10}", fullmatch=True), max_size=4), st.from_regex(r"[a-z0-9_]{1,10}", fullmatch=True))
def test_bare_pattern_is_depth_invariant(prefix, name):
    assert re.search(P.path_regex(name), "/".join([*prefix, name]))


def test_gitignore(spark):
    rules = P.ignore_rules([("", "*.log\n!keep.log\nbuild/\n/only\n# c\n\n"), ("sub", "*.txt\n"), ("sub/deep", "!a.txt\n")])
    cases = {"x.log": True, "d/keep.log": False, "build/x": True, "build": False, "only": True, "d/only": False, "sub/a.txt": True, "a.txt": False, "sub/deep/a.txt": False, "other/a.txt": False}
    got = {r.p: r.i for r in spark.createDataFrame([(k,) for k in cases], "p string").select("p", P.ignored(F.col("p"), rules).alias("i")).collect()}
    assert got == cases
    assert spark.range(1).select(P.ignored(F.lit("x"), [])).first()[0] is False


def test_language_and_kind(spark):
    rows = [("a/Dockerfile.x", "dockerfile", "code"), ("a.b/c", "b/c", "other"), ("x.PY", "python", "code"), ("readme.md", "markdown", "doc"), ("x.", "text", "other")]
    for r in spark.createDataFrame(rows, "p string, l string, k string").select("*", P.language(F.col("p")).alias("gl"), P.kind_of_file(F.col("p")).alias("gk")).collect():
        assert (r.gl, r.gk) == (r.l, r.k), r.p


def test_project_names(spark):
    sets = {1: ["My File.txt"], 2: ["app/a", "app/b/c"], 3: ["a/x", "a/y", "b/z", "r.md"], 4: ["x.md", "y.md"], 5: ["a/1", "b/1", "c/1", "d/1"], 6: ["a/1", "b/1"]}
    df = spark.createDataFrame([(b, i, p) for b, ps in sets.items() for i, p in enumerate(ps)], "b long, ord int, path string")
    assert {r.b: r.project for r in P.project_names(df, "b").collect()} == {1: "my-file", 2: "app", 3: "a", 4: "2files", 5: "a-4files", 6: "a-b"}


def test_rollup_and_tree(spark):
    df = spark.createDataFrame([(1, "a/b/x", 5, True), (1, "a/y", 2, False), (1, "z", 9, True)], "b long, path string, s long, inc boolean")
    got = {r.dir: (r.bytes, r.files, r.state) for r in P.directory_rollup(df, "b", "s", "inc").collect()}
    assert got == {"a": (7, 2, "partial"), "a/b": (5, 1, "included")}
    assert P.tree(["b/x", "a", "2", "b/y/z", "a/c"]).split("\n") == ["├── 2", "├── b", "│   ├── x", "│   └── y", "│       └── z", "└── a", "    └── c"]
