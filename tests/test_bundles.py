import json
import random

import pytest
from pyspark.sql import functions as F

from sheafline.functions import scalars as S
from sheafline.operators import bundles as B
from sheafline.operators import catalog as C
from sheafline.operators import clips as L
from sheafline.operators import ingest as I

FILES = "bundle_id long, file_id long, ord int, path string, content string, size_bytes long, recognised boolean"


def test_styles(spark):
    rows = [(1, 2, 1, 'b"<.py', "x < y & z", 9, False), (1, 1, 0, "a.py", "```", 3, True), (2, 3, 0, "n.md", None, 0, None), (3, 4, 0, "x.py", "p", 1, None), (3, 5, 1, "y.md", "q", 1, None)]
    df = spark.createDataFrame(rows, FILES)
    xml = {r.bundle_id: (r.kind, r.bundle) for r in B.assembled(df, "xml").collect()}
    assert [xml[k][0] for k in (1, 2, 3)] == ["codebase", "documents", "files"]
    assert '<file path="b&quot;&lt;.py" language="python">\nx < y & z\n</file>' in xml[1][1] and xml[1][1].index("a.py") < xml[1][1].index("x < y")
    assert "- text below was read by recognition, a guess at the characters rather than the file's own: a.py" in xml[1][1] and "recognition" not in xml[2][1]
    md = {r.bundle_id: r.bundle for r in B.assembled(df, "markdown").collect()}
    assert "### a.py\n\n```python\n```\n```" in md[1] and md[1].startswith("# Codebase: project")
    plain = {r.bundle_id: r.bundle for r in B.assembled(df, "plain").collect()}
    assert f"{B.RULE}\nFILE: x.py\n{B.RULE}\np\n\n{B.RULE}\nFILE: y.md" in plain[3]
    assert B.assembled(df.limit(0), "xml").count() == 0


def test_exclusion_lines(spark):
    s = F.struct(F.array().cast("array<string>").alias("oversize"), F.array(F.lit("a")).alias("unextractable"), F.array(*(F.lit(f"p{k}") for k in range(12))).alias("binary"), F.array().cast("array<string>").alias("unreadable"))
    got = spark.range(1).select(B.exclusion_lines(s).alias("x")).first().x
    assert got == ["Not included (content not shown):", "- no extractable text: a", "- 12 image or binary files: " + ", ".join(f"p{k}" for k in range(10)) + " +2 more"]


def test_parts_like_a_loop(spark):
    rng = random.Random(1)
    rows = [(b, b * 100 + k, k, f"f{k}", "", rng.randrange(0, 60), None) for b in range(5) for k in range(30)]
    got = {r.file_id: r.part for r in B.parts(spark.createDataFrame(rows, FILES), 100).collect()}
    for b in range(5):
        part, used = 1, 0
        for r in rows:
            if r[0] == b:
                if used and used + r[5] > 100:
                    part, used = part + 1, 0
                used += r[5]
                assert got[r[1]] == part


def test_weights(spark):
    rows = [(1, 1, 0, "a", "x" * 700, 0, None), (1, 2, 1, "b", "x" * 100, 0, None), (2, 3, 0, "c", None, 0, None)]
    got = {r.bundle_id: r for r in B.weights(spark.createDataFrame(rows, FILES), 250).collect()}
    assert (got[1].tokens, got[1].level, got[1].dominant) == (201, "tight", "a") and (got[2].tokens, got[2].level, got[2].dominant) == (0, "fits", None)


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(S.format_size(F.lit(n))) for n in (0, 1, 1024, 1536, 5 * 1024**3)] == ["0 Bytes", "1 Bytes", "1 KB", "1.5 KB", "5 GB"]
    assert [one(S.report_bytes(F.lit(n).cast("long"))) for n in (None, 5, 1536, 20_480)] == ["-", "5B", "1.5KB", "20KB"]
    assert one(S.canonical_key(F.lit("  GPT  4o_mini (x)!"))) == "gpt-4o-mini-x" and one(S.safe_filename(F.lit(' a/b:"c". '))) == "a-b-c"
    assert one(S.safe_filename(F.lit("..."))) == "untitled" and one(S.iso_day(F.lit("2026-01-02T23:00Z"))) == "2026-01-02"
    assert one(S.without_ansi(F.lit("\x1b[31mred\x1b[0m"))) == "red" and one(S.surface_label(F.lit("/"))) == "home"
    assert [one(S.fuzzy_score(F.lit(q), F.lit("Sonnet Large"))) for q in ("sonnet", "sonet", "qqqq")] == [0, 3, None]
    assert one(S.frontmatter(F.lit('---\na: "x"\nb: y: z\na: last\n---\nt'))) == {"a": "last", "b": "y: z"}
    assert one(S.lead_paragraph(F.lit("# T\n\nfirst\nline\n\nnext"))) == "first line" and one(S.lead_paragraph(F.lit("# T\n\n## U\n"))) is None
    assert one(S.numbered_lines(F.lit("a\nb"))) == "   1 | a\n   2 | b" and one(S.comment_text(F.lit("a<p>b<br>c &amp; d"))) == "a\n\nb\nc & d"
    assert one(S.html_text(F.lit(" <p>a</p><style>x</style>b &nbsp; c"))) == "a\nb c"


def test_decisions(spark):
    rows = [("a.py", None, 0), ("b.js", None, 1), ("c.png", "Binary file", 2), ("d.md", None, 3), ("e.py", None, 4)]
    df = spark.createDataFrame(rows, "path string, reason string, ord int")
    forced = spark.createDataFrame([("b.js", True, 1), ("c.png", True, 1), ("a.py", True, 1), ("a.py", False, 2)], "path string, include boolean, ord int")
    got = {r.path: (r.included, r.why) for r in I.decisions(df, include="*.py,*.js", ignore="*.js", overrides=forced).collect()}
    assert got == {"a.py": (False, "Excluded manually"), "b.js": (True, None), "c.png": (False, "Binary file"), "d.md": (False, "Outside include patterns"), "e.py": (True, None)}


def test_merge_and_recognition(spark):
    old = spark.createDataFrame([("a", 0, "1"), ("b", 1, "2")], "path string, ord int, content string")
    new = spark.createDataFrame([("b", 0, "3"), ("c", 1, "4")], "path string, ord int, content string")
    got = [(r.path, r.content) for r in I.merged_by_path(old, new, ["path"]).orderBy("place").collect()]
    assert got == [("a", "1"), ("b", "3"), ("c", "4")]
    read = spark.createDataFrame([("a", 0, " "), ("d", 0, "5")], "path string, ord int, content string")
    assert {(r.path, r.content) for r in I.recognition_merged(old, read, ["path"]).collect()} == {("b", "2"), ("d", "5")}


def test_empty_kinds(spark):
    rows = [(1, "a.pdf", False, "No extractable text"), (2, "a.py", False, "Matched ignore patterns"), (3, "a.png", False, "Binary file"), (4, "a.py", True, None), (5, "x.zip", False, "Binary file")]
    df = spark.createDataFrame(rows, "bundle_id long, path string, included boolean, why string")
    assert {r.bundle_id: r.kind for r in I.empty_kind(df).collect()} == {1: "scanned", 2: "filtered", 3: "image", 5: "archive"}


def test_catalog(spark):
    cat = spark.createDataFrame([("Big Model", 1)], "name string, id int")
    off = spark.createDataFrame([("big-model", 5.0, 2), ("BIG_model", 3.0, 1), ("other", 1.0, 9), ("big model", None, 4)], "name string, price double, size int")
    m = C.matched(cat, off, "name", "name", F.col("price").isNotNull())
    assert m.count() == 2 and C.cheapest(m, ["match_key"], "price", "size").first().price == 3.0
    rows = spark.createDataFrame([("A b", True, 0.0, 9, 1), ("a-b", True, 5.0, 1, 2), ("a_b", False, 1.0, 9, 3), ("A B", True, 4.0, 1, 4)], "name string, first boolean, price double, size int, ord int")
    assert C.deduplicated(rows, "name", "first", "price", "size", "ord").first().ord == 4
    assert spark.range(1).select(C.total_price(F.lit(1_000_000), None, F.lit(3.0), F.lit(15.0)).alias("x")).first().x == 4.5
    assert [r.n for r in C.newest_first(spark.createDataFrame([(None, "a"), ("2026", "b"), ("2026", "a")], "d string, n string"), "d", "n").collect()] == ["a", "b", "a"]


def test_threads(spark):
    items = spark.createDataFrame([(1, 'A "t"', "https://x.test", "ann", "2026-01-02T00", "body", 3), (2, None, None, None, None, None, None)], "thread_id long, title string, url string, author string, created string, text string, total int")
    comments = spark.createDataFrame([(1, 0, "bo", "2026-01-03", 5, 0, "one\ntwo", False), (1, 1, None, None, None, 12, "deep", False), (1, 2, "x", None, None, 0, "dead", True)], "thread_id long, pos int, author string, created string, score int, depth int, text string, dead boolean")
    got = {r.thread_id: r.markdown for r in L.thread(items, comments).collect()}
    assert 'title: "A \\"t\\""' in got[1] and "2 of 3 comments" in got[1] and "**bo** · 2026-01-03 · 5 points\none\ntwo" in got[1] and "> " * 8 + "deep" in got[1] and "dead" not in got[1]
    assert "No comments were read." in got[2]


def test_unique_paths(spark):
    rows = [(1, "x.md"), (2, "x.md"), (3, "x-2.md"), (4, "x.md"), (5, "y"), (6, "y"), (7, "x-4.md")]
    got = {r.ord: r.unique_path for r in L.unique_paths(spark.createDataFrame(rows, "ord int, path string")).collect()}
    assert got == {1: "x.md", 2: "x-3.md", 3: "x-2.md", 4: "x-5.md", 5: "y", 6: "y-2", 7: "x-4.md"} and len(set(got.values())) == 7


def test_flatten_and_upsert(spark):
    nodes = spark.createDataFrame([(1, None, 0), (2, 1, 1), (3, 1, 0), (4, 2, 0), (5, None, 1)], "id long, parent_id long, ord int")
    got = [(r.id, r.depth) for r in L.flattened(nodes).orderBy("place").collect()]
    assert got == [(1, 0), (3, 1), (2, 1), (4, 2), (5, 0)]
    old = spark.createDataFrame([("a", 1, False, "full")], "k string, ord int, partial boolean, t string")
    new = spark.createDataFrame([("a", 2, True, "part"), ("b", 2, True, "part")], "k string, ord int, partial boolean, t string")
    assert {(r.k, r.t) for r in L.upserted(old, new, ["k"], partial="partial").collect()} == {("a", "full"), ("b", "part")}


def test_flatten_deep_threads_and_long_ids(spark):
    big = 10**11
    rows = [(k, k - 1 if k else None, k) for k in range(150)] + [(big + 7, 0, big + 7), (big + 3, 0, big + 3), (900, 901, 900), (901, 900, 901), (902, 900, 902), (903, 999, 903)]
    got = [(r.id, r.depth) for r in L.flattened(spark.createDataFrame(rows, "id long, parent_id long, ord long")).orderBy("place").collect()]
    assert got == [(k, k) for k in range(150)] + [(big + 3, 1), (big + 7, 1)]


def test_push(spark):
    rows = [(1, "a/b.md", "x"), (2, "a/../b.md", "x"), (2, "ok.md", "x"), (3, "c.md", "x" * 30)]
    df = spark.createDataFrame(rows, "batch long, path string, markdown string")
    assert {r.batch for r in L.admitted_push(df, "batch", max_chars=20).collect()} == {1}


def test_tables_of_languages(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    model = lambda *tags: one(S.recognition_model(F.array(*(F.lit(t) for t in tags)).cast("array<string>")))
    assert [model("zh-Hant-TW"), model("xx", "pt-BR"), model("", "xx"), model(), model("nb")] == ["chi_tra", "por", "eng", "eng", "nor"]
    assert [one(S.url_language(F.lit(n))) for n in ("a.tsx", "b", "c.unknown", "x.H")] == ["typescript", "text", "text", "c"]
    assert [one(S.error_kind(F.lit(m), F.lit(n))) for m, n in (("Loading chunk 3 failed", "x"), ("Script error.", None), ("m", "TypeError"), (None, "Odd"))] == ["chunk", "foreign", "typeerror", "other"]


def test_written_bundles(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 0, "a.py", "x", 1, None), (2, 2, 0, "b.md", "y", 1, None)], FILES)
    b = B.assembled(df, "plain")
    B.write_bundles(b, str(tmp_path / "out"))
    texts = {r.bundle_id: r.value for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect()}
    assert texts[1].startswith("Codebase: project") and "FILE: b.md" in texts[2]
    assert B.artifact(b.where("bundle_id = 1")) == texts[1]
    for bad in (lambda: B.artifact(b), lambda: B.artifact(b.limit(1), as_json=True)):
        with pytest.raises(ValueError):
            bad()


def test_accounts(spark):
    rows = [(1, 10, None, True), (1, 20, None, None), (1, 30, "oversize", None), (1, None, "readError", None), (2, 5, "binary", True), (2, 6, "parseFailed", False)]
    a = B.accounting(spark.createDataFrame(rows, "bundle_id long, size_bytes long, skipped string, parsed boolean"))
    got = {r.bundle_id: json.loads(r.value) for r in B.run_summary(a, "xml", seconds=1.23456).collect()}
    assert got[1] == {"files": 2, "parsed": 1, "skipped": 2, "skippedBreakdown": {"oversize": 1, "binary": 0, "readError": 1, "parseFailed": 0}, "totalBytes": 30, "outputPath": "stdout", "elapsedSeconds": 1.235, "style": "xml"}
    assert got[2]["files"] == 0 and got[2]["totalBytes"] == 0 and got[2]["skipped"] == 2


def test_missing_lists_and_parts_in_bundles(spark):
    rows = [(1, 1, 0, "src/a.py", "x" * 30, 30, None), (1, 2, 1, "src/b.py", "y" * 25, 25, None), (1, 3, 2, "10/n.md", "z", 1, None), (2, 4, 0, "c.py", "w", 1, None)]
    df = spark.createDataFrame(rows, FILES)
    lacking = spark.createDataFrame([(1, ["big.bin"], [], ["p.png", "q.png"])], "bundle_id long, oversize array<string>, unextractable array<string>, binary array<string>")
    got = {r.bundle_id: r.bundle for r in B.assembled(df, "markdown", excluded=lacking).collect()}
    assert "File count: 3.\nNot included (content not shown):\n- over the size limit: big.bin\n- 2 image or binary files: p.png, q.png\n" in got[1] and "Not included" not in got[2]
    assert "```\n├── 10\n│   └── n.md\n└── src\n    ├── a.py\n    └── b.py\n```" in got[1]
    cut = B.split_parts(df, 20)
    assert sorted((r.bundle_id, r.part, r.path, len(r.content)) for r in cut.collect()) == [
        (1, 1, "src/a.py (part 1/2)", 20), (1, 2, "src/a.py (part 2/2)", 10), (1, 3, "src/b.py (part 1/2)", 20), (1, 4, "src/b.py (part 2/2)", 5), (1, 5, "10/n.md", 1), (2, 1, "c.py", 1),
    ]
    parts = {(r.bundle_id, r.part): r.bundle for r in B.assembled(cut, "plain", by=("bundle_id", "part"), n_parts="n_parts").collect()}
    assert parts[1, 2].startswith("Files: project (Part 2 of 5)\n") and "Part 2 of 5.\n" in parts[1, 2] and len(parts) == 6
    assert B.parts(df.limit(0), 20).count() == 0


def test_prices_and_labels(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(S.format_cost(F.lit(x))) for x in (0.0, 0.00042, 0.0042, 0.42, 4.2)] == ["$0.00", "$0.000420", "$0.0042", "$0.420", "$4.20"]
    assert [one(S.format_limit(F.lit(n))) for n in (999, 128_000, 1_000_000, 1_050_000)] == ["999", "128K", "1.0M", "1.1M"]
    assert [one(S.format_price(F.lit(a), F.lit(b))) for a, b in ((0.0, 0.0), (0.0, 1.0), (0.005, 1.0), (3.0, 1.0))] == ["Pricing N/A", "Free", "$0.0050", "$3.00"]
    assert [one(S.may_refuse_other_sites(F.lit(u))) for u in ("https://raw.githubusercontent.com/o/r/x", "https://cdn.jsdelivr.net/x", "https://x.test/a", "nonsense")] == [False, False, True, True]
    assert one(S.html_text(F.lit("<P>a&#8364;&#38;lt;&LT;&#x41;<br>&#1114112;&NBSP;b</p>"))) == "a€<<&#x41;\n\ufffd b"
    assert one(S.error_label(F.lit("error"), F.lit("importing a module script failed"), F.lit("TypeError"))) == "error/chunk"


def test_models(spark):
    rows = [("B Sonnet", 2, 3.0, 15.0), ("A", 1, 0.0, 0.0), ("C", 3, 1.0, 5.0)]
    m = spark.createDataFrame(rows, "name string, ord int, input_cost double, output_cost double").withColumn("context_limit", F.lit(1000)).withColumn("provider", F.lit("p,q"))
    costs = C.cost_table(m, 1_000_000)
    assert [r.name for r in C.by_cost(costs).collect()] == ["A", "C", "B Sonnet"] and [r.name for r in C.by_cost(costs, "name", True).collect()] == ["C", "B Sonnet", "A"]
    assert {r["Total Cost"] for r in C.cost_lines(costs).collect()} == {"$0.00", "$1.50", "$4.50"}
    assert C.default_pick(m, "ord").first().name == "B Sonnet" and C.default_pick(m.where("ord <> 2"), "ord").first().name == "A"


def test_written_costs(spark, tmp_path):
    m = spark.createDataFrame([("A, b", "p", 5, 1.0, 1.0)], "name string, provider string, context_limit int, input_cost double, output_cost double")
    C.write_costs(C.cost_table(m, 10), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["Model"] == "A, b"


def test_order_of_threads_and_seen(spark):
    rows = spark.createDataFrame([("a", "g2", 1, 50), ("b", "g1", None, 10), ("c", "g1", 9, 5)], "id string, group string, replies int, ts long")
    assert [r.id for r in L.ranked_threads(rows, ["g1", "g2"]).collect()] == ["b", "c", "a"] and [r.id for r in L.ranked_threads(rows, ["g1", "g2"], by_replies=True).collect()] == ["c", "b", "a"]
    assert {(r.id, r.ts) for r in L.seen_after(rows.where("id <> 'c'").select("id", (F.col("ts") - 1).alias("ts")), rows.where("id <> 'b'")).collect()} == {("a", 50), ("b", 9), ("c", 5)}


def test_not_text_and_kinds(spark):
    v = spark.createDataFrame([("a.rar", False, "Binary file"), (".b", False, "Hidden file"), ("c.pdf", False, "No extractable text"), ("d", False, ""), ("e.py", True, None)], "path string, included boolean, reason string")
    gone = spark.createDataFrame([("f", "timed out")], "path string, error string")
    got = {r.path: r.why for r in I.not_text(v, v.where("path = 'c.pdf'"), gone, ["path"]).collect()}
    assert got == {"a.rar": "This kind of archive can't be opened", "d": "Not text", "f": "timed out"}
    rows = [(1, "a.pdf", "No extractable text"), (1, "a.py", "Matched ignore patterns"), (2, "a.png", "Binary file"), (2, "b.gif", "Binary file"), (3, "x.tgz", "Binary file"), (4, "a.bin", "Binary file")]
    df = spark.createDataFrame(rows, "bundle_id long, path string, why string").withColumn("included", F.lit(False))
    assert {r.bundle_id: r.kind for r in I.empty_kind(df, offerable=F.col("path") == "b.gif").collect()} == {1: "scanned", 2: "recognisable", 3: "archive", 4: "other"}


def test_presets(spark):
    from sheafline.operators import paths as P

    include, ignore = P.preset("python")
    rows = spark.createDataFrame([("a/b.py",), ("a/b_test.py",), ("a.js",), ("venv/x.py",)], "path string").withColumn("ord", F.lit(0))
    assert [r.path for r in I.decisions(rows, include, ignore).where("included").collect()] == ["a/b.py"]
    assert P.preset("papers")[1].startswith(".git, ") and len(P.PRESETS) == 10
