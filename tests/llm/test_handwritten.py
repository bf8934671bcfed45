import itertools
import random

import pandas as pd
from pyspark.sql import functions as F

from sheafline.llm import handwritten as H


def code(seed, n=40):
    rng = random.Random(seed)
    names = [f"v{seed}_{k}" for k in range(12)]
    stmts = ["    {a} = {b}.get({c}, {n})", "    if {a} > {n}:\n        return {b}", "    for {a} in {b}:\n        {c}.append({a})", "    {a} = [x for x in {b} if x != {n}]", "    log.debug('{a}', {b})", "    {a}, {b} = {c}, {n}", "    assert {a} is not None, {b}"]
    return "\n".join(["def f():"] + [rng.choice(stmts).format(a=rng.choice(names), b=rng.choice(names), c=rng.choice(names), n=rng.randrange(99)) for _ in range(n)])


def test_marks():
    assert H.marks("x/package-lock.json", "{}") == "lock" and H.marks("a.js.map", "{") == "map" and H.marks("a.min.css", "x") == "minified"
    assert H.marks("a.py", "# Code generated by x-gen. DO NOT EDIT.\nx = 1") == "generated" and H.marks("a.ts", "// <auto-generated>\n//  Changes are lost.\n") == "generated"
    assert H.marks("a.go", "// Dieser Code wurde automatisch erzeugt. Nicht bearbeiten.\n") == "generated" and H.marks("src/x.gen.ts", "x") == "generated"
    for decoy in ("// This module decides whether a file is auto-generated.", "// Emits the line 'DO NOT EDIT' at the top of every produced file.", "// Writes the generated client; edit the template, not the output.", "// Checks that nobody committed minified bundles.", "// Copyright (c) the x authors"):
        assert H.marks("a.js", decoy + "\nfoo();\n") is None, decoy
    assert H.marks("v.js", "/*! lib, release 1.2.3. Upstream: https://lib.test/src */\nx") == "library"
    assert H.marks("a.js", "var a=1;function b(c){return c}" * 40) == "minified" and H.marks("readme.md", "x" * 999) is None


def test_blobs():
    def blob(path, text):
        w = H.words(text)
        return H.literal_only("\n".join(w), H.masked("\n".join(w)))

    assert blob("a.h", "static const unsigned char x[] = {\n" + "    0x82, 0x94, 0xae, 0x92,\n" * 30 + "};")
    assert blob("a.py", "TOKEN = (\n" + '    "PQdAH1Rkp/AgFqI4d/CChbQhYH28AH62ShFF"\n' * 20 + ")")
    assert blob("a.java", "class T {\n static {\n" + "".join(f"  table.put({k}, new CLIP({k * 7}, 3));\n" for k in range(40)) + " }\n}")
    assert not blob("a.py", code(1))


def test_files(spark):
    lib, changed = code(7), code(7).replace("assert", "assert  ").replace("v7_3 = v7", "v7_3 = w7", 1)
    rows = [(1, 1, "vendor/x/a.py", "# x\n" + lib, "r"), (2, 2, "src/a.py", lib, "r"), (3, 3, "lib/b.py", changed, "r"), (4, 1, "app/m.py", code(1), "r"), (5, 1, "app/m.py", code(1), "r"), (6, 2, "app/n.py", code(2), "r"), (7, 3, "app/o.py", code(3), "r")]
    rows += [(8, 9, None, None, None), (9, 9, "e.py", "", "x"), (10, 9, "README.md", "# " + "word " * 999, "x"), (10, 9, "README.md", "# " + "word " * 999, "x"), (11, None, "q.lock", "{}", "x")]
    # look-alikes of one repository: one text, other names
    rows += [(20 + k, 5, f"gen/m{k}.py", code(11).replace("v11_", f"w{k}_"), "x") for k in range(5)]
    df = spark.createDataFrame(rows, "file_id long, bundle_id long, path string, content string, reason string")
    got = {r.file_id: r.reason for r in H.machine_files(df).collect()}
    assert {k: got.get(k) for k in (1, 2, 3)} == {1: "vendored", 2: "vendored", 3: "vendored"}
    assert not {4, 5, 6, 7, 8, 9, 10} & set(got) and got[11] == "lock"
    assert {got.get(20 + k) for k in range(5)} == {"family"}
    assert H.machine_files(df.limit(0)).count() == 0


def sets(text):
    h, own = H.Masker()(H.tokens(text))
    return H.shingles(h), H.shingles(H.bound(h, own))


def test_bands_catch_what_brute_force_finds():
    """Recall of the bands against all pairs, over texts with a few to many changed lines."""
    texts = {k: code(k, 60) for k in range(20)}
    texts |= {100 * j + k: changed_lines(texts[k], j, 0.02 * j) for k in range(20) for j in (1, 2, 3, 4)}
    sh = {k: sets(t)[0] for k, t in texts.items()}
    bands = {k: set(H.bands(s)[0].tolist()) for k, s in sh.items()}
    similar = [(a, b) for a in texts for b in texts if a < b and H.similarity(sh[a], sh[b]) >= H.SIMILAR]
    assert len(similar) >= 60 and sum(bool(bands[a] & bands[b]) for a, b in similar) >= 0.97 * len(similar)


def test_renaming_leaves_bound_identifiers():
    a, other = code(5, 60), code(6, 60)
    renamed = a
    for k in range(12):
        renamed = renamed.replace(f"v5_{k}", f"name{(7 * k) % 12}x") if k else renamed.replace("v5_0", "zero")
    assert H.similarity(sets(a)[1], sets(renamed)[1]) > 0.9 and H.similarity(sets(a)[1], sets(other)[1]) < 0.5
    assert [H.mask(t) for t in H.tokens("if x1 == 'a b' and $y(3.5):  # note")][:9] == ["if", "I", "=", "=", "S", "and", "I", "(", "0"]


def changed_lines(text, seed, share):
    """``text`` with that share of its lines replaced by other code."""
    rng = random.Random(seed)
    out = text.split("\n")
    for k in rng.sample(range(1, len(out)), int(share * len(out))):
        out[k] = f"    raise E{seed}_{k}({', '.join('a' * rng.randrange(1, 6))}[{rng.randrange(9)}:{k}])" + ".x" * rng.randrange(9)
    return "\n".join(out)


def feature_rows(spark, texts):
    rows = [(i, b, f"src/f{i}.py", t) for i, b, t in texts]
    df = spark.createDataFrame(rows, "file_id long, bundle_id long, path string, content string")
    return df.mapInPandas(H.features, H._FEATURES), df


def test_links_beside_the_hub(spark):
    """Links of a bucket all of whose members are unlike its first one are found all the same."""
    base = code(5, 60)
    texts = [(1, 1, changed_lines(base, 1, 0.12))] + [(2 + k, 1, base + f"\nlast{k}(a, {k}, [b])" + ".x" * k) for k in range(4)] + [(10, 2, base + "\nother.last()")]
    sh = {i: sets(t)[0] for i, _, t in texts}
    assert H.similarity(sh[1], sh[2]) < H.SIMILAR <= H.similarity(sh[2], sh[10])
    # one bucket for all
    feats, files = feature_rows(spark, texts)
    feats = feats.withColumn("bands", F.array(F.lit(1).cast("long"))).withColumn("mask_hash", F.col("file_id"))
    got = {frozenset((r.a, r.b)) for r in H.linked(feats, files).collect()}
    assert got == {frozenset((a, b)) for a in sh for b in sh if a < b and H.similarity(sh[a], sh[b]) >= H.SIMILAR} and len(got) == 10
    assert {r.mask_hash for r in H._vendored(feats, H.linked(feats, files)).collect()} == {2, 3, 4, 5, 10}


def test_families_are_connected_not_stars(spark):
    """Five texts in a row, each linked to the next alone, are a family; three are not, nor five in five repositories."""
    feats = spark.createDataFrame([(i, 1 if i < 10 else i, i, i, [1]) for i in (1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 13, 14, 15)], "file_id long, bundle_id long, raw_hash long, mask_hash long, bands array<long>")
    links = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (4, 5), (6, 7), (8, 7), (11, 12), (12, 13), (13, 14), (14, 15)], "a long, b long")
    assert {(r.bundle_id, r.mask_hash) for r in H._families(feats, links).collect()} == {(1, k) for k in (1, 2, 3, 4, 5)}
    assert H._families(feats, links.limit(0)).count() == 0


def test_renamed_copies(spark):
    """A vendored copy with other identifiers meets its original; code of the same shape on other matters doesn't."""
    lib = code(21, 60)
    renamed = lib
    for k in range(12):
        renamed = renamed.replace(f"v21_{k} ", f"w{k}q ").replace(f"v21_{k}.", f"w{k}q.").replace(f"v21_{k})", f"w{k}q)").replace(f"v21_{k}:", f"w{k}q:").replace(f"v21_{k},", f"w{k}q,").replace(f"v21_{k}\n", f"w{k}q\n").replace(f"v21_{k}'", f"w{k}q'")
    df = spark.createDataFrame([(1, 1, "src/a.py", lib), (2, 2, "src/b.py", renamed + "\nmore(1)"), (3, 3, "src/c.py", code(22, 60)), (4, 4, "src/d.py", code(23, 60))], "file_id long, bundle_id long, path string, content string")
    assert {r.file_id: r.reason for r in H.machine_files(df).collect()} == {1: "vendored", 2: "vendored"}


def test_blob_clusters(spark):
    table = lambda k: "X = [\n" + "".join(f"    {7 * j + k}, {3 * j}, {k},\n" for j in range(30 + k)) + "]\n"
    rows = [(k, k, f"data{k}.py", table(k)) for k in range(3)] + [(9, 9, "own.py", code(31))]
    got = {r.file_id: r.reason for r in H.machine_files(spark.createDataFrame(rows, "file_id long, bundle_id long, path string, content string")).collect()}
    assert got == {0: "blob", 1: "blob", 2: "blob"}
    assert [r.reason for r in H.machine_files(spark.createDataFrame(rows[2:], "file_id long, bundle_id long, path string, content string")).collect()] == ["literals"]


def test_copies_of_marked_files(spark):
    """A library's copy without its header, changed or at the same path, and a double reading that is none."""
    def lib(k):
        return f"# lib{k} v1.2.3 | (c) x contributors | MIT license\n", code(70 + k)

    (h1, t1), (h2, t2), (h3, t3) = map(lib, range(3))
    rows = [(1, 1, "vendor/a.py", h1 + t1), (2, 2, "src/a.py", t1 + "\nmore()"), (3, 3, "lib/b.py", h2 + t2), (4, 3, "src/b.py", t2 + "\nmore()")]
    rows += [(5, 4, "src/c.py", h3 + t3), (6, 5, "src/c.py", t3), (7, 6, "src/d.py", code(80)), (8, 7, "src/d.py", code(80)), (9, 6, "src/e.py", "# note\n" + code(81)), (10, 7, "src/e.py", code(81))]
    got = {r.file_id: r.reason for r in H.machine_files(spark.createDataFrame(rows, "file_id long, bundle_id long, path string, content string")).collect()}
    assert got == {k: "vendored" for k in (1, 2, 3, 4, 5, 6, 9, 10)}


def test_marks_behind_long_licences():
    licence = [f"Line {k} of a licence, as long as such lines are, and longer." for k in range(80)]
    for path, text in (
        ("a.go", "\n".join("// " + x for x in licence) + "\n\n// Code generated by deepcopy-gen. DO NOT EDIT.\n\npackage a\n"),
        ("a.java", "/*\n" + "\n".join(licence) + "\n*/\n\n// Generated by the protocol buffer compiler.  DO NOT EDIT!\npackage a;\n"),
        ("a.php", "<?php\n/**\n" + "\n".join(" * " + x for x in licence) + "\n */\n/* This file was generated by x. */\n$a = 1;\n"),
        ("a.js", "/*\n" + "\n".join(licence) + "\nThis file is generated.\n*/\nf();\n"),
    ):
        assert H.marks(path, text) == "generated", path
    assert H.marks("a.js", "/*\n" + "\n".join(licence) + "\n*/\nf();\n// Code generated by x.\n") is None
    assert H.marks("a.js", "/* x */ f();\n" + "g();\n" * 20 + "// Generated by x.\n") is None
    packages = "".join(f'"p{k}": {{"version": "1.0.{k}", "requires": true}}, ' for k in range(99))
    assert H.marks("deps.json", "{" + packages + '"q": {"resolved": "https://r.test/q.tgz"}}') == "lock"
    assert H.marks("tickets.json", "{" + packages + '"q": {"resolved": false}}') is None


def telling(texts):
    """By brute force: pairs of similar classes that share a repository or prove a copy."""
    feats = {}
    for i, b, t in texts:
        found = H.tokens(t)
        h, own = H.Masker()(found)
        c = tuple(h.tolist()) if len(h) >= H.LONG_TOKENS else tuple(found)
        feats.setdefault(c, [len(h), H.shingles(h), (H.shingles(H.bound(h, own)).tobytes(), H.shingles(own).tobytes()), set(), i])[3].add(b)
    out = set()
    for x, y in itertools.combinations(feats.values(), 2):
        if H.similarity(x[1], y[1]) >= H.SIMILAR and (x[3] & y[3] or H._copied(min(x[0], y[0]), (x[2][0], y[2][0]), (x[2][1], y[2][1])) >= H.SIMILAR):
            out.add(frozenset((x[4], y[4])))
    return out


def test_links_are_those_of_brute_force(spark):
    """Short and long texts with few to many changed lines, in two repositories."""
    rng = random.Random(8)
    texts = []
    for k in range(40):
        lines = code(200 + k, (5, 8, 16, 60)[k % 4]).split("\n")
        for j in range(5):
            more = list(lines)
            for i in range(rng.randrange((2, 3, 5, 14)[k % 4])):
                more.insert(rng.randrange(1, len(more)), f"    raise E{k}_{j}_{i}")
            texts.append((len(texts), (k + j) % 2, "\n".join(more)))
    feats, files = feature_rows(spark, texts)
    ids = {r.mask_hash: r.i for r in feats.where("bands IS NOT NULL").groupBy("mask_hash").agg(F.min("file_id").alias("i")).collect()}
    got = {frozenset((ids[r.a], ids[r.b])) for r in H.linked(feats, files).collect()}
    wanted = {p for p in telling(texts) if p <= set(ids.values())}
    assert len(wanted) >= 40 and wanted <= got


def test_links_of_members_near_the_hub(spark):
    """Members that are nearly similar to the first one of their bucket, but not quite, are compared with each other."""
    base = code(5, 60)
    texts = [(1, 1, changed_lines(base, 1, 0.05))] + [(2 + k, 1, base + f"\nlast{k}(a, {k}, [b])" + ".x" * k) for k in range(4)]
    sh = {i: sets(t)[0] for i, _, t in texts}
    assert all(0.7 < H.similarity(sh[1], sh[k]) < H.SIMILAR <= H.similarity(sh[2], sh[k]) for k in range(2, 6))
    feats, files = feature_rows(spark, texts)
    feats = feats.withColumn("bands", F.array(F.lit(1).cast("long"))).withColumn("mask_hash", F.col("file_id"))
    assert {frozenset((r.a, r.b)) for r in H.linked(feats, files).collect()} == {frozenset(p) for p in itertools.combinations(range(2, 6), 2)}


def test_families_beside_a_hub_elsewhere(spark):
    """Look-alikes of one repository are a family, although all are linked to a text of another one."""
    texts = [(10 + k, 1 if k else 2, code(40, 60).replace("v40_", f"w{k}_") + f"\nlast{k}(a, {k}, [b])" + ".x" * k) for k in range(5)]
    feats, files = feature_rows(spark, texts)
    feats = feats.withColumn("bands", F.array(F.lit(1).cast("long"))).withColumn("mask_hash", F.col("file_id"))
    assert {r.mask_hash for r in H._families(feats, H.linked(feats, files)).collect()} == {11, 12, 13, 14}


def test_crowded_buckets(spark):
    """Of a bucket with more members than are all compared, families come out as from all pairs."""
    base, other = code(50, 9), code(51, 9)
    texts = [(k, 1, changed_lines(other if k % 3 else base, k, 0.12)) for k in range(H.CROWD + 20)] + [(900, 2, other), (901, 1, code(52, 9))]
    feats, files = feature_rows(spark, texts)
    one = feats.where("bands IS NOT NULL").withColumn("bands", F.array(F.lit(1).cast("long"))).withColumn("mask_hash", F.col("file_id"))
    sh = {i: sets(t)[0] for i, b, t in texts if b == 1}
    every = [(a, b) for a, b in itertools.combinations(sh, 2) if H.similarity(sh[a], sh[b]) >= H.SIMILAR]
    wanted = {r.mask_hash for r in H._families(one, spark.createDataFrame(every, "a long, b long")).collect()}
    assert len(wanted) > 50 and {r.mask_hash for r in H._families(one, H.linked(one, files)).collect()} == wanted


def test_buckets_in_any_batches():
    rng = random.Random(3)
    rows = sorted({(4 * k, rng.randrange(10**6)) for k, n in enumerate((1, 2, 100, 101, 350, 3, 1, 102)) for _ in range(n)})
    sizes = {c: rng.choice((90, 100, 120)) for _, c in rows}
    held = {k: [c for q, c in rows if q == k] for k in {q for q, _ in rows}}
    small = {(*sorted(p), None) for m in held.values() if len(m) <= H.CROWD for p in itertools.combinations(m, 2) if min(map(sizes.get, p)) >= 0.8 * max(map(sizes.get, p))}
    crowds = {(min(m), c, k) for k, m in held.items() if len(m) > H.CROWD for c in m}
    assert small and len(crowds) > 500
    for step in (1, 7, 100, 101, 9999):
        parts = (pd.DataFrame([(k, c, sizes[c]) for k, c in rows[i : i + step]], columns=["key", "class", "n"]) for i in range(0, len(rows), step))
        got = [(r.a, r.b, None if pd.isna(r.key) else r.key) for b in H._met(parts) for r in b.itertuples()]
        assert len(got) == len(set(got)) and set(got) == small | crowds


def test_short_files_are_told_by_all_their_names(spark):
    """A changed copy of a short file is found, although the first file of that shape has other names."""
    base = code(60, 10)
    rows = [(1, 1, "src/a.py", base.replace("v60_", "q")), (2, 2, "src/b.py", base), (3, 3, "src/c.py", base + "\nmore(1)")]
    assert H.LEAST_TOKENS < len(H.tokens(base)) < H.LONG_TOKENS
    df = spark.createDataFrame(rows, "file_id long, bundle_id long, path string, content string")
    assert {r.file_id: r.reason for r in H.machine_files(df).collect()} == {2: "vendored", 3: "vendored"}
