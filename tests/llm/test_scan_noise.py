from sheafline.llm import scan_noise as N

CLEAN = ["the parliament of the island met in the morning and the session was long", "every archive needs a keeper and this one had none at all in the village", "the half-finished manuscript came first and the census came later that morning", "a cross-border session was held between the village and the island in may"]


def corpus(n=60):
    return [(i, i, f"docs/{i}.pdf", "\n".join(CLEAN[(i + k) % 4] for k in range(4))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "file_id long, bundle_id long, path string, content string")


def images(spark, rows=()):
    return spark.createDataFrame(list(rows), "image_id long, file_id long, name string, page_no int, ocr_text string")


def test_defects(spark):
    page = "# Page 1\n\nTHE OLD ARCHIVE\nthe parl-\niament of tbe island met in the morning andthe session\nwas half-\nfinished in the 6O villages and a cross-\nborder manuscript came\n- 1 -\n# Page 2\n\nTHE 0LD ARCHIVE\nthe census came later\n- 2 -\n"
    rows = [*corpus(), (900, 1, "x.pdf", page), (901, 1, None, page), (902, 1, "y.pdf", None), (903, 1, "z.docx", ""), (904, 1, "a.py", page)]
    got = {(r.rec_id, r.line_no, r.defect) for r in N.defects(frame(spark, rows), images(spark)).collect() if r.rec_id >= 900}
    assert got == {(900, k, d) for k, d in ((3, "furniture"), (4, "hyphen"), (5, "misread"), (7, "misread"), (9, "furniture"), (12, "furniture"), (14, "furniture"))}


def test_images(spark):
    ims = [(1, 7, "a", 1, "Notes On Archives — Village Papers\nthe census came later than tbe manuscript\n- 3 -"), (2, 7, "b", 2, "Notes On Archives — Village Papers\nthe session was long\n- 4 -"), (3, 8, "c", 1, "The Census\nthe census came later"), (4, None, None, None, None), (5, None, None, None, " \n"), (6, None, "d", None, "1901   22   1,222\n1902   33   1,444\n377")]
    got = {(r.rec_id, r.line_no, r.defect) for r in N.defects(frame(spark, corpus()), images(spark, ims)).collect() if r.rec_kind == "image"}
    assert got == {(1, 1, "furniture"), (1, 2, "misread"), (1, 3, "furniture"), (2, 1, "furniture"), (2, 3, "furniture")}


def test_repair(spark):
    page = "THE OLD ARCHIVE   11\nthe parl-\niament of tbe island met in the morning andthe session\nwas long.\n\nevery archive needs a keeper\n\n12   THE OLD ARCHIVE\nand this one had none."
    out = {r.rec_id: r.text for r in N.repaired(frame(spark, [*corpus(), (900, 1, "x.pdf", page)]), None).collect()}
    assert out[900] == "the parliament of the island met in the morning and the session was long.\n\nevery archive needs a keeper and this one had none."


def test_full_bitmaps_give_the_same(spark, monkeypatch):
    """A bitmap only saves asking: one that says yes to everything changes nothing."""
    page = "the parl-\niament of tbe island met in the morning andthe session\nwas long."
    df = frame(spark, [*corpus(), (900, 1, "x.pdf", page)])
    rows = sorted(map(tuple, N.defects(df, None).collect()))
    monkeypatch.setattr(N, "bitmap", lambda words: N.Bitmap(slice(None), -1))
    assert sorted(map(tuple, N.defects(df, None).collect())) == rows and any(r[1] == 900 for r in rows)


def test_vectors_bring_words_of_like_contexts_together():
    import random

    rng = random.Random(2)
    sea, law = ["harbour", "sailor", "anchor", "vessel"], ["statute", "verdict", "clause", "tribunal"]
    runs = [[x for _ in range(6) for x in (rng.choice(g), rng.choice(("quiet", "windy") if g is sea else ("strict", "final")))] for g in (sea, law) for _ in range(300)]
    v = N.Vectors(N.pair_counts(runs))
    near = N.cosine(v.word("sailor"), v.word("anchor"))
    assert near > N.cosine(v.word("sailor"), v.word("clause")) + 0.3
    windy = [N.context("windy")]
    assert v.fits("anchor", windy) > v.fits("clause", windy) and v.fits("anchar", windy) > v.fits("clausc", windy)
    lk = N.Linker({"anchor": 900, "anchar": 1, "clause": 900}, v)
    assert lk.link("anchar", 1)[:2] == ("glyph", "anchor")


def test_very_long_runs_are_no_words(spark):
    df = frame(spark, [*corpus(), (900, 1, "x.pdf", "the session " + "rn" * 50_000 + " was long"), (901, 1, "y.pdf", "a" * 20_000 + "-\n" + "b" * 20_000)])
    assert {(r.rec_id, r.defect) for r in N.defects(df, None).collect() if r.rec_id >= 900} <= {(901, "hyphen")}


def test_empty(spark):
    assert N.defects(frame(spark, corpus(1)).limit(0), images(spark)).count() == 0
    assert N.defects(None, images(spark, [(1, 1, "x", 1, "one two three")])).count() == 0


def test_links():
    lk = N.Linker({"the": 10_000, "session": 400, "in": 900, "keeper": 300, "lands": 900, "landis": 5})
    assert lk.link("tbe", 9)[:2] == ("glyph", "the") and lk.link("5ession", 1)[:2] == ("glyph", "session") and lk.link("inthe", 2)[:2] == ("joined", "in the")
    assert lk.link("landis", 500) is None and lk.link("zzgrub", 1) is None
    assert lk.judge("kee", "per") and not lk.judge("the", "session")


def test_page_numbers_and_titles():
    assert [N.page_number(x) for x in ("12", "l4O", "xiv", "iv", "abc", None)] == [12, 140, 14, 4, -1, -1]
    assert N.titled("THE OLD ARCHIVE") and N.titled("Notes On Relay — Bofeik Papers") and not N.titled("This is a sentence.") and not N.titled("one two three")


def test_long_documents_take_linear_time():
    import time

    text = "\n".join(f"THE OLD ARCHIVE   {k}\nwords of the page\n{k}" for k in range(30_000))
    start = time.process_time()
    assert len(N.furniture(text.split("\n"), set())) >= 60_000
    assert time.process_time() - start < 20
