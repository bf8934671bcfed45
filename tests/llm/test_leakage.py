from sheafline.llm import leakage as L

ITEM = "Suppose a speckled thimble costs 233 tokens in Lukcaem and 768 tokens in Zegae."
OTHER = "Neither the satchel nor the hourglass fits through the hatch of the ship."
NOTE = "Answer the following question using only the information that is given above."


def items(spark):
    rows = [(1, f"{NOTE}\n\n{ITEM}", "x"), (2, f"{NOTE}\n\n{ITEM}\n\n{OTHER}", "x"), (3, None, "x"), (4, "short words only", "x")] + [(10 + k, NOTE, "x") for k in range(10)]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string")


def test_found(spark):
    docs = [
        (1, f"intro. {ITEM} outro"), (2, "> suppose A **speckled**\n> thimble, COSTS `233` to​kens in <b>Luk</b>caem and"), (3, "costs 233 tokens in Lukcaem and 768 tokens"), (4, NOTE), (5, None), (6, ""), (7, "word " * 100_000 + OTHER), (8, "costs 233 tokens in Lukcaem and Zegae"), (1, "again " + ITEM),
        (9, "in Zegae. Neither the satchel nor the hourglass fits"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS item_id")
    assert sorted(map(tuple, L.leaked(df, items(spark)).collect())) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (7, 2)]
    assert L.leaked(df.limit(0), items(spark)).count() == 0 and L.leaked(df, items(spark).limit(0)).count() == 0


def test_pieces_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(1, ITEM), (2, OTHER)], "doc_id long, text string")
    whole = sorted(map(tuple, L.leaked(df, items(spark)).collect()))
    monkeypatch.setattr(L, "PIECE_BYTES", 300)
    assert sorted(map(tuple, L.leaked(df, items(spark)).collect())) == whole == [(1, 1), (1, 2), (2, 2)]


def test_clean(spark):
    text = "first line\n" + ITEM + "\n" + "last line with a good many more words than were ever leaked into it by anyone at all today"
    df = spark.createDataFrame([(1, text), (2, ITEM), (3, None), (4, "fine")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.leaked_words) for r in L.without_leaks(df, items(spark)).collect()}
    assert got[1][0].split("\n")[0] == "first line" and ITEM not in got[1][0] and got[1][1] > 8
    assert 2 not in got and got[3] == (None, 0) and got[4] == ("fine", 0)


def test_pieces_clean_the_same(spark, monkeypatch):
    """Spans of several pieces are found in the text as it came: shares of words and neighbouring spans stay whole."""
    third = "Whoever counted the lanterns on the quay forgot those that hung behind the chandlery."
    its = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, third)], "item_id long, text string")
    more = "and these are words of its own that nobody has ever asked about in any test at all"
    docs = [(1, f"{ITEM}\n{OTHER}\n{third}\n{more}"), (2, f"{more}\n{OTHER}\n{more}\n{ITEM} {more}"), (3, f"{ITEM} {OTHER}"), (4, more), (5, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS item_id")
    whole = sorted(map(str, L.without_leaks(df, its).collect()))
    monkeypatch.setattr(L, "PIECE_BYTES", 90)
    assert len(list(L._pieces(its, "item_id", "text", 8, 10))) == 3
    assert sorted(map(str, L.without_leaks(df, its).collect())) == whole
    assert [r.doc_id for r in L.without_leaks(df, its).orderBy("doc_id").collect()] == [2, 4, 5]
