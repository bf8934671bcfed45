"""e3_captions against its SQL on what the tables seldom hold."""

import duckdb

import __spark_entry__ as entry


def test_captions_like_sql(spark, tmp_path):
    texts = {
        1: "Nothing was found there. Nothing was found there. Nothing was found there. Another line",  # told three times
        2: "Both versions are printed\nBoth versions are printed\n",
        3: "Is this a sentence.\x0bIs this another one",  # a vertical tab is no white space to SQL
        4: "          \nWords   with    gaps in between",  # a sentence of blanks leaves an empty line
        5: "          ",
        6: "No.\x0cSentences end at form feeds,\nNOTE that this is speech",
        7: None,
        8: "",
    }
    spark.createDataFrame(list(texts.items()), "email_id long, text string").coalesce(1).write.parquet(str(tmp_path / "emails.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW emails AS SELECT * FROM '{tmp_path}/emails.parquet/*.parquet'")
    theirs = dict(con.sql(entry.oracle_sql()["e3_captions"]).fetchall())
    assert theirs[2] == "Both versions are printed\nBoth versions are printed"
    assert {r.email_id: r.said for r in entry.queries()["e3_captions"](spark, str(tmp_path)).collect()} == theirs
