import json

from pyspark.sql import functions as F

from sheafline.operators import reports as R
from sheafline.streaming import events as S

EVENTS = "id long, ts long, page string, name string, value string, run long, n long, b long"


def test_admission(spark):
    p = "abcdefgh"
    bodies = [
        {"s": p, "e": [{"n": "marker", "v": "go.mod", "r": 1}, {"n": "marker", "v": "BAD VALUE"}, {"n": "unknown", "q": 1}, {"n": "batch_size", "q": 3, "b": 9}, {"n": "batch_size", "q": -1}, {"n": "batch_size", "q": 1.5, "v": "x"}, {"n": "batch_size", "q": 10**12 + 1, "b": 2, "r": 1001}]},
        {"s": "short", "e": [{"n": "marker", "v": "x"}]}, {"s": p, "e": []}, {"s": p, "e": [{"n": "marker", "v": "x"}] * 51}, {"s": p, "e": [{"n": "marker", "v": "x" * 20}] * 50, "pad": "y" * 20_000},
    ]
    df = spark.createDataFrame([(json.dumps(x),) for x in bodies] + [("no json",), (None,)], "body string")
    got = {tuple(r)[1:] for r in R.admitted(df, "body", ["marker", "batch_size"], F.lit(5)).collect()}
    assert got == {(p, "marker", "go.mod", 1, None, None), (p, "batch_size", None, None, 3, 9), (p, "batch_size", "x", None, None, None), (p, "batch_size", None, None, None, 2)}


def test_null_runs_and_two_surfaces(spark):
    rows = [(1, 0, "p", "entry_surface", "home", None, None, None), (2, 0, "p", "entry_surface", "docs", None, None, None), (3, 0, "p", "batch_size", None, 1, 2, 3), (4, 0, "q", "output_taken", None, None, None, None), (5, 0, "p", "marker", "go.mod", None, None, None), (6, 0, "p", "marker", "go.mod", 2, None, None)]
    e = spark.createDataFrame(rows, EVENTS)
    assert {tuple(r) for r in R.funnel(e).collect()} == {("home", 1, 1, 0), ("docs", 1, 1, 0), ("(none)", 1, 0, 1)}
    assert [tuple(r) for r in R.markers(e).collect()] == [("go.mod", 1)]
    assert R.runs(e).count() == 2 and R.funnel(e.limit(0)).count() == 0


def test_floor_percentiles(spark):
    df = spark.createDataFrame([(1, v) for v in range(10)] + [(2, 5)], "g int, v int")
    assert {r.g: (r.n, r.p50, r.p90, r.max) for r in R.floor_percentiles(df, "g", "v").collect()} == {1: (10, 4, 8, 9), 2: (1, 5, 5, 5)}


def test_retention(spark):
    e = spark.createDataFrame([(1, 100 * R.DAY), (2, 100 * R.DAY - 1), (3, None)], "id long, ts long")
    assert {r.id for r in R.retained(e, 280 * R.DAY).collect()} == {1, 3}


def test_tally_keeps_totals(spark):
    df = spark.createDataFrame([(k, f"k{k % 40}", k, 0) for k in range(200)], "id long, value string, n long, b long").withColumn("g", F.lit(1))
    out = R.tally(df, ["g"], "value", "n", "b", "id").collect()
    assert len(out) == 26 and sum(r.n for r in out) == sum(range(200)) and all(r.b is None for r in out)


def test_stream_admits_and_appends(spark, tmp_path):
    src, out, chk = (str(tmp_path / x) for x in ("in", "out", "chk"))
    body = json.dumps({"s": "abcdefgh", "e": [{"n": "marker", "v": "go.mod"}, {"n": "nope"}]})
    spark.createDataFrame([(body,)], "body string").write.parquet(src)
    rows = S.admit_stream(S.event_stream(spark, src, "body string"), "body", ["marker"])
    S.appended(rows, out, chk).awaitTermination()
    spark.createDataFrame([(body,)], "body string").write.mode("append").parquet(src)
    S.appended(rows, out, chk).awaitTermination()  # only what is new
    got = spark.read.parquet(out).collect()
    assert len(got) == 2 and {r.value for r in got} == {"go.mod"} and all(r.ts > 0 for r in got)


def test_stream_dedup_rate_and_sessions(spark, tmp_path):
    rows = [(k, 1000 + k % 20, "p" if k % 2 else "q", "entry_surface", "home", None, None, None) for k in range(80)] + [(100, 1001, "p", "bundle_size", None, 1, 1, 1), (101, 1002, "q", "bundle_size", None, 1, 1, 1), (102, 1003, "q", "output_taken", None, 1, 1, 1)]
    late = [(999, 9000, "z", "entry_surface", "home", None, None, None)]
    path = str(tmp_path / "e")
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(path)
    spark.createDataFrame(late, EVENTS).coalesce(1).write.mode("append").parquet(path)
    stream = S.stamped(S.event_stream(spark, path, EVENTS))

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert sorted(r.page for r in run(S.once_per(stream.where("name = 'entry_surface'"), ["page"]), "once")) == ["p", "q", "z"]
    rates = run(S.within_rate(stream, "page", "event_time", most=15), "rates", "complete")
    assert sum(r.admitted + r.dropped for r in rates) == 84 and max(r.admitted for r in rates) == 15
    batch = S.abandoned(S.stamped(spark.createDataFrame(rows, EVENTS)))
    assert [(r.page, r.run) for r in batch.collect()] == [("p", 1)]


def test_stream_merges_by_path(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = "path string, ord long, text string"
    state = {}

    def write(df):
        state["rows"] = [tuple(r) for r in df.select("path", "ord", "text").collect()]

    read = lambda: spark.createDataFrame(state["rows"], schema) if "rows" in state else None
    for rows in ([("a", 1, "x"), ("b", 2, "y")], [("a", 1, "new"), ("c", 2, "z")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        S.merged_stream(S.event_stream(spark, src, schema), read, write, ["path"], out).awaitTermination()
    assert {(p, t) for p, _, t in state["rows"]} == {("a", "new"), ("b", "y"), ("c", "z")}
