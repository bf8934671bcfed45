import random

import pytest

from pyspark.sql import functions as F

from sheafline.llm import quantiles as Q


def brute(values, p):
    s = sorted(values)
    return s[int((len(s) - 1) * p)]


def test_exact_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aab"), rng.choice([rng.randrange(-50, 50), rng.randrange(-(2**40), 2**40), 7])) for i in range(4000)]
    rows += rows[:300]  # delivered again
    df = spark.createDataFrame(rows, "id long, name string, n long")
    got = {(r.grp, r.p): (r.value, r.n_rows) for r in Q.exact_percentiles(df, "name", ["n"]).collect()}
    for g in "ab":
        vs = [v for _, k, v in set(rows) if k == g]
        for p in Q.PERCENTILES:
            assert got[g, p] == (brute(vs, p), len(vs))


def test_edges(spark):
    df = spark.createDataFrame(
        [(1, None, 3, 9), (2, "a", -(2**63), 9), (3, "a", 2**63 - 1, 9), (4, "a", None, 9), (None, "b", 5, 9), (None, "b", 5, 9)],
        "id long, name string, n long, value long",
    )
    got = {(r.grp, r.p): (r.value, r.n_rows) for r in Q.exact_percentiles(df, "name", ["n"], [0.0, 1.0]).collect()}
    assert got == {(None, 0.0): (3, 1), (None, 1.0): (3, 1), ("a", 0.0): (-(2**63), 2), ("a", 1.0): (2**63 - 1, 2), ("b", 0.0): (5, 2), ("b", 1.0): (5, 2)}
    assert Q.exact_percentiles(df.limit(0), "name", ["n"]).count() == 0


def test_states_combine(spark):
    rng = random.Random(5)
    rows = [(i, "g", int(rng.lognormvariate(9, 3)), i % 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, name string, n long, day long")
    days = Q.percentile_state(df, "name", ["n"], [F.col("day")])
    parts = [Q.percentile_state(df.where(F.col("day") == d), "name", ["n"]) for d in range(7)]
    whole = {r.p: (r.low, r.high, r.n_rows) for r in Q.state_percentiles(days).collect()}
    assert whole == {r.p: (r.low, r.high, r.n_rows) for r in Q.state_percentiles(Q.merged(*parts)).collect()}
    for p, (low, high, n) in whole.items():
        v = brute([r[2] for r in rows], p)
        assert low <= v <= high and n == 3000 and high - low <= max(0, v * 2**-Q.STATE_BITS)


def test_salted_join_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, "g" if i % 3 else "h", i * i) for i in range(500)], "id long, name string, n long")
    a = sorted(map(tuple, Q.exact_percentiles(df, "name", ["n"]).collect()))
    monkeypatch.setattr(Q, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(Q, "SALT_ROWS", 50)
    assert sorted(map(tuple, Q.exact_percentiles(df, "name", ["n"]).collect())) == a


@pytest.mark.parametrize("levels", [1, 3, 16])
def test_levels_do_not_matter(spark, levels):
    df = spark.createDataFrame([(i, "g", (i * 37) % 101) for i in range(101)], "id long, name string, n long")
    rows = Q.unpivoted(Q.distinct_rows(df, "name", ["n"]), ["n"])
    assert {r.p: r.value for r in Q.bisected(rows, [0.5, 0.9], levels).collect()} == {0.5: 50, 0.9: 90}


def test_several_group_columns_and_metrics(spark):
    rows = [(i, "ab"[i % 2], i % 3, i, -i if i % 5 else None, "x") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, name string, day int, n long, b long, grp string")
    got = {(r.grp.name, r.grp.day, r.metric): (r.value, r.n_rows) for r in Q.exact_percentiles(df, ["name", "day"], ["n", "b"], [0.5]).collect()}
    for name in "ab":
        for day in range(3):
            for k, m in ((3, "n"), (4, "b")):
                vs = [r[k] for r in rows if r[1] == name and r[2] == day and r[k] is not None]
                assert got[name, day, m] == (brute(vs, 0.5), len(vs))
