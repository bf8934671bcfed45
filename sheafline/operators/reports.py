"""Usage reports over the counter table, its admission and its retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut

DAY = 86_400
RETENTION_DAYS = 180
# fixed values: counters of files that could not be read
UNREAD = ("unreadable_ext", "extract_failed", "archive_unsupported")
#: Distributions of the size report: label, counter, column.
SIZES = (("files per drop", "batch_size", "n"), ("bytes per drop", "batch_size", "b"), ("bundle bytes", "bundle_size", "b"), ("largest file", "max_file_bytes", "b"), ("ingest ms", "ingest_ms", "n"))


def since(events: DataFrame, start: int | None) -> DataFrame:
    return events if start is None else events.where(F.col("ts") >= start)


def funnel(events: DataFrame, start: int | None = None) -> DataFrame:
    """Visits, visits that dropped files and visits that exported, by entry surface (Q1).

    A page is folded to its flags and its surfaces before the two meet, so a page with
    a third of all events is one row in the join.
    """
    pages = since(events, start).where("page IS NOT NULL").groupBy("page").agg(F.max(F.col("name") == "batch_size").alias("dropped"), F.max(F.col("name") == "output_taken").alias("exported"))
    surfaces = events.where("name = 'entry_surface' AND page IS NOT NULL").select("page", "value").distinct()
    rows = pages.join(surfaces, "page", "left").select(F.coalesce("value", F.lit("(none)")).alias("surface"), "page", "dropped", "exported").distinct()
    return rows.groupBy("surface").agg(F.count(F.lit(1)).alias("visits"), F.count_if("dropped").alias("dropped"), F.count_if("exported").alias("exported"))


def runs(events: DataFrame, start: int | None = None, limit: int | None = 40) -> DataFrame:
    """One row a run of a visit, the latest first (Q2); ``limit`` is the report's length."""
    when = lambda name, col: F.max(F.when(F.col("name") == name, F.col(col)))
    rows = (
        since(events, start).where("run IS NOT NULL").groupBy("page", "run")
        .agg(
            when("batch_size", "n").alias("files"), when("batch_size", "b").alias("in_bytes"), when("ingest_ms", "n").alias("ms"), when("bundle_size", "b").alias("out_bytes"),
            F.count_if(F.col("name") == "output_taken").alias("exports"), F.min("id").alias("first_id"),
        )
    )
    rows = rows.withColumn("abandoned", F.col("exports") == 0)
    return rows if limit is None else rows.orderBy(F.col("first_id").desc(), "page", "run").limit(limit)


def formats(events: DataFrame, start: int | None = None) -> DataFrame:
    """What couldn't be read, by counter and value (Q3)."""
    return since(events, start).where(F.col("name").isin(*UNREAD)).groupBy("name", "value").agg(F.sum("n").alias("files"), F.sum("b").alias("total_bytes"), F.count_distinct("page").alias("visits"))


def floor_percentiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """``n, p50, p90, max`` per group, the percentile at index ``floor((n - 1) * p)``.

    Equal values are folded first, and the running count is taken over blocks of the
    sorted values: only the sums of blocks, one row a partition and group, meet in one
    place, so a group with most rows is sorted by many tasks.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("grp"), F.col(value).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("cnt"))
    placed = cut(counts.repartitionByRange("grp", "v").withColumn("block", F.spark_partition_id()))
    blocks = placed.groupBy("grp", "block").agg(F.sum("cnt").alias("k"))
    before = blocks.withColumn("before", F.sum("k").over(Window.partitionBy("grp").orderBy("block")) - F.col("k"))
    total = blocks.groupBy("grp").agg(F.sum("k").alias("n"))
    same = lambda a, b: a["grp"].eqNullSafe(b["g"])
    sums = before.select(F.col("grp").alias("g"), F.col("block").alias("bl"), "before").join(total.select(F.col("grp").alias("h"), "n"), F.col("g").eqNullSafe(F.col("h"))).drop("h")
    run = Window.partitionBy("grp", "block").orderBy("v")
    # blocks and groups: a row a partition and group
    upto = placed.withColumn("run", F.sum("cnt").over(run)).join(sums, same(placed, sums) & (F.col("block") == F.col("bl"))).withColumn("upto", F.col("before") + F.col("run"))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * p), F.col("v")))
    return upto.groupBy(F.col("grp").alias(by)).agg(F.max("n").alias("n"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("v").alias("max"))


def sizes(events: DataFrame, start: int | None = None) -> DataFrame:
    """Distributions of the five measures (Q4), in one pass over the table."""
    picked = F.array(*(F.when((F.col("name") == c), F.struct(F.lit(label).alias("measure"), F.col(col).alias("v"))) for label, c, col in SIZES))
    rows = since(events, start).where(F.col("name").isin(*{c for _, c, _ in SIZES})).select(F.explode(F.array_compact(picked)).alias("s")).select("s.measure", "s.v")
    return floor_percentiles(rows, "measure", "v")


def over(events: DataFrame, start: int | None = None) -> DataFrame:
    """Files above thresholds (Q5)."""
    return since(events, start).where("name = 'files_over'").groupBy("value").agg(F.sum("n").alias("files"), F.count_distinct("page").alias("visits"))


def _run_key() -> Column:
    # a null run is no run: concat gives null and is not counted
    return F.concat(F.col("page"), F.lit("/"), F.col("run").cast("string"))


def markers(events: DataFrame, start: int | None = None, limit: int | None = 20) -> DataFrame:
    rows = since(events, start).where("name = 'marker'").groupBy("value").agg(F.count_distinct(_run_key()).alias("runs"))
    return rows if limit is None else rows.orderBy(F.col("runs").desc(), F.col("value").asc_nulls_last()).limit(limit)


def extensions(events: DataFrame, start: int | None = None, limit: int | None = 20) -> DataFrame:
    rows = since(events, start).where("name = 'file_ext'").groupBy("value").agg(F.sum("n").alias("files"), F.sum("b").alias("total_bytes"), F.count_distinct(_run_key()).alias("runs"))
    return rows if limit is None else rows.orderBy(F.col("runs").desc(), F.col("files").desc_nulls_last(), F.col("value").asc_nulls_last()).limit(limit)


def total(events: DataFrame, start: int | None = None) -> DataFrame:
    return since(events, start).agg(F.count(F.lit(1)).alias("events"))


def retained(events: DataFrame, now: int, days: int = RETENTION_DAYS) -> DataFrame:
    """The rows a prune keeps (Q10, K7); plain files are rewritten, partition by day to rewrite few."""
    return events.where((F.col("ts") >= now - days * DAY) | F.col("ts").isNull())


def tally(rows: DataFrame, by: list[str], key: str, n: str, b: str, order: str, cap: int = 25, other: str = "other") -> DataFrame:
    """Per group the ``cap`` largest keys, the rest summed as ``other`` (G2); sums are kept whole.

    The rank is a filter, so each task keeps ``cap`` keys of a group before they are
    shuffled; the rest is the group's total less what was kept.
    """
    per = rows.groupBy(*by, key).agg(F.sum(n).alias("n"), F.sum(b).alias("b"), F.min(order).alias("__o"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc_nulls_last(), "__o", key))
    top = per.withColumn("__r", rank).where(F.col("__r") <= cap).select(*by, key, "n", "b")
    signed = per.select(*by, "n", "b", F.lit(1).alias("k")).unionByName(top.select(*by, (-F.col("n")).alias("n"), (-F.col("b")).alias("b"), F.lit(-1).alias("k")))
    # a column is null in the rest only if it is null in every row of it
    held = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.col("k"))) > 0
    rest = signed.groupBy(*by).agg(F.sum("k").alias("k"), F.when(held("n"), F.sum("n")).alias("n"), F.when(held("b"), F.sum("b")).alias("b")).where("k > 0")
    out = top.unionByName(rest.select(*by, F.lit(other).alias(key), "n", "b"))
    # the data may hold the folded name itself
    return out.groupBy(*by, key).agg(F.sum("n").alias("n"), F.when(F.sum("b") != 0, F.sum("b")).alias("b"))


def conversion(funnel_rows: DataFrame) -> DataFrame:
    """Rates of the funnel; null where there were no visits."""
    share = lambda c: F.when(F.col("visits") > 0, F.floor(F.col(c) / F.col("visits") * 100 + 0.5).cast("long"))
    return funnel_rows.select("surface", "visits", share("dropped").alias("dropped_pct"), share("exported").alias("exported_pct"))


# -- admission (P14) ------------------------------------------------------------------------------

# fixed values: bounds of a posted batch
MAX_EVENTS, MAX_BYTES, MAX_AMOUNT, MAX_RUN = 50, 16 * 1024, 10**12, 1000
WIRE = T.StructType([T.StructField("s", T.StringType()), T.StructField("e", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("n", "v", "q", "b", "r")])))])


def _whole(c: Column, most: int) -> Column:
    """A whole number from 0 to ``most``, else null."""
    v = F.when(c.rlike(r"^\d{1,15}$"), c).cast("long")
    return F.when(v <= most, v)


def admitted(batches: DataFrame, body: str, names: list[str], ts: Column | None = None) -> DataFrame:
    """Event rows of posted batches.

    A batch of no or too many events, too many bytes or a malformed page is rejected
    whole; an event with an unknown name or a malformed label is dropped; a quantity out
    of bounds becomes null, and an event left with nothing is dropped.
    """
    raw = F.col(body)
    parsed = batches.withColumn("__w", F.from_json(raw, WIRE))
    good = (F.octet_length(raw) <= MAX_BYTES) & F.col("__w.s").rlike(r"(?i)^[a-z0-9-]{8,64}$") & F.size("__w.e").between(1, MAX_EVENTS)
    e = parsed.where(good).select(F.col("__w.s").alias("page"), F.explode("__w.e").alias("x"), (ts if ts is not None else F.unix_timestamp()).alias("ts"))
    value = F.col("x.v")
    e = e.where(F.col("x.n").isin(names) & (value.isNull() | value.rlike(r"^[a-z0-9._/+-]{1,32}$")))
    out = e.select("ts", "page", F.col("x.n").alias("name"), value.alias("value"), _whole(F.col("x.r"), MAX_RUN).alias("run"), _whole(F.col("x.q"), MAX_AMOUNT).alias("n"), _whole(F.col("x.b"), MAX_AMOUNT).alias("b"))
    return out.where(F.col("value").isNotNull() | F.col("n").isNotNull() | F.col("b").isNotNull())


def coverage(rows: DataFrame, state: str = "value") -> DataFrame:
    """How many rows are in each state, the most first (G20); all errors are one state, unknown ones are ``(none)``."""
    s = F.coalesce(F.col(state), F.lit("(none)"))
    s = F.when(s.startswith("error"), "error").otherwise(s)
    return rows.groupBy(s.alias(state)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), state)


def seldom_taken(rows: DataFrame, by: str, taken: Column, least: int = 15, share: float = 0.02) -> DataFrame:
    """What is seen ``least`` times or more and taken less often than ``share``."""
    per = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("impressions"), F.count_if(taken).alias("clicks"))
    return per.where((F.col("impressions") >= least) & (F.col("clicks") < share * F.col("impressions")))


def run_numbers(events: DataFrame, opens: str = "batch_size") -> DataFrame:
    """``events`` with ``run_no``: how many drops their visit has had so far, the event's own included; null before the first.

    A visit's events are ordered by time; a page with very many of them sorts in one task,
    spilling, as each number needs those before.
    """
    w = Window.partitionBy("page").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.sum(F.when(F.col("name") == opens, 1).otherwise(0)).over(w)
    return events.withColumn("run_no", F.when(F.col("page").isNotNull() & (n > 0), n).cast("long"))


#: The sections of the overview, in the order they are shown.
SECTIONS = ("funnel", "sizes", "over", "formats", "markers", "extensions")


def overview(events: DataFrame, start: int | None = None) -> DataFrame:
    """``(section, place, row)``: all reports in one (Q9), a row a line as JSON, in the order they are shown."""
    tables = {"funnel": funnel(events, start), "sizes": sizes(events, start), "over": over(events), "formats": formats(events, start), "markers": markers(events), "extensions": extensions(events)}
    out = None
    for k, name in enumerate(SECTIONS):
        part = tables[name].select(F.lit(name).alias("section"), F.lit(k + 1).alias("place"), F.to_json(F.struct("*")).alias("row"))
        out = part if out is None else out.unionByName(part)
    return out
