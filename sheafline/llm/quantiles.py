"""Exact percentiles per group by bisection, and additive states of bounded error.

Values live on the binary tree of 64-bit integers: a node is an interval
``[lo, lo + 2**bits)`` with ``lo`` a multiple of ``2**bits``, and its midpoint
splits it into its two children. A pass counts, for every open interval, the
rows below the midpoints of the next ``levels`` halvings; the interval shrinks
to the child holding the target rank until it is one value wide. The rows stay
where they are: a pass folds them to sums per interval and cell before anything
is shuffled. Counts are sums, so counts of partitions or days add up to those of
the whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

PERCENTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)
#: Bytes of open intervals up to which they are broadcast.
BROADCAST_BYTES = 32_000_000
#: Rows of a group that one task takes where intervals are too many to be broadcast.
SALT_ROWS = 1_000_000
#: Leading bits kept by a state's cell: the relative width of a cell is 2**-STATE_BITS.
STATE_BITS = 8


def distinct_rows(events: DataFrame, group: str | Sequence[str], metrics: Sequence[str], id_col: str | None = "id", extra: Sequence[Column] = ()) -> DataFrame:
    """``(*extra, grp, __m0, __m1, ...)``, copies of a row counted once.

    Rows that agree in ``id_col``, group and metrics are one delivery; rows whose id
    is null can't be recognised as copies and all stay. Several group columns become a
    struct. Columns beyond those named are ignored, whatever they are called.
    """
    grp = F.col(group) if isinstance(group, str) else F.struct(*(F.col(g).alias(g) for g in group))
    cols = [*extra, grp.alias("grp"), *(F.col(m).cast("long").alias(f"__m{i}") for i, m in enumerate(metrics))]
    if id_col is None:
        return events.select(*cols)
    ids = [F.col(id_col).alias("__id"), F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).alias("__row")]
    return events.select(*cols, *ids).distinct().drop("__id", "__row")


def unpivoted(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row ``(*extra, grp, metric, value)`` for each non-null metric of :func:`distinct_rows`."""
    kept = [c for c in rows.columns if not c.startswith("__m")]
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"__m{i}").alias("value")) for i, m in enumerate(metrics)))
    return rows.select(*kept, F.inline(pairs)).where(F.col("value").isNotNull())


def _contained(value: Column, lo: Column, bits: Column) -> Column:
    return (bits >= 64) | (F.call_function("shiftright", value, bits) == F.call_function("shiftright", lo, bits))


def _joined(rows: DataFrame, intervals: DataFrame, groups: DataFrame, n_bytes: int) -> DataFrame:
    """``rows`` with the open intervals of their group.

    Few intervals are broadcast. Beyond that both sides shuffle by group and salt: a
    group has a salt for each share of its rows, so that one with a third of all rows
    is spread over many tasks.
    """
    on = F.col("v.grp").eqNullSafe(F.col("i.grp")) & (F.col("v.metric") == F.col("i.metric"))
    if n_bytes <= BROADCAST_BYTES:
        return rows.alias("v").join(F.broadcast(intervals.alias("i")), on)
    # groups above a share of all rows are few, however many rows there are
    total = groups.agg(F.sum("n_rows")).first()[0] or 0
    most = max(SALT_ROWS, total // 100_000)
    salts = groups.where(F.col("n_rows") > most).select(F.col("grp").alias("g"), F.col("metric").alias("m"), F.ceil(F.col("n_rows") / most).cast("int").alias("k"))
    hot = lambda d: d.join(F.broadcast(salts), d["grp"].eqNullSafe(F.col("g")) & (d["metric"] == F.col("m")), "left").withColumn("k", F.coalesce("k", F.lit(1))).drop("g", "m")
    v = hot(rows).withColumn("__s", F.pmod(F.monotonically_increasing_id(), F.col("k")).cast("int")).alias("v")
    i = hot(intervals).withColumn("__s", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).alias("i")
    return v.join(i, on & (F.col("v.__s") == F.col("i.__s")))


def bisected(rows: DataFrame, percentiles: Sequence[float] = PERCENTILES, levels: int = 8) -> DataFrame:
    """Exact ``(grp, metric, p, n_rows, value)`` of ``(grp, metric, value)``, or of ``(..., cnt)`` equal rows each.

    The percentile of ``n`` sorted values is the one at index ``floor((n - 1) * p)``
    from 0. Every pass narrows each interval by ``levels`` halvings, so 64-bit values
    take at most ``ceil(64 / levels)`` passes over ``rows``, which should therefore be
    stored; only rows inside an open interval take part in a pass. Ties are no special
    case. An empty table gives an empty result; a null group is a group of its own.
    """
    if "cnt" not in rows.columns:
        rows = rows.withColumn("cnt", F.lit(1).cast("long"))
    xor = F.col("__lo").bitwiseXOR(F.col("__hi"))
    ps = F.array(*(F.lit(float(p)) for p in percentiles))
    groups = cut(
        rows.groupBy("grp", "metric")
        .agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"), F.sum("cnt").alias("n_rows"))
        .withColumn("bits", F.when(xor == 0, 0).otherwise(F.length(F.bin(xor))))
        .withColumn(
            "lo",
            F.when(F.col("bits") >= 64, F.lit(-(2**63)))
            .otherwise(F.call_function("shiftleft", F.call_function("shiftright", F.col("__lo"), F.col("bits")), F.col("bits"))),
        )
    )
    state = cut(
        groups.select("grp", "metric", "n_rows", "lo", "bits", F.lit(0).cast("long").alias("below"), F.explode(ps).alias("p"))
        .withColumn("target", F.floor((F.col("n_rows") - 1) * F.col("p")).cast("long"))
    )
    widest, n_bytes = state.agg(F.max("bits"), F.sum(64 + F.octet_length(F.to_json(F.struct("grp", "metric"))))).first()
    for _ in range(-(-(widest or 0) // levels)):
        state = cut(_narrowed(rows, state, groups, n_bytes, levels))
    return state.select("grp", "metric", "p", "n_rows", F.col("lo").alias("value"))


def _narrowed(rows: DataFrame, state: DataFrame, groups: DataFrame, n_bytes: int, levels: int) -> DataFrame:
    """``state`` after one pass: each interval replaced by the cell with its target rank."""
    open_, done = state.where("bits > 0"), state.where("bits = 0")
    intervals = open_.select("grp", "metric", "lo", "bits").distinct()
    shift = F.greatest(F.col("i.bits") - levels, F.lit(0))
    cells = (
        _joined(rows, intervals, groups, n_bytes)
        .where(_contained(F.col("v.value"), F.col("i.lo"), F.col("i.bits")))
        .select("i.grp", "i.metric", "i.lo", "i.bits", F.call_function("shiftright", F.col("v.value"), shift).alias("cell"), "v.cnt")
        .groupBy("grp", "metric", "lo", "bits", "cell")
        .agg(F.sum("cnt").alias("cnt"))
    )
    # at most 2**levels cells an interval, so a window's group is bounded
    w = Window.partitionBy("grp", "metric", "lo", "bits").orderBy("cell")
    cells = cells.withColumn("upto", F.sum("cnt").over(w)).alias("c")
    s = open_.alias("s")
    inside = (
        F.col("s.grp").eqNullSafe(F.col("c.grp"))
        & (F.col("s.metric") == F.col("c.metric"))
        & (F.col("s.lo") == F.col("c.lo"))
        & (F.col("s.bits") == F.col("c.bits"))
        & (F.col("s.target") < F.col("s.below") + F.col("c.upto"))
        & (F.col("s.target") >= F.col("s.below") + F.col("c.upto") - F.col("c.cnt"))
    )
    shift = F.greatest(F.col("s.bits") - levels, F.lit(0))
    moved = s.join(cells, inside).select(
        "s.grp",
        "s.metric",
        "s.n_rows",
        F.call_function("shiftleft", F.col("c.cell"), shift).alias("lo"),
        shift.cast("int").alias("bits"),
        (F.col("s.below") + F.col("c.upto") - F.col("c.cnt")).alias("below"),
        "s.p",
        "s.target",
    )
    return moved.unionByName(done)


def exact_percentiles(
    events: DataFrame,
    group: str | Sequence[str],
    metrics: Sequence[str],
    percentiles: Sequence[float] = PERCENTILES,
    id_col: str | None = "id",
) -> DataFrame:
    """Exact percentiles of integer columns per group; see :func:`distinct_rows` and :func:`bisected`."""
    return bisected(unpivoted(cut(distinct_rows(events, group, metrics, id_col)), metrics), percentiles)


def percentile_state(
    events: DataFrame, group: str, metrics: Sequence[str], keep: Sequence[Column] = (), id_col: str | None = "id", bits: int = STATE_BITS
) -> DataFrame:
    """Additive state ``(*keep, grp, metric, lo, width, cnt)``, to be stored per day or partition.

    A cell is the node of the binary tree that holds the value and is at most
    ``2**-bits`` of its magnitude wide (one value wide below ``2**bits``), so the
    cells of all states are the same and their counts add up. A group has at most
    ``(64 - bits) * 2**bits`` cells a sign, however many rows it has. Copies of a row
    have to be in the same state to be counted once, as they are when ``keep`` is a
    function of the row.
    """
    long = unpivoted(distinct_rows(events, group, metrics, id_col, keep), metrics)
    kept = [c for c in long.columns if c not in ("grp", "metric", "value")]
    size = F.length(F.bin(F.when(F.col("value") < 0, F.bitwise_not(F.col("value"))).otherwise(F.col("value"))))
    s = F.greatest(size - bits - 1, F.lit(0))
    return (
        long.withColumn("__s", s)
        .groupBy(
            *kept,
            "grp",
            "metric",
            F.call_function("shiftleft", F.call_function("shiftright", F.col("value"), F.col("__s")), F.col("__s")).alias("lo"),
            F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__s")).alias("width"),
        )
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def merged(*states: DataFrame) -> DataFrame:
    """The state of all rows from the states of disjoint sets of rows."""
    first, *rest = (s.select("grp", "metric", "lo", "width", "cnt") for s in states)
    for s in rest:
        first = first.unionByName(s)
    return first.groupBy("grp", "metric", "lo", "width").agg(F.sum("cnt").alias("cnt"))


def state_percentiles(state: DataFrame, percentiles: Sequence[float] = PERCENTILES) -> DataFrame:
    """``(grp, metric, p, n_rows, low, high)``: the cell that holds the exact percentile.

    ``high - low`` is at most ``2**-STATE_BITS`` of the magnitude; the bisection runs
    over the cells' lower ends, so the state may be of any size.
    """
    folded = cut(merged(state))
    found = bisected(folded.select("grp", "metric", F.col("lo").alias("value"), "cnt"), percentiles).alias("f")
    w = folded.select("grp", "metric", "lo", "width").alias("w")
    on = F.col("f.grp").eqNullSafe(F.col("w.grp")) & (F.col("f.metric") == F.col("w.metric")) & (F.col("f.value") == F.col("w.lo"))
    return found.join(w, on).select(
        "f.grp", "f.metric", "f.p", "f.n_rows", F.col("f.value").alias("low"), (F.col("f.value") + F.col("w.width") - 1).alias("high")
    )
