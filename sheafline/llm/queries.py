"""Queries of this subpackage, by name; each takes a session and a directory of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import credentials, emails, handwritten, leakage, packing, quantiles, scan_noise, subjects


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.defects(table(spark, sf_dir, "output_files"), table(spark, sf_dir, "extracted_images"))


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.repaired(table(spark, sf_dir, "output_files"), table(spark, sf_dir, "extracted_images"))


def _day() -> Column:
    return F.floor(F.col("ts") / 86400).cast("long")


def p2_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of ``n`` and ``b`` per event name and day, deliveries counted once."""
    events = table(spark, sf_dir, "usage_events").withColumn("day", _day())
    found = quantiles.exact_percentiles(events, ["name", "day"], ["n", "b"])
    return found.select("grp.name", "grp.day", "metric", "p", "n_rows", "value")


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of ``n`` and ``b`` per event name over all days."""
    found = quantiles.exact_percentiles(table(spark, sf_dir, "usage_events"), "name", ["n", "b"])
    return found.withColumnRenamed("grp", "name")


def p2_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The additive states kept per day."""
    return quantiles.percentile_state(table(spark, sf_dir, "usage_events"), "name", ["n", "b"], [_day().alias("day")]).withColumnRenamed("grp", "name")


def p2_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles over all days from the states of the days: the interval that holds each."""
    daily = p2_states(spark, sf_dir).withColumnRenamed("name", "grp")
    return quantiles.state_percentiles(daily).withColumnRenamed("grp", "name")


_PS = ", ".join(f"({p})" for p in quantiles.PERCENTILES)
_LONG = """
WITH d AS (SELECT DISTINCT id, ts // 86400 AS day, name, n, b FROM usage_events),
l AS (SELECT day, name, 'n' AS metric, n AS v FROM d WHERE n IS NOT NULL UNION ALL SELECT day, name, 'b', b FROM d WHERE b IS NOT NULL)
"""


def _exact(by: str) -> str:
    return f"""{_LONG}, g AS (SELECT {by}, metric, list_sort(list(v)) AS vs FROM l GROUP BY ALL)
    SELECT {by}, metric, CAST(p AS DOUBLE) AS p, CAST(len(vs) AS BIGINT) AS n_rows, CAST(vs[CAST(floor((len(vs) - 1) * CAST(p AS DOUBLE)) AS BIGINT) + 1] AS BIGINT) AS value
    FROM g, (VALUES {_PS}) AS t(p)"""


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.credential_lines(table(spark, sf_dir, "output_files"))


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.redacted(table(spark, sf_dir, "output_files")).select("file_id", "path", "content")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.machine_files(table(spark, sf_dir, "output_files")).select("file_id")


def p4_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "output_files")
    return files.select("file_id", "bundle_id", "path").join(handwritten.machine_files(files).select("file_id"), "file_id", "left_anti")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emails.old_lines(table(spark, sf_dir, "emails"))


def p5_new_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emails.newly_written(table(spark, sf_dir, "emails")).select("email_id", "new_text")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(table(spark, sf_dir, "documents"), table(spark, sf_dir, "token_limits"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = table(spark, sf_dir, "token_limits")
    return packing.fill(packing.containers(table(spark, sf_dir, "documents"), limits), limits)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "text", "leaked_words")


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subject_shares(*(table(spark, sf_dir, t) for t in ("documents", "subject_areas", "subject_labels", "eval_items")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subjects_of(_shares(spark, sf_dir))


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.composition(_shares(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        p1_found, p1_repaired, p2_daily, p2_percentiles, p2_states, p2_combined, p3_found, p3_redacted, p4_found, p4_kept, p5_found, p5_new_text,
        p6_containers, p6_fill, p7_found, p7_clean, p8_found, p8_composition,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Twins of problem 2. The others can't be told in SQL; tests/llm holds them against brute force and round trips."""
    width = "CAST(pow(2, greatest(floor(log2(greatest(v, 1))) - 8, 0)) AS BIGINT)"
    return {
        "p2_daily": _exact("name, day"),
        "p2_percentiles": _exact("name"),
        "p2_states": f"{_LONG} SELECT day, name, metric, v // w * w AS lo, w AS width, count(*) AS cnt FROM (SELECT *, {width} AS w FROM l) GROUP BY ALL",
        "p2_combined": f"SELECT name, metric, p, n_rows, v // w * w AS low, v // w * w + w - 1 AS high FROM (SELECT *, {width} AS w FROM (SELECT * EXCLUDE (value), value AS v FROM ({_exact('name')})))",
    }
