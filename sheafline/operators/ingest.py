"""The per-file decision: included or not, why, and the lists and merges built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .paths import IgnoreRule, ignored, path_matches

# fixed values: why a file was refused, and the label a counter has for it
EMPTY_REASONS = {
    "Outside include patterns": "include",
    "Matched ignore patterns": "ignore",
    "Matched .gitignore": "gitignore",
    "Excluded manually": "manual",
    "Hidden file": "hidden",
    "Binary file": "binary",
    "No extractable text": "no-text",
    "Couldn't extract text": "extract-error",
    "Password protected": "encrypted",
}
# fixed values: endings of archives and of images among dropped files
ARCHIVE_NAMES = r"(?i)\.(7z|rar|zip|tar\.gz|tgz|tar|gz|bz2|xz)$"
IMAGE_NAMES = r"(?i)\.(png|jpe?g|gif|webp|svg|bmp|ico|avif|heic|heif|tiff?)$"
#: Findings that leave no text to filter: the file isn't one that filters held back.
UNREADABLE = ("Binary file", "No extractable text", "Couldn't extract text", "Password protected")


def decisions(files: DataFrame, include: str = "", ignore: str = "", rules: list[IgnoreRule] = (), overrides: DataFrame | None = None, path: str = "path") -> DataFrame:
    """``files`` with ``included`` and ``why``.

    A pattern to include narrows; ignoring always subtracts; a manual override beats
    both, but never makes a binary file text. ``files`` may have ``reason``, the finding
    of validation; a file without one was fine.
    """
    p = F.col(path)
    reason = F.col("reason") if "reason" in files.columns else F.lit(None).cast("string")
    outside = ~path_matches(p, include) if include.strip() else F.lit(False)
    hit, git = path_matches(p, ignore), ignored(p, list(rules))
    why = F.when(reason.isNotNull(), reason).when(outside, "Outside include patterns").when(hit, "Matched ignore patterns").when(git, "Matched .gitignore")
    df = files.withColumn("__why", why)
    if overrides is not None:
        # the last word a path was given
        w = Window.partitionBy("path").orderBy(F.col("ord").desc())
        last = overrides.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(F.col("path").alias("__p"), F.col("include").alias("__forced"))
        df = df.join(last, df[path] == last["__p"], "left").drop("__p")
    else:
        df = df.withColumn("__forced", F.lit(None).cast("boolean"))
    locked = F.coalesce(F.col("__why") == "Binary file", F.lit(False))
    by_rule = F.col("__why").isNull()
    included = F.when(locked, F.lit(False)).otherwise(F.coalesce("__forced", by_rule))
    return df.withColumn("included", included).withColumn("why", F.when(included, F.lit(None)).otherwise(F.coalesce("__why", F.lit("Excluded manually")))).drop("__why", "__forced")


def exclusion_summary(decided: DataFrame, by: str = "bundle_id", path: str = "path", order: str = "ord") -> DataFrame:
    """Lists of what is missing by cause; other causes aren't told."""
    r = F.lower(F.col("why"))
    cause = F.when(r.contains("extract"), "unextractable").when(r.rlike("exceed|size"), "oversize").when(r.contains("binary"), "binary")
    rows = decided.where(~F.col("included")).withColumn("__c", cause)
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("__c") == c, F.struct(order, path)))), lambda s: s[path]).alias(c)
    return rows.groupBy(by).agg(listed("oversize"), listed("unextractable"), listed("binary"))


def status_stats(decided: DataFrame, by: str = "bundle_id", size: str = "size_bytes") -> DataFrame:
    """Counts and bytes by inclusion, and causes of exclusion."""
    i, s = F.col("included"), F.coalesce(F.col(size), F.lit(0))
    r = F.lower(F.coalesce("why", F.lit("")))
    return decided.groupBy(by).agg(
        F.count_if(i).alias("included"), F.count_if(~i).alias("excluded"), F.sum(F.when(i, s).otherwise(0)).alias("included_bytes"), F.sum(F.when(i, 0).otherwise(s)).alias("excluded_bytes"),
        F.count_if(~i & r.contains("binary")).alias("binary"), F.count_if(~i & r.contains("hidden")).alias("hidden"), F.count_if(~i & r.rlike("ignore")).alias("ignored"),
    )


def included_contents(contents: DataFrame, decided: DataFrame, on: list[str]) -> DataFrame:
    """Contents of included paths."""
    return contents.join(decided.where("included").select(*on), on, "left_semi")


def noise_skipped(decided: DataFrame, validated: DataFrame, on: list[str]) -> DataFrame:
    """Excluded, though validation found nothing against them."""
    return decided.where("NOT included").join(validated.where("reason IS NOT NULL").select(*on), on, "left_anti")


def merged_by_path(old: DataFrame, new: DataFrame, key: list[str], order: str = "ord") -> DataFrame:
    """Rows of ``new`` replace those of the same key in their place; others follow at the end."""
    a = old.withColumn("__new", F.lit(0)).withColumn("__o", F.col(order))
    b = new.withColumn("__new", F.lit(1)).withColumn("__o", F.col(order))
    u = a.unionByName(b, allowMissingColumns=True)
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("__new").desc(), F.col("__o").desc()))
    place = F.min(F.struct("__new", "__o")).over(Window.partitionBy(*key))
    return u.withColumn("__p", place).withColumn("__r", last).where("__r = 1").withColumn("place", F.struct(F.col("__p.__new").alias("batch"), F.col("__p.__o").alias("ord"))).drop("__new", "__o", "__p", "__r")


def recognition_merged(entries: DataFrame, read: DataFrame, key: list[str]) -> DataFrame:
    """Entries with what recognition read: replaced, appended, or removed where it read nothing."""
    untouched = entries.join(read.select(*key), key, "left_anti")
    return untouched.unionByName(read.where(F.trim("content") != ""), allowMissingColumns=True)


def empty_kind(decided: DataFrame, by: str = "bundle_id", offerable: Column | None = None) -> DataFrame:
    """Which kind of nothing a bundle without included files is.

    The first that holds of: a document that opened without text (``scanned``), readable
    files that filters hold back (``filtered``), an archive, images that nobody has tried
    to read (``recognisable``, where ``offerable`` holds), at least half images, ``other``.
    """
    why = F.coalesce("why", F.lit(""))
    per = decided.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("included").alias("i"), F.count_if(~F.col("included") & (why == "No extractable text")).alias("scanned"),
        F.count_if(~F.col("included") & ~why.isin(*UNREADABLE)).alias("filtered"), F.count_if(F.col("path").rlike(ARCHIVE_NAMES)).alias("archive"),
        F.count_if(F.col("path").rlike(IMAGE_NAMES)).alias("image"), F.count_if(F.lit(False) if offerable is None else offerable).alias("offer"),
    )
    kind = (
        F.when(F.col("scanned") > 0, "scanned").when(F.col("filtered") > 0, "filtered").when(F.col("archive") > 0, "archive").when(F.col("offer") > 0, "recognisable")
        .when((F.col("image") > 0) & (2 * F.col("image") >= F.col("n")), "image").otherwise("other")
    )
    return per.where("i = 0").select(by, kind.alias("kind"))


def reason_slug(reason: Column) -> Column:
    """A reason as a counter label."""
    m = F.create_map(*(F.lit(x) for kv in EMPTY_REASONS.items() for x in kv))
    return F.coalesce(F.try_element_at(m, reason), F.lit("other"))


def _kept(validated: DataFrame, decided: DataFrame, on: list[str]) -> DataFrame:
    return validated.join(decided.where("included").select(*on).distinct(), on, "left_semi")


def flagged(validated: DataFrame, decided: DataFrame, on: list[str]) -> DataFrame:
    """Included files of which it is open whether they are text."""
    return _kept(validated.where("classification = 'ambiguous'"), decided, on)


def extracted(validated: DataFrame, decided: DataFrame, on: list[str]) -> DataFrame:
    """Included files whose text was taken out of a document."""
    return _kept(validated.where("extracted"), decided, on)


def partial(validated: DataFrame, decided: DataFrame, on: list[str]) -> DataFrame:
    """Included documents that lost whole pages."""
    return _kept(validated.where(F.array_contains("notes", "pages-skipped")), decided, on)


def not_text(validated: DataFrame, unread: DataFrame, failed: DataFrame, on: list[str], path: str = "path") -> DataFrame:
    """``(*on, why)`` of what can't be combined: refused files but hidden ones and unread documents, and failures."""
    refused = validated.where(~F.col("included") & ~F.col("reason").eqNullSafe(F.lit("Hidden file"))).join(unread.select(*on), on, "left_anti")
    closed = F.when(F.col(path).rlike(r"(?i)\.(7z|rar)$"), "This kind of archive can't be opened")
    why = F.coalesce(closed, F.when(F.col("reason") != "", F.col("reason")), F.lit("Not text"))
    return refused.select(*on, why.alias("why")).unionByName(failed.select(*on, F.col("error").alias("why")))
