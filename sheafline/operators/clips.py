"""Clipped threads, articles and transcripts as files, and the bookkeeping of what was kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import iso_day, yaml_string

MAX_DEPTH = 8


def front_matter(**fields: Column) -> Column:
    """A block of the fields that are present, in order."""
    rows = F.array_compact(F.array(*(F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in fields.items())))
    return F.concat(F.lit("---\n"), F.array_join(rows, "\n"), F.lit("\n---\n"))


def comment_block(author: Column, created: Column, score: Column, depth: Column, text: Column) -> Column:
    """A comment behind as many quote marks as it is deep, eight at most (L2, L4)."""
    d = F.least(F.coalesce(depth, F.lit(0)), F.lit(MAX_DEPTH))
    prefix = F.repeat(F.lit("> "), d.cast("int"))
    points = F.when(score.isNotNull(), F.concat(F.lit(" · "), score.cast("string"), F.lit(" points")))
    head = F.concat(F.lit("**"), F.coalesce(author, F.lit("[deleted]")), F.lit("**"), F.coalesce(F.concat(F.lit(" · "), iso_day(created)), F.lit("")), F.coalesce(points, F.lit("")))
    lines = F.concat(F.array(head), F.split(F.coalesce(text, F.lit("")), "\n"))
    return F.array_join(F.transform(lines, lambda x: F.rtrim(F.concat(prefix, x))), "\n")


def thread(items: DataFrame, comments: DataFrame, id_col: str = "thread_id", order: str = "pos") -> DataFrame:
    """``(id, markdown)`` of threads: heading, body and comments in order (L1-L4).

    ``items``: id, title, url, author, created, text, total (comments said to exist, null
    where the site doesn't tell). Dead comments are left out, their replies keep their depth.
    """
    block = comment_block(F.col("author"), F.col("created"), F.col("score"), F.col("depth"), F.col("text"))
    said = comments.where(~F.coalesce(F.col("dead"), F.lit(False))).groupBy(id_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, block.alias("b")))), lambda s: s["b"]), "\n\n").alias("said"), F.count(F.lit(1)).alias("n")
    )
    j = items.join(said, id_col, "left")
    matter = front_matter(title=yaml_string(F.col("title")), source=F.col("url"), author=yaml_string(F.col("author")), date=iso_day(F.col("created")))
    n = F.coalesce("n", F.lit(0))
    count = F.when(F.col("total").isNull() & (n == 0), "No comments were read.").when(F.col("total").isNull(), F.concat(n.cast("string"), F.lit(" comments"))).when(F.col("total") == 0, "No comments.").otherwise(
        F.concat(n.cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" comments"))
    )
    text = F.concat_ws("\n\n", F.concat(matter, F.lit("\n# "), F.coalesce("title", F.lit("Untitled"))), F.when(F.trim("text") != "", F.col("text")), F.concat(F.lit("## "), count), F.col("said"))
    return j.select(id_col, F.concat(text, F.lit("\n")).alias("markdown"))


#: Characters of a text that stand for it in a description.
DESCRIPTION = 200


def article(rows: DataFrame, id_col: str = "clip_id") -> DataFrame:
    """``(id, markdown)`` of clipped articles (L3): the byline is the author, or else the site."""
    quoted = lambda c: yaml_string(F.coalesce(c, F.lit("")))
    who = F.coalesce(F.when(F.col("author") != "", F.col("author")), F.col("site_name"), F.lit(""))
    head = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("title: "), quoted(F.col("title"))), F.concat(F.lit("source: "), quoted(F.col("url"))), F.lit("author:"), F.concat(F.lit("  - "), yaml_string(F.concat(F.lit("[["), who, F.lit("]]")))),
        F.concat(F.lit("published: "), F.when(F.col("published") != "", iso_day(F.col("published"))).otherwise("")), F.concat(F.lit("created: "), F.coalesce("clipped_on", F.lit(""))),
        F.concat(F.lit("description: "), quoted(F.substring("excerpt", 1, DESCRIPTION))), F.lit("tags:"), F.lit('  - "clippings"'), F.lit("---"),
    )
    return rows.select(id_col, F.concat(head, F.lit("\n![]("), F.coalesce("url", F.lit("")), F.lit(")\n\n"), F.coalesce("body", F.lit("")), F.lit("\n")).alias("markdown"))


def ranked_threads(rows: DataFrame, groups: list[str], group: str = "group", replies: str = "replies", stamp: str = "ts", by_replies: bool = False) -> DataFrame:
    """Threads by the rank of their group, then by replies if asked, the latest first."""
    rank = F.coalesce(F.array_position(F.array(*(F.lit(g) for g in groups)), F.col(group)), F.lit(0))
    lead = [rank.asc(), *([F.coalesce(replies, F.lit(0)).desc()] if by_replies else []), F.col(stamp).desc_nulls_last()]
    return rows.orderBy(*lead)


def seen_after(seen: DataFrame, found: DataFrame, key: str = "id", stamp: str = "ts") -> DataFrame:
    """What has been seen after a run: the stamp found now replaces an earlier one (K9)."""
    return upserted(seen.select(key, stamp), found.select(key, stamp).groupBy(key).agg(F.max(stamp).alias(stamp)), [key], stamp)


def preview(text: Column, most: int = 4000) -> Column:
    """The beginning of a text."""
    return F.substring(text, 1, most)


def preview_blocks(blocks: Column, head: int = 200, tail: int = 40) -> Column:
    """The first and last blocks of a long list, all of a short one."""
    n = F.size(blocks)
    return F.when(n <= head + tail, blocks).otherwise(F.concat(F.slice(blocks, 1, head), F.slice(blocks, -tail, tail)))


def transcript_line(seconds: Column, text: Column) -> Column:
    """A stamped line of speech (L1)."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), F.floor(seconds % 60)
    stamp = F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))
    return F.concat(F.lit("**"), stamp, F.lit("** · "), text)


def flattened(nodes: DataFrame, id_col: str = "id", parent: str = "parent_id", order: str = "ord") -> DataFrame:
    """Nodes of reply trees in pre-order, with ``depth`` and a sortable ``place``.

    Each round doubles how far up a node sees, so trees of any depth take a logarithm of
    it in rounds. Ids are unique; nodes on a cycle, or under a parent that isn't there,
    hang on no root and have no place.
    """
    from ..session import cut

    text = F.col(order).cast("string")
    width = max(10, nodes.agg(F.max(F.length(text)).alias("w")).first()["w"] or 0)
    state = cut(nodes.withColumn("__up", F.col(parent)).withColumn("depth", F.when(F.col(parent).isNull(), 0).otherwise(1)).withColumn("place", F.lpad(text, width, "0")))
    left = state.where("__up IS NOT NULL").count()
    while left:
        p = state.select(F.col(id_col).alias("__p"), F.col("__up").alias("__next"), F.col("depth").alias("__depth"), F.col("place").alias("__place"))
        up = state.where("__up IS NOT NULL").join(p, F.col("__up") == F.col("__p"))
        up = up.withColumn("depth", F.col("depth") + F.col("__depth")).withColumn("place", F.concat("__place", F.lit("/"), "place")).withColumn("__up", F.col("__next"))
        state = cut(state.where("__up IS NULL").unionByName(up.select(*state.columns)))
        # while a tree is unfinished each round finishes some of it; what stays is on or under a cycle
        if (n := state.where("__up IS NOT NULL").count()) >= left:
            break
        left = n
    return state.where("__up IS NULL").drop("__up")


def unique_paths(clips: DataFrame, path: str = "path", order: str = "ord", by: tuple[str, ...] = ()) -> DataFrame:
    """Clips with paths made unique by ``-2``, ``-3`` before the ending, names already taken skipped.

    Repeats of a path take the free numbers of their own name: taken ones are those
    literal paths that have the form of a suffixed one.
    """
    stem, ext = F.regexp_replace(F.col(path), r"(\.[^./]+)?$", ""), F.regexp_extract(F.col(path), r"(\.[^./]+)$", 1)
    w = Window.partitionBy(*by, path).orderBy(order)
    rows = clips.withColumn("__stem", stem).withColumn("__ext", ext).withColumn("__k", F.row_number().over(w))
    named = clips.select(*by, F.col(path).alias("__path")).distinct()
    root, number = F.regexp_extract("__path", r"^(.*)-(\d{1,9})(\.[^./]+)?$", 1), F.regexp_extract("__path", r"^(.*)-(\d{1,9})(\.[^./]+)?$", 2)
    taken = named.where((root != "") & (number.cast("int") >= 2)).groupBy(*by, root.alias("__stem"), F.regexp_extract("__path", r"(\.[^./]+)$", 1).alias("__ext")).agg(F.array_sort(F.collect_set(number.cast("int"))).alias("__taken"))
    j = rows.join(taken, [*by, "__stem", "__ext"], "left")
    # the k-th free number from 2 on: every taken number at or below the running one pushes it by one
    free = F.aggregate(F.coalesce("__taken", F.array().cast("array<int>")), F.col("__k"), lambda acc, t: F.when(t <= acc, acc + 1).otherwise(acc))
    suffixed = F.concat("__stem", F.lit("-"), free.cast("string"), "__ext")
    return j.withColumn("unique_path", F.when(F.col("__k") == 1, F.col(path)).otherwise(suffixed)).drop("__stem", "__ext", "__k", "__taken")


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: str = "ord", partial: str | None = None) -> DataFrame:
    """The latest row of each key (K8, N1); a partial reading never replaces a full one."""
    u = old.withColumn("__n", F.lit(0)).unionByName(new.withColumn("__n", F.lit(1)), allowMissingColumns=True)
    lead = [F.col("__n").desc(), F.col(order).desc()]
    if partial:
        lead = [F.coalesce(partial, F.lit(False)).asc(), *lead]
    return u.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*lead))).where("__r = 1").drop("__r", "__n")


def unexpired(sent: DataFrame, now: Column, stamp: str, days: int = 7) -> DataFrame:
    return sent.where(F.col(stamp) >= now - days * 86_400)


def grouped_listing(links: DataFrame, target: str, text: str) -> DataFrame:
    """One row a target: of its texts the longest is the title."""
    return links.groupBy(target).agg(F.max_by(text, F.struct(F.length(text), text)).alias("title"), F.count(F.lit(1)).alias("links"))


def expanded_sets(sets: DataFrame, items: DataFrame, key: str, order: str, cap: int) -> DataFrame:
    """Items of each set, ``cap`` at most; a set without items is a failure row."""
    w = Window.partitionBy(key).orderBy(order)
    some = items.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= cap).drop("__r")
    return sets.join(some, key, "left").withColumn("failed", F.col(order).isNull())


def admitted_push(batch: DataFrame, by: str, path: str = "path", text: str = "markdown", max_files: int = 200, max_chars: int = 4_000_000) -> DataFrame:
    """Pushed files of batches without a violation; one bad path rejects its batch."""
    bad = F.exists(F.split(F.col(path), "/"), lambda s: s.isin("", ".", "..")) | F.col(path).isNull()
    ok = batch.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(text)).alias("c"), F.count_if(bad).alias("b")).where((F.col("n") <= max_files) & (F.col("c") <= max_chars) & (F.col("b") == 0))
    return batch.join(ok.select(by), by, "left_semi")


def relevant_threads(rows: DataFrame, title: str, want: str, noise: str, since: Column, created: str) -> DataFrame:
    """Threads whose title asks, isn't noise and is young enough."""
    return rows.where(F.col(title).rlike(f"(?i){want}") & ~F.col(title).rlike(f"(?i){noise}") & (F.col(created) >= since))


def new_threads(rows: DataFrame, seen: DataFrame, key: str, order: str) -> DataFrame:
    """Threads not seen before, one a key."""
    first = rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__r = 1").drop("__r")
    return first.join(seen.select(key), key, "left_anti")


def changed(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(order))
    first = F.row_number().over(Window.partitionBy(by).orderBy(order)) == 1
    return rows.withColumn("__c", first | ~F.col(value).eqNullSafe(before)).where("__c").drop("__c")
