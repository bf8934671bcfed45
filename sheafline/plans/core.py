"""Core queries over the tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bundles, catalog, classify, clips, ingest, paths, reports
from ..session import table
from ..sources import remote
from ..streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = 1_790_000_000  # a fixed clock, so that both engines prune alike


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "usage_events")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "output_files")


# -- usage reports -------------------------------------------------------------------------------


@query("""
SELECT coalesce(s.value, '(none)') AS surface, count(DISTINCT e.page) AS visits,
  count(DISTINCT CASE WHEN e.name = 'batch_size' THEN e.page END) AS dropped, count(DISTINCT CASE WHEN e.name = 'output_taken' THEN e.page END) AS exported
FROM usage_events e LEFT JOIN (SELECT DISTINCT page, value FROM usage_events WHERE name = 'entry_surface') s ON s.page = e.page WHERE e.page IS NOT NULL GROUP BY 1
""")
def q1_funnel(spark, d):
    """Q1, J2, G3, G4."""
    return reports.funnel(_events(spark, d))


@query("""
SELECT page, run, max(CASE WHEN name = 'batch_size' THEN n END) AS files, max(CASE WHEN name = 'batch_size' THEN b END) AS in_bytes, max(CASE WHEN name = 'ingest_ms' THEN n END) AS ms,
  max(CASE WHEN name = 'bundle_size' THEN b END) AS out_bytes, CAST(sum(CASE WHEN name = 'output_taken' THEN 1 ELSE 0 END) AS BIGINT) AS exports, min(id) AS first_id,
  sum(CASE WHEN name = 'output_taken' THEN 1 ELSE 0 END) = 0 AS abandoned
FROM usage_events WHERE run IS NOT NULL GROUP BY page, run ORDER BY min(id) DESC, page, run LIMIT 40
""")
def q2_runs(spark, d):
    """The report of the latest 40 runs."""
    return reports.runs(_events(spark, d))


@query("""
SELECT page, run, max(CASE WHEN name = 'batch_size' THEN n END) AS files, max(CASE WHEN name = 'batch_size' THEN b END) AS in_bytes, max(CASE WHEN name = 'ingest_ms' THEN n END) AS ms,
  max(CASE WHEN name = 'bundle_size' THEN b END) AS out_bytes, CAST(sum(CASE WHEN name = 'output_taken' THEN 1 ELSE 0 END) AS BIGINT) AS exports, min(id) AS first_id,
  sum(CASE WHEN name = 'output_taken' THEN 1 ELSE 0 END) = 0 AS abandoned
FROM usage_events WHERE run IS NOT NULL GROUP BY page, run
""")
def q2_all_runs(spark, d):
    return reports.runs(_events(spark, d), limit=None)


@query("""
SELECT name, value, CAST(sum(n) AS BIGINT) AS files, CAST(sum(b) AS BIGINT) AS total_bytes, count(DISTINCT page) AS visits FROM usage_events
WHERE name IN ('unreadable_ext', 'extract_failed', 'archive_unsupported') GROUP BY name, value
""")
def q3_formats(spark, d):
    """Q3."""
    return reports.formats(_events(spark, d))


_MEASURES = " UNION ALL ".join(f"SELECT '{label}' AS measure, {col} AS v FROM usage_events WHERE name = '{name}' AND {col} IS NOT NULL" for label, name, col in reports.SIZES)


@query(f"""
SELECT measure, len(vs) AS n, vs[CAST(floor((len(vs) - 1) * 0.5) AS BIGINT) + 1] AS p50, vs[CAST(floor((len(vs) - 1) * 0.9) AS BIGINT) + 1] AS p90, vs[len(vs)] AS max
FROM (SELECT measure, list_sort(list(v)) AS vs FROM ({_MEASURES}) GROUP BY measure)
""")
def q4_sizes(spark, d):
    """Q4, G8."""
    return reports.sizes(_events(spark, d))


@query("SELECT value, CAST(sum(n) AS BIGINT) AS files, count(DISTINCT page) AS visits FROM usage_events WHERE name = 'files_over' GROUP BY value")
def q5_over(spark, d):
    """Q5."""
    return reports.over(_events(spark, d))


@query("SELECT value, count(DISTINCT page || '/' || run) AS runs FROM usage_events WHERE name = 'marker' GROUP BY value ORDER BY runs DESC, value NULLS LAST LIMIT 20")
def q6_markers(spark, d):
    """The report of 20 values."""
    return reports.markers(_events(spark, d))


@query("""
SELECT value, CAST(sum(n) AS BIGINT) AS files, CAST(sum(b) AS BIGINT) AS total_bytes, count(DISTINCT page || '/' || run) AS runs FROM usage_events WHERE name = 'file_ext'
GROUP BY value ORDER BY runs DESC, files DESC NULLS LAST, value NULLS LAST LIMIT 20
""")
def q7_extensions(spark, d):
    """Q7: the report of 20 values."""
    return reports.extensions(_events(spark, d))


@query("SELECT count(*) AS events FROM usage_events WHERE ts >= 1770000000")
def q8_total(spark, d):
    """Q8, S14."""
    return reports.total(_events(spark, d), 1_770_000_000)


@query(f"SELECT * FROM usage_events WHERE ts >= {NOW} - 180 * 86400 OR ts IS NULL")
def q10_retained(spark, d):
    """Q10, K7, C23."""
    return reports.retained(_events(spark, d), NOW)


@query("""
WITH p AS (SELECT name, coalesce(value, '-') AS value, CAST(sum(n) AS BIGINT) AS n, CAST(sum(b) AS BIGINT) AS b, min(id) AS o FROM usage_events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC NULLS LAST, o, value) AS k FROM p)
SELECT name, CASE WHEN k <= 5 THEN value ELSE 'other' END AS value, CAST(sum(n) AS BIGINT) AS n, CASE WHEN sum(b) <> 0 THEN CAST(sum(b) AS BIGINT) END AS b FROM r GROUP BY 1, 2
""")
def g2_tally(spark, d):
    """G1, G2."""
    e = _events(spark, d).withColumn("value", F.coalesce("value", F.lit("-")))
    return reports.tally(e, ["name"], "value", "n", "b", "id", cap=5)


@query(f"""
SELECT surface, visits, CASE WHEN visits > 0 THEN CAST(floor(dropped / visits * 100 + 0.5) AS BIGINT) END AS dropped_pct, CASE WHEN visits > 0 THEN CAST(floor(exported / visits * 100 + 0.5) AS BIGINT) END AS exported_pct
FROM ({SQL['q1_funnel']})
""")
def g23_conversion(spark, d):
    """G23."""
    return reports.conversion(reports.funnel(_events(spark, d)))


_WIRE_NAMES = ("file_ext", "marker", "batch_size", "ingest_ms", "output_taken")


@query(f"""
WITH e AS (SELECT *, id // 60 AS k FROM usage_events WHERE id IS NOT NULL),
g AS (SELECT page, k FROM e GROUP BY page, k HAVING count(*) BETWEEN 1 AND 50 AND regexp_full_match(page, '(?i)[a-z0-9-]{{8,64}}'))
SELECT e.page, e.name, e.value, CASE WHEN e.run BETWEEN 0 AND 1000 THEN e.run END AS run, CASE WHEN e.n BETWEEN 0 AND 1000000000000 THEN e.n END AS n, CASE WHEN e.b BETWEEN 0 AND 1000000000000 THEN e.b END AS b
FROM e JOIN g ON e.page = g.page AND e.k = g.k
WHERE e.name IN {_WIRE_NAMES} AND (e.value IS NULL OR regexp_full_match(e.value, '[a-z0-9._/+-]{{1,32}}')) AND (e.value IS NOT NULL OR e.n BETWEEN 0 AND 1000000000000 OR e.b BETWEEN 0 AND 1000000000000)
""")
def admitted_events(spark, d):
    """The table posted again in batches of a page's neighbouring events."""
    e = _events(spark, d).where("id IS NOT NULL")
    wire = F.struct(F.col("name").alias("n"), F.col("value").alias("v"), F.col("n").cast("string").alias("q"), F.col("b").cast("string").alias("b"), F.col("run").cast("string").alias("r"))
    batches = e.groupBy("page", F.expr("id div 60").alias("k")).agg(F.collect_list(wire).alias("e"))
    posted = batches.select(F.to_json(F.struct(F.col("page").alias("s"), "e")).alias("body"))
    return reports.admitted(posted, "body", list(_WIRE_NAMES), F.lit(0)).drop("ts")


@query("""
SELECT page, to_timestamp(ts // 10 * 10)::TIMESTAMP AS since, CAST(least(count(*), 30) AS BIGINT) AS admitted, CAST(greatest(count(*) - 30, 0) AS BIGINT) AS dropped FROM usage_events WHERE ts IS NOT NULL GROUP BY page, ts // 10
""")
def t3_rate(spark, d):
    """T3 over the table as a batch."""
    r = stream.within_rate(stream.stamped(_events(spark, d).where("ts IS NOT NULL")), "page", "event_time")
    return r.withColumn("since", F.col("since").cast("timestamp_ntz")).withColumn("admitted", F.col("admitted").cast("long"))


@query("""
SELECT page, run FROM usage_events WHERE run IS NOT NULL GROUP BY page, run
HAVING max(CASE WHEN name = 'bundle_size' THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN name = 'output_taken' THEN 1 ELSE 0 END) = 0
""")
def t6_abandoned(spark, d):
    """T6 as a batch: bundled runs without an export."""
    flag = lambda n: F.max((F.col("name") == n).cast("int"))
    r = _events(spark, d).where("run IS NOT NULL").groupBy("page", "run").agg(flag("bundle_size").alias("x"), flag("output_taken").alias("y"))
    return r.where("x = 1 AND y = 0").select("page", "run")


# -- paths -----------------------------------------------------------------------------------------

_IGNORE = "|".join(f"(?:{paths.path_regex(p)})" for p in paths.DEFAULT_IGNORE)


@query(f"SELECT file_id, path, coalesce(regexp_matches(path, '{_IGNORE}'), false) AS noise FROM output_files")
def noise_paths(spark, d):
    """P1-P4."""
    return _files(spark, d).select("file_id", "path", paths.is_noise(F.col("path")).alias("noise"))


@query(r"""
SELECT file_id, regexp_matches(path, '^(?:.*/)?src/[^/]*\.(?:ts|js)$|^(?:.*/)?Dockerfile(?:/.*)?$|^(?:.*/)?[^/]*\.tf(?:/.*)?$') AS chosen FROM output_files
""")
def globs(spark, d):
    """Slashed, bare and braced patterns."""
    return _files(spark, d).select("file_id", paths.path_matches(F.col("path"), ["src/*.{ts,js}", "Dockerfile", "*.tf"]).alias("chosen"))


@query(r"""
SELECT file_id, CASE WHEN regexp_matches(path, '^src/(?:.*/)?keep[^/]*(?:/.*)?$') THEN false WHEN regexp_matches(path, '^(?:.*/)?[^/]*\.java(?:/.*)?$|^(?:src/)(?:.*/)?[^/]*\.c(?:/.*)?$|^docs/.+$') THEN true ELSE false END AS ignored FROM output_files
""")
def gitignored(spark, d):
    """Nested ignore files, the last word wins."""
    rules = paths.ignore_rules([("", "# comment\n*.java\n/docs/\n"), ("src", "*.c\n!keep*\n")])
    return _files(spark, d).select("file_id", paths.ignored(F.col("path"), rules).alias("ignored"))


_MAP = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in paths.LANGUAGES.items()) + "}"


@query(f"""
SELECT file_id, CASE WHEN contains(lower(path), 'dockerfile') THEN 'dockerfile' WHEN contains(lower(path), 'makefile') THEN 'makefile'
  ELSE coalesce({_MAP}[string_split(lower(path), '.')[-1]], nullif(string_split(lower(path), '.')[-1], ''), 'text') END AS language FROM output_files
""")
def r14_language(spark, d):
    """R14."""
    return _files(spark, d).select("file_id", paths.language(F.col("path")).alias("language"))


_KIND = f"""CASE WHEN regexp_matches(lower(path), 'dockerfile|makefile') THEN 'code' WHEN string_split(lower(path), '.')[-1] IN {tuple(paths.PROSE_KINDS)} THEN 'doc'
  WHEN string_split(lower(path), '.')[-1] IN {tuple(paths.CODE_KINDS)} THEN 'code' ELSE 'other' END"""


@query(f"""
SELECT bundle_id, CASE WHEN code > doc THEN 'codebase' WHEN doc > code THEN 'documents' ELSE 'files' END AS kind, code, doc
FROM (SELECT bundle_id, count(*) FILTER (k = 'code') AS code, count(*) FILTER (k = 'doc') AS doc FROM (SELECT bundle_id, {_KIND} AS k FROM output_files) GROUP BY bundle_id)
""")
def r13_bundle_kind(spark, d):
    """R13."""
    return paths.bundle_kind(_files(spark, d), "bundle_id")


@query(f"""
SELECT marker, count(*) AS files FROM (SELECT lower(string_split(path, '/')[-1]) AS f, CASE WHEN f IN {tuple(paths.MARKERS)} THEN f ELSE regexp_extract(f, '.\\.(csproj|fsproj|vbproj|sln|gemspec|cabal|podspec)$', 1) END AS marker FROM output_files)
WHERE marker <> '' GROUP BY marker
""")
def r18_markers(spark, d):
    """R18."""
    return _files(spark, d).select(paths.ecosystem_marker(F.col("path")).alias("marker")).where("marker IS NOT NULL").groupBy("marker").agg(F.count(F.lit(1)).alias("files"))


@query("SELECT ext, count(*) AS files FROM (SELECT coalesce(nullif(lower(regexp_extract(string_split(path, '/')[-1], '^.+\\.([^.]*)$', 1)), ''), 'none') AS ext FROM output_files) GROUP BY ext")
def r19_extensions(spark, d):
    """R19."""
    return _files(spark, d).groupBy(S.file_extension(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("files"))


_SLUG = "regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9_-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"


@query(f"""
WITH f AS (SELECT bundle_id, ord, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM output_files),
t AS (SELECT bundle_id, p[1] AS top, count(*) AS n, count(*) FILTER (len(p) > 1) AS m, min(ord) FILTER (len(p) > 1) AS o, min(p[-1]) AS leaf FROM f GROUP BY ALL),
g AS (SELECT bundle_id, sum(n) AS n, count(*) AS tops, sum(m) AS deep, list(top ORDER BY m DESC, o, top) FILTER (m > 0) AS ds, max(m) AS most, min(top) AS top, min(leaf) AS leaf FROM t GROUP BY bundle_id)
SELECT bundle_id, CASE WHEN n = 1 AND deep = 0 THEN {_SLUG.format("regexp_replace(leaf, '\\.[^/.]+$', '')")} WHEN tops = 1 THEN {_SLUG.format('top')} WHEN ds IS NULL THEN {_SLUG.format("n || 'files'")}
  WHEN most > deep / 2 THEN {_SLUG.format('ds[1]')} WHEN len(ds) <= 3 THEN {_SLUG.format("array_to_string(ds, '-')")} ELSE {_SLUG.format("ds[1] || '-' || n || 'files'")} END AS project FROM g
""")
def g16_project_names(spark, d):
    """G16."""
    return paths.project_names(_files(spark, d), "bundle_id")


@query("""
WITH a AS (SELECT bundle_id, size_bytes, recognised IS NOT FALSE AS i, unnest(list_transform(range(1, len(string_split(path, '/'))), lambda k: array_to_string(string_split(path, '/')[1:k], '/'))) AS dir FROM output_files)
SELECT bundle_id, dir, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) AS files, count(*) FILTER (i) AS included, CASE WHEN count(*) FILTER (i) = 0 THEN 'excluded' WHEN count(*) FILTER (i) = count(*) THEN 'included' ELSE 'partial' END AS state
FROM a GROUP BY bundle_id, dir
""")
def g14_directories(spark, d):
    """G14, G15."""
    f = _files(spark, d).withColumn("i", F.coalesce("recognised", F.lit(True)))
    return paths.directory_rollup(f, "bundle_id", "size_bytes", "i")


# -- decisions ---------------------------------------------------------------------------------------


def _decided(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d).select("file_id", "bundle_id", "ord", "path", "size_bytes", "content")
    media = F.lit(None).cast("string")
    kind = classify.classification(media, classify.suspicion(F.coalesce("content", F.lit(""))))
    reason = F.coalesce(classify.validation(F.col("path"), kind), F.when(F.col("size_bytes") > 8000, "File exceeds size limit"))
    return ingest.decisions(f.withColumn("reason", reason).drop("content"), include="*.py, *.ts, *.pdf, Dockerfile, .env, *.js", ignore="*.js, src/app", rules=paths.ignore_rules([("", "*.ts\n!web/**/*.ts\n")]))


_DECIDED = r"""
(SELECT file_id, bundle_id, ord, path, size_bytes, CASE WHEN starts_with(string_split(path, '/')[-1], '.') THEN 'Hidden file' WHEN ratio > 0.3 THEN 'Binary file' WHEN size_bytes > 8000 THEN 'File exceeds size limit' END AS reason,
  CASE WHEN reason IS NOT NULL THEN reason
  WHEN NOT regexp_matches(path, '^(?:.*/)?[^/]*\.(?:py|ts|pdf|js)(?:/.*)?$|^(?:.*/)?(?:Dockerfile|\.env)(?:/.*)?$') THEN 'Outside include patterns'
  WHEN regexp_matches(path, '^(?:.*/)?[^/]*\.js(?:/.*)?$|^(?:.*/)?src/app$') THEN 'Matched ignore patterns'
  WHEN regexp_matches(path, '^(?:.*/)?[^/]*\.ts(?:/.*)?$') AND NOT regexp_matches(path, '^web/(?:[^/]+/)*[^/]*\.ts(?:/.*)?$') THEN 'Matched .gitignore' END AS why, why IS NULL AS included
FROM (SELECT *, CASE WHEN s = '' THEN 0 ELSE (length(s) - length(regexp_replace(s, '[\x{00}-\x{08}\x{0B}\x{0E}-\x{1F}\x{FFFD}]', '', 'g'))) / length(s) END AS ratio FROM (SELECT *, substr(coalesce(content, ''), 1, 8192) AS s FROM output_files)))
"""


@query(f"SELECT file_id, reason, included, why FROM {_DECIDED}")
def decisions(spark, d):
    """P7-P11, R4-R6, J3."""
    return _decided(spark, d).select("file_id", "reason", "included", "why")


@query(f"""
SELECT bundle_id, count(*) FILTER (included) AS included, count(*) FILTER (NOT included) AS excluded, CAST(sum(CASE WHEN included THEN size_bytes ELSE 0 END) AS BIGINT) AS included_bytes, CAST(sum(CASE WHEN included THEN 0 ELSE size_bytes END) AS BIGINT) AS excluded_bytes,
  count(*) FILTER (NOT included AND contains(lower(why), 'binary')) AS binary, count(*) FILTER (NOT included AND contains(lower(why), 'hidden')) AS hidden, count(*) FILTER (NOT included AND contains(lower(why), 'ignore')) AS ignored FROM {_DECIDED} GROUP BY bundle_id
""")
def g10_status(spark, d):
    """G10."""
    return ingest.status_stats(_decided(spark, d))


@query(f"""
SELECT bundle_id, coalesce(list(path ORDER BY ord, path) FILTER (regexp_matches(lower(why), 'exceed|size')), []) AS oversize, coalesce(list(path ORDER BY ord, path) FILTER (contains(lower(why), 'extract')), []) AS unextractable,
  coalesce(list(path ORDER BY ord, path) FILTER (contains(lower(why), 'binary')), []) AS binary FROM {_DECIDED} WHERE NOT included GROUP BY bundle_id
""")
def g11_exclusions(spark, d):
    """G11."""
    return ingest.exclusion_summary(_decided(spark, d)).select("bundle_id", "oversize", "unextractable", "binary")


@query(f"SELECT file_id, length(content) AS n FROM output_files WHERE file_id IN (SELECT file_id FROM {_DECIDED} WHERE included)")
def j5_included(spark, d):
    """J5, J6."""
    return ingest.included_contents(_files(spark, d).select("file_id", F.length("content").cast("long").alias("n")), _decided(spark, d), ["file_id"])


@query(f"SELECT file_id, why FROM {_DECIDED} WHERE NOT included AND reason IS NULL")
def j7_noise(spark, d):
    """J7, J8."""
    x = _decided(spark, d)
    return ingest.noise_skipped(x, x, ["file_id"]).select("file_id", "why")


# -- bundles -----------------------------------------------------------------------------------------


@query("""
SELECT bundle_id, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, max(size_bytes) AS largest, count(*) FILTER (size_bytes > 1048576) AS over_1, count(*) FILTER (size_bytes > 10485760) AS over_10, count(*) FILTER (size_bytes > 33554432) AS over_32
FROM output_files GROUP BY bundle_id
""")
def g9_headline(spark, d):
    """G9."""
    return bundles.headline(_files(spark, d))


@query("SELECT coalesce(nullif(lower(regexp_extract(string_split(path, '/')[-1], '^.+\\.([^.]*)$', 1)), ''), 'no extension') AS extension, count(*) AS files FROM output_files GROUP BY 1")
def g12_histogram(spark, d):
    """G12."""
    return bundles.extension_histogram(_files(spark, d))


@query("""
WITH f AS (SELECT *, length(coalesce(content, '')) AS c FROM output_files),
g AS (SELECT bundle_id, CAST(sum(c) AS BIGINT) AS n_chars, count(*) AS n_files, first(path ORDER BY c DESC, ord, file_id) AS top, max(c) AS most FROM f GROUP BY bundle_id),
t AS (SELECT *, CAST(ceil((n_chars + n_files - 1) / 4) AS BIGINT) AS tokens FROM g)
SELECT bundle_id, n_chars, n_files, tokens, n_chars > 1048576 AS large, CASE WHEN tokens / 8000.0 > 1 THEN 'over' WHEN tokens / 8000.0 >= 0.8 THEN 'tight' ELSE 'fits' END AS level,
  CASE WHEN (n_chars > 1048576 OR tokens / 8000.0 >= 0.8) AND n_files > 1 AND most / n_chars >= 0.3 THEN top END AS dominant FROM t
""")
def g13_weights(spark, d):
    """G13, C2, C3."""
    return bundles.weights(_files(spark, d), 8000)


_LANG = SQL["r14_language"].replace("SELECT file_id,", "").strip().removesuffix("FROM output_files").strip().removesuffix("AS language").strip()
_ATTR = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_OPEN = f"""'<file path="' || {_ATTR.format('path')} || '" language="' || {_ATTR.format(f'coalesce(lang_tag, {_LANG})')} || '">'"""


@query(f"""
SELECT bundle_id, count(*) AS n_files, md5(string_agg({_OPEN} || chr(10) || coalesce(content, '') || chr(10) || '</file>', chr(10) ORDER BY ord, file_id)) AS digest FROM output_files GROUP BY bundle_id
""")
def b3_blocks(spark, d):
    """The files of each bundle as one text, by its digest."""
    f = _files(spark, d)
    block = bundles.file_block("xml", F.col("path"), F.coalesce("content", F.lit("")), F.coalesce("lang_tag", paths.language(F.col("path"))))
    return f.withColumn("b", block).groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n_files"), F.md5(bundles.joined("b", "\n").cast("binary")).alias("digest"))


@query()
def b3_xml(spark, d):
    """Whole bundles."""
    f = _files(spark, d).join(table(spark, d, "bundles").select("bundle_id", "project_name", "source"), "bundle_id", "left")
    return bundles.assembled(f, "xml", project="project_name", source="source")


@query()
def b4_markdown(spark, d):
    """B4."""
    return bundles.assembled(_files(spark, d), "markdown")


@query()
def b5_plain(spark, d):
    """B5."""
    return bundles.assembled(_files(spark, d), "plain")


@query()
def n4_parts(spark, d):
    """Greedy parts; a running sum with resets has no plain SQL twin."""
    return bundles.parts(_files(spark, d).drop("content"), 20_000).select("bundle_id", "file_id", "part")


@query(r"""
SELECT file_id, md5(array_to_string(list_transform(string_split(content, chr(10)), lambda x, i: lpad(CAST(i AS VARCHAR), CAST(greatest(4, length(CAST(i AS VARCHAR))) AS INTEGER), ' ') || ' | ' || x), chr(10))) AS digest FROM output_files WHERE content IS NOT NULL
""")
def n5_numbered(spark, d):
    """N5."""
    return _files(spark, d).where("content IS NOT NULL").select("file_id", F.md5(S.numbered_lines(F.col("content")).cast("binary")).alias("digest"))


@query(f"SELECT language, count(*) AS files, CAST(sum(ceil(length(coalesce(content, '')) / 4)) AS BIGINT) AS tokens FROM (SELECT *, {_LANG} AS language FROM output_files) GROUP BY language")
def c2_tokens(spark, d):
    """C2, G22."""
    return bundles.tokens_by_language(_files(spark, d))


# -- scalars -------------------------------------------------------------------------------------------


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(source), '[^a-z0-9.\s_-]', '', 'g'), '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS key FROM documents
""")
def c1_keys(spark, d):
    """C1."""
    return table(spark, d, "documents").select("doc_id", S.canonical_key(F.col("source")).alias("key"))


@query("""
SELECT email_id, replace(replace(replace(replace(subject, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped,
  CASE WHEN subject IS NULL THEN NULL ELSE subject END AS subject FROM emails
""")
def c11_escaped(spark, d):
    """C11."""
    return table(spark, d, "emails").select("email_id", S.xml_attribute(F.col("subject")).alias("escaped"), "subject")


@query(r"""
SELECT id, CASE WHEN length(v) BETWEEN 1 AND 32 THEN v END AS label, CASE WHEN s = '' THEN 'home' ELSE substr(s, 1, 32) END AS surface
FROM (SELECT id, regexp_replace(lower(value), '[^a-z0-9._/+-]', '', 'g') AS v, regexp_replace(value, '^/+|/+$', '', 'g') AS s FROM usage_events)
""")
def c16_labels(spark, d):
    """C16, C19."""
    return _events(spark, d).select("id", S.label_value(F.col("value")).alias("label"), S.surface_label(F.col("value")).alias("surface"))


@query(r"""
SELECT image_id, CAST(least(90, floor(greatest(0, confidence) / 10) * 10) AS INTEGER) AS band, coalesce(confidence >= 55 AND length(regexp_replace(ocr_text, '[^\p{L}\p{N}]', '', 'g')) >= 8, false) AS readable FROM extracted_images
""")
def r24_confidence(spark, d):
    """R24, P20."""
    i = table(spark, d, "extracted_images")
    return i.select("image_id", S.confidence_band(F.col("confidence")).alias("band"), S.recognition_floor(F.col("confidence"), F.col("ocr_text")).alias("readable"))


@query("""
SELECT file_id, CASE WHEN size_bytes < 1048576 THEN 'small' WHEN size_bytes < 33554432 THEN 'medium' ELSE 'large' END AS scale,
  CASE WHEN size_bytes >= 512000 THEN 'high' WHEN size_bytes >= 102400 THEN 'medium' WHEN size_bytes >= 20480 THEN 'low' ELSE 'none' END AS severity FROM output_files
""")
def r23_scales(spark, d):
    """R23."""
    s = F.col("size_bytes")
    return _files(spark, d).select("file_id", F.when(s.isNull(), "large").otherwise(S.size_scale(s)).alias("scale"), S.size_severity(s).alias("severity"))


@query(r"""
SELECT doc_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1)) AS host, coalesce(nullif(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/')[-1], ''), 'file.txt') AS file
FROM (SELECT doc_id, regexp_extract(text, 'source: (https?://\S+)', 1) AS url FROM documents) WHERE url <> ''
""")
def c20_urls(spark, d):
    """C20, C21."""
    u = table(spark, d, "documents").select("doc_id", F.regexp_extract("text", r"source: (https?://\S+)", 1).alias("url")).where("url <> ''")
    return u.select("doc_id", "url", S.host(F.col("url")).alias("host"), S.url_filename(F.col("url")).alias("file"))


_E5 = "html"
for _p, _r in ((r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>", ""), (r"(?i)</?(?:p|div|br|tr|li|h[1-6]|blockquote|table)\b[^>]*>", "' || chr(10) || '"), (r"<[^>]+>", "")):
    _E5 = f"regexp_replace({_E5}, '{_p}', '{_r}', 'g')"
for _p, _r in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _E5 = f"replace({_E5}, '{_p}', '{_r}')"
for _p, _r in ((r"[ \t]+", " "), (r" ?\n ?", "' || chr(10) || '"), (r"\n{3,}", "' || chr(10) || chr(10) || '"), (r"^\s+|\s+$", "")):
    _E5 = f"regexp_replace({_E5}, '{_p}', '{_r}', 'g')"


@query(f"SELECT email_id, {_E5} AS plain FROM emails WHERE html IS NOT NULL")
def e5_html(spark, d):
    """E5, C12."""
    return table(spark, d, "emails").where("html IS NOT NULL").select("email_id", S.html_text(F.col("html")).alias("plain"))


@query("""
SELECT bundle_id, CASE WHEN len(ps) > 10 THEN array_to_string(ps[1:10], ', ') || ' +' || (len(ps) - 10) || ' more' ELSE array_to_string(ps, ', ') END AS listed FROM (SELECT bundle_id, list(path ORDER BY ord, path) AS ps FROM output_files GROUP BY bundle_id)
""")
def c25_listed(spark, d):
    """C25, O6."""
    ps = F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda s: s["path"])
    return _files(spark, d).groupBy("bundle_id").agg(S.capped_list(ps).alias("listed"))


# -- keyed matching ------------------------------------------------------------------------------------


_CANON = r"regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9.\s_-]', '', 'g'), '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"""
SELECT bundle_id, count(*) AS offers FROM (SELECT b.bundle_id FROM (SELECT bundle_id, {_CANON.format('source')} AS k FROM bundles WHERE source IS NOT NULL) b JOIN (SELECT {_CANON.format('source')} AS k FROM documents WHERE source IS NOT NULL) o ON b.k = o.k) GROUP BY bundle_id
""")
def j1_matched(spark, d):
    """J1 with its count per catalog row: bundles and documents of one source name."""
    b = table(spark, d, "bundles").where("source IS NOT NULL").select("bundle_id", F.col("source").alias("name"))
    o = table(spark, d, "documents").where("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return catalog.matched(b, o, "name", "source").groupBy("bundle_id").agg(F.sum("n").alias("offers"))


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_quantity DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def g17_winners(spark, d):
    """The cheapest offer of each part, ties resolved."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return catalog.winners(li, ["l_partkey"], [F.col("l_extendedprice"), -F.col("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber")]).drop("l_quantity")


@query(f"""
SELECT match_key, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY match_key ORDER BY t, CASE WHEN t IN (0, 2) THEN p_retailprice ELSE 0 END, p_size DESC, p_partkey) AS k FROM
  (SELECT *, {_CANON.format('p_brand')} AS match_key, CASE WHEN p_size > 25 AND p_retailprice > 0 THEN 0 WHEN p_size > 25 THEN 1 WHEN p_retailprice > 0 THEN 2 ELSE 3 END AS t FROM part)) WHERE k = 1
""")
def g18_deduplicated(spark, d):
    """G18, O2."""
    p = table(spark, d, "part").withColumn("first_party", F.col("p_size") > 25)
    return catalog.deduplicated(p, "p_brand", "first_party", "p_retailprice", "p_size", "p_partkey").select("match_key", "p_partkey")


@query("SELECT capacity_tokens AS tokens, count(*) AS fits FROM part, token_limits WHERE p_size * 400 >= capacity_tokens GROUP BY 1")
def j10_fitting(spark, d):
    """Stated needs against every row."""
    p = table(spark, d, "part").select((F.col("p_size") * 400).alias("room"))
    needs = table(spark, d, "token_limits").select(F.col("capacity_tokens").alias("tokens"))
    return catalog.fitting(p, needs, "room", "tokens").groupBy("tokens").agg(F.count(F.lit(1)).alias("fits"))


# -- clips and merges ----------------------------------------------------------------------------------


@query()
def n2_unique_paths(spark, d):
    """N2 over the paths of each bundle."""
    f = _files(spark, d).select("bundle_id", "file_id", "path")
    return clips.unique_paths(f, "path", "file_id", ("bundle_id",)).select("bundle_id", "file_id", "unique_path")


@query("SELECT message_id, email_id FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY received_at DESC NULLS LAST, email_id DESC) AS k FROM emails WHERE message_id IS NOT NULL) WHERE k = 1")
def n1_latest(spark, d):
    """The last delivery of each message."""
    e = table(spark, d, "emails").where("message_id IS NOT NULL").select("message_id", "email_id", "received_at")
    return clips.upserted(e.limit(0), e.withColumn("ord", F.struct(F.coalesce("received_at", F.lit("0001-01-01").cast("timestamp_ntz")), "email_id")), ["message_id"]).select("message_id", "email_id")


@query("SELECT source, max_by(path, (length(path), path)) AS title, count(*) AS links FROM documents WHERE source IS NOT NULL AND path IS NOT NULL GROUP BY source")
def l7_grouped(spark, d):
    """L7."""
    return clips.grouped_listing(table(spark, d, "documents").where("source IS NOT NULL AND path IS NOT NULL"), "source", "path")


@query("SELECT doc_id, source FROM (SELECT *, lag(lang) OVER (PARTITION BY source ORDER BY doc_id) AS b, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k = 1 OR lang IS DISTINCT FROM b")
def n7_changes(spark, d):
    """Documents whose language differs from the one before of their source."""
    return clips.changed(table(spark, d, "documents"), "source", "doc_id", "lang").select("doc_id", "source")


@query("SELECT e.email_id FROM emails e WHERE e.in_reply_to IS NOT NULL AND NOT EXISTS (SELECT 1 FROM emails m WHERE m.message_id = e.in_reply_to)")
def j9_unseen(spark, d):
    """Replies to messages that aren't there."""
    e = table(spark, d, "emails")
    seen = e.select(F.col("message_id").alias("in_reply_to"))
    return e.where("in_reply_to IS NOT NULL").join(seen, "in_reply_to", "left_anti").select("email_id")


@query()
def l5_threads(spark, d):
    """Replies under the messages they answer, in pre-order."""
    e = table(spark, d, "emails").select("email_id", "message_id", "in_reply_to").where("message_id IS NOT NULL")
    first = e.groupBy("message_id").agg(F.min("email_id").alias("id"), F.min("in_reply_to").alias("in_reply_to"))
    ids = first.select(F.col("message_id").alias("in_reply_to"), F.col("id").alias("parent_id"))
    nodes = first.join(ids, "in_reply_to", "left").select("id", "parent_id", F.col("id").alias("ord"))
    return clips.flattened(nodes).select("id", "depth", "place")


@query()
def c17_frontmatter(spark, d):
    """C17, C18."""
    t = F.col("text")
    return table(spark, d, "documents").where(t.startswith("---")).select("doc_id", F.to_json(S.frontmatter(t)).alias("fields"), S.lead_paragraph(t).alias("lead"))


@query()
def r16_urls(spark, d):
    """R16, R17, S12, P22 over the addresses documents came from."""
    u = table(spark, d, "documents").select("doc_id", F.regexp_extract("text", r"source: (https?://\S+)", 1).alias("url")).where("url <> ''")
    return u.select("doc_id", remote.classified_url(F.col("url")).alias("kind"), remote.parsed_source(F.col("url"))["type"].alias("type"), remote.page_kind(F.col("url")).alias("page"))


@query()
def e17_placeholders(spark, d):
    """Documents with their images' text in place."""
    from ..operators import extract

    return extract.filled_placeholders(_files(spark, d).where(F.col("content").contains("[Image: ")), table(spark, d, "extracted_images"))


@query()
def e13_furniture(spark, d):
    """Edge lines that number pages or repeat."""
    from ..operators import extract

    return extract.running_furniture(_files(spark, d).where(F.col("content").contains("# Page ")), "file_id", "content")


@query()
def e15_undecodable(spark, d):
    """E15."""
    from ..operators import extract

    return extract.undecodable(_files(spark, d).where(F.col("content").contains("# Page ")), "file_id", "content").select("file_id", "lost", "pages")


# -- more of the inventory -----------------------------------------------------------------------------


@query()
def b1_trees(spark, d):
    """B1."""
    return paths.trees(_files(spark, d), "bundle_id")


@query("SELECT page, value FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY ts, id) AS k FROM usage_events WHERE name = 'entry_surface') WHERE k = 1")
def t4_first_surface(spark, d):
    """T4 as a batch: the first surface of each page."""
    e = _events(spark, d).where("name = 'entry_surface'").select("page", "value", "ts", "id")
    return catalog.winners(e, ["page"], [F.col("ts"), F.col("id")]).select("page", "value")


@query(f"""
SELECT doc_id, CASE WHEN contains(t, q) THEN 0 WHEN near <= greatest(2, floor(length(q) * 0.4)) THEN CAST(near + 2 AS INTEGER) END AS score
FROM (SELECT doc_id, q, t, list_min(list_transform(string_split_regex(t, '[-.]'), lambda w: levenshtein(w, q))) AS near FROM (SELECT doc_id, 'window' AS q, {_CANON.format('source')} AS t FROM documents WHERE source IS NOT NULL))
""")
def c9_fuzzy(spark, d):
    """C9."""
    docs = table(spark, d, "documents").where("source IS NOT NULL")
    return docs.select("doc_id", S.fuzzy_score(F.lit("Window"), F.col("source")).alias("score"))


@query("SELECT coalesce(value, '(none)') AS value, count(*) AS n FROM usage_events WHERE name = 'js_error' GROUP BY 1")
def g20_histogram(spark, d):
    """G20."""
    return _events(spark, d).where("name = 'js_error'").groupBy(F.coalesce("value", F.lit("(none)")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT bundle_id, CAST(sum(strlen(coalesce(content, ''))) AS BIGINT) AS bytes, count(DISTINCT ord // 10) AS parts, CAST(ceil(sum(strlen(coalesce(content, ''))) / count(DISTINCT ord // 10)) AS BIGINT) AS average FROM output_files GROUP BY bundle_id")
def g21_part_sizes(spark, d):
    """G21, C10."""
    return bundles.part_sizes(_files(spark, d).withColumn("part", F.expr("ord div 10")))


@query("""
SELECT email_id FROM emails WHERE regexp_matches(subject, '(?i)report|notes on') AND NOT regexp_matches(subject, '(?i)archive|^re:') AND received_at >= TIMESTAMP '2026-01-01'
""")
def relevant_threads(spark, d):
    """P17."""
    e = table(spark, d, "emails")
    return clips.relevant_threads(e, "subject", "report|notes on", "archive|^re:", F.lit("2026-01-01").cast("timestamp_ntz"), "received_at").select("email_id")


@query("""
SELECT value, count(*) AS impressions, count(*) FILTER (b IS NOT NULL) AS clicks FROM usage_events WHERE value IS NOT NULL GROUP BY value HAVING count(*) >= 15 AND count(*) FILTER (b IS NOT NULL) < 0.02 * count(*)
""")
def seldom_taken(spark, d):
    """Much seen, hardly taken."""
    per = _events(spark, d).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("impressions"), F.count("b").alias("clicks"))
    return per.where((F.col("impressions") >= 15) & (F.col("clicks") < 0.02 * F.col("impressions")))


@query("""
SELECT file_id, CASE WHEN size_bytes = 0 THEN '0 Bytes' ELSE regexp_replace(printf('%.2f', round(size_bytes / pow(1024, e), 2)), '\\.?0+$', '') || ' ' || ['Bytes', 'KB', 'MB', 'GB'][e + 1] END AS size
FROM (SELECT file_id, size_bytes, CAST(CASE WHEN size_bytes >= 1073741824 THEN 3 WHEN size_bytes >= 1048576 THEN 2 WHEN size_bytes >= 1024 THEN 1 ELSE 0 END AS INTEGER) AS e FROM output_files WHERE size_bytes IS NOT NULL)
""")
def c6_sizes(spark, d):
    """C6."""
    return _files(spark, d).where("size_bytes IS NOT NULL").select("file_id", S.format_size(F.col("size_bytes")).alias("size"))


@query("""
SELECT bundle_id, CAST(count(*) AS BIGINT) AS n, md5(string_agg(path || ':' || s, '|' ORDER BY ord, path)) AS digest FROM
 (SELECT bundle_id, ord, path, CASE WHEN contains(lower(path), 'docker') THEN 'a' WHEN path LIKE '%.py' THEN 'b' ELSE 'c' END AS s FROM output_files) GROUP BY bundle_id
""")
def j11_patterns(spark, d):
    """Every path against a list of patterns, the first that matches wins."""
    p = F.col("path")
    first = F.when(F.contains(F.lower(p), F.lit("docker")), "a").when(paths.path_matches(F.element_at(F.split(p, "/"), -1), ["*.py"]), "b").otherwise("c")
    said = F.transform(F.array_sort(F.collect_list(F.struct("ord", "path", first.alias("s")))), lambda x: F.concat(x["path"], F.lit(":"), x["s"]))
    return _files(spark, d).groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(said, "|").cast("binary")).alias("digest"))
