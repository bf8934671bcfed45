"""Queries of the operators on bundles, runs, models and clips, each beside its SQL."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bundles, catalog, clips, ingest, paths, reports
from ..session import table
from ..sources import remote
from . import core
from .core import _CANON, _DECIDED, _LANG, QUERIES, SQL, _decided, _events, _files, query

# -- trees and bundles ---------------------------------------------------------------------------

_ORDERED = "SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY ord NULLS FIRST, file_id) AS o FROM output_files WHERE path IS NOT NULL"
#: A drawing in SQL: nodes with their first appearance, sorted by the keys of their ancestors.
_TREES = f"""
SELECT bundle_id, string_agg(line, chr(10) ORDER BY keys) AS tree FROM (
  SELECT a.bundle_id, a.node, list(b.key ORDER BY a.j) AS keys,
    string_agg(CASE WHEN a.j < a.k THEN CASE WHEN b.last THEN '    ' ELSE '│   ' END WHEN b.last THEN '└── ' ELSE '├── ' END, '' ORDER BY a.j) || a.name AS line
  FROM (SELECT *, unnest(range(1, k + 1)) AS j FROM _nodes) a JOIN _nodes b ON a.bundle_id = b.bundle_id AND b.node = a.node[1:a.j] GROUP BY a.bundle_id, a.node, a.name
) GROUP BY bundle_id
"""
_NODES = f"""
_files AS ({_ORDERED}),
_steps AS (SELECT bundle_id, o, s, unnest(range(1, len(s) + 1)) AS k FROM (SELECT bundle_id, o, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM _files)),
_named AS (SELECT bundle_id, s[1:k] AS node, k, s[k] AS name, s[1:k - 1] AS parent, min(o) AS o FROM _steps GROUP BY ALL),
_keyed AS (SELECT *, CASE WHEN regexp_full_match(name, '0|[1-9][0-9]{{0,9}}') AND TRY_CAST(name AS BIGINT) < 4294967295 THEN [0, CAST(name AS BIGINT)] ELSE [1, o] END AS key FROM _named),
_nodes AS (SELECT *, row_number() OVER (PARTITION BY bundle_id, parent ORDER BY key DESC) = 1 AS last FROM _keyed)
"""


QUERIES.pop("b1_trees")


@query(f"WITH {_NODES} {_TREES}")
def b1_trees(spark, d):
    """B1."""
    return paths.trees(_files(spark, d).where("path IS NOT NULL"), "bundle_id")


_Q = lambda s: s.replace("'", "''")
def _listed(name: str) -> str:
    return f"array_to_string({name}[1:10], ', ') || CASE WHEN len({name}) > 10 THEN ' +' || (len({name}) - 10) || ' more' ELSE '' END"


def _bundle_sql(style: str, project: str, source: str, lacking: bool) -> str:
    """The whole text of a bundle; what its files are is taken from the library's own tested columns (g13, decisions)."""
    if style == "xml":
        esc = lambda c: f"""replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""
        block = f"""'<file path="' || {esc('path')} || '" language="' || {esc('lang')} || '">' || chr(10) || coalesce(content, '') || chr(10) || '</file>'"""
    elif style == "markdown":
        block = "'### ' || path || chr(10) || chr(10) || '```' || lang || chr(10) || coalesce(content, '') || chr(10) || '```'"
    else:
        block = "repeat('=', 72) || chr(10) || 'FILE: ' || path || chr(10) || repeat('=', 72) || chr(10) || coalesce(content, '')"
    sep = "chr(10)" if style == "xml" else "chr(10) || chr(10)"
    nl = "chr(10)"
    noun = "CASE kind WHEN 'codebase' THEN 'a codebase' WHEN 'documents' THEN 'a set of documents' ELSE 'a set of files' END"
    title = "CASE kind WHEN 'codebase' THEN 'Codebase' WHEN 'documents' THEN 'Documents' ELSE 'Files' END"
    lines = [f"'This is a packed snapshot of ' || {noun} || '.'", f"'{_Q(bundles.READ_ONLY)}'", f"'Source: ' || {source}", "'File count: ' || n || '.'", f"CASE WHEN len(guessed) > 0 THEN '{_Q(bundles.GUESSED)}' || {_listed('guessed')} END"]
    if lacking:
        lines += [f"CASE WHEN len(oversize) > 0 OR len(unextractable) > 0 OR len(bin) > 0 THEN '{bundles.MISSING}' END", f"CASE WHEN len(oversize) > 0 THEN '{bundles.OVERSIZE}' || {_listed('oversize')} END", f"CASE WHEN len(unextractable) > 0 THEN '{bundles.UNEXTRACTABLE}' || {_listed('unextractable')} END",
                  f"CASE WHEN len(bin) > 0 THEN '- ' || len(bin) || CASE WHEN len(bin) = 1 THEN '{bundles.ONE_BINARY}' ELSE '{bundles.MANY_BINARY}' END || {_listed('bin')} END"]
    summary = f"concat_ws({nl}, {', '.join(lines)})"
    if style == "xml":
        attrs = f"""concat_ws(' ', 'project="' || {esc(project)} || '"', 'source="' || {esc(source)} || '"', 'generator="sheafline"')"""
        text = f"'<' || kind || ' ' || {attrs} || '>' || {nl} || '<summary>' || {nl} || {summary} || {nl} || '</summary>' || {nl} || '<directory_structure>' || {nl} || tree || {nl} || '</directory_structure>' || {nl} || '<files>' || {nl} || blocks || {nl} || '</files>' || {nl} || '</' || kind || '>' || {nl}"
    elif style == "markdown":
        text = f"'# ' || {title} || ': ' || {project} || {nl} || {nl} || {summary} || {nl} || {nl} || '## Directory structure' || {nl} || {nl} || '```' || {nl} || tree || {nl} || '```' || {nl} || {nl} || '## Files' || {nl} || {nl} || blocks || {nl}"
    else:
        text = f"{title} || ': ' || {project} || {nl} || {nl} || {summary} || {nl} || {nl} || 'Directory structure:' || {nl} || tree || {nl} || {nl} || blocks || {nl}"
    held = f"LEFT JOIN (SELECT bundle_id, list(path ORDER BY ord, path) FILTER (contains(lower(why), 'size')) AS oversize, list(path ORDER BY ord, path) FILTER (contains(lower(why), 'extract')) AS unextractable, list(path ORDER BY ord, path) FILTER (contains(lower(why), 'binary')) AS bin FROM {_DECIDED} WHERE NOT included GROUP BY 1) x ON x.bundle_id = m.bundle_id" if lacking else ""
    return f"""
    WITH {_NODES}, t AS ({_TREES}), k AS (SELECT *, {_LANG} AS own FROM _files),
    m AS (SELECT bundle_id, count(*) AS n, CAST(sum(length(coalesce(content, ''))) AS BIGINT) AS chars, string_agg({block}, {sep} ORDER BY ord NULLS FIRST, file_id) AS blocks, coalesce(list(path ORDER BY ord NULLS FIRST, file_id) FILTER (recognised), []) AS guessed
      FROM (SELECT *, coalesce(lang_tag, own) AS lang FROM k) GROUP BY bundle_id)
    SELECT m.bundle_id, kind, n AS n_files, chars AS n_chars, md5({text}) AS digest
    FROM m JOIN t ON t.bundle_id = m.bundle_id JOIN ({SQL['r13_bundle_kind']}) q ON q.bundle_id = m.bundle_id LEFT JOIN bundles b ON b.bundle_id = m.bundle_id {held}
    """


def _digested(df):
    return df.select("bundle_id", "kind", "n_files", "n_chars", F.md5(F.col("bundle").cast("binary")).alias("digest"))


for _n in ("b3_xml", "b4_markdown", "b5_plain", "n4_parts", "j9_unseen", "g20_histogram", "seldom_taken", "c20_urls", "t6_abandoned", "e5_html", "l5_threads", "e17_placeholders"):
    QUERIES.pop(_n, None)
    SQL.pop(_n, None)


def _with_projects(spark, d):
    return _files(spark, d).join(table(spark, d, "bundles").select("bundle_id", "project_name", "source"), "bundle_id", "left")


@query(_bundle_sql("xml", "coalesce(b.project_name, 'project')", "b.source", False))
def b3_xml(spark, d):
    """Whole bundles with their drawing, by digest."""
    return _digested(bundles.assembled(_with_projects(spark, d), "xml", project="project_name", source="source"))


@query(_bundle_sql("markdown", "'project'", "NULL", False))
def b4_markdown(spark, d):
    """B4."""
    return _digested(bundles.assembled(_files(spark, d), "markdown"))


@query(_bundle_sql("plain", "coalesce(b.project_name, 'project')", "b.source", True))
def b5_plain(spark, d):
    """With the lists of what is missing."""
    lacking = ingest.exclusion_summary(_decided(spark, d))
    return _digested(bundles.assembled(_with_projects(spark, d), "plain", project="project_name", source="source", excluded=lacking))


_PART = 20_000
_PACKED = f"""
WITH RECURSIVE i AS (SELECT bundle_id, file_id, coalesce(size_bytes, 0) AS s, row_number() OVER (PARTITION BY bundle_id ORDER BY ord NULLS FIRST, file_id) AS rn FROM output_files),
r AS (
  SELECT bundle_id, file_id, rn, s, CAST(1 AS BIGINT) AS part, CASE WHEN s > {_PART} THEN CAST(ceil(s / {_PART}) AS BIGINT) ELSE 1 END AS last, CASE WHEN s > {_PART} THEN 0 ELSE s END AS used, s <= {_PART} AS is_open FROM i WHERE rn = 1
  UNION ALL
  SELECT i.bundle_id, i.file_id, i.rn, i.s, CASE WHEN i.s > {_PART} OR NOT r.is_open OR r.used + i.s > {_PART} THEN r.last + 1 ELSE r.last END,
    CASE WHEN i.s > {_PART} THEN r.last + CAST(ceil(i.s / {_PART}) AS BIGINT) WHEN NOT r.is_open OR r.used + i.s > {_PART} THEN r.last + 1 ELSE r.last END,
    CASE WHEN i.s > {_PART} THEN 0 WHEN NOT r.is_open OR r.used + i.s > {_PART} THEN i.s ELSE r.used + i.s END, i.s <= {_PART}
  FROM r JOIN i ON i.bundle_id = r.bundle_id AND i.rn = r.rn + 1
)
SELECT bundle_id, file_id, CAST(part AS INTEGER) AS part, CAST(last - part + 1 AS INTEGER) AS pieces, CAST(max(last) OVER (PARTITION BY bundle_id) AS INTEGER) AS n_parts FROM r
"""


@query(_PACKED)
def n4_parts(spark, d):
    """Greedy parts, and files above the size of a part in pieces of their own."""
    return bundles.parts(_files(spark, d).drop("content"), _PART).select("bundle_id", "file_id", "part", "pieces", "n_parts")


_CAUSE = "CASE WHEN content IS NULL THEN 'readError' WHEN size_bytes > 8000 THEN 'oversize' WHEN lower(path) LIKE '%.docx' THEN 'parseFailed' END"
_ACCOUNTS = f"""
SELECT bundle_id, count(*) FILTER (c IS NULL) AS files, count(*) FILTER (c IS NULL AND lower(path) LIKE '%.pdf') AS parsed, count(*) FILTER (c IS NOT NULL) AS skipped, count(*) FILTER (c = 'oversize') AS oversize,
  count(*) FILTER (c = 'binary') AS binary, count(*) FILTER (c = 'readError') AS readError, count(*) FILTER (c = 'parseFailed') AS parseFailed, CAST(coalesce(sum(size_bytes) FILTER (c IS NULL), 0) AS BIGINT) AS totalBytes
FROM (SELECT *, {_CAUSE} AS c FROM output_files) GROUP BY bundle_id
"""


def _accounts(spark, d):
    low = F.lower("path")
    cause = F.when(F.col("content").isNull(), "readError").when(F.col("size_bytes") > 8000, "oversize").when(low.endswith(".docx"), "parseFailed")
    return bundles.accounting(_files(spark, d).withColumn("skipped", cause).withColumn("parsed", low.endswith(".pdf")))


@query(_ACCOUNTS)
def b7_accounts(spark, d):
    """B7."""
    return _accounts(spark, d)


@query(f"""
SELECT bundle_id, '{{"files":' || files || ',"parsed":' || parsed || ',"skipped":' || skipped || ',"skippedBreakdown":{{"oversize":' || oversize || ',"binary":' || "binary" || ',"readError":' || readError || ',"parseFailed":' || parseFailed
  || '}},"totalBytes":' || totalBytes || ',"outputPath":"stdout","elapsedSeconds":0.25,"style":"xml"}}' AS value FROM ({_ACCOUNTS})
""")
def k3_summaries(spark, d):
    """K3."""
    return bundles.run_summary(_accounts(spark, d), "xml", seconds=0.25)


@query("SELECT bundle_id, CAST(coalesce(sum(ceil(length(content) / 4)), 0) AS BIGINT) AS tokens, count(content) AS ready, count(*) - count(content) AS failed FROM output_files GROUP BY bundle_id")
def g22_tray(spark, d):
    """G22, C2."""
    return bundles.tray(_files(spark, d))


# -- paths ---------------------------------------------------------------------------------------

_ENDINGS = ", ".join(f"'{e}'" for e in paths.binary_endings())


@query(f"SELECT file_id, lower(regexp_extract(string_split(path, '/')[-1], '^.+\\.([^.]*)$', 1)) IN ({_ENDINGS}) AS denied FROM output_files")
def denied_endings(spark, d):
    """P12."""
    return _files(spark, d).select("file_id", paths.binary_by_name(F.col("path")).alias("denied"))


@query("""
SELECT file_id, CASE WHEN e IN ('pdf', 'docx', 'pptx', 'odt', 'odp', 'rtf') THEN 'document' WHEN e IN ('png', 'jpeg', 'gif', 'tiff', 'webp') THEN 'image' END AS offered
FROM (SELECT file_id, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS e FROM output_files)
""".replace("\\\\", "\\"))
def offered_formats(spark, d):
    """P21."""
    return _files(spark, d).select("file_id", paths.may_be_read(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("offered"))


@query(r"""
WITH s AS (SELECT bundle_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM output_files),
x AS (SELECT bundle_id, s, unnest(range(1, len(s) + 1)) AS k FROM s),
n AS (SELECT bundle_id, array_to_string(s[1:k - 1], '/') AS parent, s[k] AS name, bool_or(k < len(s)) AS directory FROM x GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY bundle_id, parent ORDER BY directory DESC, name) AS INTEGER) AS place FROM n
""")
def o4_children(spark, d):
    """O4."""
    return paths.listed_children(_files(spark, d), "bundle_id")


# -- what a drop came to -------------------------------------------------------------------------


@query(r"""
SELECT bundle_id, CASE WHEN scanned > 0 THEN 'scanned' WHEN filtered > 0 THEN 'filtered' WHEN archive > 0 THEN 'archive' WHEN image > 0 AND image >= n / 2 THEN 'image' ELSE 'other' END AS kind
FROM (SELECT bundle_id, count(*) AS n, count(*) FILTER (why = 'No extractable text') AS scanned, count(*) FILTER (why NOT IN ('Binary file', 'No extractable text', 'Couldn''t extract text', 'Password protected')) AS filtered,
  count(*) FILTER (regexp_matches(path, '(?i)\.(7z|rar|zip|tar\.gz|tgz|tar|gz|bz2|xz)$')) AS archive, count(*) FILTER (regexp_matches(path, '(?i)\.(png|jpe?g|gif|webp|svg|bmp|ico|avif|heic|heif|tiff?)$')) AS image
  FROM (SELECT bundle_id, path, CASE WHEN bundle_id % 3 = 0 THEN 'Binary file' WHEN bundle_id % 3 = 1 AND path LIKE '%.pdf' THEN 'No extractable text' WHEN bundle_id % 3 = 1 THEN 'Binary file' ELSE 'Matched ignore patterns' END AS why FROM output_files) GROUP BY 1)
""")
def r20_kinds(spark, d):
    """R20, over bundles of which nothing was kept."""
    b = F.col("bundle_id") % 3
    why = F.when(b == 0, "Binary file").when((b == 1) & F.col("path").endswith(".pdf"), "No extractable text").when(b == 1, "Binary file").otherwise("Matched ignore patterns")
    return ingest.empty_kind(_files(spark, d).select("bundle_id", "path", F.lit(False).alias("included"), why.alias("why")))


@query(f"""
SELECT file_id, CASE why WHEN 'Outside include patterns' THEN 'include' WHEN 'Matched ignore patterns' THEN 'ignore' WHEN 'Matched .gitignore' THEN 'gitignore' WHEN 'Excluded manually' THEN 'manual' WHEN 'Hidden file' THEN 'hidden'
  WHEN 'Binary file' THEN 'binary' WHEN 'No extractable text' THEN 'no-text' WHEN 'Couldn''t extract text' THEN 'extract-error' WHEN 'Password protected' THEN 'encrypted' ELSE 'other' END AS slug FROM {_DECIDED} WHERE NOT included
""")
def r21_slugs(spark, d):
    """R21."""
    return _decided(spark, d).where("NOT included").select("file_id", ingest.reason_slug(F.col("why")).alias("slug"))


@query(r"""
SELECT email_id, 'rejection/' || CASE WHEN regexp_matches(m, '(?i)dynamically imported module|importing a module script|loading chunk') THEN 'chunk' WHEN m = 'Script error.' THEN 'foreign'
  WHEN lower(n) IN ('error', 'typeerror', 'rangeerror', 'referenceerror', 'syntaxerror', 'urierror', 'evalerror', 'aggregateerror', 'quotaexceedederror', 'notallowederror', 'aborterror', 'securityerror', 'networkerror', 'notsupportederror', 'datacloneerror') THEN lower(n) ELSE 'other' END AS label
FROM (SELECT email_id, CASE email_id % 5 WHEN 0 THEN 'Loading chunk 7 failed: ' || coalesce(subject, '') WHEN 1 THEN 'Script error.' ELSE coalesce(subject, '') END AS m, ['TypeError', 'URIError', 'NotFoundError', 'AggregateError', NULL, 'Error', 'Mine'][email_id % 7 + 1] AS n FROM emails)
""")
def r22_errors(spark, d):
    """R22."""
    i, s = F.col("email_id"), F.coalesce("subject", F.lit(""))
    message = F.when(i % 5 == 0, F.concat(F.lit("Loading chunk 7 failed: "), s)).when(i % 5 == 1, "Script error.").otherwise(s)
    names = F.array(*(F.lit(x) for x in ("TypeError", "URIError", "NotFoundError", "AggregateError", None, "Error", "Mine")))
    return table(spark, d, "emails").select("email_id", S.error_label(F.lit("rejection"), message, F.get(names, (i % 7).cast("int"))).alias("label"))


_VALIDATED = "(SELECT file_id, path, size_bytes % 3 = 0 AS ambiguous, lower(path) LIKE '%.pdf' AS extracted, size_bytes % 5 = 0 AS cut FROM output_files)"


def _validated(spark, d):
    s = F.col("size_bytes")
    notes = F.when(s % 5 == 0, F.array(F.lit("charts-skipped"), F.lit("pages-skipped"))).otherwise(F.array().cast("array<string>"))
    return _files(spark, d).select("file_id", "path", F.when(s % 3 == 0, "ambiguous").otherwise("text").alias("classification"), F.lower("path").endswith(".pdf").alias("extracted"), notes.alias("notes"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS list, v.file_id FROM {_VALIDATED} v WHERE {c} AND v.file_id IN (SELECT file_id FROM {_DECIDED} WHERE included)" for n, c in (("flagged", "ambiguous"), ("extracted", "extracted"), ("partial", "cut"))))
def j6_lists(spark, d):
    """J6."""
    v, x = _validated(spark, d), _decided(spark, d)
    parts = [f(v, x, ["file_id"]).select(F.lit(f.__name__).alias("list"), "file_id") for f in (ingest.flagged, ingest.extracted, ingest.partial)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""
SELECT file_id, CASE WHEN regexp_matches(path, '(?i)\\.(7z|rar)$') THEN 'This kind of archive can''t be opened' WHEN reason <> '' THEN reason ELSE 'Not text' END AS why FROM {_DECIDED}
WHERE NOT included AND reason IS DISTINCT FROM 'Hidden file' AND lower(path) NOT LIKE '%.pdf'
UNION ALL SELECT file_id, 'gone' FROM output_files WHERE size_bytes % 97 = 0
""".replace("\\\\", "\\"))
def j8_not_text(spark, d):
    """J8."""
    x, f = _decided(spark, d), _files(spark, d)
    unread = f.where(F.lower("path").endswith(".pdf")).select("file_id")
    return ingest.not_text(x, unread, f.where("size_bytes % 97 = 0").select("file_id", F.lit("gone").alias("error")), ["file_id"])


# -- models and prices ---------------------------------------------------------------------------


def _models(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("uid"), F.col("p_name").alias("name"), F.col("p_brand").alias("provider"), (F.col("p_size") * 31_250).cast("long").alias("context_limit"), F.when(F.col("p_size") % 7 == 0, 0.0).otherwise(F.col("p_size") / 64.0).alias("input_cost"), F.when(F.col("p_size") % 14 == 0, 0.0).otherwise(F.col("p_size") / 16.0).alias("output_cost"))


_MODELS = "(SELECT p_partkey AS uid, p_name AS name, p_brand AS provider, CAST(p_size * 31250 AS BIGINT) AS context_limit, CASE WHEN p_size % 7 = 0 THEN 0.0::DOUBLE ELSE p_size / 64.0::DOUBLE END AS input_cost, CASE WHEN p_size % 14 = 0 THEN 0.0::DOUBLE ELSE p_size / 16.0::DOUBLE END AS output_cost FROM part)"
_COST = lambda c: f"CASE WHEN {c} = 0 THEN '$0.00' WHEN {c} < 0.001 THEN '$' || printf('%.6f', round({c}, 6)) WHEN {c} < 0.01 THEN '$' || printf('%.4f', round({c}, 4)) WHEN {c} < 1 THEN '$' || printf('%.3f', round({c}, 3)) ELSE '$' || printf('%.2f', round({c}, 2)) END"
_COSTED = f"(SELECT *, 0.0032::DOUBLE * input_cost AS inputCost, 0.00032::DOUBLE * output_cost AS outputCost, 0.0032::DOUBLE * input_cost + 0.00032::DOUBLE * output_cost AS totalCost FROM {_MODELS})"


@query(f"SELECT uid, {_COST('totalCost')} AS shown FROM {_COSTED}")
def c5_costs(spark, d):
    """C4, C5."""
    return catalog.cost_table(_models(spark, d), 3200).select("uid", S.format_cost(F.col("totalCost")).alias("shown"))


@query(f"""SELECT provider AS "Provider", name AS "Model", context_limit AS "Context Limit", {_COST('inputCost')} AS "Input Cost", {_COST('outputCost')} AS "Output Cost", {_COST('totalCost')} AS "Total Cost" FROM {_COSTED}""")
def k5_cost_lines(spark, d):
    """K5."""
    return catalog.cost_lines(catalog.cost_table(_models(spark, d), 3200))


@query(f"""
SELECT uid, CASE WHEN context_limit >= 1000000 THEN printf('%.1f', round(context_limit / 1e6, 1)) || 'M' WHEN context_limit >= 1000 THEN printf('%.0f', round(context_limit / 1000.0, 0)) || 'K' ELSE CAST(context_limit AS VARCHAR) END AS room,
  CASE WHEN input_cost = 0 AND output_cost = 0 THEN 'Pricing N/A' WHEN input_cost = 0 THEN 'Free' WHEN input_cost < 0.01 THEN '$' || printf('%.4f', round(input_cost, 4)) ELSE '$' || printf('%.2f', round(input_cost, 2)) END AS price FROM {_MODELS}
""")
def c8_labels(spark, d):
    """C8."""
    return _models(spark, d).select("uid", S.format_limit(F.col("context_limit")).alias("room"), S.format_price(F.col("input_cost"), F.col("output_cost")).alias("price"))


@query(f"SELECT uid, totalCost FROM {_COSTED} ORDER BY totalCost, name, uid LIMIT 25")
def o3_cheapest(spark, d):
    """O3: the 25 cheapest of the table."""
    return catalog.by_cost(catalog.cost_table(_models(spark, d), 3200).withColumn("name", F.concat("name", F.lit("\t"), F.lpad(F.col("uid").cast("string"), 12, "0"))), "totalCost").limit(25).select("uid", "totalCost")


@query(f"SELECT provider, uid FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY CASE WHEN contains(lower(name), 'blue') THEN 0 ELSE 1 END, uid) AS k FROM {_MODELS}) WHERE k = 1")
def c26_picks(spark, d):
    """The pick of each provider."""
    return catalog.default_pick(_models(spark, d), "uid", ["provider"], "blue").select("provider", "uid")


@query(f"SELECT uid, input_cost > 0 OR output_cost > 0 AS priced, uid % 2 = 0 AND uid % 3 <> 0 AS texts FROM {_MODELS}")
def text_models(spark, d):
    """P19."""
    i = F.col("uid")
    reads, writes = F.when(i % 2 == 0, F.array(F.lit("image"), F.lit("text"))).otherwise(F.array(F.lit("image"))), F.when(i % 3 != 0, F.array(F.lit("text"))).otherwise(F.lit(None).cast("array<string>"))
    return _models(spark, d).select("uid", catalog.priced(F.col("input_cost"), F.col("output_cost")).alias("priced"), catalog.text_to_text(reads, writes).alias("texts"))


_SCORE = lambda t: f"(CASE WHEN contains({t}, 'polished') THEN 0 WHEN list_min(list_transform(string_split_regex({t}, '[-.]'), lambda w: levenshtein(w, 'polished'))) <= greatest(2, floor(8 * 0.4)) THEN CAST(list_min(list_transform(string_split_regex({t}, '[-.]'), lambda w: levenshtein(w, 'polished'))) + 2 AS INTEGER) END)"


@query(f"SELECT p_partkey, coalesce({_SCORE(_CANON.format('p_name'))}, {_SCORE(_CANON.format('p_type'))}, {_SCORE(_CANON.format('p_brand'))}) AS score FROM part")
def c9_fields(spark, d):
    """The first of three fields that has a score."""
    return table(spark, d, "part").select("p_partkey", S.best_score(F.lit("Polished"), F.col("p_name"), F.col("p_type"), F.col("p_brand")).alias("score"))


# -- addresses, clips and runs -------------------------------------------------------------------

_ADDRESSES = "(SELECT doc_id, unnest(regexp_extract_all(text, 'https?://[^\\s<>)\\]\"'']+')) AS url FROM documents WHERE text IS NOT NULL)"
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1))"


@query(f"SELECT doc_id, url, {_HOST} AS host, NOT ({' OR '.join(f'contains({_HOST}, {chr(39)}{h}{chr(39)})' for h in S.RAW_HOSTS)}) AS may_refuse, count(*) AS n FROM {_ADDRESSES} GROUP BY ALL")
def c20_urls(spark, d):
    """Every address in a document."""
    urls = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"https?://[^\s<>)\]\"']+"), F.lit(0))).alias("url"))
    u = F.col("url")
    return urls.select("doc_id", "url", S.host(u).alias("host"), S.may_refuse_other_sites(u).alias("may_refuse")).groupBy("doc_id", "url", "host", "may_refuse").agg(F.count(F.lit(1)).alias("n"))


_FLAT = "html"
for _p, _r in ((r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>", ""), (S.HTML_BREAKS, "' || chr(10) || '"), (r"<[^>]+>", "")):
    _FLAT = f"regexp_replace({_FLAT}, '{_p}', '{_r}', 'g')"
_CODED = f"(SELECT email_id, string_split_regex(f, '&#\\d+;') AS p, list_transform(regexp_extract_all(f, '&#(\\d+);', 1), lambda x: CAST(x AS BIGINT)) AS c FROM (SELECT email_id, {_FLAT} AS f FROM emails_html))"
_NAMED = "array_to_string(list_transform(p, lambda x, i: x || coalesce(CASE WHEN c[i] >= 1114112 OR c[i] BETWEEN 55296 AND 57343 THEN chr(65533) ELSE chr(CAST(c[i] AS INTEGER)) END, '')), '')"
for _p, _r in S.HTML_ENTITIES:
    _NAMED = f"regexp_replace({_NAMED}, '(?i){_p}', '{_Q(_r)}', 'g')"
for _p, _r in ((r"[ \t]+", " "), (r" ?\n ?", "' || chr(10) || '"), (r"\n{3,}", "' || chr(10) || chr(10) || '"), (r"^\s+|\s+$", "")):
    _NAMED = f"regexp_replace({_NAMED}, '{_p}', '{_r}', 'g')"
#: Bodies as they are, and once more with entities of every form in them.
_MORE = "html || '<p>&#8364;&#38;lt; &LT;b&GT; &AMP;amp; &#128512;&nbsp;&Nbsp;x &bogus; &#39;&QUOT;</p>'"


@query(f"WITH emails_html AS (SELECT email_id, html FROM emails WHERE html IS NOT NULL UNION ALL SELECT -email_id, {_Q(_MORE) if False else _MORE} FROM emails WHERE html IS NOT NULL) SELECT email_id, {_NAMED} AS plain FROM {_CODED}")
def e5_html(spark, d):
    """E5."""
    e = table(spark, d, "emails").where("html IS NOT NULL").select("email_id", "html")
    more = e.select((-F.col("email_id")).alias("email_id"), F.concat("html", F.lit("<p>&#8364;&#38;lt; &LT;b&GT; &AMP;amp; &#128512;&nbsp;&Nbsp;x &bogus; &#39;&QUOT;</p>")).alias("html"))
    return e.unionByName(more).select("email_id", S.html_text(F.col("html")).alias("plain"))


_YAML = lambda c: f"""'"' || regexp_replace(replace(replace({c}, '\\', '\\\\'), '"', '\\"'), '\\s*[\\r\\n]+\\s*', ' ', 'g') || '"'"""


@query(f"""
SELECT doc_id, md5('---' || chr(10) || 'title: ' || {_YAML("coalesce(path, '')")} || chr(10) || 'source: ' || {_YAML("'https://x.test/' || doc_id")} || chr(10) || 'author:' || chr(10) || '  - ' || {_YAML("'[[' || coalesce(nullif(source, ''), 'Site') || ']]'")} || chr(10)
  || 'published: ' || coalesce(strftime(captured_at, '%Y-%m-%d'), '') || chr(10) || 'created: 2026-01-02' || chr(10) || 'description: ' || {_YAML("substr(coalesce(text, ''), 1, 200)")} || chr(10) || 'tags:' || chr(10) || '  - "clippings"' || chr(10) || '---' || chr(10)
  || '![](https://x.test/' || doc_id || ')' || chr(10) || chr(10) || coalesce(text, '') || chr(10)) AS digest FROM documents
""")
def l3_articles(spark, d):
    """L3, C15."""
    t = table(spark, d, "documents")
    rows = t.select("doc_id", F.col("path").alias("title"), F.concat(F.lit("https://x.test/"), F.col("doc_id").cast("string")).alias("url"), F.col("source").alias("author"), F.lit("Site").alias("site_name"), F.date_format("captured_at", "yyyy-MM-dd").alias("published"), F.lit("2026-01-02").alias("clipped_on"), F.col("text").alias("excerpt"), F.col("text").alias("body"))
    return clips.article(rows, "doc_id").select("doc_id", F.md5(F.col("markdown").cast("binary")).alias("digest"))


@query("SELECT message_id AS id, max(received_at) AS ts FROM emails WHERE message_id IS NOT NULL GROUP BY 1")
def k9_seen(spark, d):
    """K9: what an earlier run saw, and what this one found."""
    e = table(spark, d, "emails").where("message_id IS NOT NULL").select(F.col("message_id").alias("id"), F.col("received_at").alias("ts"), "email_id")
    half = F.col("email_id") % 2 == 0
    seen = e.where(half).groupBy("id").agg(F.min("ts").alias("ts"))
    return clips.seen_after(seen, e)


@query("SELECT e.email_id FROM emails e WHERE e.message_id IS NOT NULL AND e.email_id IN (SELECT min(email_id) FROM emails WHERE message_id IS NOT NULL GROUP BY message_id) AND e.message_id NOT IN (SELECT in_reply_to FROM emails WHERE in_reply_to IS NOT NULL)")
def j9_unseen(spark, d):
    """Messages, once each, that nobody answered."""
    e = table(spark, d, "emails")
    answered = e.where("in_reply_to IS NOT NULL").select(F.col("in_reply_to").alias("message_id"))
    return clips.new_threads(e.where("message_id IS NOT NULL").select("message_id", "email_id"), answered, "message_id", "email_id").select("email_id")


@query("SELECT file_id, md5(substr(content, 1, 4000)) AS head, CASE WHEN len(b) <= 240 THEN len(b) ELSE 240 END AS n, md5(array_to_string(CASE WHEN len(b) <= 240 THEN b ELSE list_concat(b[1:200], b[-40:]) END, '|')) AS blocks FROM (SELECT *, string_split(content, chr(10)) AS b FROM output_files WHERE content IS NOT NULL)")
def o7_previews(spark, d):
    """O7."""
    b = clips.preview_blocks(F.split("content", "\n"))
    return _files(spark, d).where("content IS NOT NULL").select("file_id", F.md5(clips.preview(F.col("content")).cast("binary")).alias("head"), F.size(b).cast("long").alias("n"), F.md5(F.array_join(b, "|").cast("binary")).alias("blocks"))


@query("SELECT id, CASE WHEN page IS NOT NULL AND s > 0 THEN CAST(s AS BIGINT) END AS run_no FROM (SELECT id, page, sum(CASE WHEN name = 'batch_size' THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY ts NULLS FIRST, id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT DISTINCT id, ts, page, name FROM usage_events))")
def n8_runs(spark, d):
    """N8."""
    return reports.run_numbers(_events(spark, d).select("id", "ts", "page", "name").distinct()).select("id", "run_no")


@query("SELECT CASE WHEN starts_with(coalesce(value, '(none)'), 'error') THEN 'error' ELSE coalesce(value, '(none)') END AS value, count(*) AS n FROM usage_events WHERE name = 'js_error' GROUP BY 1")
def g20_histogram(spark, d):
    """G20."""
    return reports.coverage(_events(spark, d).where("name = 'js_error'"))


@query("SELECT value, count(*) AS impressions, count(*) FILTER (b IS NOT NULL) AS clicks FROM usage_events WHERE value IS NOT NULL GROUP BY value HAVING count(*) >= 15 AND count(*) FILTER (b IS NOT NULL) < 0.02 * count(*)")
def seldom_taken(spark, d):
    """Much seen, hardly taken."""
    return reports.seldom_taken(_events(spark, d), "value", F.col("b").isNotNull())


@query(" UNION ALL ".join(f"SELECT '{n}' AS section, {k} AS place, count(*) AS lines FROM ({SQL[q]})" for k, (n, q) in enumerate((("funnel", "q1_funnel"), ("sizes", "q4_sizes"), ("over", "q5_over"), ("formats", "q3_formats"), ("markers", "q6_markers"), ("extensions", "q7_extensions")), 1)))
def q9_overview(spark, d):
    """Q9: the lines of each section, in the order they are shown."""
    return reports.overview(_events(spark, d)).groupBy("section", "place").agg(F.count(F.lit(1)).alias("lines"))


@query("""
SELECT page, run FROM usage_events WHERE run IS NOT NULL AND page IS NOT NULL AND ts IS NOT NULL GROUP BY page, run
HAVING bool_or(name = 'bundle_size') AND NOT bool_or(name = 'output_taken') AND max(ts) - min(ts) < 1800
""")
def t6_abandoned(spark, d):
    """Bundled and not exported, over runs that are one session long."""
    from ..streaming import events as stream

    e = _events(spark, d).where("run IS NOT NULL AND page IS NOT NULL AND ts IS NOT NULL")
    short = e.groupBy("page", "run").agg((F.max("ts") - F.min("ts")).alias("span")).where("span < 1800").select("page", "run")
    return stream.abandoned(stream.stamped(e.join(short, ["page", "run"], "left_semi"))).select("page", "run")


# -- archives and bytes --------------------------------------------------------------------------


def _archived(spark, d, kind: str):
    """Each bundle's files as one archive, by the standard library."""
    @F.pandas_udf("binary")
    def packed(names: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for ns, ts in zip(names, texts):
            buf = io.BytesIO()
            if kind == "zip":
                with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("__MACOSX/junk", "x")
                    for n, t in zip(ns, ts):
                        z.writestr(f"./{n}", t)
                out.append(buf.getvalue())
            else:
                with tarfile.open(fileobj=buf, mode="w") as t_:
                    for n, t in zip(ns, ts):
                        info = tarfile.TarInfo(n)
                        info.size = len(t.encode())
                        t_.addfile(info, io.BytesIO(t.encode()))
                out.append(gzip.compress(buf.getvalue(), mtime=0) if kind == "tar.gz" else buf.getvalue())
        return pd.Series(out, dtype="object")

    f = _files(spark, d).where("content <> ''").select("bundle_id", F.concat(F.col("file_id").cast("string"), F.lit("/a.txt")).alias("n"), "content")
    per = f.groupBy("bundle_id").agg(F.collect_list(F.struct("n", "content")).alias("x"))
    return per.select("bundle_id", F.concat(F.lit("in/box"), F.col("bundle_id").cast("string"), F.lit("." + kind)).alias("path"), F.lit(kind).alias("archive"), packed(F.col("x.n"), F.col("x.content")).alias("content"))


def _expanded(spark, d, kind: str):
    from ..operators import archives

    return archives.expanded(_archived(spark, d, kind), "bundle_id").select(F.col("ord").alias("bundle_id"), "path", F.md5("content").alias("digest"), "depth")


_ENTRIES = "SELECT bundle_id, 'in/box' || bundle_id || '/' || file_id || '/a.txt' AS path, md5(content) AS digest, 1 AS depth FROM output_files WHERE content <> ''"


@query(_ENTRIES)
def a1_zip(spark, d):
    """A1, A3-A5."""
    return _expanded(spark, d, "zip")


@query(_ENTRIES)
def a2_tar(spark, d):
    """A2, A4, A5."""
    return _expanded(spark, d, "tar")


@query(_ENTRIES)
def a3_packed_tar(spark, d):
    """A3: an archive in a packed one."""
    return _expanded(spark, d, "tar.gz")


@query("SELECT file_id, n, md5(content) AS digest FROM output_files, (VALUES (0), (1), (2), (3)) t(n) WHERE content <> ''")
def r3_decoded(spark, d):
    """Texts in four encodings, read again."""
    from ..operators import classify

    c = F.col("content")
    forms = F.array(F.encode(c, "UTF-8"), F.concat(F.unhex(F.lit("EFBBBF")), F.encode(c, "UTF-8")), F.concat(F.unhex(F.lit("FFFE")), F.encode(c, "UTF-16LE")), F.concat(F.unhex(F.lit("FEFF")), F.encode(c, "UTF-16BE")))
    rows = _files(spark, d).where("content <> ''").select("file_id", F.posexplode(forms).alias("n", "bytes"))
    return rows.select("file_id", "n", F.md5(classify.decoded("bytes").cast("binary")).alias("digest"))


_HEADS = (("89504E470D0A1A0A", "png", "binary"), ("FFD8FFE0", "jpeg", "binary"), ("474946383961", "gif", "binary"), ("255044462D312E37", "pdf", "extract"), ("7B5C72746631", "rtf", "extract"), ("1F8B0800", "gz", "expand"), ("377ABCAF271C", "7z", "expand"), ("526172211A0700", "rar", "expand"))


@query("SELECT file_id, kind, format, archive FROM (SELECT file_id, ['binary', 'binary', 'binary', 'extract', 'extract', 'expand', 'expand', 'expand'][file_id % 8 + 1] AS kind, CASE WHEN file_id % 8 < 5 THEN ['png', 'jpeg', 'gif', 'pdf', 'rtf'][file_id % 8 + 1] END AS format, CASE WHEN file_id % 8 >= 5 THEN ['gz', '7z', 'rar'][file_id % 8 - 4] END AS archive FROM output_files)")
def r7_routes(spark, d):
    """Heads of files by their signature."""
    from ..operators import classify

    magic = F.array(*(F.unhex(F.lit(h)) for h, _, _ in _HEADS))
    f = _files(spark, d).select("file_id", F.concat(F.get(magic, (F.col("file_id") % 8).cast("int")), F.encode(F.coalesce("content", F.lit("")), "UTF-8")).alias("head"))
    return classify.routed(f).select("file_id", "route.kind", "route.format", "route.archive")


@query("SELECT file_id, '```py' || chr(10) || rtrim(content, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) || chr(10) || '```' AS text FROM output_files WHERE content IS NOT NULL AND path LIKE '%.py' AND trim(content, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def e2_notebooks(spark, d):
    """Files as notebooks of one cell."""
    from ..operators import extract

    cell = F.struct(F.lit("code").alias("cell_type"), F.col("content").alias("source"))
    nb = F.to_json(F.struct(F.array(cell).alias("cells"), F.struct(F.struct(F.lit("py").alias("name")).alias("language_info")).alias("metadata"), F.lit(4).alias("nbformat")))
    rows = _files(spark, d).where(F.col("content").isNotNull() & F.col("path").endswith(".py") & (F.trim(F.regexp_replace("content", r"\s", " ")) != "")).select("file_id", F.encode(nb, "UTF-8").alias("content"), F.lit("notebook").alias("parser_id"))
    return extract.extracted(rows).select("file_id", F.col("extraction.text").alias("text"))


@query(r"""
SELECT email_id, array_to_string(list_transform(list_filter(string_split_regex(coalesce(text, ''), '[.!?]\s+|\n'), lambda x: regexp_matches(x, '^[A-Za-z ,]{8,}$')), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), chr(10)) AS said FROM emails
WHERE len(list_filter(string_split_regex(coalesce(text, ''), '[.!?]\s+|\n'), lambda x: regexp_matches(x, '^[A-Za-z ,]{8,}$'))) > 0
""")
def e3_captions(spark, d):
    """Sentences as captions, with their scaffolding taken off again; each has a voice of its own, as the operator tells a line that repeats the one before once."""
    from ..operators import extract

    # the white space of SQL's pattern, which has no vertical tab
    said = F.filter(F.split(F.coalesce("text", F.lit("")), r"[.!?][ \t\n\f\r]+|\n"), lambda x: x.rlike(r"^[A-Za-z ,]{8,}\z"))
    cues = F.transform(said, lambda x, i: F.concat((i + 1).cast("string"), F.lit("\r\n00:00:01,000 --> 00:00:02,000\r\n<v "), i.cast("string"), F.lit("><i>"), x, F.lit("</i></v>")))
    rows = table(spark, d, "emails").where(F.size(said) > 0).select("email_id", F.encode(F.array_join(cues, "\r\n\r\n"), "UTF-8").alias("content"), F.lit("subtitles").alias("parser_id"))
    return extract.extracted(rows).select("email_id", F.regexp_replace("extraction.text", r"(?m)^\d+: ?", "").alias("said"))


@query("""
WITH RECURSIVE f AS (SELECT message_id, min(email_id) AS id, min(in_reply_to) AS irt FROM emails WHERE message_id IS NOT NULL GROUP BY 1),
n AS (SELECT f.id, p.id AS parent_id FROM f LEFT JOIN f p ON f.irt = p.message_id),
r AS (SELECT id, 0 AS depth, lpad(CAST(id AS VARCHAR), 10, '0') AS place FROM n WHERE parent_id IS NULL UNION ALL SELECT n.id, r.depth + 1, r.place || '/' || lpad(CAST(n.id AS VARCHAR), 10, '0') FROM n JOIN r ON n.parent_id = r.id)
SELECT * FROM r
""")
def l5_threads(spark, d):
    """Replies under the messages they answer, in pre-order."""
    e = table(spark, d, "emails").select("email_id", "message_id", "in_reply_to").where("message_id IS NOT NULL")
    first = e.groupBy("message_id").agg(F.min("email_id").alias("id"), F.min("in_reply_to").alias("in_reply_to"))
    ids = first.select(F.col("message_id").alias("in_reply_to"), F.col("id").alias("parent_id"))
    nodes = first.join(ids, "in_reply_to", "left").select("id", "parent_id", F.col("id").alias("ord"))
    return clips.flattened(nodes).select("id", "depth", "place")


@query(r"""
WITH m AS (SELECT file_id, list('[Image: ' || name || ']' || chr(1) || coalesce(trim(ocr_text, ' '), '') ORDER BY image_id, name, ocr_text) AS reads FROM extracted_images WHERE name IS NOT NULL GROUP BY file_id)
SELECT f.file_id, md5(regexp_replace(CASE WHEN reads IS NULL THEN content ELSE list_reduce(list_concat([content], reads), lambda acc, x: replace(acc, string_split(x, chr(1))[1], string_split(x, chr(1))[2])) END, '\[Image: [^\]\n]*\]', '', 'g')) AS digest
FROM output_files f LEFT JOIN m ON m.file_id = f.file_id WHERE contains(content, '[Image: ')
""")
def e17_placeholders(spark, d):
    """Documents with their images' text in place."""
    from ..operators import extract

    found = extract.filled_placeholders(_files(spark, d).where(F.col("content").contains("[Image: ")), table(spark, d, "extracted_images"))
    return found.select("file_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"SELECT file_id, CASE WHEN why = 'Binary file' THEN false WHEN file_id % 4 = 0 THEN file_id % 8 = 0 ELSE included END AS included FROM {_DECIDED}")
def overridden(spark, d):
    """The last word a path was given wins, but never over a binary file."""
    x = _decided(spark, d).select("file_id", F.concat(F.col("file_id").cast("string"), F.lit("/"), "path").alias("path"), "reason", "why", "included")
    said = x.where("file_id % 4 = 0").select("path", F.posexplode(F.array(F.lit(True), F.col("file_id") % 8 == 0)).alias("ord", "include"))
    return ingest.decisions(x.select("file_id", "path", F.col("why").alias("reason")), overrides=said).select("file_id", "included")


@query("SELECT DISTINCT page, value FROM usage_events WHERE name = 'entry_surface' AND page IS NOT NULL")
def t5_once(spark, d):
    """T4, T5: each surface of a visit once, over what has arrived."""
    from ..streaming import events as stream

    return stream.once_per(_events(spark, d).where("name = 'entry_surface' AND page IS NOT NULL").select("page", "value"), ["page", "value"])
