"""Ticket and report queries (T1-T8, A1-A16) over the workspace view."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.fixed import ENUMS, REPORT_SCHEMA
from quarry.functions.text import day_span, iso_timestamp
from quarry.operators import aggregate as A
from quarry.operators import dyadic, scan
from quarry.operators import tickets as TK
from quarry.plans import documents as D
from quarry.plans import oracle_sql as O
from quarry.plans import report as R
from quarry.plans import runner
from quarry.plans.fixture_tickets import (EPOCH, NOW, conversation_tickets, conversation_tickets_sql,
                                          span_hours, tickets_df, tickets_sql)
from quarry.plans.queries_profile import generated_files
from quarry.plans.registry import register
from quarry.session import stage_path
from quarry.sources.tables import FIXTURE_ROOT, fixture_files


def _run(spark, sf_dir, profile=True):
    """Files are parsed once: the profiles are written and read by all branches."""
    inventory = scan.inventory(fixture_files(spark, sf_dir), FIXTURE_ROOT)
    return R.prepare(inventory, tickets_df(spark, sf_dir), profile=profile)


def _with(*ctes: str) -> str:
    return O.with_inventory(tickets_sql(), O.TICKET_FILES_SQL, *ctes)


def _per_task(run):
    """Valid tickets joined to their scope's stats and lists."""
    return run.tickets.filter("valid").join(R.per_scope(run), "scope_id", "left")


# --------------------------------------------------------------------- T1-T3
# Operators on tickets alone run over one ticket per conversation.

def _with_conversations(*ctes: str) -> str:
    return "WITH " + ",\n".join([conversation_tickets_sql(), O.VALIDATED_SQL.strip(), *ctes]) + "\n"


@register("ticket_validation", _with_conversations() + """
SELECT task_id, workspace_path, valid, error FROM vtk""")
def ticket_validation(spark, sf_dir):
    """Required fields and the date rule."""
    return TK.validate(conversation_tickets(spark, sf_dir)).select(
        "task_id", "workspace_path", "valid", "error")


@register("context_defaults", _with_conversations() + f"""
SELECT task_id,
  coalesce(requester, 'Unknown') AS requester_name,
  coalesce(requester_email, 'unknown@example.com') AS requester_email,
  coalesce(requester_role, 'User') AS requester_role,
  coalesce(timezone, 'UTC') AS timezone,
  coalesce(original_question, '') AS original_question,
  coalesce(channel, 'API') AS channel, coalesce(thread_id, '') AS thread_id,
  coalesce(urgency, 'Normal') AS urgency, coalesce(requested_at, '{NOW}') AS requested_at,
  coalesce(requested_format, 'summary') AS requested_format,
  CASE WHEN coalesce(scan_all, FALSE) THEN 'all_files' ELSE 'date_range' END AS time_range,
  {O.iso('start_date')} AS start_date, {O.iso('end_date')} AS end_date,
  workspace_path AS workspace,
  CASE WHEN coalesce(scan_all, FALSE) THEN 'all' ELSE 'date_range' END AS filter_type,
  CAST(floor((epoch_us(end_date) - epoch_us(start_date)) / 86400000000) AS BIGINT) AS span_days
FROM tickets""")
def context_defaults(spark, sf_dir):
    """Request context with defaults, flattened."""
    requester, request, scope = TK.context_struct(NOW)
    t = conversation_tickets(spark, sf_dir).select("task_id", requester.alias("rq"), request.alias("r"),
                                 scope.alias("s"),
                                 day_span("start_date", "end_date").alias("span_days"))
    return t.select(
        "task_id", F.col("rq.name").alias("requester_name"),
        F.col("rq.email").alias("requester_email"), F.col("rq.role").alias("requester_role"),
        F.col("rq.timezone").alias("timezone"), "r.original_question", "r.channel", "r.thread_id",
        "r.urgency", "r.requested_at", "r.requested_format", "s.time_range", "s.start_date",
        "s.end_date", "s.workspace", "s.filter_type", "span_days")


@register("ticket_files", _with() + f"""
SELECT task_id, path, file_type, size, {O.iso('modified')} AS modified FROM tf""")
def ticket_files(spark, sf_dir):
    """Every (ticket, file) pair."""
    inventory = scan.inventory(fixture_files(spark, sf_dir), FIXTURE_ROOT)
    validated = TK.with_scope(TK.validate(tickets_df(spark, sf_dir)))
    pairs = TK.files_in_scopes(inventory, TK.scopes(validated))
    return (validated.filter("valid").select("task_id", "scope_id")
            .join(pairs, "scope_id")
            .select("task_id", "path", "file_type", "size",
                    iso_timestamp("modified").alias("modified")))


# ------------------------------------------------------------------ A1-A12

@register("statistics", _with() + """
SELECT t.task_id, count(tf.path) AS files_scanned, count(tf.path) AS files_matched,
  count(tf.path) AS files_processed, CAST(0 AS BIGINT) AS files_failed,
  CAST(coalesce(sum(tf.size), 0) AS BIGINT) AS total_size_bytes,
  round_even(coalesce(sum(tf.size), 0) / 1048576.0, 3) AS total_size_mb
FROM vtk t LEFT JOIN tf ON t.task_id = tf.task_id WHERE t.valid GROUP BY t.task_id""")
def statistics(spark, sf_dir):
    """A1 per valid ticket."""
    c = R.report_columns(NOW)
    return _per_task(_run(spark, sf_dir, profile=False)).select(
        "task_id", c["files_processed"].alias("files_scanned"),
        c["files_processed"].alias("files_matched"), c["files_processed"].alias("files_processed"),
        F.lit(0).cast("bigint").alias("files_failed"), c["total_size_bytes"].alias("total_size_bytes"),
        c["total_size_mb"].alias("total_size_mb"))


@register("breakdown_per_task", _with() + """
SELECT task_id, file_type, count(*) AS files FROM tf GROUP BY task_id, file_type""")
def breakdown_per_task(spark, sf_dir):
    """A2: file count per type per ticket (types present only)."""
    t = _per_task(_run(spark, sf_dir, profile=False))
    stack = F.explode(F.array(*[F.struct(F.lit(k).alias("file_type"),
                                         F.col(f"n_{k}").alias("files")) for k in A.TYPES]))
    return (t.select("task_id", stack.alias("b")).select("task_id", "b.file_type", "b.files")
            .filter("files > 0"))


@register("breakdown_note", _with() + f"""
SELECT task_id, string_agg(DISTINCT ltrim(suffix, '.'), ',' ORDER BY ltrim(suffix, '.')) AS formats,
  CAST(sum({O.words('content_n')}) AS BIGINT) AS total_words
FROM (SELECT *, regexp_replace(content, '\\r\\n?', chr(10), 'g') AS content_n FROM tf)
WHERE file_type = 'note' GROUP BY task_id""")
def breakdown_note(spark, sf_dir):
    """Note formats and total words per ticket."""
    return (_per_task(_run(spark, sf_dir)).filter("n_note > 0")
            .select("task_id", F.array_join("note_formats", ",").alias("formats"),
                    F.col("note_total_words").alias("total_words")))


@register("breakdown_code", None)
def breakdown_code(spark, sf_dir):
    """A3: languages, lines, functions, classes (Python parse: rows-only)."""
    return (_per_task(_run(spark, sf_dir)).filter("n_code > 0")
            .select("task_id", F.col("n_code").alias("files"),
                    F.when(F.col("code_python"), "python").otherwise("").alias("languages"),
                    F.col("code_total_lines").alias("total_lines"),
                    F.col("code_functions").alias("functions"),
                    F.col("code_classes").alias("classes")))


@register("breakdown_data", None)
def breakdown_data(spark, sf_dir):
    """A4: formats, rows, max columns (pandas CSV parse: rows-only)."""
    return (_per_task(_run(spark, sf_dir)).filter("n_data > 0")
            .select("task_id", F.array_join("data_formats", ",").alias("formats"),
                    F.col("data_total_rows").alias("total_rows"),
                    F.col("data_total_columns").alias("total_columns")))


@register("breakdown_notebook", None)
def breakdown_notebook(spark, sf_dir):
    """A5: notebook cell counts (notebook JSON parse: rows-only)."""
    return (_per_task(_run(spark, sf_dir)).filter("n_notebook > 0")
            .select("task_id", F.col("notebook_total_cells").alias("total_cells"),
                    F.col("notebook_code_cells").alias("code_cells"),
                    F.col("notebook_markdown_cells").alias("markdown_cells")))


@register("activity_summary", _with() + """
SELECT t.task_id, CASE WHEN count(tf.path) = 0 THEN 'No activity found'
  WHEN count(*) FILTER (WHERE tf.file_type = 'code') > 0 THEN 'Active development with code changes'
  WHEN count(*) FILTER (WHERE tf.file_type = 'data') > 0 THEN 'Data collection and processing activity'
  WHEN count(*) FILTER (WHERE tf.file_type = 'note') > 0 THEN 'Documentation updates'
  ELSE 'General workspace activity' END AS activity_summary
FROM vtk t LEFT JOIN tf ON t.task_id = tf.task_id WHERE t.valid GROUP BY t.task_id""")
def activity_summary(spark, sf_dir):
    """A7."""
    return _per_task(_run(spark, sf_dir, profile=False)).select("task_id", A.activity_summary().alias("activity_summary"))


@register("summary_text", None)
def summary_text(spark, sf_dir):
    """A8 full text (code summaries come from the Python parse: rows-only)."""
    return _per_task(_run(spark, sf_dir)).select("task_id", A.summary_text().alias("summary"))


def _ranked(types: tuple, n: int) -> str:
    in_list = ", ".join(f"'{t}'" for t in types)
    return f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY path) AS rank
  FROM tf WHERE file_type IN ({in_list})),
top AS (SELECT * FROM ranked WHERE rank <= {n})"""


def _list_rows(run, kind):
    t = run.tickets.filter("valid").select("task_id", "scope_id")
    return t.join(A.first_n_rows(run.parsed, run.selection).filter(F.col("kind") == kind), "scope_id")


@register("highlights", _with(_ranked(("code", "data", "notebook", "note"), 10)) + """
SELECT task_id, rank, CASE file_type WHEN 'code' THEN 'New code added (' || name || ')'
  WHEN 'data' THEN 'Data file updated (' || name || ')'
  WHEN 'notebook' THEN 'Analysis notebook created (' || name || ')'
  ELSE 'Documentation updated (' || name || ')' END AS highlight FROM top""")
def highlights(spark, sf_dir):
    """First 10 highlights per ticket in path order."""
    rows = _list_rows(_run(spark, sf_dir, profile=False), "highlights")
    return rows.select("task_id", F.col("rank").cast("bigint").alias("rank"),
                       A._item("highlights").alias("highlight"))


@register("notable_changes", _with(_ranked(("code", "data"), 5)) + """
SELECT task_id, rank, file_type AS type, name AS file,
  CASE file_type WHEN 'code' THEN 'high' ELSE 'medium' END AS impact FROM top""")
def notable_changes(spark, sf_dir):
    """A10: first 5 code/data changes (description is the parse summary, not compared)."""
    rows = _list_rows(_run(spark, sf_dir, profile=False), "notable_changes")
    return rows.select("task_id", F.col("rank").cast("bigint").alias("rank"),
                       F.col("file_type").alias("type"), F.col("name").alias("file"),
                       F.when(F.col("file_type") == "code", "high").otherwise("medium")
                       .alias("impact"))


@register("recommendations", _with(_ranked(("code", "notebook"), 5)) + """
SELECT task_id, rank, CASE file_type WHEN 'code' THEN 'Review ' || name || ' implementation'
  ELSE 'Execute ' || name || ' to generate visualizations' END AS recommendation FROM top""")
def recommendations(spark, sf_dir):
    """A10: first 5 recommendations per ticket."""
    rows = _list_rows(_run(spark, sf_dir, profile=False), "recommendations")
    return rows.select("task_id", F.col("rank").cast("bigint").alias("rank"),
                       A._item("recommendations").alias("recommendation"))


@register("file_listing", _with(_ranked(("code", "data", "note", "notebook", "other"), 10)) + """
SELECT top.task_id, rank,
  name || ' (' || file_type || ', ' || printf('%.1f', round_even(size / 1024.0, 1)) || ' KB)' AS line,
  greatest(n.files - 10, 0) AS more_files
FROM top JOIN (SELECT task_id, count(*) AS files FROM tf GROUP BY task_id) n
  ON top.task_id = n.task_id""")
def file_listing(spark, sf_dir):
    """First 10 files (name, type, KB to 1 decimal) plus the remainder count."""
    run = _run(spark, sf_dir, profile=False)
    rows = _list_rows(run, "file_listing")
    counts = _per_task(run).select("task_id", F.greatest(F.col("files_processed") - 10, F.lit(0))
                                   .alias("more_files"))
    return rows.join(counts, "task_id").select(
        "task_id", F.col("rank").cast("bigint").alias("rank"),
        A._item("file_listing").alias("line"), "more_files")


LARGE_THRESHOLD = 16 * 1024  # exercised threshold; the report itself uses 10 MB


@register("large_file_warnings", _with() + f"""
SELECT task_id, path, name, 'info' AS level,
  'Found ' || count(*) OVER (PARTITION BY task_id) || ' large files (>16KB)' AS message
FROM tf WHERE size > {LARGE_THRESHOLD}""")
def large_file_warnings(spark, sf_dir):
    """A11 with a parameterised threshold: one row per affected file."""
    run = _run(spark, sf_dir, profile=False)
    t = run.tickets.filter("valid").select("task_id", "scope_id")
    big = run.pairs.filter(F.col("size") > LARGE_THRESHOLD)
    counts = big.groupBy("scope_id").agg(F.count(F.lit(1)).alias("n"))
    return (t.join(big.select("scope_id", "path", "name"), "scope_id").join(counts, "scope_id")
            .select("task_id", "path", "name", F.lit("info").alias("level"),
                    F.format_string("Found %d large files (>16KB)", "n").alias("message")))


@register("suggested_actions", _with() + """
, flags AS (
  SELECT t.task_id, count(*) FILTER (WHERE tf.file_type = 'code') > 0 AS has_code,
         count(*) FILTER (WHERE tf.file_type = 'notebook') > 0 AS has_nb
  FROM vtk t LEFT JOIN tf ON t.task_id = tf.task_id WHERE t.valid GROUP BY t.task_id)
SELECT task_id, 1 AS rank, 'semantic_search' AS action FROM flags
UNION ALL SELECT task_id, 2, 'deep_dive' FROM flags WHERE has_code
UNION ALL SELECT task_id, 2 + CAST(has_code AS INT), 'execute_notebook' FROM flags WHERE has_nb
UNION ALL SELECT task_id, 2 + CAST(has_code AS INT) + CAST(has_nb AS INT), 'compare' FROM flags""".replace("\n, flags", ",\nflags"))
def suggested_actions(spark, sf_dir):
    """Ordered follow-up actions per ticket."""
    t = _per_task(_run(spark, sf_dir, profile=False)).select("task_id", A.suggested_actions().alias("a"))
    return t.select("task_id", F.posexplode("a").alias("pos", "x")).select(
        "task_id", (F.col("pos") + 1).alias("rank"), F.col("x.action").alias("action"))


@register("files_indexed", None)
def files_indexed(spark, sf_dir):
    """Successful parses of tickets that re-index (parse-dependent: rows-only)."""
    return _per_task(_run(spark, sf_dir)).select("task_id", R._files_indexed().alias("files_indexed"))


# ----------------------------------------------------------------- T4-T8

_REPORT_SQL = _with() + """
, agg AS (
  SELECT t.task_id, count(tf.path) AS n, CAST(coalesce(sum(tf.size), 0) AS BIGINT) AS bytes,
    count(*) FILTER (WHERE tf.file_type = 'code') AS n_code,
    count(*) FILTER (WHERE tf.file_type = 'data') AS n_data,
    count(*) FILTER (WHERE tf.file_type = 'notebook') AS n_notebook,
    count(*) FILTER (WHERE tf.file_type = 'note') AS n_note,
    count(*) FILTER (WHERE tf.file_type = 'other') AS n_other,
    count(*) FILTER (WHERE tf.size > 10485760) AS large
  FROM vtk t LEFT JOIN tf ON t.task_id = tf.task_id GROUP BY t.task_id),
hl AS (
  SELECT task_id, string_agg(CASE file_type WHEN 'code' THEN 'New code added (' || name || ')'
      WHEN 'data' THEN 'Data file updated (' || name || ')'
      WHEN 'notebook' THEN 'Analysis notebook created (' || name || ')'
      ELSE 'Documentation updated (' || name || ')' END, chr(10) ORDER BY path) AS highlights
  FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY path) AS rk FROM tf
        WHERE file_type IN ('code', 'data', 'notebook', 'note')) WHERE rk <= 10 GROUP BY task_id)
SELECT t.task_id, CASE WHEN t.valid THEN 'success' ELSE 'error' END AS status,
  CASE WHEN NOT t.valid THEN 'Task failed: ' || t.error
       WHEN a.n = 0 THEN 'No files found matching criteria'
       ELSE 'Successfully processed ' || a.n || ' files' END AS message,
  CASE WHEN t.valid THEN a.n END AS files_processed,
  CASE WHEN t.valid THEN a.bytes END AS total_size_bytes,
  CASE WHEN t.valid THEN round_even(a.bytes / 1048576.0, 3) END AS total_size_mb,
  CASE WHEN t.valid THEN a.n_code END AS n_code, CASE WHEN t.valid THEN a.n_data END AS n_data,
  CASE WHEN t.valid THEN a.n_notebook END AS n_notebook,
  CASE WHEN t.valid THEN a.n_note END AS n_note, CASE WHEN t.valid THEN a.n_other END AS n_other,
  CASE WHEN NOT t.valid THEN NULL WHEN a.n = 0 THEN 'No activity found'
       WHEN a.n_code > 0 THEN 'Active development with code changes'
       WHEN a.n_data > 0 THEN 'Data collection and processing activity'
       WHEN a.n_note > 0 THEN 'Documentation updates' ELSE 'General workspace activity' END
    AS activity_summary,
  CASE WHEN t.valid THEN coalesce(h.highlights, '') END AS highlights,
  CASE WHEN t.valid THEN CAST(a.large AS BIGINT) END AS warnings,
  coalesce(t.requester, 'Unknown') AS requester_name, coalesce(t.channel, 'API') AS channel,
  coalesce(t.urgency, 'Normal') AS urgency,
  CASE WHEN coalesce(t.scan_all, FALSE) THEN 'all_files' ELSE 'date_range' END AS time_range,
  '1.0' AS schema_version
FROM vtk t JOIN agg a ON t.task_id = a.task_id LEFT JOIN hl h ON t.task_id = h.task_id""".replace(
    "\n, agg", ",\nagg")


def _full_reports(spark, sf_dir, lists=False):
    return R.build_reports(_run(spark, sf_dir), NOW, lists=lists)


@register("task_report", _REPORT_SQL)
def task_report(spark, sf_dir):
    """The report of every ticket, its SQL-checkable scalar fields."""
    rep = _full_reports(spark, sf_dir)
    return rep.select(
        "task_id", "status", "message",
        F.col("results.statistics.files_processed").alias("files_processed"),
        F.col("results.statistics.total_size_bytes").alias("total_size_bytes"),
        F.col("results.statistics.total_size_mb").alias("total_size_mb"),
        *[F.when(F.col("status") == "success",
                 F.coalesce(F.col(f"results.breakdown_by_type.{k}.count"), F.lit(0)))
          .alias(f"n_{k}") for k in A.TYPES],
        F.col("insights.activity_summary").alias("activity_summary"),
        F.array_join("insights.highlights", "\n").alias("highlights"),
        F.size("warnings").cast("bigint").alias("warnings"),
        F.col("context.requester.name").alias("requester_name"),
        F.col("context.request.channel").alias("channel"),
        F.col("context.request.urgency").alias("urgency"),
        F.col("context.scope.time_range").alias("time_range"),
        F.col("metadata.schema_version").alias("schema_version"),
    )


@register("task_report_json", None)
def task_report_json(spark, sf_dir):
    """The whole nested report of every ticket as one JSON document per row."""
    rep = _full_reports(spark, sf_dir, lists=True)
    return rep.select("task_id", F.to_json(F.struct(*[c for c in rep.columns
                                                       if c != "scope_id"])).alias("report"))


@register("task_errors", _with_conversations() + """
SELECT coalesce(task_id, 'unknown') AS task_id, 'error' AS status, 'Task failed: ' || error AS message,
  error AS errors
FROM vtk WHERE NOT valid""")
def task_errors(spark, sf_dir):
    """Error reports of invalid tickets; no file is touched."""
    rep = R.error_reports(TK.validate(conversation_tickets(spark, sf_dir)))
    return rep.select("task_id", "status", "message", F.array_join("errors", "|").alias("errors"))


@register("task_result_flat", None)
def task_result_flat(spark, sf_dir):
    """Legacy flat result (files_indexed and summary are parse-dependent)."""
    flat = R.flat_view(_full_reports(spark, sf_dir, lists=True))
    return flat.select("task_id", "status", "message", "files_processed", "files_indexed",
                       "summary", F.array_join("errors", "|").alias("errors"))


@register("run_totals", _with() + """
, per AS (
  SELECT t.task_id, t.valid, count(tf.path) AS n
  FROM vtk t LEFT JOIN tf ON t.task_id = tf.task_id GROUP BY t.task_id, t.valid)
SELECT count(*) AS tasks, count(*) FILTER (WHERE valid) AS successful,
  CAST(sum(CASE WHEN valid THEN n ELSE 0 END) AS BIGINT) AS total_files FROM per""".replace(
    "\n, per", ",\nper"))
def run_totals(spark, sf_dir):
    """Totals over the batch of reports."""
    totals = R.run_totals(_full_reports(spark, sf_dir))
    return totals.select("tasks", "successful", "total_files")




@register("report_violations", _with_conversations() + """
SELECT coalesce(task_id, 'unknown') AS task_id, 'channel' AS field, coalesce(channel, 'API') AS value
  FROM vtk WHERE coalesce(channel, 'API') NOT IN ('Email', 'Slack', 'Teams', 'API')
UNION ALL SELECT coalesce(task_id, 'unknown'), 'urgency', coalesce(urgency, 'Normal') FROM vtk
  WHERE coalesce(urgency, 'Normal') NOT IN ('Low', 'Normal', 'High', 'Critical')
UNION ALL SELECT coalesce(task_id, 'unknown'), 'requested_format', coalesce(requested_format, 'summary')
  FROM vtk WHERE coalesce(requested_format, 'summary') NOT IN ('summary', 'detailed', 'list')""")
def report_violations(spark, sf_dir):
    """T8 for the fields that tickets bring into their reports; no file is touched."""
    return R.context_violations(TK.validate(conversation_tickets(spark, sf_dir)), ENUMS, NOW)


# Defects planted into the written documents, by ticket number modulo 11: a key of the lines
# around the lists is renamed, or its value gets another type.
_DEFECTS = [
    # (key, text put instead, what is then violated: path, rule, value)
    ("agent_version", '"agent_versions":', ("metadata.agent_version", "required", None)),
    ("requester", '"requesters":', ("context.requester", "required", None)),
    ("statistics", '"statistic":', ("results.statistics", "required", None)),
    ("activity_summary", '"activity":', ("insights.activity_summary", "required", None)),
    ("example", '"sample":', ("suggested_actions[].example", "required", None)),
    ("agent_id", '"agent":', ("agent_id", "required", None)),
    ("files_scanned", '"files_scanned":null,"was":', ("results.statistics.files_scanned", "type", "null")),
    ("total_size_mb", '"total_size_mb":"many","was":', ("results.statistics.total_size_mb", "type", "string")),
    ("is_final", '"is_final":1,"was":', ("metadata.is_final", "type", "integer")),
]
_IN_ERRORS_TOO = ("agent_version", "requester", "agent_id")


def _documents(run, lines=lambda x: x):
    """The run's documents, written and read back."""
    spark = run.parsed.sparkSession
    path = stage_path(spark, "documents")
    D.write_documents(lines(D.document_lines(run, R.build_reports(run, NOW, lists=False))), path)
    return D.read_documents(spark, path)


def _planted(lines):
    """Defects around the lists by ticket, and in the records of some files."""
    number = F.coalesce(F.expr("try_cast(substring(task_id, 3) AS int)"), F.lit(-1)) % 11
    text = F.col("line")
    for k, (key, instead, _) in enumerate(_DEFECTS):
        text = F.when((number == k) & (F.col("path") == ""),
                      F.regexp_replace(F.col("line"), f'"{key}":', instead.replace("$", ""))).otherwise(text)
    doc = F.expr("try_cast(regexp_extract(path, '([0-9]+)[^0-9/]*$', 1) AS bigint)")
    text = (F.when((F.col("section") == D.FILES) & (doc % 29 == 3), F.regexp_replace(text, '"name":', '"names":'))
            .when((F.col("section") == D.FILES) & (doc % 31 == 4), F.regexp_replace(text, '"size_bytes":', '"size_bytes":0.5,"was":'))
            .otherwise(text))
    return lines.withColumn("line", text)


def _conformance_sql() -> str:
    quoted = lambda v: "NULL" if v is None else f"'{v}'"
    planted = "\n".join(
        f"UNION ALL SELECT task_id, {', '.join(map(quoted, v))}, {'valid::INT' if key not in _IN_ERRORS_TOO else '1'}"
        f"{' * n_actions' if key == 'example' else ''} FROM docs WHERE k = {i}"
        for i, (key, _, v) in enumerate(_DEFECTS))
    return _with() + f""",
docs AS (
  SELECT t.*, substr(t.task_id, 3)::INT % 11 AS k, 2 + coalesce(has_code, 0) + coalesce(has_nb, 0) AS n_actions
  FROM vtk t LEFT JOIN (
    SELECT task_id, max((file_type = 'code')::INT) AS has_code, max((file_type = 'notebook')::INT) AS has_nb
    FROM tf GROUP BY task_id) USING (task_id)),
found(task_id, path, rule, value, n) AS (
  SELECT task_id, 'context.request.channel', 'enum', coalesce(channel, 'API'), 1 FROM docs
    WHERE coalesce(channel, 'API') NOT IN ('Email', 'Slack', 'Teams', 'API')
  UNION ALL SELECT task_id, 'context.request.urgency', 'enum', coalesce(urgency, 'Normal'), 1 FROM docs
    WHERE coalesce(urgency, 'Normal') NOT IN ('Low', 'Normal', 'High', 'Critical')
  UNION ALL SELECT task_id, 'context.request.requested_format', 'enum', coalesce(requested_format, 'summary'), 1
    FROM docs WHERE coalesce(requested_format, 'summary') NOT IN ('summary', 'detailed', 'list')
  UNION ALL SELECT task_id, 'results', 'required', NULL, 1 FROM docs WHERE NOT valid
  UNION ALL SELECT task_id, 'metadata.reply_agent_compatible', 'required', NULL, 1 FROM docs WHERE NOT valid
  {planted}
  UNION ALL SELECT task_id, 'results.files[].name', 'required', NULL, count(*) FROM tf WHERE doc_id % 29 = 3 GROUP BY task_id
  UNION ALL SELECT task_id, 'results.files[].size_bytes', 'type', 'number', count(*) FROM tf
    WHERE doc_id % 31 = 4 AND doc_id % 29 <> 3 GROUP BY task_id)
SELECT task_id, path, rule, value, sum(n)::BIGINT AS n FROM found WHERE n > 0 GROUP BY ALL"""


@register("report_conformance", _conformance_sql())
def report_conformance(spark, sf_dir):
    """T8 over the documents that the report sink wrote, read back: every
    violation of the schema, those of planted defects among them."""
    found = D.stored_violations(_documents(_run(spark, sf_dir), _planted), REPORT_SCHEMA)
    return found.groupBy("task_id", "path", "rule", "value").agg(F.count("*").alias("n"))


@register("report_documents", _with(f"""
per AS (
  SELECT task_id, count(*) AS files, sum(size)::BIGINT AS size_bytes,
    count(*) FILTER (WHERE file_type = 'note') AS notes, max(path) AS last_path,
    max({O.iso('modified')}) AS last_modified
  FROM tf GROUP BY task_id)""") + """
SELECT t.task_id, CASE WHEN valid THEN 'success' ELSE 'error' END AS status,
  coalesce(files, 0) AS files, size_bytes, coalesce(notes, 0) AS notes, last_path, last_modified,
  CASE WHEN valid THEN coalesce(files, 0) END AS files_processed
FROM vtk t LEFT JOIN per USING (task_id)""")
def report_documents(spark, sf_dir):
    """The written documents read back; every file record counts."""
    docs = _documents(_run(spark, sf_dir))
    value = lambda path, kind: F.try_variant_get("v", f"$.{path}", kind)
    parsed = docs.withColumn("v", F.parse_json("document"))
    file = F.col("part") == D.PARTS[D.FILES]
    return parsed.groupBy("task_id", "ticket").agg(
        F.max(F.when(F.col("part") == "", value("status", "string"))).alias("status"),
        F.count_if(file).alias("files"), F.sum(F.when(file, value("size_bytes", "bigint"))).alias("size_bytes"),
        F.count_if(file & (value("type", "string") == "note")).alias("notes"),
        F.max(F.when(file, value("path", "string"))).alias("last_path"),
        F.max(F.when(file, value("modified", "string"))).alias("last_modified"),
        F.max(F.when(F.col("part") == "", value("results.statistics.files_processed", "bigint")))
        .alias("files_processed")).drop("ticket")


# ------------------------------------------------------------ many tickets

N_WINDOWS = 100


def window_tickets(spark, sf_dir, n: int = N_WINDOWS):
    """``n`` overlapping windows over the time that the files span."""
    i, last = F.col("id"), span_hours(spark, sf_dir)
    at = lambda h: F.timestamp_add("HOUR", h, F.lit(EPOCH).cast("timestamp_ntz"))
    lo = F.floor(i * last / n)
    return spark.range(n).select(
        F.format_string("W-%03d", i).alias("task_id"), F.lit(FIXTURE_ROOT).alias("workspace_path"),
        at(lo).alias("start_date"), at(lo + last // 40).alias("end_date"),
        F.lit(False).alias("scan_all"), F.lit(True).alias("reindex"),
        F.lit(None).cast(TK.CONTEXT).alias("context"))


def window_counts(spark, sf_dir, n: int = N_WINDOWS):
    inventory = scan.inventory(fixture_files(spark, sf_dir), FIXTURE_ROOT)
    validated = TK.with_scope(TK.validate(window_tickets(spark, sf_dir, n)))
    per_scope = dyadic.aggregate(inventory, TK.resolve_scopes(TK.scopes(validated)), {
        "files": (F.lit(1).cast("bigint"), "sum"), "total_size_bytes": (F.col("size"), "sum")})
    return (validated.select("task_id", "scope_id").join(per_scope, "scope_id", "left")
            .select("task_id", F.coalesce("files", F.lit(0)).alias("files"),
                    F.coalesce("total_size_bytes", F.lit(0)).cast("bigint").alias("total_size_bytes")))


@register("ticket_window_counts", O.with_inventory() + f"""
, w AS (SELECT 'W-' || lpad(CAST(i AS VARCHAR), 3, '0') AS task_id,
          TIMESTAMP '{EPOCH}' + to_hours(i * last // {N_WINDOWS}) AS s,
          TIMESTAMP '{EPOCH}' + to_hours(i * last // {N_WINDOWS} + last // 40) AS e
        FROM range({N_WINDOWS}) t(i), (SELECT max(doc_id) AS last FROM documents))
SELECT task_id, count(path) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size_bytes
FROM w LEFT JOIN inventory ON modified BETWEEN s AND e GROUP BY task_id""".replace("\n, w AS", ",\nw AS"))
def ticket_window_counts(spark, sf_dir):
    """T3 at many tickets: 100 overlapping windows, files and bytes per ticket."""
    return window_counts(spark, sf_dir)


# ------------------------------------------- reports over generated sources
# The same report pieces over a workspace whose .py / .csv / .ipynb files
# are generated from the documents (see queries_profile): every value that
# comes from a parser is then known to SQL, so these are checked exactly.

def _generated_run(spark, sf_dir):
    return R.prepare(generated_files(spark, sf_dir), tickets_df(spark, sf_dir))


_GEN = f"""
gf AS (
  SELECT *, len(string_split(content, chr(10))) AS n_lines,
    len(regexp_extract_all(content, '{O.WORD_RE}')) AS n_words,
    (file_type = 'code' AND suffix = '.py') AS is_py,
    (file_type = 'data' AND suffix = '.csv') AS is_csv,
    (file_type = 'notebook' AND suffix = '.ipynb') AS is_nb
  FROM tf)"""


@register("breakdown_code_generated", _with(_GEN) + """
SELECT task_id, count(*) AS files,
  CASE WHEN count(*) FILTER (WHERE suffix = '.py') > 0 THEN 'python' ELSE '' END AS languages,
  CAST(coalesce(sum(5 + 3 * n_lines) FILTER (WHERE is_py), 0) AS BIGINT) AS total_lines,
  CAST(coalesce(sum(n_lines + 1) FILTER (WHERE is_py), 0) AS BIGINT) AS functions,
  CAST(count(*) FILTER (WHERE is_py) AS BIGINT) AS classes
FROM gf WHERE file_type = 'code' GROUP BY task_id""")
def breakdown_code_generated(spark, sf_dir):
    """A3 checked exactly (generated modules)."""
    return (_per_task(_generated_run(spark, sf_dir)).filter("n_code > 0")
            .select("task_id", F.col("n_code").alias("files"),
                    F.when(F.col("code_python"), "python").otherwise("").alias("languages"),
                    F.col("code_total_lines").alias("total_lines"),
                    F.col("code_functions").alias("functions"),
                    F.col("code_classes").alias("classes")))


@register("breakdown_data_generated", _with(_GEN) + """
SELECT task_id, string_agg(DISTINCT ltrim(suffix, '.'), ',' ORDER BY ltrim(suffix, '.')) AS formats,
  CAST(coalesce(sum(n_words) FILTER (WHERE is_csv), 0) AS BIGINT) AS total_rows,
  CAST(CASE WHEN count(*) FILTER (WHERE is_csv) > 0 THEN 3 ELSE 0 END AS BIGINT) AS total_columns
FROM gf WHERE file_type = 'data' GROUP BY task_id""")
def breakdown_data_generated(spark, sf_dir):
    """A4 checked exactly (generated CSV files)."""
    return (_per_task(_generated_run(spark, sf_dir)).filter("n_data > 0")
            .select("task_id", F.array_join("data_formats", ",").alias("formats"),
                    F.col("data_total_rows").alias("total_rows"),
                    F.col("data_total_columns").alias("total_columns")))


@register("breakdown_notebook_generated", _with(_GEN) + """
SELECT task_id, CAST(sum(n_lines) FILTER (WHERE is_nb) AS BIGINT) AS total_cells,
  CAST(sum((n_lines + 1) // 2) FILTER (WHERE is_nb) AS BIGINT) AS code_cells,
  CAST(sum(n_lines // 2) FILTER (WHERE is_nb) AS BIGINT) AS markdown_cells
FROM gf WHERE file_type = 'notebook' GROUP BY task_id""")
def breakdown_notebook_generated(spark, sf_dir):
    """A5 checked exactly (generated notebooks)."""
    return (_per_task(_generated_run(spark, sf_dir)).filter("n_notebook > 0")
            .select("task_id", F.col("notebook_total_cells").alias("total_cells"),
                    F.col("notebook_code_cells").alias("code_cells"),
                    F.col("notebook_markdown_cells").alias("markdown_cells")))


@register("files_indexed_generated", _with(_GEN) + """
SELECT t.task_id, CASE WHEN t.reindex THEN count(gf.path) ELSE 0 END AS files_indexed,
  count(gf.path) AS files_processed
FROM vtk t LEFT JOIN gf ON t.task_id = gf.task_id WHERE t.valid GROUP BY t.task_id, t.reindex""")
def files_indexed_generated(spark, sf_dir):
    """A15 checked exactly: every generated file parses, so all are indexed."""
    t = _per_task(_generated_run(spark, sf_dir))
    return t.select("task_id", R._files_indexed().alias("files_indexed"),
                    F.coalesce("files_processed", F.lit(0)).alias("files_processed"))


def _summary_sql() -> str:
    kinds = " , ".join(
        f"CASE WHEN n_{k} > 0 THEN '  - {k}: ' || n_{k} || ' file(s)' END" for k in A.TYPES)
    return _with(_GEN) + f"""
, cnt AS (
  SELECT t.task_id, count(gf.path) AS n, coalesce(sum(gf.size), 0) AS bytes,
    {", ".join(f"count(*) FILTER (WHERE gf.file_type = '{k}') AS n_{k}" for k in A.TYPES)}
  FROM vtk t LEFT JOIN gf ON t.task_id = gf.task_id WHERE t.valid GROUP BY t.task_id),
code5 AS (
  SELECT task_id, string_agg('  - ' || name || ': Python file with 1 class(es), '
      || (n_lines + 1) || ' function(s)', chr(10) ORDER BY path) AS lines
  FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY path) AS rk
        FROM gf WHERE file_type = 'code') WHERE rk <= 5 GROUP BY task_id)
SELECT c.task_id, CASE WHEN n = 0 THEN 'No files were processed.' ELSE
  'Processed ' || n || ' files from workspace.' || chr(10) || chr(10) || 'File breakdown:'
  || chr(10) || concat_ws(chr(10), {kinds}) || chr(10) || chr(10) || 'Total size: '
  || printf('%.2f', round_even(bytes / 1048576.0, 2)) || ' MB'
  || coalesce(chr(10) || chr(10) || 'Notable code files:' || chr(10) || code5.lines, '') END
  AS summary
FROM cnt c LEFT JOIN code5 ON c.task_id = code5.task_id""".replace("\n, cnt AS", ",\ncnt AS")


@register("summary_text_generated", _summary_sql())
def summary_text_generated(spark, sf_dir):
    """A8 checked exactly, notable code lines included (generated modules)."""
    return _per_task(_generated_run(spark, sf_dir)).select(
        "task_id", A.summary_text().alias("summary"))


@register("notable_changes_generated", _with(_GEN, """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY path) AS rank
  FROM gf WHERE file_type IN ('code', 'data')),
top AS (SELECT * FROM ranked WHERE rank <= 5)""") + """
SELECT task_id, rank, file_type AS type, name AS file,
  CASE WHEN is_py THEN 'Python file with 1 class(es), ' || (n_lines + 1) || ' function(s)'
       WHEN is_csv THEN 'CSV file with ' || n_words || ' rows and 3 columns'
       ELSE upper(file_type[1]) || file_type[2:] || ' file with '
         || """ + O.lines("regexp_replace(content, '\\r\\n?', chr(10), 'g')") + """ || ' lines' END
    AS description,
  CASE file_type WHEN 'code' THEN 'high' ELSE 'medium' END AS impact
FROM top""")
def notable_changes_generated(spark, sf_dir):
    """A10 with descriptions (the parse summaries), checked exactly over the
    generated sources."""
    run = _generated_run(spark, sf_dir)
    t = _per_task(run).select("task_id", F.posexplode("notable_changes").alias("pos", "c"))
    return t.select("task_id", (F.col("pos") + 1).cast("bigint").alias("rank"),
                    F.col("c.type").alias("type"), F.col("c.file").alias("file"),
                    F.col("c.description").alias("description"), F.col("c.impact").alias("impact"))


@register("report_files", _with() + f"""
SELECT task_id, path, name, file_type AS type, size AS size_bytes, {O.iso('modified')} AS modified,
  'unknown' AS author, CASE WHEN file_type = 'code' THEN 'python' END AS language,
  CASE WHEN file_type IN ('data', 'note') THEN ltrim(suffix, '.')
       WHEN file_type = 'notebook' THEN 'jupyter' END AS format
FROM tf""")
def report_files(spark, sf_dir):
    """P6 per ticket: the ``results.files`` records (scope table joined to tickets)."""
    run = _run(spark, sf_dir)
    files = R.report_files(run)
    return (run.tickets.filter("valid").select("task_id", "scope_id").join(files, "scope_id")
            .select("task_id", "path", "name", "type", "size_bytes", "modified", "author",
                    "analysis.language", "analysis.format"))


@register("task_result_flat_generated", _with(_GEN) + """
, agg AS (
  SELECT t.task_id, t.valid, t.reindex, t.error, count(gf.path) AS n
  FROM vtk t LEFT JOIN gf ON t.task_id = gf.task_id GROUP BY ALL)
SELECT task_id, CASE WHEN valid THEN 'success' ELSE 'error' END AS status,
  CASE WHEN NOT valid THEN 'Task failed: ' || error WHEN n = 0 THEN 'No files found matching criteria'
       ELSE 'Successfully processed ' || n || ' files' END AS message,
  CASE WHEN valid THEN n ELSE 0 END AS files_processed,
  CASE WHEN valid AND reindex THEN n ELSE 0 END AS files_indexed,
  CASE WHEN valid THEN '' ELSE error END AS errors
FROM agg""".replace("\n, agg AS", ",\nagg AS"))
def task_result_flat_generated(spark, sf_dir):
    """T7 checked exactly over the generated sources (every file parses)."""
    flat = R.flat_view(R.build_reports(_generated_run(spark, sf_dir), NOW, lists=True))
    return flat.select("task_id", "status", "message", "files_processed", "files_indexed",
                       F.array_join("errors", "|").alias("errors"))


@register("run_totals_generated", _with(_GEN) + """
, per AS (
  SELECT t.task_id, t.valid, t.reindex, count(gf.path) AS n
  FROM vtk t LEFT JOIN gf ON t.task_id = gf.task_id GROUP BY ALL)
SELECT count(*) AS tasks, count(*) FILTER (WHERE valid) AS successful,
  CAST(sum(CASE WHEN valid THEN n ELSE 0 END) AS BIGINT) AS total_files,
  CAST(sum(CASE WHEN valid AND reindex THEN n ELSE 0 END) AS BIGINT) AS total_indexed,
  CAST(count(*) FILTER (WHERE NOT valid) AS BIGINT) AS total_errors
FROM per""".replace("\n, per AS", ",\nper AS"))
def run_totals_generated(spark, sf_dir):
    """A14 with indexed and error totals, checked exactly over the generated sources."""
    totals = R.run_totals(R.build_reports(_generated_run(spark, sf_dir), NOW, lists=False))
    return totals.select("tasks", "successful", "total_files", "total_indexed", "total_errors")


@register("task_report_fields", _with(_GEN) + """
, agg AS (
  SELECT t.task_id, count(gf.path) AS n, coalesce(sum(gf.size), 0) AS bytes,
    count(gf.path) FILTER (WHERE gf.file_type = 'code') AS n_code,
    coalesce(sum(gf.n_words) FILTER (WHERE gf.file_type = 'note'), 0) AS words
  FROM vtk t LEFT JOIN gf ON t.task_id = gf.task_id GROUP BY t.task_id)
SELECT t.task_id, CASE WHEN valid THEN 'success' ELSE 'error' END AS status,
  CASE WHEN valid THEN n END AS files_scanned, CASE WHEN valid THEN bytes::BIGINT END AS total_size_bytes,
  CASE WHEN valid AND n_code > 0 THEN n_code END AS code_files,
  CASE WHEN valid THEN 'hashed-words-md5' END AS embedding_model,
  CASE WHEN valid THEN 0 ELSE 1 END::BIGINT AS error_count, CASE WHEN valid THEN '' ELSE error END AS errors,
  coalesce(requester, 'Unknown') AS requester, coalesce(timezone, 'UTC') AS timezone
FROM vtk t JOIN agg USING (task_id)""".replace("\n, agg AS", ",\nagg AS"))
def task_report_fields(spark, sf_dir):
    """Fields read back from the JSON documents that the report sink writes."""
    rep = R.build_reports(_generated_run(spark, sf_dir), NOW)
    doc = F.to_json(F.struct(*[c for c in rep.columns if c != "scope_id"]))
    at = lambda path: F.get_json_object("report", f"$.{path}")
    return rep.select(doc.alias("report")).select(
        at("task_id").alias("task_id"), at("status").alias("status"),
        at("results.statistics.files_scanned").cast("bigint").alias("files_scanned"),
        at("results.statistics.total_size_bytes").cast("bigint").alias("total_size_bytes"),
        at("results.breakdown_by_type.code.count").cast("bigint").alias("code_files"),
        at("rag_status.embedding_model").alias("embedding_model"),
        at("error_count").cast("bigint").alias("error_count"),
        F.array_join(F.from_json(at("errors"), "array<string>"), "|").alias("errors"),
        at("context.requester.name").alias("requester"),
        at("context.requester.timezone").alias("timezone"))


@register("run_stages", _with(_GEN) + """
, needed AS (SELECT DISTINCT path, size FROM tf),
indexed AS (SELECT DISTINCT path FROM tf WHERE reindex)
SELECT 'scan' AS stage, count(*) AS rows, TRUE AS timed FROM needed
UNION ALL SELECT 'parse', count(*), TRUE FROM needed
UNION ALL SELECT 'index', count(*), TRUE FROM indexed""".replace("\n, needed AS", ",\nneeded AS"))
def run_stages(spark, sf_dir):
    """A whole run over the generated sources (scan, parse, index,
    reports, documents); its stages' rows and that each was timed."""
    base = stage_path(spark, "run")
    done = runner.run_tickets(spark, generated_files(spark, sf_dir), tickets_df(spark, sf_dir), f"{base}/out",
                              collection=f"{base}/points", now_iso=NOW)
    points = runner.current_points(spark, f"{base}/points").count()
    times, rows = done["timings"], done["rows"] | {"index": points}
    timed = all(t >= 0 for t in times.values()) and times["total"] >= times["scan"] + times["parse"] + times["index"]
    return spark.createDataFrame([(stage, rows[stage], timed) for stage in ("scan", "parse", "index")],
                                 "stage string, rows bigint, timed boolean")
