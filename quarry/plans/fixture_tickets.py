"""Tickets made from the driver's tables, and the same rows in DuckDB SQL.

``tickets_df``: one ticket per nation, for the report queries; their windows
lie over the time that the files really span, so they select more files as
``documents`` grows. ``conversation_tickets``: one ticket per conversation,
valid and invalid, for the operators that look at tickets alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.tickets import CONTEXT

# Stands in for the wall clock in "requested_at" and "timestamp".
NOW = "2024-03-01T09:00:00"

CTX_FIELDS = [f.name for f in CONTEXT.fields]
CHANNELS = ("Email", "Slack", "Teams", "API", "Pager")       # the last is not allowed
URGENCIES = ("Low", "Normal", "High", "Critical", "Asap")
FORMATS = ("summary", "detailed", "list", "table")
EPOCH = "2024-01-01 00:00:00"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _hours(n: Column) -> Column:
    return F.timestamp_add("HOUR", n, F.lit(EPOCH).cast("timestamp_ntz"))


def _every(n: Column, of: tuple) -> Column:
    """Member n of a list in turn, null past its end (one turn longer)."""
    return F.get(F.array(*[F.lit(x) for x in of]), (n % (len(of) + 1)).cast("int"))


def _every_sql(n: str, of: tuple) -> str:
    return f"[{', '.join(repr(x) for x in of)}][(({n}) % {len(of) + 1} + 1)::INT]"


def _context(n: Column, requester: Column, question: Column) -> Column:
    fields = {
        "requester": F.when(n % 4 != 0, requester),
        "requester_email": F.when(n % 6 == 1, F.concat(F.lower(requester), F.lit("@example.com"))),
        "requester_role": F.when(n % 9 == 2, "Analyst"),
        "timezone": F.when(n % 10 == 3, "Europe/Paris"),
        "original_question": F.when(n % 3 != 0, question),
        "channel": _every(n, CHANNELS), "thread_id": F.when(n % 8 == 5, F.concat(F.lit("th-"), n)),
        "urgency": _every(n, URGENCIES),
        "requested_at": F.when(n % 12 == 7, "2024-02-29T17:30:00"),
        "requested_format": _every(n, FORMATS),
    }
    return F.struct(*[fields[f].cast("string").alias(f) for f in CTX_FIELDS])


def _context_sql(n: str, requester: str, question: str) -> str:
    fields = {
        "requester": f"CASE WHEN {n} % 4 <> 0 THEN {requester} END",
        "requester_email": f"CASE WHEN {n} % 6 = 1 THEN lower({requester}) || '@example.com' END",
        "requester_role": f"CASE WHEN {n} % 9 = 2 THEN 'Analyst' END",
        "timezone": f"CASE WHEN {n} % 10 = 3 THEN 'Europe/Paris' END",
        "original_question": f"CASE WHEN {n} % 3 <> 0 THEN {question} END",
        "channel": _every_sql(n, CHANNELS), "thread_id": f"CASE WHEN {n} % 8 = 5 THEN 'th-' || {n} END",
        "urgency": _every_sql(n, URGENCIES),
        "requested_at": f"CASE WHEN {n} % 12 = 7 THEN '2024-02-29T17:30:00' END",
        "requested_format": _every_sql(n, FORMATS),
    }
    return ",\n    ".join(f"{v} AS {k}" for k, v in fields.items())


def span_hours(spark: SparkSession, sf_dir: str) -> int:
    """The hours that the files' times span (one value)."""
    return _table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] or 0


def tickets_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ticket per nation: windows of a sixth of the files' time, one on
    each day-long stretch, all files, reversed, past the end, without dates."""
    n, last = F.col("n_nationkey").cast("bigint"), span_hours(spark, sf_dir)
    start = F.floor(n * last / 30)
    end = F.when(n % 11 == 5, start - 48).otherwise(start + last // 6)
    late = F.when(n % 13 == 9, last + 1000).otherwise(0)
    dated = (n % 7 != 3) & (n % 12 != 0)
    return (_table(spark, sf_dir, "nation")
            .select(F.concat(F.lit("N-"), F.lpad(n.cast("string"), 2, "0")).alias("task_id"),
                    F.lit("/ws").alias("workspace_path"),
                    F.when(dated, _hours(start + late)).alias("start_date"),
                    F.when(dated, _hours(end + late)).alias("end_date"),
                    (n % 12 == 0).alias("scan_all"), (n % 5 != 1).alias("reindex"),
                    _context(n, F.col("n_name"), F.lit("What changed here?")).alias("context")))


def tickets_sql() -> str:
    """CTE ``tickets`` with the context flattened into columns."""
    n = "n_nationkey::BIGINT"
    return f"""span AS (SELECT coalesce(max(doc_id), 0) AS last FROM documents),
placed AS (
  SELECT *, n_nationkey * last // 30 + CASE WHEN n_nationkey % 13 = 9 THEN last + 1000 ELSE 0 END AS lo,
    n_nationkey * last // 30 + CASE WHEN n_nationkey % 11 = 5 THEN -48 ELSE last // 6 END
      + CASE WHEN n_nationkey % 13 = 9 THEN last + 1000 ELSE 0 END AS hi,
    n_nationkey % 7 <> 3 AND n_nationkey % 12 <> 0 AS dated
  FROM nation, span),
tickets AS (
  SELECT 'N-' || lpad(n_nationkey::VARCHAR, 2, '0') AS task_id, '/ws' AS workspace_path,
    CASE WHEN dated THEN TIMESTAMP '{EPOCH}' + to_hours(lo::BIGINT) END AS start_date,
    CASE WHEN dated THEN TIMESTAMP '{EPOCH}' + to_hours(hi::BIGINT) END AS end_date,
    n_nationkey % 12 = 0 AS scan_all, n_nationkey % 5 <> 1 AS reindex,
    {_context_sql(n, 'n_name', "'What changed here?'")}
  FROM placed)"""


def conversation_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ticket per conversation: its first turn asks the question."""
    n = F.col("conv_id").cast("bigint")
    first = (_table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL")
             .groupBy("conv_id").agg(F.min(F.struct("turn", "text"))["text"].alias("text")))
    start = n * 37 % 5000
    return first.select(
        F.when(n % 19 != 4, F.concat(F.lit("C-"), n)).alias("task_id"),
        F.when(n % 13 != 6, F.lit("/ws")).alias("workspace_path"),
        F.when(n % 11 != 2, _hours(start)).alias("start_date"),
        F.when(n % 7 != 1, _hours(start + n % 240 - 24)).alias("end_date"),
        F.when(n % 5 != 0, n % 17 == 0).alias("scan_all"), F.when(n % 3 != 0, n % 2 == 0).alias("reindex"),
        _context(n, F.concat(F.lit("User"), n), F.substring("text", 1, 80)).alias("context"))


def conversation_tickets_sql() -> str:
    n = "conv_id"
    return f"""firsts AS (
  SELECT conv_id::BIGINT AS conv_id, text FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS r
    FROM conversations WHERE conv_id IS NOT NULL) WHERE r = 1),
tickets AS (
  SELECT CASE WHEN {n} % 19 <> 4 THEN 'C-' || {n} END AS task_id,
    CASE WHEN {n} % 13 <> 6 THEN '/ws' END AS workspace_path,
    CASE WHEN {n} % 11 <> 2 THEN TIMESTAMP '{EPOCH}' + to_hours({n} * 37 % 5000) END AS start_date,
    CASE WHEN {n} % 7 <> 1 THEN TIMESTAMP '{EPOCH}' + to_hours({n} * 37 % 5000 + {n} % 240 - 24) END
      AS end_date,
    CASE WHEN {n} % 5 <> 0 THEN {n} % 17 = 0 END AS scan_all,
    CASE WHEN {n} % 3 <> 0 THEN {n} % 2 = 0 END AS reindex,
    {_context_sql(n, "('User' || conv_id)", 'substring(text, 1, 80)')}
  FROM firsts)"""
