"""Ticket-level operators: validation (T1), context defaults (T2) and the
ticket -> files range join (T3).

Tickets are deduplicated into *scopes* (all files, or one inclusive time
window). Every per-file aggregate is computed once per scope, however many
tickets share it, and joined back to the tickets at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import fixed as X
from quarry.functions.text import iso_timestamp
from quarry.operators import dyadic

CONTEXT = T.StructType([T.StructField(n, T.StringType()) for n in (
    "requester", "requester_email", "requester_role", "timezone", "original_question",
    "channel", "thread_id", "urgency", "requested_at", "requested_format")])

TICKET_SCHEMA = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("workspace_path", T.StringType()),
    T.StructField("start_date", T.TimestampNTZType()),
    T.StructField("end_date", T.TimestampNTZType()),
    T.StructField("scan_all", T.BooleanType()),
    T.StructField("reindex", T.BooleanType()),
    T.StructField("context", CONTEXT),
])

CONTEXT_DEFAULTS = X.CONTEXT_DEFAULTS
DATES_REQUIRED = X.DATES_REQUIRED

def validate(tickets: DataFrame) -> DataFrame:
    """Adds ``valid`` and ``error``; defaults scan_all=false, reindex=true."""
    scan_all = F.coalesce(F.col("scan_all"), F.lit(False))
    error = (F.when(F.col("task_id").isNull(), F.lit("task_id: Field required"))
             .when(F.col("workspace_path").isNull(), F.lit("workspace_path: Field required"))
             .when(~scan_all & (F.col("start_date").isNull() | F.col("end_date").isNull()),
                   F.lit(DATES_REQUIRED)))
    return tickets.withColumns({
        "scan_all": scan_all,
        "reindex": F.coalesce(F.col("reindex"), F.lit(True)),
        "error": error,
    }).withColumn("valid", F.col("error").isNull())


def scope_id() -> Column:
    return F.when(F.col("scan_all"), F.lit("all")).otherwise(
        F.concat(iso_timestamp("start_date"), F.lit("/"), iso_timestamp("end_date")))


def with_scope(tickets: DataFrame) -> DataFrame:
    return tickets.withColumn("scope_id", F.when(F.col("valid"), scope_id()))


def scopes(tickets: DataFrame) -> DataFrame:
    """Distinct file selections of the valid tickets."""
    return (with_scope(tickets).filter("valid")
            .select("scope_id", "scan_all", "start_date", "end_date").dropDuplicates(["scope_id"]))


def context_struct(now_iso: str) -> tuple[Column, Column, Column]:
    """Requester, request and scope structs with defaults.

    ``now_iso`` stands in for the wall clock of ``requested_at``; it is a
    parameter so results are reproducible.
    """
    ctx = F.col("context")

    def pick(field):
        default = now_iso if field == "requested_at" else CONTEXT_DEFAULTS[field]
        return F.coalesce(ctx.getField(field), F.lit(default))

    requester = F.struct(pick("requester").alias("name"), pick("requester_email").alias("email"),
                         pick("requester_role").alias("role"), pick("timezone").alias("timezone"))
    request = F.struct(*[pick(f).alias(f) for f in (
        "original_question", "channel", "thread_id", "urgency", "requested_at",
        "requested_format")])
    all_files = F.coalesce(F.col("scan_all"), F.lit(False))
    scope = F.struct(
        F.when(all_files, "all_files").otherwise("date_range").alias("time_range"),
        iso_timestamp("start_date").alias("start_date"),
        iso_timestamp("end_date").alias("end_date"),
        F.col("workspace_path").alias("workspace"),
        F.when(all_files, "all").otherwise("date_range").alias("filter_type"),
    )
    return requester, request, scope


def resolve_scopes(scope_df: DataFrame) -> dyadic.Selection:
    """The scopes as nodes of the time tree; one action of a row per level."""
    windows = scope_df.filter("not scan_all").select("scope_id", "start_date", "end_date")
    return dyadic.selection(windows, scope_df.filter("scan_all"))


def files_in_scopes(files: DataFrame, scopes_: "DataFrame | dyadic.Selection",
                    how: str = "inner") -> DataFrame:
    """(scope, file) pairs, or with ``how='left_semi'`` the files any scope
    needs. One plan for any number and length of windows (see ``dyadic``); the
    all-files scope is a tag, not a join."""
    s = scopes_ if isinstance(scopes_, dyadic.Selection) else resolve_scopes(scopes_)
    return dyadic.semi_join(files, s) if how == "left_semi" else dyadic.join(files, s)
