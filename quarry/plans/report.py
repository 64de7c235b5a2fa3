"""Ticket reports (T4-T7, T9): many tickets in one job.

Stages::

    tickets --validate--> scopes (distinct windows, as nodes of a time tree)
    inventory --semi join nodes--> needed files --parse--> parsed  [materialised]
    parsed --units, nodes, scopes--> stats, first-N lists
    parsed --join nodes--> pairs, only for results that list files
    tickets ⟕ (stats ⟕ lists) on scope_id --> one report row per ticket

The lists of a report that grow with the data (file records, messages of
failed parses, names of large files) are tables keyed by scope;
``documents.write_documents`` streams them into one JSON document per ticket.
A report row names the place of the file records
(``results.files_location``); with ``lists=True`` it also holds the messages
and names, gathered per scope, for scopes that are known to be small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import fixed as X
from quarry.functions.text import template
from quarry.operators import aggregate as A
from quarry.operators import dyadic, enrich, parse, tickets as TK
from quarry.operators import vectors as V
from quarry.session import materialize

AGENT_ID = X.AGENT_ID
AGENT_VERSION = X.AGENT_VERSION
SCHEMA_VERSION = X.SCHEMA_VERSION
COLLECTION = X.COLLECTION


@dataclass
class TicketRun:
    tickets: DataFrame   # validated, with scope_id
    scopes: DataFrame    # distinct scopes of valid tickets
    parsed: DataFrame    # one profile row per needed file
    selection: dyadic.Selection  # the scopes as ranges of time

    @property
    def pairs(self) -> DataFrame:
        """(scope_id, parsed file), for results that list files."""
        return TK.files_in_scopes(self.parsed, self.selection)


def prepare(inventory: DataFrame, tickets: DataFrame, persist: bool = True,
            profile: bool = True) -> TicketRun:
    """Validate, select files per scope, parse each needed file once.

    ``inventory`` carries the M1 columns plus ``content``. With ``persist``
    the parsed table is checkpointed into the shared checkpoint folder so the
    aggregate and list branches (and a retry after a lost executor) read it
    instead of re-running the parsers. ``profile=False`` keeps names,
    types and sizes only (lists and counters that need no parser).
    """
    validated = TK.with_scope(TK.validate(tickets))
    scope_df = TK.scopes(validated)
    resolved = TK.resolve_scopes(scope_df)
    needed = TK.files_in_scopes(inventory, resolved, "left_semi")
    parsed = numbered(parse.parse_files(needed) if profile else parse.without_profile(needed))
    if persist and profile:
        parsed = materialize(parsed)
    return TicketRun(validated, scope_df, parsed, resolved)


def numbered(parsed: DataFrame) -> DataFrame:
    """``file_no`` tells rows of one path apart, once the table is written."""
    return parsed.withColumn("file_no", F.monotonically_increasing_id())


def per_scope(run: TicketRun, lists: bool = False) -> DataFrame:
    """Stats and bounded lists: one row per scope; with ``lists`` also every
    error message and large file."""
    bounded = (A.scope_stats(run.parsed, run.selection)
               .join(A.scope_lists(run.parsed, run.selection), "scope_id", "left"))
    if not lists:
        return bounded
    listed = lambda rows, item, name: rows.groupBy("scope_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("path", F.col(item).alias("item")))),
                    lambda x: x["item"]).alias(name))
    return (bounded
            .join(listed(report_errors(run), "message", "error_messages"), "scope_id", "left")
            .join(listed(A.large_file_names(run.pairs), "name", "large_file_names"),
                  "scope_id", "left"))


def _files_indexed() -> Column:
    """Successful parses, only when the ticket asks for indexing."""
    return F.when(F.col("reindex"), F.coalesce(F.col("files_succeeded"), F.lit(0))).otherwise(0)


def _by_type() -> Column:
    """A2-A6 as a struct with one nullable member per type present."""
    def member(k, extra):
        fields = [F.col(f"n_{k}").alias("count")] + extra
        return F.when(F.col(f"n_{k}") > 0, F.struct(*fields)).alias(k)
    return F.struct(
        member("code", [F.when(F.col("code_python"), F.array(F.lit("python")))
                        .otherwise(A.empty_list()).alias("languages"),
                        F.col("code_total_lines").alias("total_lines"),
                        F.col("code_functions").alias("functions"),
                        F.col("code_classes").alias("classes")]),
        member("data", [F.col("data_formats").alias("formats"),
                        F.col("data_total_rows").alias("total_rows"),
                        F.col("data_total_columns").alias("total_columns")]),
        member("notebook", [F.col("notebook_total_cells").alias("total_cells"),
                            F.col("notebook_code_cells").alias("code_cells"),
                            F.col("notebook_markdown_cells").alias("markdown_cells")]),
        member("note", [F.col("note_formats").alias("formats"),
                        F.col("note_total_words").alias("total_words")]),
        member("other", []),
    )


def report_columns(now_iso: str, collection: DataFrame | None = None) -> dict[str, Column]:
    """Flat report values (used by the nested report and the flat checks)."""
    total = F.coalesce(F.col("files_processed"), F.lit(0))
    valid = F.col("valid")
    return {
        "status": F.when(valid, "success").otherwise("error"),
        "message": (F.when(~valid, template(X.MSG_FAILED, error=F.col("error")))
                    .when(total == 0, F.lit(X.MSG_NO_FILES))
                    .otherwise(template(X.MSG_SUCCESS, n=total))),
        "files_processed": total,
        "files_indexed": _files_indexed(),
        "total_size_bytes": F.coalesce(F.col("total_size_bytes"), F.lit(0)).cast("bigint"),
        "total_size_mb": F.bround(F.coalesce(F.col("total_size_bytes"), F.lit(0))
                                  / F.lit(float(A.MB)), 3),
        "activity_summary": A.activity_summary(),
        "summary": A.summary_text(),
        "highlights": F.coalesce(F.col("highlights"), A.empty_list()),
        "recommendations": F.coalesce(F.col("recommendations"), A.empty_list()),
        "large_files": F.coalesce(F.col("large_files"), F.lit(0)),
    }


def build_reports(run: TicketRun, now_iso: str, collection: DataFrame | None = None,
                  agent_id: str = AGENT_ID, agent_version: str = AGENT_VERSION,
                  files_location: str | None = None, embedder: str = V.EMBEDDER,
                  dim: int = V.DEFAULT_DIM, lists: bool = True) -> DataFrame:
    """One nested report row per ticket (valid or not).

    With ``lists`` a row holds all error messages and large-file names of its
    scope; without, rows are bounded and ``documents`` writes the lists.

    ``files_location`` is where the table of file records (``report_files``)
    is written; ``embedder`` and ``dim`` describe the vectors really stored.
    """
    t = run.tickets.join(per_scope(run, lists), "scope_id", "left")
    if not lists:
        t = t.withColumns({"error_messages": A.empty_list(), "large_file_names": A.empty_list()})
    points = vectors = None
    if collection is not None:  # one aggregate row (V8)
        info = collection.first()
        points, vectors = info["points_count"], info["vectors_count"]
    t = t.withColumns({"_points": F.lit(points).cast("bigint"),
                       "_vectors": F.lit(vectors).cast("bigint")})
    c = report_columns(now_iso)
    requester, request, scope = TK.context_struct(now_iso)
    valid = F.col("valid")
    ok = lambda col: F.when(valid, col)
    statistics = F.struct(
        c["files_processed"].alias("files_scanned"), c["files_processed"].alias("files_matched"),
        c["files_processed"].alias("files_processed"), c["files_indexed"].alias("files_indexed"),
        F.lit(0).cast("bigint").alias("files_failed"),
        F.coalesce(F.col("parse_failed"), F.lit(0)).alias("parse_failed"),
        c["total_size_bytes"].alias("total_size_bytes"), c["total_size_mb"].alias("total_size_mb"))
    results = F.struct(c["summary"].alias("summary"), statistics.alias("statistics"),
                       _by_type().alias("breakdown_by_type"),
                       F.lit(files_location).cast("string").alias("files_location"))
    rag_status = F.struct(
        F.lit(True).alias("enabled"), F.lit(COLLECTION).alias("collection_name"),
        F.coalesce(F.col("_points"), F.lit(0)).alias("total_documents"),
        F.lit(embedder).alias("embedding_model"),
        F.lit(dim).alias("embedding_dimension"),
        F.coalesce(F.col("_vectors"), F.lit(0)).alias("vector_count"),
        F.lit(True).alias("index_updated"), F.lit(True).alias("searchable"),
        A.empty_list().alias("top_similar_queries"))
    insights = F.struct(
        c["highlights"].alias("highlights"), c["activity_summary"].alias("activity_summary"),
        F.coalesce(F.col("notable_changes"),
                   F.array().cast("array<struct<type:string,file:string,description:string,"
                                  "impact:string>>")).alias("notable_changes"),
        c["recommendations"].alias("recommendations"))
    warnings = F.when(c["large_files"] > 0, F.array(F.struct(
        F.lit(X.WARNING_LEVEL).alias("level"),
        template(X.WARNING_LARGE, n=c["large_files"]).alias("message"),
        F.coalesce(F.col("large_file_names"), A.empty_list()).alias("affected_files"),
    ))).otherwise(A.empty_list("array<struct<level:string,message:string,affected_files:array<string>>>"))
    performance = F.struct(*[F.lit(None).cast("double").alias(n) for n in (
        "processing_time_seconds", "scan_time_seconds", "parse_time_seconds",
        "index_time_seconds")], F.lit(None).cast("string").alias("started_at"),
        F.lit(None).cast("string").alias("completed_at"))
    metadata = F.struct(
        F.lit(agent_version).alias("agent_version"), F.lit(SCHEMA_VERSION).alias("schema_version"),
        ok(F.lit(True)).alias("reply_agent_compatible"),
        ok(F.lit(False)).alias("requires_user_action"), ok(F.lit(True)).alias("is_final"))
    return t.select(
        F.coalesce(F.col("task_id"), F.lit("unknown")).alias("task_id"),
        F.lit(agent_id).alias("agent_id"), F.lit(now_iso).alias("timestamp"),
        c["status"].alias("status"), c["message"].alias("message"),
        F.struct(requester.alias("requester"), request.alias("request"),
                 scope.alias("scope")).alias("context"),
        ok(results).alias("results"), ok(rag_status).alias("rag_status"),
        ok(insights).alias("insights"), performance.alias("performance"),
        F.when(valid, F.coalesce(F.col("parse_failed"), F.lit(0)))
         .otherwise(F.lit(1)).cast("bigint").alias("error_count"),
        F.when(~valid, F.array(F.col("error")))
         .otherwise(F.coalesce(F.col("error_messages"), A.empty_list())).alias("errors"),
        ok(warnings).alias("warnings"), ok(A.suggested_actions()).alias("suggested_actions"),
        metadata.alias("metadata"),
        F.col("scope_id"),
    )


def report_files(run: TicketRun) -> DataFrame:
    """Per-scope enhanced file records (``results.files``); join tickets on scope_id."""
    return enrich.enhanced_files(run.pairs, keys=("scope_id",))


def report_errors(run: TicketRun) -> DataFrame:
    """C7 per scope: ``"{name}: {error}"`` of every failed parse."""
    return parse.parse_errors(run.pairs, keys=("scope_id",))


def flat_view(reports: DataFrame) -> DataFrame:
    """The legacy flat result (task_id, status, message, counts, ...)."""
    return reports.select(
        "task_id", "status", "message",
        F.coalesce(F.col("results.statistics.files_processed"), F.lit(0)).alias("files_processed"),
        F.coalesce(F.col("results.statistics.files_indexed"), F.lit(0)).alias("files_indexed"),
        F.coalesce(F.col("results.summary"), F.lit("")).alias("summary"),
        "errors",
        F.col("performance.processing_time_seconds").alias("processing_time"),
    )


def run_totals(reports: DataFrame) -> DataFrame:
    """Totals over a batch of reports (nested paths, decision D2)."""
    processed = F.coalesce(F.col("results.statistics.files_processed"), F.lit(0))
    indexed = F.coalesce(F.col("results.statistics.files_indexed"), F.lit(0))
    t = F.coalesce(F.col("performance.processing_time_seconds"), F.lit(0.0))
    return reports.agg(
        F.count(F.lit(1)).alias("tasks"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.sum(processed).cast("bigint").alias("total_files"),
        F.sum(indexed).cast("bigint").alias("total_indexed"),
        F.sum(t).alias("total_time"), F.avg(t).alias("avg_time"),
        F.sum("error_count").cast("bigint").alias("total_errors"),
    )


def error_reports(tickets: DataFrame) -> DataFrame:
    """task_id, status, message, errors of the tickets that are not valid.
    Reads the tickets only."""
    return tickets.filter(~F.col("valid")).select(
        F.coalesce(F.col("task_id"), F.lit("unknown")).alias("task_id"),
        F.lit("error").alias("status"), template(X.MSG_FAILED, error=F.col("error")).alias("message"),
        F.array("error").alias("errors"))


def _outside(field: str, col: Column, allowed) -> Column:
    return F.when(col.isNull() | ~col.isin(*allowed),
                  F.struct(F.lit(field).alias("field"), col.alias("value")))


def context_violations(tickets: DataFrame, enums: dict, now_iso: str) -> DataFrame:
    """T8 for what a ticket alone decides: (task_id, field, value) of every
    enumerated field of its request outside its enumeration."""
    _, request, _ = TK.context_struct(now_iso)
    checks = [_outside(name, F.col(f"r.{name}"), enums[name])
              for name in ("channel", "urgency", "requested_format")]
    return (tickets.select(F.coalesce(F.col("task_id"), F.lit("unknown")).alias("task_id"),
                           request.alias("r"))
            .select("task_id", F.explode(F.array_compact(F.array(*checks))).alias("v"))
            .select("task_id", "v.field", "v.value"))
