"""End-to-end runs: tickets in, report tables and vector points out.

``run_tickets`` is the batch form of handling tickets: one job for any
number of tickets. Every stage boundary is a write to shared storage (the
checkpointed parse, the output tables), so a lost executor costs a task
retry, not the run. ``search_workspace`` answers a text query against the
points written by earlier runs.
"""

from __future__ import annotations

import datetime as dt
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import iso_timestamp
from quarry.operators import tickets as TK
from quarry.operators import vectors as V
from quarry.operators.aggregate import large_file_names
from quarry.plans import documents as D
from quarry.plans import report as R
from quarry.plans.collection import (clear_collection, create_collection, current_points,  # noqa: F401
                                     delete_file, upsert_points)
from quarry.session import materialize, materialize_observed, release, stage_mark


def _now_iso() -> str:
    return dt.datetime.now().isoformat()


def index_documents(run: R.TicketRun) -> DataFrame:
    """V1-V3: points of every successfully parsed file of a re-indexing ticket."""
    scopes = TK.scopes(run.tickets.filter("valid AND reindex"))
    files = TK.files_in_scopes(run.parsed, scopes, "left_semi").filter("success")
    docs = files.select(
        F.col("path").alias("file_path"), V.index_text().alias("content"),
        F.create_map(
            F.lit("file_name"), F.col("name"), F.lit("file_type"), F.col("file_type"),
            F.lit("size"), F.col("size").cast("string"),
            F.lit("modified"), iso_timestamp("modified"),
            F.lit("summary"), F.col("summary")).alias("metadata"))
    return V.make_points(docs)


def run_tickets(spark: SparkSession, files: DataFrame, tickets: DataFrame, out_dir: str,
                collection: str | None = None, now_iso: str | None = None) -> dict:
    """Handle a batch of tickets; returns the output locations, the timings and
    the rows of each stage (observed as the stages are written).

    Outputs under ``out_dir``: ``documents`` (one JSON document per ticket,
    with every file record, see ``plans.documents``), ``reports`` (JSON lines,
    a ticket's report without the lists that grow), and ``report_files``,
    ``report_errors`` and ``large_files`` (parquet, keyed by scope_id; join
    ``reports`` on it).
    """
    started, mark = _now_iso(), stage_mark()
    t0 = time.perf_counter()
    validated = TK.with_scope(TK.validate(tickets))
    scope_df = TK.scopes(validated)
    resolved = TK.resolve_scopes(scope_df)
    needed = TK.files_in_scopes(files, resolved, "left_semi")
    seen = {}
    if "content" not in files.columns:  # an inventory: the scan ends with its selection
        needed, seen = materialize_observed(needed, "needed-files", files=F.count("*"))
    scan_s = time.perf_counter() - t0
    t1 = time.perf_counter()
    # one parse per file, shared storage; counted as it is written
    parsed, counts = materialize_observed(
        R.numbered(R.parse.parse_files(needed)), "parsed", files=F.count("*"),
        failed=F.count_if(~F.col("success")), bytes=F.coalesce(F.sum("size"), F.lit(0)))
    run = R.TicketRun(validated, scope_df, parsed, resolved)
    parse_s = time.perf_counter() - t1
    t2 = time.perf_counter()
    info, indexed = None, {"points": 0}
    if collection:
        points, indexed = materialize_observed(index_documents(run), "points", points=F.count("*"))
        upsert_points(spark, collection, points)
        info = V.collection_info(current_points(spark, collection))
    index_s = time.perf_counter() - t2
    files_location = os.path.join(out_dir, "report_files")
    R.report_files(run).write.mode("overwrite").parquet(files_location)
    R.report_errors(run).write.mode("overwrite").parquet(os.path.join(out_dir, "report_errors"))
    large_file_names(run.pairs).write.mode("overwrite").parquet(os.path.join(out_dir, "large_files"))
    # aggregated before the clock stops; only writing reports and documents is not in it
    reports = materialize(R.build_reports(run, now_iso or _now_iso(), collection=info,
                                          files_location=files_location, lists=False), "reports")
    total = time.perf_counter() - t0
    perf = F.struct(
        F.lit(total).alias("processing_time_seconds"), F.lit(scan_s).alias("scan_time_seconds"),
        F.lit(parse_s).alias("parse_time_seconds"), F.lit(index_s).alias("index_time_seconds"),
        F.lit(started).alias("started_at"), F.lit(_now_iso()).alias("completed_at"))
    reports = reports.withColumn("performance", perf)
    reports.write.mode("overwrite").json(os.path.join(out_dir, "reports"))
    D.write_documents(D.document_lines(run, reports), os.path.join(out_dir, "documents"))
    release(spark, mark)  # everything is written
    return {"out_dir": out_dir, "collection": collection,
            "timings": {"scan": scan_s, "parse": parse_s, "index": index_s, "total": total},
            "rows": {"scan": seen.get("files", counts["files"]), "parse": counts["files"],
                     "failed": counts["failed"], "bytes": counts["bytes"], "index": indexed["points"]}}


def embed_text(text: str, dim: int = V.DEFAULT_DIM) -> list[float]:
    """The hashed embedding of one short text (a query), computed locally."""
    return V.hashed_vector(text, dim).tolist()


def search_hits(points: DataFrame, query: list[float], limit: int = 5,
                score_threshold: float | None = None) -> DataFrame:
    """V6: the nearest points of a query vector, as search hits."""
    hits = V.search(points, query, k=limit, threshold=score_threshold)
    return hits.select("file_path", "score", "metadata", "content_preview")


def search_workspace(spark: SparkSession, collection: str, query: str, limit: int = 5,
                     score_threshold: float | None = None) -> DataFrame:
    """V4-V6: top ``limit`` points for a text query, as search hits."""
    return search_hits(current_points(spark, collection), embed_text(query), limit, score_threshold)
