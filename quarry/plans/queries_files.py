"""Inventory queries over the workspace view of ``documents``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quarry.functions.text import iso_timestamp
from quarry.operators import enrich, scan
from quarry.plans import oracle_sql as O
from quarry.plans.fixture_tickets import EPOCH, span_hours
from quarry.plans.registry import register
from quarry.session import stage_path
from quarry.sources import datasource
from quarry.sources.tables import FIXTURE_ROOT, fixture_files, write_tree

# A time near the files' first, shared with the oracle text.
RANGE_START = "2024-01-03 00:00:00"

# Windows over the time that the files really span (its share n / d).
_AT = lambda n, d: f"(SELECT TIMESTAMP '{EPOCH}' + to_hours((max(doc_id) * {n} // {d})::BIGINT) FROM documents)"
WINDOW_SQL = f"{_AT(1, 5)} AND {_AT(3, 5)}"
DAYS_SQL = f"date_trunc('day', {_AT(1, 10)}) AND date_trunc('day', {_AT(1, 4)}) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND"


def span(spark, sf_dir, *shares):
    last = span_hours(spark, sf_dir)
    start = dt.datetime.fromisoformat(EPOCH)
    return [start + dt.timedelta(hours=last * n // d) for n, d in shares]


def window(spark, sf_dir):
    return span(spark, sf_dir, (1, 5), (3, 5))


def inventory(spark, sf_dir):
    return scan.inventory(fixture_files(spark, sf_dir), FIXTURE_ROOT)


@register("breakdown_by_type", O.with_inventory() + f"""
SELECT file_type, count(*) AS files, CAST(sum(size) AS BIGINT) AS total_size_bytes,
       round_even(sum(size) / 1048576.0, 3) AS total_size_mb
FROM inventory WHERE modified >= {O.ts(RANGE_START)} GROUP BY file_type""")
def breakdown_by_type(spark, sf_dir):
    """Slice 1: files changed since a time, classified, counted and sized per type."""
    files = scan.inventory(fixture_files(spark, sf_dir).filter(
        F.col("modified") >= F.lit(RANGE_START).cast("timestamp_ntz")), FIXTURE_ROOT)
    return (files.groupBy("file_type")
            .agg(F.count(F.lit(1)).alias("files"),
                 F.sum("size").alias("total_size_bytes"),
                 F.bround(F.sum("size") / F.lit(1048576.0), 3).alias("total_size_mb")))


@register("workspace_files", O.with_inventory() + f"""
SELECT path, name, file_type, size, {O.iso('modified')} AS modified FROM inventory""")
def workspace_files(spark, sf_dir):
    """The walk's inventory (M1 columns)."""
    return inventory(spark, sf_dir).select("path", "name", "file_type", "size",
                                           iso_timestamp("modified").alias("modified"))


@register("ignored_paths", O.with_inventory() + """
SELECT path, pruned, ignored FROM flagged""")
def ignored_paths(spark, sf_dir):
    """Prune (directory) and ignore (file) flags of every path."""
    return scan.ignore_flags(fixture_files(spark, sf_dir), FIXTURE_ROOT).select(
        "path", "pruned", "ignored")


@register("classify_files", O.with_inventory() + f"""
SELECT path, regexp_extract(name, '(?s)^.+([.][^.]+)$', 1) AS suffix,
  {O._type_case("regexp_extract(name, '(?s)^.+([.][^.]+)$', 1)")} AS file_type FROM named""")
def classify_files(spark, sf_dir):
    """Suffix and type of every path (ignored ones included)."""
    files = fixture_files(spark, sf_dir).withColumn("name", F.substring_index("path", "/", -1))
    return scan.classify(files).select("path", "suffix", "file_type")


@register("scan_changes", O.with_inventory() + f"""
SELECT path, file_type, size, {O.iso('modified')} AS modified FROM inventory
WHERE modified BETWEEN {WINDOW_SQL}""")
def scan_changes(spark, sf_dir):
    """Inventory inside an inclusive window."""
    files = scan.scan_changes(fixture_files(spark, sf_dir), *window(spark, sf_dir), FIXTURE_ROOT)
    return files.select("path", "file_type", "size", iso_timestamp("modified").alias("modified"))


@register("scan_changes_days", O.with_inventory() + f"""
SELECT path, file_type, {O.iso('modified')} AS modified FROM inventory
WHERE modified BETWEEN {DAYS_SQL}""")
def scan_changes_days(spark, sf_dir):
    """Whole calendar days, end day included to its last microsecond."""
    days = [t.date() for t in span(spark, sf_dir, (1, 10), (1, 4))]
    files = scan.scan_changes_days(fixture_files(spark, sf_dir), *days, FIXTURE_ROOT)
    return files.select("path", "file_type", iso_timestamp("modified").alias("modified"))


@register("scan_counters", O.with_inventory() + f"""
SELECT count(*) FILTER (WHERE NOT pruned) AS scanned,
  count(*) FILTER (WHERE NOT pruned AND ignored) AS ignored,
  count(*) FILTER (WHERE NOT pruned AND NOT ignored
                   AND modified BETWEEN {WINDOW_SQL}) AS changed
FROM flagged""")
def scan_counters(spark, sf_dir):
    """S3: scanned / ignored / changed counters of one scan."""
    return scan.scan_counters(fixture_files(spark, sf_dir), *window(spark, sf_dir), FIXTURE_ROOT)


@register("scan_metrics", O.with_inventory() + f"""
SELECT count(*) FILTER (WHERE NOT pruned) AS scanned,
  count(*) FILTER (WHERE NOT pruned AND ignored) AS ignored,
  count(*) FILTER (WHERE NOT pruned AND NOT ignored AND modified BETWEEN {WINDOW_SQL}) AS changed,
  (SELECT count(*) FROM inventory WHERE modified BETWEEN {WINDOW_SQL}) AS files,
  (SELECT sum(size) FROM inventory WHERE modified BETWEEN {WINDOW_SQL})::BIGINT AS bytes
FROM flagged""")
def scan_metrics(spark, sf_dir):
    """S3 observed while the inventory is written, beside the inventory itself."""
    files, seen = scan.observed_inventory(fixture_files(spark, sf_dir), *window(spark, sf_dir), FIXTURE_ROOT)
    return files.agg(*[F.lit(seen[k]).alias(k) for k in ("scanned", "ignored", "changed")],
                     F.count("*").alias("files"), F.lit(seen["bytes"]).alias("bytes"))


@register("workspace_scan", O.with_inventory() + f"""
SELECT substr(path, 4) AS path, name, file_type, suffix, size, {O.iso('modified')} AS modified
FROM inventory WHERE modified BETWEEN {WINDOW_SQL} AND starts_with(path, '/ws/' || (SELECT min(source) FROM documents))""")
def workspace_scan(spark, sf_dir):
    """S1, S2 over a real folder: the files are written as a tree and read back
    by the data source, with the window and a subtree pushed into it."""
    root = stage_path(spark, "tree").removeprefix("file:")
    files = fixture_files(spark, sf_dir)
    write_tree(files.withColumn("path", F.concat(F.lit(root), F.substring("path", len(FIXTURE_ROOT) + 1, 10_000))))
    datasource.register(spark)
    first = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").agg(F.min("source")).first()[0]
    lo, hi = window(spark, sf_dir)
    found = (spark.read.format("workspace").load(root)
             .where((F.col("modified") >= F.lit(lo).cast("timestamp_ntz"))
                    & (F.col("modified") <= F.lit(hi).cast("timestamp_ntz"))
                    & F.col("path").startswith(f"{root}/{first}")))
    return found.select(F.substring("path", len(root) + 1, 10_000).alias("path"), "name", "file_type", "suffix",
                        "size", iso_timestamp("modified").alias("modified"))


@register("file_display", O.with_inventory() + f"""
SELECT path, name, file_type, strftime(modified, '%Y-%m-%d %H:%M') AS modified,
  round_even(size / 1024.0, 2) AS size_kb
FROM inventory WHERE modified BETWEEN {WINDOW_SQL}""")
def file_display(spark, sf_dir):
    """The display table of changed files."""
    files = scan.scan_changes(fixture_files(spark, sf_dir), *window(spark, sf_dir), FIXTURE_ROOT)
    return enrich.display(files, keys=("path",))
