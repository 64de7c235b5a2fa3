"""Inventory operators: ignore rules, type classification, time-range
selection and scan counters (all native column expressions)."""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import fixed as X
from quarry.functions.text import file_name, file_suffix
from quarry.session import materialize_observed

IGNORE_PATTERNS = X.IGNORE_PATTERNS
FILE_TYPES = X.FILE_TYPES

_GLOB_SUFFIXES = [p[1:] for p in IGNORE_PATTERNS if p.startswith("*")]


def _alternation() -> str:
    """Plain substring patterns as one regex alternation (no '/' inside)."""
    return "|".join(re.escape(p) for p in IGNORE_PATTERNS)


def _glob_alternation() -> str:
    return "|".join(re.escape(s) for s in _GLOB_SUFFIXES)


def ignore_flags(files: DataFrame, root: str | None = None) -> DataFrame:
    """Adds ``name``, ``pruned`` and ``ignored``.

    ``pruned``: the file sits below a directory the walk never enters (a
    directory strictly below ``root`` whose path contains a pattern or whose
    name ends in ".pyc"). ``ignored``: the file path contains a pattern or the
    name ends in ".pyc". The file is kept iff neither holds. Without ``root``
    the first path component is taken as the root.

    Each test is one regular expression over ``path``, so the expression
    stays small even when ``path`` is itself computed.
    """
    path = F.col("path")
    root_re = "/[^/]*" if root is None else re.escape(str(root).rstrip("/"))
    alt, glob = _alternation(), _glob_alternation()
    below_root_dir = path.rlike(f"^{root_re}/.*/")
    dir_hit = path.rlike(f"(?:{alt}).*/") | path.rlike(f"^{root_re}/(?:.*/)?[^/]*(?:{glob})/")
    return files.withColumns({
        "name": file_name(path),
        "pruned": below_root_dir & dir_hit,
        "ignored": path.rlike(f"{alt}|(?:{glob})$"),
    })


def keep_predicate() -> Column:
    return ~F.col("pruned") & ~F.col("ignored")


def _lookup(mapping: dict, key: Column, default: str) -> Column:
    """One map-literal lookup: ``key`` is referenced once, however long the map."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def classify(files: DataFrame) -> DataFrame:
    """Adds ``suffix`` (as written) and ``file_type``."""
    files = files.withColumn("suffix", file_suffix(F.col("name")))
    return files.withColumn("file_type", _lookup(FILE_TYPES, F.lower("suffix"), "other"))


def inventory(files: DataFrame, root: str | None = None) -> DataFrame:
    """Every file the walk would report, classified (M1 columns + extras)."""
    flagged = ignore_flags(files, root)
    return classify(flagged.filter(keep_predicate())).drop("pruned", "ignored")


def in_range(start, end) -> Column:
    """``start <= modified <= end``; both ends inclusive."""
    return F.col("modified").between(_ts(start), _ts(end))


def scan_changes(files: DataFrame, start, end, root: str | None = None) -> DataFrame:
    """The inventory restricted to an inclusive modification window.

    The time predicate is applied before the path rules so that it can reach
    the scan (parquet row-group pruning, data-source filter push-down).
    """
    return inventory(files.filter(in_range(start, end)), root)


def day_bounds(start_day, end_day) -> tuple[Column, Column]:
    """Calendar days to [00:00:00, 23:59:59.999999]."""
    lo = F.to_date(_ts(start_day)).cast("timestamp_ntz")
    hi = (F.date_add(F.to_date(_ts(end_day)), 1).cast("timestamp_ntz")
          - F.expr("INTERVAL '0.000001' SECOND"))
    return lo, hi


def scan_changes_days(files: DataFrame, start_day, end_day, root: str | None = None) -> DataFrame:
    lo, hi = day_bounds(start_day, end_day)
    return inventory(files.filter(F.col("modified").between(lo, hi)), root)


def scan_counters(files: DataFrame, start, end, root: str | None = None) -> DataFrame:
    """S3: files scanned (walk reached them), ignored, and changed in range."""
    flagged = ignore_flags(files, root)
    reached = ~F.col("pruned")
    return flagged.agg(
        F.count_if(reached).alias("scanned"),
        F.count_if(reached & F.col("ignored")).alias("ignored"),
        F.count_if(reached & ~F.col("ignored") & in_range(start, end)).alias("changed"),
    )


def observed_inventory(files: DataFrame, start, end, root: str | None = None) -> tuple[DataFrame, dict]:
    """S2 and S3 in one pass: the written inventory of a window, and the
    counters (and bytes) of the scan that wrote it."""
    reached, kept = ~F.col("pruned"), ~F.col("pruned") & ~F.col("ignored")
    size = F.when(kept & in_range(start, end), F.col("size"))
    # rows are flagged and counted, and only then dropped
    return materialize_observed(
        ignore_flags(files, root), "scan",
        lambda seen: classify(seen.where(kept & in_range(start, end))).drop("pruned", "ignored"),
        scanned=F.count_if(reached), ignored=F.count_if(reached & F.col("ignored")),
        changed=F.count(size), bytes=F.coalesce(F.sum(size), F.lit(0)))


def _ts(value) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, _dt.datetime):
        value = value.isoformat(sep=" ")
    elif isinstance(value, _dt.date):
        value = value.isoformat() + " 00:00:00"
    return F.to_timestamp_ntz(F.lit(str(value)))
