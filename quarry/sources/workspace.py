"""A folder tree as the ``files`` table.

    files = read_workspace(spark, "/data/ws")

The tree must be mounted at the same path on every executor. Listing is
breadth first: every level is one job in which tasks open the level's
directories, drop the ignored ones and write the entries' names as a table
under the checkpoint folder, so each directory is read once, by one task, in
bounded batches, and no list of names passes through the driver. The names are
then dealt over tasks of about ``filesPerPartition`` files, which stat them: a
directory that holds most of the files is stat'ed by many tasks.

Columns: path, name, file_type, modified (naive local time, microseconds),
size, ignored, suffix. File contents are no part of the inventory; the parse
stage (``quarry.operators.parse``) opens each file once. Hidden and
``_``-prefixed names and zero-byte files are kept. A link to a directory is
neither a file nor entered. Ignored files are dropped unless
``includeIgnored`` is true (for scan counters). ``start`` / ``end`` restrict
the inclusive modification window.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import file_suffix
from quarry.operators.scan import FILE_TYPES, IGNORE_PATTERNS
from quarry.session import materialize, ship_package

SCHEMA = ("path STRING, name STRING, file_type STRING, modified TIMESTAMP_NTZ, size BIGINT, "
          "ignored BOOLEAN")
BATCH = 4096

_GLOBS = [p[1:] for p in IGNORE_PATTERNS if p.startswith("*")]


def should_ignore(abs_path: str, name: str) -> bool:
    """P1 on one absolute path: pattern substring, or glob suffix of the name."""
    return any(p in abs_path for p in IGNORE_PATTERNS) or any(name.endswith(g) for g in _GLOBS)


def classify(name: str) -> str:
    i = name.rfind(".")
    suffix = name[i:] if 0 < i < len(name) - 1 else ""
    return FILE_TYPES.get(suffix.lower(), "other")


def _entries(directory: str) -> Iterator[tuple[str, str, bool]]:
    """(directory, name, is a directory to enter) of one directory."""
    try:
        with os.scandir(directory) as found:
            for entry in found:
                if not entry.is_dir():
                    yield directory, entry.name, False
                elif (not entry.is_symlink()
                      and not should_ignore(os.path.join(directory, entry.name), entry.name)):
                    yield directory, entry.name, True
    except OSError:  # vanished or unreadable: skipped, like the walk it models
        return


def _list_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["directory", "name", "enter"]
    for batch in batches:
        rows: list[tuple] = []
        for directory in batch["directory"]:
            for row in _entries(directory):
                rows.append(row)
                if len(rows) == BATCH:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
        yield pd.DataFrame(rows, columns=columns)


def _stat_fn(include_ignored: bool, start: dt.datetime | None, end: dt.datetime | None):
    def row(directory: str, name: str):
        path = os.path.join(directory, name)
        ignored = should_ignore(path, name)
        if ignored and not include_ignored:
            return None
        try:
            st = os.stat(path)
        except OSError:
            return None
        modified = dt.datetime.fromtimestamp(st.st_mtime)
        if (start is not None and modified < start) or (end is not None and modified > end):
            return None
        return path, name, classify(name), modified, st.st_size, ignored

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [r for r in map(row, batch["directory"], batch["name"]) if r is not None]
            yield pd.DataFrame(found, columns=["path", "name", "file_type", "modified", "size",
                                               "ignored"]).astype({"modified": "datetime64[us]"})
    return run


def _parse_ts(value) -> dt.datetime | None:
    if value in (None, ""):
        return None
    return dt.datetime.fromisoformat(str(value).replace("T", " "))


def read_workspace(spark: SparkSession, root: str, includeIgnored: bool = False,
                   start: str | None = None, end: str | None = None,
                   filesPerPartition: int = 2000) -> DataFrame:
    """The inventory of the tree below ``root``, written once under the
    checkpoint folder (the branches of a run all read it)."""
    root = os.path.realpath(root)
    if not os.path.isdir(root):
        raise ValueError(f"Workspace path does not exist or is not a directory: {root}")
    ship_package(spark)
    tasks = spark.sparkContext.defaultParallelism
    level = spark.createDataFrame([(root,)], "directory STRING")
    names = None
    while True:
        listed = materialize(
            level.repartition(tasks, "directory")
            .mapInPandas(_list_level, "directory STRING, name STRING, enter BOOLEAN"), "listing")
        here = listed.where("NOT enter").select("directory", "name")
        names = here if names is None else names.unionByName(here)
        below = listed.where("enter").select(
            F.concat("directory", F.lit("/"), "name").alias("directory"))
        n_below = below.count()
        if not n_below:
            break
        level = below
        tasks = max(spark.sparkContext.defaultParallelism, n_below // BATCH)
    tasks = max(spark.sparkContext.defaultParallelism, -(-names.count() // filesPerPartition))
    rows = names.repartition(tasks, "directory", "name").mapInPandas(
        _stat_fn(includeIgnored, _parse_ts(start), _parse_ts(end)), SCHEMA)
    return materialize(rows.withColumn("suffix", file_suffix(F.col("name"))), "inventory")
