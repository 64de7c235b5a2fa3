"""The folder inventory as a Spark data source (S1, S2)::

    register(spark)
    spark.read.format("workspace").load("/data/ws").where("modified >= ...")

Columns as in ``sources.workspace``; ignored files are left out unless the
option ``includeIgnored`` is true. The planner opens directories, breadth
first, until there are ``minPartitions`` of them (or no more), and keeps no
names: a partition is a part of the tree that a task walks itself, and a
directory with more than ``filesPerPartition`` entries is dealt over several
tasks by the hash of the names, each of which stats its own names only.

With ``spark.sql.python.filterPushdown.enabled`` comparisons of ``modified``
and prefixes of ``path`` are pushed into the reader: names outside a prefix are
not stat'ed, subtrees outside are not entered, and files outside the window
never leave the task.
"""

from __future__ import annotations

import datetime as dt
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan,
                                    GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual,
                                    StringStartsWith)

from quarry.sources.workspace import SCHEMA, _entries, classify, should_ignore

_COMPARE = {GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y,
            LessThan: lambda x, y: x < y, LessThanOrEqual: lambda x, y: x <= y, EqualTo: lambda x, y: x == y}


@dataclass
class Part(InputPartition):
    """Directories of one task. ``deep`` ones are walked, of the others only the
    own files are read, those of share ``k`` of ``of``."""
    directories: tuple[str, ...]
    deep: bool
    k: int = 0
    of: int = 1

    def __hash__(self):
        return hash((self.directories, self.deep, self.k, self.of))


def _naive(value) -> dt.datetime:
    return value.replace(tzinfo=None) if isinstance(value, dt.datetime) else value


class WorkspaceReader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.realpath(options["path"])
        if not os.path.isdir(self.root):
            raise ValueError(f"Workspace path does not exist or is not a directory: {self.root}")
        self.include_ignored = str(options.get("includeIgnored", "false")).lower() == "true"
        self.min_partitions = int(options.get("minPartitions", 32))
        self.per_partition = int(options.get("filesPerPartition", 2000))
        self.tests: list[tuple[type, dt.datetime]] = []
        self.prefixes: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if f.attribute == ("modified",) and type(f) in _COMPARE and isinstance(f.value, dt.datetime):
                self.tests.append((type(f), _naive(f.value)))
            elif f.attribute == ("path",) and isinstance(f, StringStartsWith):
                self.prefixes.append(f.value)
            else:
                yield f  # left to Spark

    def _wanted(self, directory: str) -> bool:
        """Whether a path below the directory can have every prefix."""
        below = directory + "/"
        return all(below.startswith(p) or p.startswith(below) for p in self.prefixes)

    def partitions(self) -> list[Part]:
        frontier, own = [self.root], []
        while frontier and len(frontier) < self.min_partitions:
            below = []
            for directory in frontier:
                n = 0
                for _, name, enter in _entries(directory):
                    n += not enter
                    if enter and self._wanted(child := os.path.join(directory, name)):
                        below.append(child)
                if n:
                    shares = -(-n // self.per_partition)
                    own += [Part((directory,), False, k, shares) for k in range(shares)]
            frontier = below
        n_tasks = max(1, min(len(frontier), 4 * self.min_partitions))
        return own + [Part(tuple(frontier[k::n_tasks]), True) for k in range(n_tasks) if frontier[k::n_tasks]]

    def read(self, partition: Part) -> Iterator[tuple]:
        queue = list(partition.directories)
        while queue:
            directory = queue.pop()
            for _, name, enter in _entries(directory):
                path = os.path.join(directory, name)
                if enter:
                    if partition.deep and self._wanted(path):
                        queue.append(path)
                elif partition.of == 1 or zlib.crc32(os.fsencode(name)) % partition.of == partition.k:
                    row = self._row(path, name)
                    if row is not None:
                        yield row

    def _row(self, path: str, name: str) -> tuple | None:
        if not all(path.startswith(p) for p in self.prefixes):
            return None
        ignored = should_ignore(path, name)
        if ignored and not self.include_ignored:
            return None
        try:
            st = os.stat(path)
        except OSError:  # vanished or unreadable: skipped
            return None
        modified = dt.datetime.fromtimestamp(st.st_mtime)
        if not all(_COMPARE[kind](modified, value) for kind, value in self.tests):
            return None
        i = name.rfind(".")
        return (path, name, classify(name), modified, st.st_size, ignored,
                name[i:] if 0 < i < len(name) - 1 else "")


class WorkspaceDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workspace"

    def schema(self) -> str:
        return SCHEMA + ", suffix STRING"

    def reader(self, schema) -> WorkspaceReader:
        return WorkspaceReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes ``format("workspace")`` known, with its filters pushed down."""
    from quarry.session import ship_package
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkspaceDataSource)
