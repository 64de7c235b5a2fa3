"""Range joins and window aggregates over dyadic ranges of time.

Time is cut into units of 2^UNIT_BITS microseconds, and 2^k units from a
multiple of 2^k on are the node (k, i) of a binary tree. A window is covered
by O(log n) nodes (a ten-year window by some forty), and its two end units
are edges, where the exact bounds decide. A row lies in one node of each level,
so a range join is a hash join on (level, node) with the rows entered once per
level that any window uses; no row is compared with the windows around it, and
a window's length does not matter.

Aggregates of overlapping windows do not go over (window, row) pairs: rows are
reduced to their unit, units to the nodes that windows ask for, and a window
merges its O(log n) nodes with the rows of its edges. The work is rows + units
x levels + windows x nodes, for any number of overlapping windows. Sums, least
and greatest values, flags, bounded sets and first-N lists all merge (they need
not subtract), and no step runs over all of time in one task.

Defined cases: a row without a time is in no window (but in the all scope); a
window whose end lies before its start has no rows; both ends are inclusive;
equal windows of different scopes are kept apart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import materialize

UNIT_BITS = 26          # units of 67 seconds
MAX_LEVEL = 63 - UNIT_BITS
ALL = "all"
# Nodes up to this size (counted, with their keys) are broadcast; larger sets
# are shuffled for the same join.
BROADCAST_BYTES = 16 << 20
_NODE_BYTES = 64        # of a node beside its scope id


def micros(time: Column) -> Column:
    """Microseconds of a time without a zone (the session's zone is UTC)."""
    return F.unix_micros(time.cast("timestamp"))


def unit_of(time: Column) -> Column:
    return F.shiftright(micros(time), UNIT_BITS)


def cover(windows: DataFrame) -> DataFrame:
    """scope_id, level, node, edge, lo, hi (the window's exact bounds): the
    nodes of the windows (scope_id, start_date, end_date)."""
    ends = windows.where("start_date <= end_date").select(
        "scope_id", micros(F.col("start_date")).alias("lo"), micros(F.col("end_date")).alias("hi"))
    first, last = F.shiftright("lo", UNIT_BITS), F.shiftright("hi", UNIT_BITS)
    node = lambda level, n, edge: F.struct(level.cast("int").alias("level"), n.alias("node"),
                                           F.lit(edge).alias("edge"))
    edges = F.array_distinct(F.array(node(F.lit(0), first, True), node(F.lit(0), last, True)))

    def at_level(k: Column) -> Column:
        # the units between the edges, as nodes of this level: from ceil to floor; a node
        # whose sibling lies outside can not be part of a larger one
        low = -F.call_function("shiftright", -(first + 1), k)
        high = F.call_function("shiftright", last, k) - 1
        some = low <= high
        return F.array(F.when(some & (low % 2 != 0), node(k, low, False)),
                       F.when(some & (high % 2 == 0), node(k, high, False)))

    inner = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(MAX_LEVEL)), at_level))
    return (ends.select("scope_id", "lo", "hi", F.explode(F.array_compact(F.concat(edges, inner))).alias("x"))
            .select("scope_id", "x.level", "x.node", "x.edge", "lo", "hi"))


@dataclass
class Selection:
    """Scopes as nodes. ``levels`` are those that occur (at most MAX_LEVEL + 1),
    ``has_all`` tells of a scope that takes every row."""
    nodes: DataFrame
    levels: list[int]
    has_all: bool
    n_bytes: int

    def hinted(self, nodes: DataFrame) -> DataFrame:
        return F.broadcast(nodes) if self.n_bytes <= BROADCAST_BYTES else nodes


def selection(windows: DataFrame, has_all: DataFrame | None = None) -> Selection:
    """The nodes of the windows, written once (all joins and aggregates read
    them), and one action that returns a row per level: which levels there are,
    how many bytes of nodes, and whether the frame ``has_all`` has a row."""
    nodes = cover(windows)
    if has_all is not None:
        mark = [F.lit(ALL).alias("scope_id"), F.lit(-1).alias("level"), F.lit(0).cast("bigint").alias("node"),
                F.lit(False).alias("edge"), *[F.lit(0).cast("bigint").alias(c) for c in ("lo", "hi")]]
        nodes = nodes.unionByName(has_all.limit(1).select(*mark))
    nodes = materialize(nodes, "nodes")
    found = {r["level"]: r["bytes"] for r in nodes.groupBy("level").agg(
        F.sum(F.octet_length("scope_id") + _NODE_BYTES).alias("bytes")).collect()}
    return Selection(nodes.where("level >= 0"), sorted(k for k in found if k >= 0), -1 in found, sum(found.values()))


def _entered(rows: DataFrame, unit: Column, levels: list[int]) -> DataFrame:
    """Each row once per level, with its node there."""
    every = F.array(*[F.lit(k) for k in levels]).cast("array<int>")
    return (rows.withColumn("_unit", unit).withColumn("level", F.explode(every))
            .withColumn("node", F.call_function("shiftright", F.col("_unit"), F.col("level"))).drop("_unit"))


def join(rows: DataFrame, s: Selection, time: str = "modified") -> DataFrame:
    """(scope, row) pairs: the columns of ``rows`` and scope_id."""
    nodes = s.nodes.select("scope_id", "level", "node", "lo", "hi")
    met = (_entered(rows.withColumn("_at", micros(F.col(time))), unit_of(F.col(time)), s.levels)
           .join(s.hinted(nodes), ["level", "node"])
           .where(F.col("_at").between(F.col("lo"), F.col("hi"))).select("scope_id", *rows.columns))
    return met.unionByName(rows.withColumn("scope_id", F.lit(ALL))) if s.has_all else met


def covered(s: Selection) -> DataFrame:
    """level, node, lo, hi: ranges that do not overlap and together are the
    windows. Nodes inside other nodes go; edges of one unit are merged."""
    inner = s.nodes.where("NOT edge").select("level", "node").distinct()

    def outside(nodes: DataFrame, least: int) -> DataFrame:
        """Without the nodes that lie in one of ``inner``, ``least`` levels up or more."""
        up = F.array(*[F.lit(k) for k in s.levels]).cast("array<int>")
        above = F.transform(F.filter(up, lambda k: k >= F.col("level") + least), lambda k: F.struct(
            k.alias("level"), F.call_function("shiftright", F.col("node"), k - F.col("level")).alias("node")))
        keys = nodes.columns
        inside = (nodes.select(F.struct(*keys).alias("_own"), F.explode(above).alias("x"))
                  .select("_own", "x.level", "x.node").join(inner, ["level", "node"]).select("_own").distinct())
        return nodes.join(inside, F.struct(*[nodes[k] for k in keys]) == inside["_own"], "left_anti")

    start = F.shiftleft(F.col("node"), UNIT_BITS)
    edges = s.nodes.where("edge").select(
        "level", "node", F.greatest("lo", start).alias("lo"),
        F.least("hi", start + ((1 << UNIT_BITS) - 1)).alias("hi")).distinct()
    by_start = Window.partitionBy("node").orderBy("lo", "hi")
    before = F.max("hi").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    edges = (outside(edges, 0).withColumn("opens", F.coalesce(F.col("lo") > before + 1, F.lit(True)).cast("int"))
             .withColumn("part", F.sum("opens").over(by_start))
             .groupBy("level", "node", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("part"))
    whole = outside(inner, 1).select("level", "node", F.lit(-(1 << 62)).alias("lo"), F.lit(1 << 62).alias("hi"))
    return whole.unionByName(edges)


def semi_join(rows: DataFrame, s: Selection, time: str = "modified") -> DataFrame:
    """The rows that any scope takes, each once."""
    if s.has_all:
        return rows
    return (_entered(rows.withColumn("_at", micros(F.col(time))), unit_of(F.col(time)), s.levels)
            .join(s.hinted(covered(s)), ["level", "node"])
            .where(F.col("_at").between(F.col("lo"), F.col("hi"))).select(*rows.columns))


# How the values of rows merge; sets are arrays (of one element, or none, in a row).
MERGES: dict[str, Callable[[str], Column]] = {
    "sum": F.sum, "max": F.max, "min": F.min, "any": F.bool_or,
    "set": lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))),
}


def aggregate(rows: DataFrame, s: Selection, values: dict[str, tuple[Column, str]],
              time: str = "modified") -> DataFrame:
    """scope_id and the merged ``values`` (name -> value of a row, how it
    merges) of every scope that has rows."""
    merge = [MERGES[how](name).alias(name) for name, (_, how) in values.items()]
    plain = rows.select(unit_of(F.col(time)).alias("unit"), micros(F.col(time)).alias("_at"),
                        *[(F.array_compact(F.array(v)) if how == "set" else v).alias(n)
                          for n, (v, how) in values.items()])
    units = plain.groupBy("unit").agg(*merge)
    inner = s.nodes.where("NOT edge").select("scope_id", "level", "node")
    edges = s.nodes.where("edge").select("scope_id", F.col("node").alias("unit"), "lo", "hi")
    names = list(values)
    nodes = (_entered(units, F.col("unit"), s.levels)
             .join(s.hinted(inner.select("level", "node").distinct()), ["level", "node"])
             .groupBy("level", "node").agg(*merge))
    parts = (inner.join(nodes, ["level", "node"]).select("scope_id", *names)
             .unionByName(plain.join(s.hinted(edges), "unit")
                          .where(F.col("_at").between(F.col("lo"), F.col("hi"))).select("scope_id", *names)))
    if s.has_all:
        parts = parts.unionByName(units.select(F.lit(ALL).alias("scope_id"), *names))
    return parts.groupBy("scope_id").agg(*merge)


def first_n(rows: DataFrame, s: Selection, n: int, by: str = "kind", order: str = "path",
            time: str = "modified") -> DataFrame:
    """The first ``n`` rows of every scope and ``by``, with scope_id and rank.
    A unit and a node hold at most n rows of each ``by``."""
    def limited(frame: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy(*keys, by).orderBy(order)
        return frame.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)

    columns = rows.columns
    plain = rows.withColumns({"unit": unit_of(F.col(time)), "_at": micros(F.col(time))})
    units = limited(plain, "unit").drop("rank", "_at")
    inner = s.nodes.where("NOT edge").select("scope_id", "level", "node")
    edges = s.nodes.where("edge").select("scope_id", F.col("node").alias("unit"), "lo", "hi")
    asked = s.hinted(inner.select("level", "node").distinct())
    nodes = limited(_entered(units, F.col("unit"), s.levels).join(asked, ["level", "node"]), "level", "node")
    parts = (inner.join(nodes, ["level", "node"]).select("scope_id", *columns)
             .unionByName(plain.join(s.hinted(edges), "unit")
                          .where(F.col("_at").between(F.col("lo"), F.col("hi"))).select("scope_id", *columns)))
    if s.has_all:
        parts = parts.unionByName(units.select(F.lit(ALL).alias("scope_id"), *columns))
    return limited(parts, "scope_id")
