"""SimHash near-duplicates: tiled exact comparison of all fingerprints.

1. Fingerprints: words of the text with A-Z lower-cased, shingles of
   ``SHINGLE`` words, XXH64 (seed 42) of each; a bit is 1 when more than half
   of the hashes set it. One pass, in batches.
2. Distinct fingerprints are sorted by population count (whole and by
   quarter) and cut into tiles of at most ``TILE`` fingerprints of one
   population count. A tile's row holds the fingerprints as bytes and the
   range of its four quarter counts.
3. Two fingerprints at distance d differ by at most d in population count, and
   their quarter counts by at most d in sum. Tile pairs outside that bound are
   skipped before any fingerprint moves; the others meet in one row and are
   compared in full with numpy exclusive-or and bit counts.
4. A tile pair returns a spanning forest of its links, never all pairs of a
   group; alternating star contraction joins the forests into components.

No fingerprint or link passes through the driver. The comparison is exact, so
it stays quadratic in the number of distinct fingerprints; the bounds in 3
leave about a twentieth of the pairs at large sizes.

Defined cases: a null or blank text has fingerprint zero, linked like any
other; fewer words than a shingle hash as one sequence; rows without id get
the component of their fingerprint, and a component without any id has a null
component_id; repeated rows share a fingerprint and a component; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import (id_as_text, key, key_filter, materialize, python_ready,
                               text_or_empty, with_filter)
from quarry.llm.components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
TILE = 4096
_CHUNK = 1 << 15     # hashes whose bits are counted at once
_ROWS = 128          # rows of a tile compared at once


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, as a signed integer."""
    import xxhash
    words = text.encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    raw = np.frombuffer(b"".join([xxhash.xxh64_digest(g, SEED) for g in grams]), np.uint8)
    raw = raw.reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(raw), _CHUNK):
        ones += np.unpackbits(raw[at:at + _CHUNK], axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(raw))
    return int(bits.view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """k (row key), fp."""
    python_ready(docs)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch["text"]], np.int64)
            yield pd.DataFrame({"id": batch["id"], "h": batch["h"], "fp": fps})

    return (docs.select(key(id_col, text_col).alias("k"), text_or_empty(text_col).alias("text"))
            .select(id_as_text("k.id").alias("id"), "k.h", "text")
            .mapInPandas(run, "id string, h bigint, fp bigint")
            .select(F.struct(F.col("id").cast(id_type).alias("id"), "h").alias("k"), "fp"))


def _quarters(fp: str) -> list:
    return [F.bit_count(F.shiftrightunsigned(F.col(fp), 16 * q).bitwiseAND(0xFFFF)).alias(f"q{q}")
            for q in (3, 2, 1, 0)]


def tiles(fps: DataFrame, tile: int = TILE) -> DataFrame:
    """Distinct ``fp`` to rows of tile_id, pop, lo, hi (quarter ranges), fps."""
    cols = ["pop", "q3", "q2", "q1", "q0"]
    ordered = (fps.select("fp", F.bit_count("fp").alias("pop"), *_quarters("fp"))
               .repartitionByRange(*cols, "fp").sortWithinPartitions(*cols, "fp"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch])
            done = []
            for pop, group in held.groupby("pop", sort=True):
                whole = len(group) // tile * tile
                # the last population count may go on in the next batch
                end = len(group) if pop != held["pop"].iloc[-1] else whole
                done += [_tile(group.iloc[i:min(i + tile, end)]) for i in range(0, end, tile)]
                rest = group.iloc[end:]
            held = rest
            if done:
                yield pd.DataFrame(done)
        if held is not None and len(held):
            yield pd.DataFrame([_tile(held)])

    def _tile(rows: pd.DataFrame) -> dict:
        quarters = rows[cols[1:]].to_numpy(np.int32)
        values = rows["fp"].to_numpy(np.int64)
        return {"tile_id": int(values[0]), "pop": int(rows["pop"].iloc[0]),
                "lo": quarters.min(axis=0), "hi": quarters.max(axis=0), "fps": values.tobytes()}

    return ordered.mapInPandas(
        cut, "tile_id bigint, pop int, lo array<int>, hi array<int>, fps binary")


def tile_pairs(tiled: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): tiles that may hold fingerprints within ``radius``, each
    unordered pair once, every tile with itself too."""
    left = tiled.select(F.col("tile_id").alias("a"), F.col("lo").alias("alo"),
                        F.col("hi").alias("ahi"), F.col("pop").alias("apop"),
                        F.explode(F.sequence("pop", F.col("pop") + radius)).alias("pop"))
    right = tiled.select(F.col("tile_id").alias("b"), "pop", F.col("lo").alias("blo"),
                         F.col("hi").alias("bhi"))
    gap = sum((F.greatest(F.lit(0), F.col("alo")[i] - F.col("bhi")[i],
                          F.col("blo")[i] - F.col("ahi")[i]) for i in range(4)), F.lit(0))
    return (left.join(right, "pop")
            .where(((F.col("pop") > F.col("apop")) | (F.col("a") <= F.col("b"))) & (gap <= radius))
            .select("a", "b"))


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between two arrays of distinct
    fingerprints (the same array twice: within it)."""
    same = len(a) == len(b) and bool((a == b).all())
    nodes = a if same else np.concatenate([a, b])
    at_b = 0 if same else len(a)
    root = np.arange(len(nodes))
    links = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for start in range(0, len(a), _ROWS):
        near = np.bitwise_count(a[start:start + _ROWS, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        i, j = i + start, j + at_b
        if same:
            i, j = i[i < j], j[i < j]
        while len(i):
            open_ = root[i] != root[j]
            i, j = i[open_], j[open_]
            # one link for each pair of trees, then the trees' roots again
            _, first = np.unique(np.stack([root[i], root[j]]), axis=1, return_index=True)
            for x, y in zip(i[first].tolist(), j[first].tolist()):
                p, q = find(x), find(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    links.append((int(nodes[x]), int(nodes[y])))
            while not (root == root[root]).all():
                root = root[root]
            if not len(first):
                break
    return links


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(u, v): links that connect exactly the distinct ``fp`` values whose
    chain of distances stays within ``radius``."""
    tiled = materialize(tiles(fps, tile), "tiles")
    pairs = materialize(tile_pairs(tiled, radius), "tile-pairs")
    held = tiled.select("tile_id", "fps")
    met = (pairs.join(held.withColumnsRenamed({"tile_id": "a", "fps": "afps"}), "a")
           .join(held.withColumnsRenamed({"tile_id": "b", "fps": "bfps"}), "b"))
    # a pair costs the same wherever it runs: spread them evenly, few per task
    tasks = max(met.sparkSession.sparkContext.defaultParallelism, pairs.count() // 64)
    met = met.repartition(tasks, "a", "b").select("afps", "bfps")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for x, y in zip(batch["afps"], batch["bfps"]):
                found += forest(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), radius)
            rows = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({"u": rows[:, 0], "v": rows[:, 1]})

    return met.mapInPandas(compare, "u bigint, v bigint")


def simhash_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """k, fp, component_id, keep (key of the component's row with the least id,
    then least text hash), size (rows of the component): one row per input row."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    first = F.struct(F.col("k.id").isNull().alias("no_id"), "k")
    distinct = materialize(rows.groupBy("fp").agg(F.min(first).alias("first"),
                                                  F.count("*").alias("size")), "distinct-fp")
    roots = components(links(distinct.select("fp"), radius, tile))
    named = (distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
             .select("fp", "first", "size", F.coalesce("root", "fp").alias("root")))
    whole = named.groupBy("root").agg(F.min("first")["k"].alias("keep"), F.sum("size").alias("size"))
    of_fp = materialize(named.select("fp", "root").join(whole, "root")
                        .select("fp", "keep", "size"), "fp-components")
    return (rows.join(of_fp, "fp")
            .select("k", "fp", F.col("keep.id").alias("component_id"), "keep", "size"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits), component_id."""
    return (simhash_rows(docs, id_col, text_col, shingle, radius)
            .select(F.col("k.id").alias(id_col),
                    F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with its columns, one row of each component: the row with the
    least id (rows without id last, ties to the least text hash).

    Only rows of components with more than one row move to meet their
    decision; a bitmap of fixed size finds them, all others pass unshuffled.
    """
    found = materialize(simhash_rows(docs, id_col, text_col, shingle, radius).where("size > 1")
                        .select("k", (F.col("k") == F.col("keep")).alias("stays")).distinct(),
                        "near-copies")
    marked = with_filter(docs.select(F.struct("*").alias("d"), key(id_col, text_col).alias("k")),
                         key_filter(found, "k"), "k")
    cols = [F.col(f"d.`{c}`") for c in docs.columns]
    copy = F.row_number().over(Window.partitionBy("k").orderBy(F.lit(1)))
    met = (marked.where("hit").join(found, "k", "left").where("stays IS NULL OR stays")
           .withColumn("copy", copy).where("stays IS NULL OR copy = 1"))
    return marked.where("NOT hit").select(*cols).unionByName(met.select(*cols))
