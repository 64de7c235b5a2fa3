"""Approximate nearest neighbours: a forest of random-projection trees.

Fitting: ``TREES`` trees are grown on the driver over a bounded sample of the
vectors (``SAMPLE``, by a hash of the id). A node splits its sample by the
hyperplane between two of its points, at the median; a leaf keeps at most
``LEAF`` sample points. How many leaves a search must open is calibrated on
the sample: queries of the sample search it against brute force, and the
number rises until their recall reaches ``TARGET_RECALL``.

Indexing: every vector descends every tree. Equal vectors are indexed once,
with their k + 1 smallest ids (the window limit runs before the shuffle, so a
vector that stands a million times is a few rows), which loses no neighbour.

Searching: a query walks all trees through one shared priority queue ordered
by its squared distances to the splits it has crossed, and collects leaves. Queries and
points meet per leaf; a leaf returns the k + 1 best points of each query by
exact cosine on the original vectors in double precision, and the best k over
all leaves are the result. Big leaves are split by a salt, so a task holds a
bounded number of points and queries at any size of the table.

Defined cases: vectors that are null, empty, zero, of another length than the
table's most common one, or hold a null or non-finite component take no part,
neither as query nor as candidate; a row without id takes no part; rows that
repeat an id with the same vector count once, with another vector they are
candidates of their own; fewer candidates than k give fewer rows; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import hash_sample, materialize, python_ready

TREES = 3
LEAF = 24
SAMPLE = 50_000
TARGET_RECALL = 0.94
CALIBRATION_QUERIES = 200
SEED = 11
POINTS_PER_GROUP = 2048
QUERIES_PER_GROUP = 20_000
K = 5


@dataclass
class Tree:
    normal: np.ndarray     # (inner nodes, dimensions)
    offset: np.ndarray
    left: np.ndarray       # child: inner node number, or -1 - leaf number
    right: np.ndarray
    leaves: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of each row."""
        at = np.zeros(len(x), np.int64) if len(self.normal) else np.full(len(x), -1)
        open_ = np.flatnonzero(at >= 0)
        while len(open_):
            node = at[open_]
            side = np.einsum("ij,ij->i", x[open_], self.normal[node]) - self.offset[node]
            at[open_] = np.where(side <= 0, self.left[node], self.right[node])
            open_ = open_[at[open_] >= 0]
        return -1 - at


def grow(x: np.ndarray, rng: np.random.Generator, leaf: int = LEAF) -> Tree:
    normal, offset, left, right = [], [], [], []
    leaves = 0
    todo = [(np.arange(len(x)), None, None)]
    while todo:
        rows, parent, side = todo.pop()
        plane = _plane(x[rows], rng) if len(rows) > leaf else None
        if plane is None:
            number = -1 - leaves
            leaves += 1
        else:
            number = len(normal)
            n, o, low = plane
            normal.append(n)
            offset.append(o)
            left.append(0)
            right.append(0)
            todo += [(rows[low], number, left), (rows[~low], number, right)]
        if side is not None:
            side[parent] = number
    d = x.shape[1]
    return Tree(np.array(normal).reshape(-1, d), np.array(offset), np.array(left, np.int64),
                np.array(right, np.int64), leaves)


def _plane(x: np.ndarray, rng: np.random.Generator):
    """(normal, offset, low side) halving the points, None if none does."""
    for _ in range(5):
        a, b = x[rng.choice(len(x), 2, replace=False)]
        n = a - b
        size = np.linalg.norm(n)
        if size < 1e-12:
            continue
        n = n / size
        along = x @ n
        o = float(np.median(along))
        low = along <= o
        if 0 < low.sum() < len(x):
            return n, o, low
    return None


@dataclass
class Forest:
    trees: list[Tree]
    open_leaves: int

    def search(self, q: np.ndarray, n: int) -> list[tuple[int, int]]:
        """The first n leaves (tree, leaf) of the shared queue."""
        out = []
        queue = [(0.0, t, 0 if len(tree.normal) else -1) for t, tree in enumerate(self.trees)]
        side = [tree.normal @ q - tree.offset if len(tree.normal) else None for tree in self.trees]
        while queue and len(out) < n:
            far, t, node = heapq.heappop(queue)
            while node >= 0:
                tree, margin = self.trees[t], side[t][node]
                near, other = ((tree.left[node], tree.right[node]) if margin <= 0
                               else (tree.right[node], tree.left[node]))
                heapq.heappush(queue, (far + margin * margin, t, int(other)))
                node = int(near)
            out.append((t, -1 - node))
        return out


def fit(x: np.ndarray, seed: int = SEED, trees: int = TREES, k: int = K,
        target: float = TARGET_RECALL) -> Forest:
    """Forest over sample vectors of length one, with calibrated search."""
    rng = np.random.default_rng(seed)
    forest = Forest([grow(x, rng) for _ in range(trees)], 0)
    most = sum(t.leaves for t in forest.trees)
    queries = rng.choice(len(x), min(CALIBRATION_QUERIES, len(x)), replace=False)
    where = [t.leaf_of(x) for t in forest.trees]
    # rank in the queue of the first leaf that holds each true neighbour
    ranks = []
    for q in queries:
        score = x @ x[q]
        score[q] = -2
        near = np.argsort(-score, kind="stable")[:k]
        at = {leaf: i for i, leaf in enumerate(forest.search(x[q], most))}
        ranks += [min(at[(t, int(w[c]))] for t, w in enumerate(where)) for c in near if c != q]
    forest.open_leaves = int(np.quantile(ranks, target, method="higher")) + 1 if ranks else most
    return forest


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): rows that take part, vectors as doubles."""
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (vectors.select(F.col(id_col).cast("bigint").alias("id"),
                           F.col(vec_col).cast("array<double>").alias("vec"))
            .where(F.col("id").isNotNull() & (F.size("vec") > 0))
            .where(F.coalesce(good, F.lit(False)) & F.exists("vec", lambda x: x != 0)))
    sizes = rows.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("c"))
    common = sizes.orderBy(F.desc("c"), "n").limit(1).collect()
    return rows.where(F.size("vec") == (common[0]["n"] if common else 0))


def _unit(vectors) -> np.ndarray:
    x = np.stack(vectors).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of extreme values stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def ann_search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id",
               vec_col: str = "embedding", k: int = K, sample: int = SAMPLE) -> DataFrame:
    """One row per query and neighbour: query_id, rank, vec_id, score.

    ``is_query`` is an expression over the column ``id``.
    """
    spark = python_ready(vectors)
    rows = usable(vectors, id_col, vec_col)
    # equal vectors: one point with its k + 1 smallest ids
    by_vector = Window.partitionBy("vec").orderBy("id")
    points = materialize(
        rows.withColumn("n", F.dense_rank().over(by_vector)).where(F.col("n") <= k + 1)
        .groupBy("vec").agg(F.sort_array(F.collect_set("id")).alias("ids"))
        .select(F.col("ids")[0].alias("point"), "ids", "vec"), "ann-points")
    n_points = points.count()
    picked = hash_sample(points, sample, n_points, "point").select("vec").toPandas()["vec"]
    if not n_points:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    forest = fit(_unit(picked.tolist()), k=k)
    held = spark.sparkContext.broadcast(forest)
    queries = materialize(rows.where(is_query).distinct(), "ann-queries")
    # neighbouring leaves of a tree form a bucket of some POINTS_PER_GROUP points; beyond
    # that a leaf's points are salted, and its queries fall into blocks
    leaves = max(t.leaves for t in forest.trees)
    per_bucket = max(1, POINTS_PER_GROUP * leaves // n_points)
    salts = -(-n_points // (leaves * POINTS_PER_GROUP))
    share = forest.open_leaves / sum(t.leaves for t in forest.trees)
    blocks = 1 + int(queries.count() * min(1.0, share * per_bucket) // QUERIES_PER_GROUP)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _unit(batch["vec"].tolist())
            for t, tree in enumerate(held.value.trees):
                leaf = tree.leaf_of(x)
                for block in range(blocks):
                    yield pd.DataFrame({
                        "tree": t, "bucket": leaf // per_bucket, "salt": batch["point"] % salts,
                        "block": block, "query": None, "leaves": [[n] for n in leaf.tolist()],
                        "ids": batch["ids"], "vec": batch["vec"]})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for query, vec in zip(batch["id"], batch["vec"]):
                found: dict[tuple, list] = {}
                for t, n in held.value.search(_unit([vec])[0], held.value.open_leaves):
                    found.setdefault((t, n // per_bucket), []).append(n)
                at = [(t, b, s, n) for (t, b), n in found.items() for s in range(salts)]
                yield pd.DataFrame({
                    "tree": [a[0] for a in at], "bucket": [a[1] for a in at],
                    "salt": [a[2] for a in at], "block": query // 7 % blocks, "query": query,
                    "leaves": [a[3] for a in at], "ids": None, "vec": [vec] * len(at)})

    schema = ("tree int, bucket bigint, salt bigint, block bigint, query bigint, "
              "leaves array<bigint>, ids array<bigint>, vec array<double>")
    met = points.mapInPandas(index, schema).unionByName(queries.mapInPandas(ask, schema))

    def rerank(group: pd.DataFrame) -> pd.DataFrame:
        asked, there = group[group["query"].notna()], group[group["query"].isna()]
        out: list[tuple[int, int, float]] = []
        if len(asked) and len(there):
            x, ids = _unit(there["vec"].tolist()), there["ids"].tolist()
            least = int(group["bucket"].iloc[0]) * per_bucket
            leaf = np.array([n[0] for n in there["leaves"]]) - least
            for start in range(0, len(asked), 256):
                part = asked.iloc[start:start + 256]
                opened = np.zeros((len(part), per_bucket), bool)
                for i, n in enumerate(part["leaves"]):
                    opened[i, np.asarray(n) - least] = True
                score = np.where(opened[:, leaf], _unit(part["vec"].tolist()) @ x.T, -2.0)
                for row, query in zip(score, part["query"].astype("int64").tolist()):
                    # k + 1 points: one of them may be the query's own
                    floor = max(np.partition(row, -k - 1)[-k - 1] if len(row) > k else -2.0, -1.5)
                    own = [(-float(row[p]), i) for p in np.flatnonzero(row >= floor)
                           for i in ids[p] if i != query]
                    out += [(query, i, -s) for s, i in sorted(own)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    hits = met.groupBy("tree", "bucket", "salt", "block").applyInPandas(
        rerank, "query_id bigint, vec_id bigint, score double")
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
