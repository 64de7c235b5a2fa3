"""Vector collection operators.

A collection is a parquet table of points: ``point_id``, ``embedding``
(ARRAY<FLOAT>, dimension fixed per collection), ``file_path``,
``content_preview`` and ``metadata``. Search is exact cosine similarity:

* one query: the score is a JVM expression over the array column and
  ``orderBy(score desc).limit(k)`` becomes a per-partition top-k
  (TakeOrderedAndProject);
* many queries: chunks of points meet blocks of queries in numpy; a task keeps
  the k best of each query, and one row_number window (WindowGroupLimit) merges
  the tasks. No query x point pair table is ever materialised;
* a collection that is searched often: ``PivotIndex`` stores unit vectors and
  norms once and skips the parts that the triangle inequality rules out.

The default text embedder is a hashed bag of words: lower-cased words
(Python ``str.split`` whitespace) are hashed into buckets with md5 and the
count vector is L2-normalised. It runs as an Arrow batch job in the slot a
sentence-embedding model would take (no shuffle; numpy per batch).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import WS_CLASS

DEFAULT_DIM = 384
EMBEDDER = "hashed-words-md5"
DEFAULT_K = 5
# Floats of the queries that meet a chunk of points at once.
QUERY_BLOCK_FLOATS = 1_000_000

POINTS = T.StructType([
    T.StructField("point_id", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("file_path", T.StringType()),
    T.StructField("content_preview", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])


# ------------------------------------------------------------------ V1 text

def index_text() -> Column:
    """V1: summary, preview, then ``key: value`` lines; empty parts dropped."""
    parts = F.concat(F.array(F.col("summary"), F.col("content_preview")),
                     F.coalesce(F.col("detail_lines"), F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n")


# ------------------------------------------------------------- V2 embedding

SPARSE = T.StructType([T.StructField("indices", T.ArrayType(T.IntegerType())),
                       T.StructField("weights", T.ArrayType(T.DoubleType()))])


def bucket(word: str, dim: int) -> int:
    """The dimension that a word counts in."""
    import hashlib
    return int(hashlib.md5(word.encode("utf-8")).hexdigest()[:8], 16) % dim


BUCKET_CACHE = 200_000  # words whose bucket a task remembers


class _Buckets(dict):
    """Buckets of the words a task has met, within a bound."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) >= BUCKET_CACHE:
            self.clear()
        found = self[word] = bucket(word, self.dim)
        return found


def hashed_vector(text: str, dim: int, buckets: "_Buckets | None" = None):
    """L2-normalised bucket counts of ``text.lower().split()`` (Python white
    space, the same rule as the word counts)."""
    import numpy as np
    buckets = _Buckets(dim) if buckets is None else buckets
    counts = np.bincount(np.array([buckets[w] for w in text.lower().split()], dtype=np.int64),
                         minlength=dim).astype(np.float64)
    norm = float(np.sqrt((counts * counts).sum()))
    return counts / norm if norm > 0 else counts


def _embed_fn(text: str, dim: int, dense: bool, arrow_schema):
    """mapInArrow body: the hashed vector of each row's text."""
    import numpy as np
    import pyarrow as pa

    def shaped(vector):
        if dense:
            return vector.tolist()
        at = np.nonzero(vector)[0]
        return {"indices": at.astype(np.int32).tolist(), "weights": vector[at].tolist()}

    def run(batches):
        buckets = _Buckets(dim)
        for batch in batches:
            vectors = [None if t is None else shaped(hashed_vector(t, dim, buckets))
                       for t in batch.column(text).to_pylist()]
            arr = pa.array(vectors, type=arrow_schema.field(len(arrow_schema) - 1).type)
            yield pa.RecordBatch.from_arrays(list(batch.columns) + [arr], schema=arrow_schema)
    return run


def _with_vector(df: DataFrame, text: str, out: str, dim: int, dense: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    out_type = T.ArrayType(T.DoubleType()) if dense else SPARSE
    schema = T.StructType(df.schema.fields + [T.StructField(out, out_type)])
    return df.mapInArrow(_embed_fn(text, dim, dense, to_arrow_schema(schema)), schema)


def with_sparse(df: DataFrame, text: str, out: str, dim: int = DEFAULT_DIM) -> DataFrame:
    """Adds ``out`` = struct(indices ARRAY<INT>, weights ARRAY<DOUBLE>), the
    normalised non-zero buckets of the hashed embedding of column ``text``."""
    return _with_vector(df, text, out, dim, dense=False)


def with_embedding(df: DataFrame, text: str, out: str = "embedding",
                   dim: int = DEFAULT_DIM) -> DataFrame:
    """Adds the dense hashed embedding (ARRAY<DOUBLE>, length ``dim``)."""
    return _with_vector(df, text, out, dim, dense=True)


def sparse_rows(df: DataFrame, id_col: str, text: str, dim: int = DEFAULT_DIM) -> DataFrame:
    """id_col, bucket, weight: the non-zero buckets of the hashed embedding as
    rows, in the JVM. Counts are summed before they move; rows that repeat an
    id count as one text, a null text has none."""
    words = F.split(F.lower(F.col(text)), f"[{WS_CLASS}]+")
    place = F.conv(F.substring(F.md5(F.col("word")), 1, 8), 16, 10).cast("bigint") % dim
    counts = (df.select(id_col, F.explode(words).alias("word")).where("word != ''")
              .groupBy(id_col, place.cast("int").alias("bucket")).agg(F.count("*").alias("n")))
    whole = Window.partitionBy(id_col)
    return counts.select(id_col, "bucket", (
        F.col("n") / F.sqrt(F.sum((F.col("n") * F.col("n")).cast("double")).over(whole))).alias("weight"))


# ------------------------------------------------------------ V3 write/read

def point_id(file_path: Column, content: Column) -> Column:
    """Deterministic id (a retried task writes the same id)."""
    return F.sha2(F.concat_ws("\u0000", file_path, content), 256)


def make_points(docs: DataFrame, dim: int = DEFAULT_DIM, embedder=None) -> DataFrame:
    """V3 batch index: rows need ``file_path`` and ``content``; ``metadata`` optional.

    Rows lacking a path or content are skipped; the stored preview is the
    first 500 characters of the indexed text. ``embedder(df, text_col,
    out_col)`` replaces the hashed embedder (e.g. a model applied with
    ``predict_batch_udf``).
    """
    embedder = embedder or (lambda df, c, o: with_embedding(df, c, o, dim))
    meta = (F.col("metadata") if "metadata" in docs.columns
            else F.create_map().cast("map<string,string>"))
    kept = docs.filter(F.col("file_path").isNotNull() & F.col("content").isNotNull()
                       & (F.col("content") != ""))
    kept = kept.select("file_path", "content", meta.alias("metadata"))
    return embedder(kept, "content", "embedding").select(
        point_id(F.col("file_path"), F.col("content")).alias("point_id"),
        "embedding", "file_path",
        F.substring("content", 1, 500).alias("content_preview"),
        "metadata",
    )


def delete_file(points: DataFrame, file_path: str) -> DataFrame:
    """V7: the collection without any point of ``file_path`` (all of them)."""
    return points.filter(F.col("file_path").isNull() | (F.col("file_path") != F.lit(file_path)))


def collection_info(points: DataFrame, name: str = "local_rag") -> DataFrame:
    """V8: name, point and vector counts, dimension, status."""
    return points.agg(
        F.lit(name).alias("collection_name"),
        F.count(F.lit(1)).alias("points_count"),
        F.count("embedding").alias("vectors_count"),
        F.count("embedding").alias("indexed_vectors_count"),
        F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimension"),
        F.lit("green").alias("status"),
    )


# ------------------------------------------------------------------- search

def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector has zero norm."""
    den = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(den > 0, _dot(a, b) / den).otherwise(F.lit(0.0))


def search(points: DataFrame, query: list[float], k: int = DEFAULT_K,
           threshold: float | None = None, id_col: str = "point_id",
           vector_col: str = "embedding") -> DataFrame:
    """V4-V6 for one query vector: top-k by score (ties by id)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = points.withColumn("score", F.round(cosine(F.col(vector_col), q), SCORE_DIGITS))
    if threshold is not None:
        scored = scored.filter(F.col("score") >= F.lit(threshold))
    return scored.orderBy(F.col("score").desc(), F.col(id_col)).limit(k)


def _unit_rows(flat, n: int):
    """n vectors of length one (zero vectors stay zero) from their components."""
    import numpy as np
    rows = np.asarray(flat, dtype=np.float64).reshape(n, -1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _pack_fn(id_col: str, vector_col: str, arrow_schema):
    """mapInArrow body: each batch as one row of ids and unit vectors."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(vector_col).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pydict(
                    {"ids": [batch.column(id_col).to_pylist()],
                     "vectors": [_unit_rows(flat, batch.num_rows).tobytes()], "bounds": [None]},
                    schema=arrow_schema)
    return run


def best_of_chunk(score, ids: list, k: int, threshold: float | None, positive: bool) -> list[int]:
    """Places of exactly k scores by (score, id), the order of the final
    ranking: what a chunk leaves out can not rank among the k of the table."""
    import numpy as np
    keep = np.nonzero(score > 0)[0] if positive else np.arange(len(ids))
    if threshold is not None:
        keep = keep[score[keep] >= threshold]
    if keep.size > k:
        kth = np.partition(-score[keep], k - 1)[k - 1]
        over, tied = keep[-score[keep] < kth], keep[-score[keep] == kth]
        tied = sorted(tied.tolist(), key=lambda i: ids[i])[:k - len(over)]
        return over.tolist() + tied
    return keep.tolist()


def _unskipped(q_far, low, high, kth):
    """Queries that a part of a chunk may still help: the triangle inequality
    over the distances to the pivots bounds every score in it."""
    import numpy as np
    apart = np.maximum(np.maximum(low - q_far, q_far - high).max(axis=1), 0.0)
    return np.nonzero(1.0 - apart * apart / 2.0 >= kth - SCORE_SLACK)[0]


def _meet_fn(id_col: str, k: int, threshold: float | None, positive: bool, arrow_schema,
             pivots=None, count: bool = False):
    """mapInArrow body: chunks of points against blocks of queries. A task keeps
    the k best of each query and returns them at its end; with ``count`` it
    returns how many (part, query) meetings there were and how many were skipped.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        blocks, met, skipped = {}, 0, 0
        for batch in batches:
            for row in range(batch.num_rows):
                name = batch.column("b")[row].as_py()
                if name not in blocks:
                    block = batch.column("block")[row].as_py()
                    q = _unit_rows([q["v"] for q in block], len(block))
                    far = None if pivots is None else distances(q, pivots)
                    if far is not None:  # a zero vector scores 0 everywhere: no bound holds for it
                        far[~q.any(axis=1)] = np.nan
                    blocks[name] = ([q["qid"] for q in block], q, far,
                                    np.full(len(block), -np.inf), [[] for _ in block])
                qids, q, far, kth, best = blocks[name]
                ids = batch.column("ids")[row].as_py()
                points = np.frombuffer(batch.column("vectors")[row].as_py()).reshape(len(ids), -1)
                bounds = batch.column("bounds")[row].as_py() or []
                parts = [(p["size"], np.array(p["low"]), np.array(p["high"])) for p in bounds] or [(len(ids), None, None)]
                end = 0
                for size, low, high in parts:
                    start, end = end, end + size
                    some = np.arange(len(qids))
                    if low is not None and len(low):
                        some = np.union1d(_unskipped(far, low, high, kth), np.nonzero(np.isnan(far[:, 0]))[0])
                    met, skipped = met + len(qids), skipped + len(qids) - len(some)
                    if not len(some):
                        continue
                    # scores are compared at 1e-9: summation order must not break ties
                    score = np.round(points[start:end] @ q[some].T, SCORE_DIGITS)
                    for j in np.nonzero(score.max(axis=0) >= kth[some])[0].tolist():
                        i, own = int(some[j]), score[:, j]
                        near = [(-float(own[x]), ids[start + x])
                                for x in best_of_chunk(own, ids[start:end], k, threshold, positive)]
                        best[i] = sorted(best[i] + near)[:k]
                        if len(best[i]) == k:
                            kth[i] = -best[i][-1][0]
        if count:
            yield pa.RecordBatch.from_pydict({"met": [met], "skipped": [skipped]}, schema=arrow_schema)
            return
        for qids, _, _, _, best in blocks.values():
            out = [(qid, point, -score) for qid, found in zip(qids, best) for score, point in found]
            yield pa.RecordBatch.from_pydict(
                {"query_id": [o[0] for o in out], id_col: [o[1] for o in out],
                 "score": [o[2] for o in out]}, schema=arrow_schema)
    return run


SCORE_SLACK = 1e-8  # scores are rounded, and so are the distances that bound them
SCORE_DIGITS = 9


def search_batch(points: DataFrame, queries: DataFrame, k: int = DEFAULT_K,
                 threshold: float | None = None, id_col: str = "point_id",
                 vector_col: str = "embedding", query_id_col: str = "query_id",
                 query_vector_col: str = "embedding", positive: bool = False) -> DataFrame:
    """V4 for many queries: (query_id, id, score, rank), rank <= k.

    Points are packed into chunks (a row of ids and unit vectors per Arrow
    batch) and queries into blocks of at most about ``QUERY_BLOCK_FLOATS``
    floats; every chunk meets every block in numpy. A task keeps the k best of
    each query and returns them once; one window merges the tasks. One block is
    broadcast, more are Spark's choice; no query passes through the driver.
    ``positive`` leaves out scores of zero and below before ranking. Vectors of
    another dimension than the queries' fail the job.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    blocks, dim = _query_blocks(queries, query_id_col, query_vector_col)
    packed_schema = _packed(points.schema[id_col].dataType)
    packed = (points.filter(F.col(vector_col).isNotNull())
              .select(id_col, of_dimension(vector_col, dim).alias(vector_col))
              .mapInArrow(_pack_fn(id_col, vector_col, to_arrow_schema(packed_schema)), packed_schema))
    return _ranked(packed, blocks, k, threshold, positive, id_col, queries.schema[query_id_col].dataType)


def of_dimension(vector_col: str, dim: int) -> Column:
    return F.when(F.size(vector_col) == dim, F.col(vector_col)).otherwise(
        F.raise_error(F.lit(f"embedding dimension must be {dim}")))


def _packed(id_type: T.DataType) -> T.StructType:
    bounds = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("low", T.ArrayType(T.DoubleType())),
                           T.StructField("high", T.ArrayType(T.DoubleType()))])
    return T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("vectors", T.BinaryType()),
                         T.StructField("bounds", T.ArrayType(bounds))])


def _query_blocks(queries: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """b, block (qid and v of some queries), and the queries' dimension."""
    q = queries.select(F.col(id_col).alias("qid"), F.col(vector_col).alias("v"))
    size = q.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    dim = size["dim"] or 0
    n_blocks = max(1, -(-size["n"] * dim // QUERY_BLOCK_FLOATS))
    blocks = (q.groupBy(F.pmod(F.xxhash64("qid"), F.lit(n_blocks)).alias("b"))
              .agg(F.collect_list(F.struct("qid", F.col("v").cast("array<double>").alias("v")))
                   .alias("block")))
    return (F.broadcast(blocks) if n_blocks == 1 else blocks), dim


def _ranked(packed: DataFrame, blocks: DataFrame, k: int, threshold: float | None, positive: bool,
            id_col: str, query_id_type: T.DataType, pivots=None) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    id_type = packed.schema["ids"].dataType.elementType
    out_schema = T.StructType([T.StructField("query_id", query_id_type), T.StructField(id_col, id_type),
                               T.StructField("score", T.DoubleType())])
    candidates = packed.crossJoin(blocks).mapInArrow(
        _meet_fn(id_col, k, threshold, positive, to_arrow_schema(out_schema), pivots), out_schema)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(id_col))
    return candidates.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# -------------------------------------------------------------- pivot index

N_PIVOTS = 16
PIVOT_SAMPLE = 2_000    # vectors that the pivots are chosen from
PART_ROWS = 128         # points that share bounds
CHUNK_FLOATS = 500_000  # of a row of the index


def distances(rows, pivots):
    """Euclidean distances of unit vectors (rows) to unit pivots."""
    import numpy as np
    return np.sqrt(np.maximum(2.0 - 2.0 * rows @ pivots.T, 0.0))


def choose_pivots(sample, n: int = N_PIVOTS):
    """Farthest-first among the vectors of a sample that are not zero."""
    import numpy as np
    rows = _unit_rows(sample, len(sample)) if len(sample) else np.zeros((0, 1))
    rows = rows[rows.any(axis=1)]
    if not len(rows):
        return np.zeros((0, rows.shape[1]))
    chosen, near = [0], distances(rows, rows[:1])[:, 0]
    while len(chosen) < min(n, len(rows)) and near.max() > 1e-6:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(rows, rows[chosen[-1:]])[:, 0])
    return rows[chosen]


class PivotIndex:
    """Points as unit vectors with their norms stored, ordered by their nearest
    pivot and distance to it, in parts of at most ``PART_ROWS`` points with the
    least and greatest distance to every pivot.

    A search skips a part for a query when the triangle inequality keeps all
    its scores below the query's k-th best of the task; results are exact. Zero
    vectors score 0 and lie in parts without bounds. The pivots come from a
    sample of ``PIVOT_SAMPLE`` vectors by a hash of the id; every point is in
    the index. ``chunks`` is written under the checkpoint folder.
    """

    def __init__(self, points: DataFrame, id_col: str = "point_id", vector_col: str = "embedding"):
        from pyspark.sql.pandas.types import to_arrow_schema

        from quarry.session import materialize
        self.id_col = id_col
        rows = points.filter(F.col(vector_col).isNotNull()).select(id_col, F.col(vector_col).alias("v"))
        some = rows.orderBy(F.xxhash64(F.col(id_col).cast("string"))).limit(PIVOT_SAMPLE).select("v").collect()
        self.dim = len(some[0]["v"]) if some else 0
        self.pivots = choose_pivots([r["v"] for r in some])
        schema = T.StructType([points.schema[id_col], T.StructField("v", T.BinaryType()),
                               T.StructField("norm", T.DoubleType()), T.StructField("cell", T.IntegerType()),
                               T.StructField("near", T.DoubleType())])
        placed = (rows.withColumn("v", of_dimension("v", self.dim))
                  .mapInArrow(_place_fn(id_col, self.pivots, to_arrow_schema(schema)), schema))
        # by range, so that a crowded cell is many tasks' work
        ordered = placed.repartitionByRange("cell", "near", id_col).sortWithinPartitions("cell", "near", id_col)
        packed = _packed(points.schema[id_col].dataType)
        packed = T.StructType([*packed.fields, T.StructField("norms", T.ArrayType(T.DoubleType()))])
        self.chunks = materialize(ordered.mapInArrow(
            _chunk_fn(id_col, self.pivots, max(1, CHUNK_FLOATS // max(self.dim, 1)), to_arrow_schema(packed)),
            packed), "pivot-index")

    def search(self, queries: DataFrame, k: int = DEFAULT_K, threshold: float | None = None,
               query_id_col: str = "query_id", query_vector_col: str = "embedding",
               positive: bool = False) -> DataFrame:
        """What ``search_batch`` gives over the indexed points."""
        blocks = self._blocks(queries, query_id_col, query_vector_col)
        return _ranked(self.chunks.drop("norms"), blocks, k, threshold, positive, self.id_col,
                       queries.schema[query_id_col].dataType, self.pivots)

    def skipped(self, queries: DataFrame, k: int = DEFAULT_K, query_id_col: str = "query_id",
                query_vector_col: str = "embedding") -> DataFrame:
        """met, skipped: (part, query) meetings of a search, and those it skipped."""
        from pyspark.sql.pandas.types import to_arrow_schema
        blocks = self._blocks(queries, query_id_col, query_vector_col)
        schema = T.StructType([T.StructField("met", T.LongType()), T.StructField("skipped", T.LongType())])
        return (self.chunks.drop("norms").crossJoin(blocks)
                .mapInArrow(_meet_fn(self.id_col, k, None, False, to_arrow_schema(schema), self.pivots, True), schema)
                .agg(F.sum("met").alias("met"), F.sum("skipped").alias("skipped")))

    def _blocks(self, queries: DataFrame, id_col: str, vector_col: str) -> DataFrame:
        blocks, dim = _query_blocks(queries, id_col, vector_col)
        if self.dim and dim and dim != self.dim:
            raise ValueError(f"embedding dimension must be {self.dim}")
        return blocks


def _place_fn(id_col: str, pivots, arrow_schema):
    """mapInArrow body: unit vector, norm, nearest pivot and the distance to it."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            norms = np.linalg.norm(flat.reshape(n, -1), axis=1)
            unit = _unit_rows(flat, n)
            cell, near = np.full(n, -1, np.int32), np.zeros(n)
            if len(pivots):
                far = distances(unit, pivots)
                cell, near = far.argmin(axis=1).astype(np.int32), far.min(axis=1)
                cell[norms == 0], near[norms == 0] = -1, 0.0  # zero vectors: no bound holds
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array([row.tobytes() for row in unit], pa.binary()), pa.array(norms),
                 pa.array(cell), pa.array(near)], schema=arrow_schema)
    return run


def _chunk_fn(id_col: str, pivots, chunk_rows: int, arrow_schema):
    """mapInArrow body: ordered points as rows of at most ``chunk_rows`` points,
    in parts that do not mix cells, with the parts' bounds."""
    import numpy as np
    import pyarrow as pa

    def chunk(rows):
        unit = np.frombuffer(b"".join(r[1] for r in rows)).reshape(len(rows), -1)
        bounds, start = [], 0
        while start < len(rows):
            end = start + 1
            while end < len(rows) and end - start < PART_ROWS and rows[end][3] == rows[start][3]:
                end += 1
            far = distances(unit[start:end], pivots) if rows[start][3] >= 0 else np.zeros((1, 0))
            bounds.append({"size": end - start, "low": far.min(axis=0).tolist(), "high": far.max(axis=0).tolist()})
            start = end
        return pa.RecordBatch.from_pydict(
            {"ids": [[r[0] for r in rows]], "vectors": [unit.tobytes()], "bounds": [bounds],
             "norms": [[r[2] for r in rows]]}, schema=arrow_schema)

    def run(batches):
        held = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (id_col, "v", "norm", "cell")]
            held += zip(*columns)
            while len(held) >= chunk_rows:
                yield chunk(held[:chunk_rows])
                held = held[chunk_rows:]
        if held:
            yield chunk(held)
    return run


def centroids(points: DataFrame, key: str | None, vector_col: str = "embedding") -> DataFrame:
    """Mean vector per ``key`` (or of the whole table): (key, embedding)."""
    keys = [key] if key else []
    exploded = points.select(*keys, F.posexplode(vector_col).alias("pos", "x"))
    per_pos = exploded.groupBy(*keys, "pos").agg(F.avg("x").alias("m"))
    return (per_pos.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("pm"))
            .select(*keys, F.transform("pm", lambda e: e["m"]).alias(vector_col)))

