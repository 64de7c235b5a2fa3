"""Vector queries (V1-V10) over ``embeddings``, ``documents`` and ``benchmark``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import WS_CLASS
from quarry.operators import parse
from quarry.operators import vectors as V
from quarry.plans import runner
from quarry.plans.queries_profile import generated_files, index_text_sql
from quarry.plans.registry import register
from quarry.session import ensure_checkpoint_dir
from quarry.sources.tables import load_table

K = 5
BATCH_K = 20
THRESHOLD = 0.3
DELETED = "/ws/vectors/label_3.npy"
WORD = f"[^{WS_CLASS}]+"


def _embeddings(spark, sf_dir):
    return load_table(spark, sf_dir, "embeddings")


def _points(spark, sf_dir):
    """The ``embeddings`` table as a collection: one file per label."""
    e = _embeddings(spark, sf_dir)
    return e.select(
        F.col("vec_id").cast("string").alias("point_id"), "embedding",
        F.format_string("/ws/vectors/label_%d.npy", "label").alias("file_path"),
        F.lit("").alias("content_preview"),
        F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))


_E = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""


def _score(v: str, q: str) -> str:
    den = f"(sqrt(list_dot_product({v}, {v})) * sqrt(list_dot_product({q}, {q})))"
    return f"(CASE WHEN {den} > 0 THEN list_dot_product({v}, {q}) / {den} ELSE 0 END)"


@register("vector_topk", f"""
WITH {_E},
c AS (SELECT list(m ORDER BY pos) AS q FROM (
  SELECT pos, avg(x) AS m FROM (
    SELECT unnest(v) AS x, unnest(generate_series(0, len(v) - 1)) AS pos FROM e) GROUP BY pos)),
s AS (SELECT vec_id, {_score('v', 'q')} AS score FROM e, c)
SELECT vec_id, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, vec_id LIMIT {K}""")
def vector_topk(spark, sf_dir):
    """V4: top-5 vectors nearest the collection centroid (one query)."""
    e = _embeddings(spark, sf_dir)
    q = V.centroids(e, None).first()["embedding"]  # one dim-sized query vector
    hits = V.search(e, q, k=K, id_col="vec_id")
    return hits.select("vec_id", F.round("score", 6).alias("score"))


def _batch_sql(k: int, threshold: float | None) -> str:
    where = f"WHERE score >= {threshold}" if threshold is not None else ""
    return f"""
WITH {_E},
c AS (SELECT label AS query_id, list(m ORDER BY pos) AS q FROM (
  SELECT label, pos, avg(x) AS m FROM (
    SELECT label, unnest(v) AS x, unnest(generate_series(0, len(v) - 1)) AS pos FROM e)
  GROUP BY label, pos) GROUP BY label),
s AS (SELECT query_id, vec_id, {_score('v', 'q')} AS score FROM e, c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank
      FROM s {where})
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= {k}"""


def _batch(spark, sf_dir, k, threshold):
    e = _embeddings(spark, sf_dir)
    queries = V.centroids(e, "label").withColumnRenamed("label", "query_id")
    hits = V.search_batch(e, queries, k=k, threshold=threshold, id_col="vec_id")
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"),
                       F.col("rank").cast("bigint").alias("rank"))


@register("vector_topk_batch", _batch_sql(K, None))
def vector_topk_batch(spark, sf_dir):
    """V4 batch: top-5 per label centroid, candidates pruned per Arrow batch."""
    return _batch(spark, sf_dir, K, None)


@register("vector_threshold", _batch_sql(BATCH_K, THRESHOLD))
def vector_threshold(spark, sf_dir):
    """V5: minimum score applied before ranking (top-20, score >= 0.3)."""
    return _batch(spark, sf_dir, BATCH_K, THRESHOLD)


@register("vector_index_search", _batch_sql(BATCH_K, None))
def vector_index_search(spark, sf_dir):
    """V4 over a stored pivot index: top-20 per label centroid."""
    e = _embeddings(spark, sf_dir)
    queries = V.centroids(e, "label").withColumnRenamed("label", "query_id")
    hits = V.PivotIndex(e, "vec_id").search(queries, k=BATCH_K)
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"),
                       F.col("rank").cast("bigint").alias("rank"))


@register("collection_info", """
SELECT 'local_rag' AS collection_name, count(*) AS points_count, count(embedding) AS vectors_count,
  count(embedding) AS indexed_vectors_count, coalesce(max(len(embedding)), 0) AS dimension,
  'green' AS status FROM embeddings""")
def collection_info(spark, sf_dir):
    """V8: collection statistics."""
    return V.collection_info(_points(spark, sf_dir)).withColumn(
        "dimension", F.col("dimension").cast("bigint"))


@register("delete_file", f"""
SELECT '/ws/vectors/label_' || label || '.npy' AS file_path, count(*) AS points
FROM embeddings WHERE '/ws/vectors/label_' || label || '.npy' <> '{DELETED}' GROUP BY 1""")
def delete_file(spark, sf_dir):
    """V7: every point of one file removed; remaining points per file."""
    kept = V.delete_file(_points(spark, sf_dir), DELETED)
    return kept.groupBy("file_path").agg(F.count(F.lit(1)).alias("points"))


def _sparse_sql(table: str, key: str, text: str) -> str:
    return f"""
w_{table} AS (SELECT {key} AS id, unnest(regexp_extract_all(lower({text}), '{WORD}')) AS word
              FROM {table}),
b_{table} AS (SELECT id, CAST(('0x' || substr(md5(word), 1, 8)) AS BIGINT) % 384 AS bucket,
                     count(*) AS c FROM w_{table} GROUP BY 1, 2),
n_{table} AS (SELECT id, sqrt(sum(c * c)) AS nrm FROM b_{table} GROUP BY 1),
s_{table} AS (SELECT b.id, b.bucket, b.c / n.nrm AS weight
              FROM b_{table} b JOIN n_{table} n ON b.id = n.id)"""


@register("embed_documents", "WITH " + _sparse_sql("documents", "doc_id", "text").strip() + """
SELECT id AS doc_id, CAST(bucket AS INTEGER) AS bucket, round(weight, 9) AS weight
FROM s_documents""")
def embed_documents(spark, sf_dir):
    """V2: hashed bag-of-words vectors of every document (sparse rows)."""
    d = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    return V.sparse_rows(d, "doc_id", "text").select("doc_id", "bucket", F.round("weight", 9).alias("weight"))


@register("text_search", "WITH " + _sparse_sql("documents", "doc_id", "text").strip() + ",\n"
          + _sparse_sql("benchmark", "item_id", "text").strip() + f""",
dots AS (SELECT q.id AS item_id, d.id AS doc_id, sum(q.weight * d.weight) AS score
         FROM s_benchmark q JOIN s_documents d ON q.bucket = d.bucket GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank
      FROM dots)
SELECT item_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= {K}""")
def text_search(spark, sf_dir):
    """V2+V4: each benchmark text searched over all documents, top-5."""
    d = load_table(spark, sf_dir, "documents")
    b = load_table(spark, sf_dir, "benchmark")
    points = V.with_embedding(d.select("doc_id", "text"), "text").select("doc_id", "embedding")
    queries = V.with_embedding(b.select(F.col("item_id").alias("query_id"), "text"),
                               "text").select("query_id", "embedding")
    hits = V.search_batch(points, queries, k=K, id_col="doc_id", positive=True)
    return hits.select(F.col("query_id").alias("item_id"), "doc_id",
                       F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register("index_points", index_text_sql() + """
SELECT path AS file_path, sha256(path || chr(0) || index_text) AS point_id,
  substring(index_text, 1, 500) AS content_preview, file_type
FROM indexed""")
def index_points(spark, sf_dir):
    """V3: points of every indexed file, the generated code, CSV and notebook
    files included (deterministic ids, 500-character preview)."""
    docs = parse.parse_files(generated_files(spark, sf_dir)).filter("success").select(
        F.col("path").alias("file_path"), V.index_text().alias("content"),
        F.create_map(F.lit("file_name"), F.col("name"), F.lit("file_type"), F.col("file_type"),
                     F.lit("size"), F.col("size").cast("string"),
                     F.lit("summary"), F.col("summary")).alias("metadata"))
    return V.make_points(docs).select("file_path", "point_id", "content_preview",
                                      F.col("metadata")["file_type"].alias("file_type"))


def _fresh_collection(spark) -> str:
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/collection-{uuid.uuid4().hex}"


@register("collection_lifecycle", f"""
WITH p AS (SELECT vec_id::VARCHAR AS point_id, '/ws/vectors/label_' || label || '.npy' AS file_path,
             embedding FROM embeddings),
q AS (SELECT * FROM p WHERE file_path <> '{DELETED}')
SELECT file_path, count(*) AS points, min(point_id) AS least_id, max(point_id) AS greatest_id,
  max(len(embedding)) AS dimension, round(sum(list_sum(embedding)::DOUBLE), 3) AS checksum
FROM q GROUP BY file_path""")
def collection_lifecycle(spark, sf_dir):
    """A collection is created, written, cleared, written
    again in two steps (the second replaces files of the first), loses one
    file, and is read back."""
    path, points = _fresh_collection(spark), _points(spark, sf_dir)
    runner.create_collection(spark, path)
    runner.upsert_points(spark, path, points.limit(10))
    runner.clear_collection(spark, path)
    half = F.pmod(F.xxhash64("point_id"), F.lit(2)) == 0
    runner.upsert_points(spark, path, points.filter(half))
    runner.upsert_points(spark, path, points)
    runner.delete_file(spark, path, DELETED)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return (runner.current_points(spark, path).groupBy("file_path")
            .agg(F.count("*").alias("points"), F.min("point_id").alias("least_id"),
                 F.max("point_id").alias("greatest_id"),
                 F.max(F.size("embedding")).cast("bigint").alias("dimension"),
                 F.round(F.sum(total), 3).alias("checksum")))


@register("search_hits", f"""
WITH {_E},
c AS (SELECT list(m ORDER BY pos) AS q FROM (
  SELECT pos, avg(x) AS m FROM (
    SELECT unnest(v) AS x, unnest(generate_series(0, len(v) - 1)) AS pos FROM e WHERE label = 3)
  GROUP BY pos)),
s AS (SELECT vec_id, label, {_score('v', 'q')} AS score FROM e, c)
SELECT '/ws/vectors/label_' || label || '.npy' AS file_path, round(score, 6) AS score,
  label::VARCHAR AS label, '' AS content_preview
FROM s WHERE round(score, 9) >= 0.1 ORDER BY round(score, 9) DESC, vec_id::VARCHAR LIMIT {BATCH_K}""")
def search_hits(spark, sf_dir):
    """V6: search hits (path, score, metadata, preview) of a collection that
    was written and read back."""
    path = _fresh_collection(spark)
    runner.upsert_points(spark, path, _points(spark, sf_dir))
    e = _embeddings(spark, sf_dir).filter("label = 3")
    q = V.centroids(e, None).first()["embedding"]  # one dim-sized query vector
    hits = runner.search_hits(runner.current_points(spark, path), q, limit=BATCH_K,
                              score_threshold=0.1)
    return hits.select("file_path", F.round("score", 6).alias("score"),
                       F.col("metadata")["label"].alias("label"), "content_preview")
