"""Vector collection lifecycle and search."""

import math
import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import vectors as V
from quarry.plans import collection as C
from quarry.plans import runner as P

DOCS = [
    ("/test/ml_code.py", "Machine learning model training and evaluation", "code"),
    ("/test/data.csv", "Temperature sensor readings over time", "data"),
    ("/test/notes.md", "Meeting notes about the project roadmap", "note"),
]


def _points(spark):
    df = spark.createDataFrame(DOCS, "file_path string, content string, file_type string")
    df = df.select("file_path", "content",
                   F.create_map(F.lit("file_type"), F.col("file_type")).alias("metadata"))
    return V.make_points(df)


def test_embedding_is_unit_length_and_dimensioned(spark):
    rows = _points(spark).collect()
    assert all(len(r.embedding) == V.DEFAULT_DIM for r in rows)
    assert all(abs(math.sqrt(sum(x * x for x in r.embedding)) - 1) < 1e-9 for r in rows)
    local = P.embed_text(DOCS[0][1])
    assert max(abs(a - b) for a, b in zip(local, rows[0].embedding)) < 1e-12


def test_collection_lifecycle_and_search(spark, tmp_path):
    coll = str(tmp_path / "coll")
    P.upsert_points(spark, coll, _points(spark))
    assert P.current_points(spark, coll).count() == 3
    hits = P.search_workspace(spark, coll, "machine learning", limit=2).collect()
    assert len(hits) == 2
    assert hits[0].file_path == "/test/ml_code.py"
    assert hits[0].metadata == {"file_type": "code"}
    # re-indexing replaces points of the same file instead of duplicating them
    P.upsert_points(spark, coll, _points(spark))
    assert P.current_points(spark, coll).count() == 3
    P.upsert_points(spark, coll, _points(spark), mode="append")
    assert P.current_points(spark, coll).count() == 6
    info = V.collection_info(P.current_points(spark, coll)).first()
    assert info.points_count == 6 and info.dimension == V.DEFAULT_DIM
    kept = V.delete_file(P.current_points(spark, coll), "/test/ml_code.py")
    assert kept.count() == 4


def test_threshold_and_clear(spark, tmp_path):
    coll = str(tmp_path / "c2")
    P.upsert_points(spark, coll, _points(spark))
    none = P.search_workspace(spark, coll, "machine learning", score_threshold=0.99).collect()
    assert none == []
    P.clear_collection(spark, coll)
    assert P.current_points(spark, coll).count() == 0
    P.create_collection(spark, str(tmp_path / "c3"))
    assert P.current_points(spark, str(tmp_path / "c3")).count() == 0
    P.upsert_points(spark, coll, _points(spark))
    assert P.delete_file(spark, coll, "/test/data.csv") == 1
    assert P.current_points(spark, coll).count() == 2
    with pytest.raises(ValueError, match="dimensions"):
        P.upsert_points(spark, coll, V.make_points(
            spark.createDataFrame([("/p", "some text")], "file_path string, content string"), dim=16))


def files_under(folder):
    """Parquet files and their bytes."""
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f))
            for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def many_points(spark, n=2000, files=400):
    return spark.range(n).select(
        F.col("id").cast("string").alias("point_id"),
        F.array(*[(F.col("id") % (k + 7)).cast("float") for k in range(8)]).alias("embedding"),
        F.concat(F.lit("/ws/f"), F.col("id") % files).alias("file_path"), F.lit("").alias("content_preview"),
        F.create_map(F.lit("k"), F.lit("v")).alias("metadata"))


def test_an_upsert_writes_the_buckets_of_its_files(spark, tmp_path):
    coll = str(tmp_path / "c")
    C.create_collection(spark, coll, n_buckets=32)
    points = many_points(spark)
    P.upsert_points(spark, coll, points)
    before = files_under(coll + "/data")
    some = points.where("file_path IN ('/ws/f1', '/ws/f2', '/ws/f3', '/ws/f4')").withColumn(
        "content_preview", F.lit("again"))
    P.upsert_points(spark, coll, some)
    after = files_under(coll + "/data")
    assert all(after[f] == size for f, size in before.items())
    written = {f: size for f, size in after.items() if f not in before}
    buckets = {f.split("bucket=")[1].split("/")[0] for f in written}
    assert 1 <= len(buckets) <= 4 and sum(written.values()) < sum(before.values()) / 4
    now = P.current_points(spark, coll)
    assert now.count() == 2000 and now.select("point_id").distinct().count() == 2000
    assert now.where("content_preview = 'again'").count() == 20


def test_a_delete_writes_no_points_and_wears_buckets_out(spark, tmp_path, monkeypatch):
    coll = str(tmp_path / "c")
    C.create_collection(spark, coll, n_buckets=4)
    points = many_points(spark)
    P.upsert_points(spark, coll, points)
    before = files_under(coll + "/data")
    assert P.delete_file(spark, coll, "/ws/f7") == 5 and P.delete_file(spark, coll, "/ws/f7") == 0
    assert P.delete_file(spark, coll, "/ws/none") == 0
    assert P.delete_file(spark, coll, "/ws/f8") == 5
    assert files_under(coll + "/data") == before
    assert {r["file_path"] for r in points.select("file_path").distinct().collect()} -         {r["file_path"] for r in P.current_points(spark, coll).select("file_path").distinct().collect()} == {"/ws/f7", "/ws/f8"}
    assert P.current_points(spark, coll).count() == 1990
    # an upsert brings a deleted file back and leaves the other one deleted
    P.upsert_points(spark, coll, points.where("file_path = '/ws/f7'"))
    assert P.current_points(spark, coll).count() == 1995
    # many deletes of one bucket: it is written anew without them
    monkeypatch.setattr(C, "COMPACT_SHARE", 0.0)
    assert C.compact(spark, coll, share=0.0) in ([], [0], [1], [2], [3])
    assert P.current_points(spark, coll).count() == 1995
    assert C._deleted(spark, coll, C._current(spark, coll)).count() == 0


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    coll = str(tmp_path / "c")
    points = many_points(spark, 200)
    P.upsert_points(spark, coll, points)
    commit = C._commit

    def dies(*args):
        raise RuntimeError("lost")
    monkeypatch.setattr(C, "_commit", dies)
    with pytest.raises(RuntimeError):
        P.upsert_points(spark, coll, points.withColumn("content_preview", F.lit("new")))
    assert P.current_points(spark, coll).where("content_preview = ''").count() == 200
    monkeypatch.setattr(C, "_commit", commit)
    P.upsert_points(spark, coll, points.withColumn("content_preview", F.lit("newer")))
    now = P.current_points(spark, coll)
    assert now.count() == now.where("content_preview = 'newer'").count() == 200


def test_points_without_a_path_and_empty_upserts(spark, tmp_path):
    coll = str(tmp_path / "c")
    points = many_points(spark, 10).withColumn("file_path", F.when(F.col("point_id") > "4", F.col("file_path")))
    P.upsert_points(spark, coll, points)
    P.upsert_points(spark, coll, points.limit(0))
    assert P.current_points(spark, coll).count() == 10
    P.upsert_points(spark, coll, points)
    # rows without a path are never replaced
    assert P.current_points(spark, coll).count() == 15


def test_batch_search_equals_single_search(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    cents = V.centroids(e, "label").withColumnRenamed("label", "query_id")
    batch = V.search_batch(e, cents, k=3, id_col="vec_id")
    for row in cents.limit(3).collect():
        single = [r.vec_id for r in V.search(e, list(row.embedding), k=3, id_col="vec_id").collect()]
        got = [r.vec_id for r in batch.filter(F.col("query_id") == row.query_id)
               .orderBy("rank").collect()]
        assert got == single


def test_batch_search_in_several_blocks(spark, monkeypatch):
    """Queries beyond one block are split into several; the result is the
    same."""
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    cents = V.centroids(e, "label").withColumnRenamed("label", "query_id")
    one = sorted(V.search_batch(e, cents, k=4, id_col="vec_id").collect())
    monkeypatch.setattr(V, "QUERY_BLOCK_FLOATS", 3 * 64)  # about 3 queries per block
    many = sorted(V.search_batch(e, cents, k=4, id_col="vec_id").collect())
    assert one == many and len(one) == 4 * cents.count()


def test_chunk_candidates_are_bounded():
    """Points at the same score do not travel: at most k of a chunk and query."""
    import numpy as np
    ids = np.random.default_rng(0).permutation(500).tolist()
    zero, one = np.zeros(500), np.ones(500)
    for score, positive, n in ((zero, False, 3), (zero, True, 0), (one, True, 3)):
        found = V.best_of_chunk(score, ids, 3, None, positive)
        assert sorted(ids[i] for i in found) == list(range(n))
    mixed = np.array([0.5, 0.9, 0.5, 0.1, 0.5])
    assert sorted(V.best_of_chunk(mixed, [9, 8, 7, 6, 5], 3, None, False)) == [1, 2, 4]
    assert V.best_of_chunk(mixed, [9, 8, 7, 6, 5], 5, 0.5, False) == [0, 1, 2, 4]


def test_batch_search_refuses_other_dimensions(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    with pytest.raises(Exception, match="dimension"):
        V.search_batch(points, queries, id_col="id").collect()


def _clusters(n, dim=16, centers=12, spread=0.05, seed=1):
    import numpy as np
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(centers, dim))
    rows = base[rng.integers(0, centers, n)] + spread * rng.normal(size=(n, dim))
    rows *= rng.uniform(0.1, 9, (n, 1))
    rows[:: max(n // 7, 1)] = 0.0
    return rows, base


@pytest.mark.parametrize("k, threshold, positive", [(3, None, False), (7, 0.5, False), (40, None, True)])
def test_pivot_index_gives_the_exact_neighbours(spark, monkeypatch, k, threshold, positive):
    import numpy as np
    monkeypatch.setattr(V, "CHUNK_FLOATS", 16 * 100)
    monkeypatch.setattr(V, "PART_ROWS", 16)
    rows, base = _clusters(700)
    rows[5] = rows[6]  # ties go to the smaller id
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)] + [(9999, None)],
                                   "id long, embedding array<double>")
    queries = [(i, b.tolist()) for i, b in enumerate(base)] + [(50, rows[6].tolist()), (60, [0.0] * 16), (70, (-base[0]).tolist())]
    frame = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    index = V.PivotIndex(points, "id")
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"])
           for r in index.search(frame, k=k, threshold=threshold, positive=positive).collect()}
    unit = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
    want = {}
    for q, v in queries:
        v = np.array(v)
        v = v / max(np.linalg.norm(v), 1e-300)
        scores = np.round(unit @ v, 9)
        order = [i for i in np.lexsort((np.arange(700), -scores))
                 if (threshold is None or scores[i] >= threshold) and (not positive or scores[i] > 0)][:k]
        want |= {(q, n + 1): (int(i), float(scores[i])) for n, i in enumerate(order)}
    assert {key: i for key, (i, _) in got.items()} == {key: i for key, (i, _) in want.items()}
    assert all(abs(got[key][1] - score) < 1e-8 for key, (_, score) in want.items())
    plain = V.search_batch(points, frame, k=k, threshold=threshold, id_col="id", positive=positive)
    assert {(r["query_id"], r["rank"]): r["id"] for r in plain.collect()} == {key: i for key, (i, _) in want.items()}


def test_pivot_index_skips_far_parts_and_stores_norms(spark):
    import numpy as np
    rows, base = _clusters(4000)
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id long, embedding array<double>")
    frame = spark.createDataFrame([(i, b.tolist()) for i, b in enumerate(base)], "query_id long, embedding array<double>")
    index = V.PivotIndex(points, "id")
    counts = index.skipped(frame, k=5).first()
    assert counts["skipped"] > 0.5 * counts["met"]
    stored = {i: n for r in index.chunks.select("ids", "norms").collect() for i, n in zip(r["ids"], r["norms"])}
    assert len(stored) == 4000 and all(abs(stored[i] - np.linalg.norm(rows[i])) < 1e-9 for i in range(4000))


def test_pivot_index_of_no_points_or_zero_vectors(spark):
    schema = "id long, embedding array<double>"
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert V.PivotIndex(spark.createDataFrame([], schema), "id").search(queries).count() == 0
    zeros = V.PivotIndex(spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0])], schema), "id")
    assert [(r["id"], r["score"]) for r in zeros.search(queries, k=1).collect()] == [(1, 0.0)]
    one = V.PivotIndex(spark.createDataFrame([(1, [0.0, 2.0])], schema), "id")
    with pytest.raises(ValueError, match="dimension"):
        one.search(spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>"))


def test_sparse_rows_are_the_embedding_s_without_python(spark):
    texts = [(1, "the cat the dog"), (2, ""), (3, None), (4, "ÉTÉ été x y\tz"), (5, "a " * 500)]
    df = spark.createDataFrame(texts, "id int, text string")
    rows = V.sparse_rows(df, "id", "text")
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in rows.collect():
        got.setdefault(r["id"], {})[r["bucket"]] = r["weight"]
    for i, text in texts:
        dense = V.hashed_vector(text or "", V.DEFAULT_DIM)
        assert got.get(i, {}) == pytest.approx({b: w for b, w in enumerate(dense) if w})
