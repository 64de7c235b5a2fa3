"""Readers for the driver's parquet tables and the workspace view over them.

``files_from_documents`` turns the ``documents`` table into a workspace
inventory (path, size, modified, content) so that every file-level operator
runs on real, scale-growing data. The path layout puts documents under
ignored directories, gives them every file type (including the upper-case
``.CSV`` trap and names without a suffix) and spreads their modification
times one hour apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import spread

FIXTURE_ROOT = "/ws"


# Tables whose rows feed per-row work (profiles, embeddings, scoring), with
# the key that spreads a small single-file table over the cluster.
SPREAD_KEYS = {"documents": "doc_id", "embeddings": "vec_id", "benchmark": "item_id"}


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    key = SPREAD_KEYS.get(name)
    return spread(df, key) if key else df


def files_from_documents(documents: DataFrame) -> DataFrame:
    """Workspace inventory over ``documents``: one file per document."""
    doc = F.col("doc_id")
    subdir = (F.when(doc % 11 == 0, "__pycache__/").when(doc % 13 == 0, ".github/")
              .when(doc % 17 == 0, "myvenv2/").when(doc % 19 == 0, "x.pyc/").otherwise(""))
    stem = (F.when(doc % 3 == 0, "test_").when(doc % 3 == 1, "analysis_").otherwise("sensor_"))
    ext = (F.when(doc % 9 == 0, ".py").when(doc % 9 == 1, ".csv").when(doc % 9 == 2, ".ipynb")
           .when(doc % 9 == 3, ".md").when(doc % 9 == 4, ".txt").when(doc % 9 == 5, ".json")
           .when(doc % 9 == 6, ".CSV").when(doc % 9 == 7, ".bin").otherwise(""))
    path = F.concat(F.lit(FIXTURE_ROOT + "/"), F.col("source"), F.lit("/"), subdir, stem,
                    doc.cast("string"), ext)
    modified = F.timestamp_add("HOUR", doc, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return documents.select(
        doc.alias("doc_id"),
        path.alias("path"),
        F.col("text").alias("content"),
        F.octet_length("text").cast("bigint").alias("size"),
        modified.alias("modified"),
    )


def fixture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_from_documents(load_table(spark, sf_dir, "documents"))


def write_tree(files: DataFrame) -> int:
    """Writes every file (path, content, modified) to a mounted folder, with its
    time; returns how many. A repeated task writes the same files again."""
    def run(batches):
        import os

        import pandas as pd
        for batch in batches:
            for path, content, modified in zip(batch["path"], batch["content"], batch["modified"], strict=True):
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(content if isinstance(content, bytes) else (content or "").encode())
                at = modified.to_pydatetime().timestamp()
                os.utime(path, (at, at))
            yield pd.DataFrame({"n": [len(batch)]})

    written = files.select("path", "content", "modified").mapInPandas(run, "n bigint")
    return written.agg(F.sum("n")).first()[0] or 0


# DuckDB twin of ``files_from_documents``, used by the SQL oracles.
FILES_SQL = """
files AS (
  SELECT doc_id,
    '/ws/' || source || '/'
    || CASE WHEN doc_id % 11 = 0 THEN '__pycache__/' WHEN doc_id % 13 = 0 THEN '.github/'
            WHEN doc_id % 17 = 0 THEN 'myvenv2/' WHEN doc_id % 19 = 0 THEN 'x.pyc/' ELSE '' END
    || CASE doc_id % 3 WHEN 0 THEN 'test_' WHEN 1 THEN 'analysis_' ELSE 'sensor_' END || doc_id
    || CASE doc_id % 9 WHEN 0 THEN '.py' WHEN 1 THEN '.csv' WHEN 2 THEN '.ipynb' WHEN 3 THEN '.md'
            WHEN 4 THEN '.txt' WHEN 5 THEN '.json' WHEN 6 THEN '.CSV' WHEN 7 THEN '.bin' ELSE '' END
      AS path,
    text AS content,
    CAST(strlen(text) AS BIGINT) AS size,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS modified
  FROM documents)"""
