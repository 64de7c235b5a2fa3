"""From documents to a mixed, encoded training corpus.

``STAGES`` are (name, function) pairs in order; each function takes
(spark, docs, sf_dir) and returns the documents that it keeps, with the
columns of ``documents``; the last returns the encoded corpus. ``run`` writes
every stage's result as Parquet under ``spark.checkpoint.dir`` and reads it
back for the next one, so a lost executor repeats tasks of one stage at most;
what a stage was made from is deleted when its result is written.

Each operator's defined cases hold for its stage (its module's docstring);
columns beside ``doc_id``, ``text`` and ``source`` pass through unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, mixing, sentencepiece_codec, simhash_dedup, toxicity
from quarry.llm.common import materialize, table
from quarry.llm.queries import tokenizer_path
from quarry.session import release, stage_mark

TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``TOXIC``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxicity_score(model, F.col("text")) < TOXIC)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints."""
    return simhash_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the target weights of their sources ask."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with their digest and that of the decoded text."""
    return sentencepiece_codec.sentencepiece_encode(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("mix_sources", mix),
    ("sentencepiece", encode),
]

# a trained classifier, SimHash and a tokenizer model: not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), stage_mark()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, mark, keep_last=True)  # what led to the stage's result
    return docs
