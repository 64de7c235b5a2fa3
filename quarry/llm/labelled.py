"""Labelled documents for the trained operators, all or a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import hash_sample, materialize, text_or_empty


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``folds``, equals ``fold`` (null id: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def known_labels(labels: DataFrame, label: str, train: Column, id_col: str = "doc_id") -> DataFrame:
    """``(id, y)`` of every training id. A label that is null or not 0 or 1 is
    left out, an id with both labels counts as 1."""
    return (labels.where(train & F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
            .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label)).cast("int").alias("y")))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column,
                    per_class: int, id_col: str = "doc_id",
                    text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """``(id, y, text)`` of at most ``per_class`` training rows of each class,
    in the order of a hash of the id, and the number of training rows by class.

    The ids that meet the documents are at most 2 * per_class, so they are
    broadcast. Labels are those of ``known_labels``, an id with several texts
    stands with the least one.
    """
    known = materialize(known_labels(labels, label, train, id_col), "labelled")
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [hash_sample(known.where(F.col("y") == y), per_class, totals.get(y, 0), "id")
              for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    rows = (docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
            .join(ids, "id").groupBy("id", "y").agg(F.min("text").alias("text")))
    return materialize(rows, "labelled-sample"), totals
