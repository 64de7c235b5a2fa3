"""Exact deduplication by progressive refinement, DataFrame functions only.

Texts are equal when they are identical after white space (space, tab to
carriage return) is deleted. The refinement narrows in three levels:

1. length of the normalised text: a length that occurs once is settled;
2. hash of the first ``prefix_chars`` normalised characters within a length;
3. SHA-256 of the whole normalised text, computed only for rows whose
   (length, prefix hash) occurs more than once.

No text is shuffled. Levels 1 and 2 work on counts that are pre-aggregated in
each map task, so a group that holds a third of the rows arrives as one row
per task. Level 3 finds its rows in the second scan through a bitmap of the
surviving (length, prefix) pairs (``common.key_filter``): its size is fixed at 8
MB, so it is broadcast at any corpus size; a false positive only costs one
hash, because the groups are formed on the full hash. The groups (at most one
row per distinct repeated text) are written to the checkpoint folder and
joined back to the surviving rows, a plain sort-merge join that adaptive
execution can split when one group is hot.

Defined cases: a null text counts as empty and all empty texts are equal; a
row without id is kept only when its group has no row with an id of the same
original length; rows that repeat id and text count in ``group_size`` and at
most one of them stays; an empty table gives an empty result; other columns
of the input are never touched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import (WHITESPACE, key, key_filter, materialize, text_or_empty,
                               with_filter)

PREFIX_CHARS = 64


@dataclass(frozen=True)
class ExactGroups:
    """``survivors``: k, n_norm, pre, sha, n_chars of the rows hashed in full;
    ``groups``: sha, n_norm, keep_id, keep_h, group_size of repeated texts."""
    survivors: DataFrame
    groups: DataFrame
    bitmap: DataFrame


def normalised(text_col: str) -> Column:
    return F.translate(text_or_empty(text_col), WHITESPACE, "")


def _levels(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    norm = normalised(text_col)
    return docs.select(
        key(id_col, text_col).alias("k"),
        F.length(norm).alias("n_norm"),
        F.xxhash64(F.substring(norm, 1, prefix_chars)).alias("pre"),
        F.length(text_or_empty(text_col)).alias("n_chars"),
        norm.alias("norm"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 prefix_chars: int = PREFIX_CHARS) -> ExactGroups:
    levels = _levels(docs, id_col, text_col, prefix_chars)
    pairs = materialize(levels.groupBy("n_norm", "pre").agg(F.count("*").alias("n")), "exact-pairs")
    lengths = pairs.groupBy("n_norm").agg(F.sum("n").alias("n")).where("n > 1").select("n_norm")
    repeated = pairs.where("n > 1").join(lengths, "n_norm", "left_semi")
    bitmap = key_filter(repeated, "n_norm", "pre")
    survivors = materialize(
        with_filter(levels, bitmap, "n_norm", "pre").where("hit")
        .select("k", "n_norm", "n_chars", F.sha2("norm", 256).alias("sha")), "exact-survivors")
    best = F.max(F.struct("n_chars", F.col("k.id").isNotNull().alias("has_id"),
                          (-F.col("k.id")).alias("neg_id"), F.col("k.h").alias("h")))
    groups = materialize(
        survivors.groupBy("sha", "n_norm").agg(F.count("*").alias("group_size"), best.alias("b"))
        .where("group_size > 1")
        .select("sha", "n_norm", "group_size", (-F.col("b.neg_id")).alias("keep_id"),
                F.col("b.h").alias("keep_h")), "exact-groups")
    return ExactGroups(survivors, groups, bitmap)


def decisions(found: ExactGroups) -> DataFrame:
    """One row per key in a repeated group: k, keep_id, keep_h, group_size."""
    return (found.survivors.select("k", "sha", "n_norm")
            .join(found.groups, ["sha", "n_norm"])
            .select("k", "keep_id", "keep_h", "group_size").distinct())


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256."""
    found = exact_groups(docs, id_col, text_col)
    rows = docs.select(key(id_col, text_col).alias("k"),
                       F.sha2(normalised(text_col), 256).alias("text_sha256"))
    copy = F.row_number().over(Window.partitionBy("k").orderBy(F.lit(1)))
    return (rows.join(decisions(found), "k", "left")
            .withColumn("copy", copy)
            .select(F.col("k.id").alias(id_col),
                    F.when(F.col("group_size").isNull(), F.col("k.id"))
                    .otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1)).alias("group_size"),
                    (F.col("group_size").isNull()
                     | (F.col("keep_id").eqNullSafe(F.col("k.id"))
                        & (F.col("keep_h") == F.col("k.h")) & (F.col("copy") == 1))).alias("kept"),
                    "text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its columns, one row of each group of equal texts.

    Rows outside the bitmap pass without a shuffle; only rows that may repeat
    move to meet their decision.
    """
    found = exact_groups(docs, id_col, text_col)
    cols = [F.col(f"d.`{c}`") for c in docs.columns]
    norm = normalised(f"d.{text_col}")
    marked = with_filter(
        docs.alias("d").select(F.struct("d.*").alias("d")).select(
            "d", key(f"d.{id_col}", f"d.{text_col}").alias("k"), F.length(norm).alias("n_norm"),
            F.xxhash64(F.substring(norm, 1, PREFIX_CHARS)).alias("pre")), found.bitmap, "n_norm", "pre")
    single = marked.where("NOT hit").select(*cols)
    repeated = (marked.where("hit").select("k", "d").join(decisions(found), "k", "left")
                .where("group_size IS NULL OR (keep_id <=> k.id AND keep_h = k.h)")
                .withColumn("copy", F.row_number().over(
                    Window.partitionBy("k").orderBy(F.lit(1))))
                .where("group_size IS NULL OR copy = 1").select(*cols))
    return single.unionByName(repeated)
