"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import materialize, ship_package

__all__ = ["WHITESPACE", "WORD", "hash_sample", "id_as_text", "key", "key_filter", "materialize",
           "python_ready", "table", "text_or_empty", "with_filter"]

# fixed values: the word and white-space classes of the contracts
WORD = r"[^\x20\x09-\x0D]+"
WHITESPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def key(id_col: str, text_col: str) -> Column:
    """Row key ``struct(id, text hash)``.

    Never null, so rows without an id still join (struct fields compare
    null-safe); rows that repeat an id with another text stay apart, rows
    that repeat both share one key and get the same decision.
    """
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"))


FILTER_BITS = 1 << 26


def _slot(cols: tuple) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(FILTER_BITS)) + 1


def key_filter(rows: DataFrame, *cols: str) -> DataFrame:
    """A bitmap of the keys ``cols`` of ``rows``, written as a table (bucket,
    bits): ``FILTER_BITS`` bits, 8 MB, however many keys there are."""
    slot = _slot(cols)
    return materialize(
        rows.groupBy(F.bitmap_bucket_number(slot).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")), "key-filter")


def with_filter(rows: DataFrame, bitmap: DataFrame, *cols: str) -> DataFrame:
    """Adds ``hit``: true for every key of the filter, and by chance for a few
    others. The broadcast has the filter's fixed size."""
    slot = _slot(cols)
    pos = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(pos / 8) + 1).cast("int"), F.lit(1))),
                  16, 10)
    hit = F.getbit(byte.cast("int"), (pos % 8).cast("int")) == 1
    return (rows.withColumn("bucket", F.bitmap_bucket_number(slot))
            .join(F.broadcast(bitmap), "bucket", "left")
            .withColumn("hit", F.coalesce(hit, F.lit(False))).drop("bucket", "bits"))


def id_as_text(id_col: str) -> Column:
    """The id for a trip through pandas, where integers beside a null would
    become floats; cast back behind it."""
    return F.col(id_col).cast("string")


def hash_sample(rows: DataFrame, n: int, total: int, *cols: str) -> DataFrame:
    """About the ``n`` rows that come first by a hash of ``cols``, of ``total``.

    Rows far behind in that order are left out before the sort, so that each
    task hands over its part of some 2 n rows, not n rows.
    """
    place = F.pmod(F.xxhash64(*cols, F.lit("sample")), F.lit(1 << 40))
    share = min(1.0, (2 * n + 100) / max(total, 1))
    return rows.where(place < int(share * (1 << 40))).orderBy(place, *cols).limit(n)


def python_ready(df: DataFrame) -> SparkSession:
    """The frame's session, with this package importable in Python workers."""
    ship_package(df.sparkSession)
    return df.sparkSession
