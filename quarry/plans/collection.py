"""Versioned vector collections (S7, S8, V7, V9, V10): parquet buckets, a
manifest per version, deletion bitmaps.

Points lie in ``n_buckets`` buckets by the hash of their file path, under
``data/version=<v>/bucket=<b>``. A version is a manifest: which written version
holds each bucket's rows, and which of these rows are deleted. An upsert reads
and writes the buckets of its files alone; the manifest of the new version
refers to the others as they are. A delete writes no points: the rows of the
path are added to the bucket's bitmap of deleted positions, which readers
apply; a bucket is rewritten once ``COMPACT_SHARE`` of its rows are deleted.

A version exists when its manifest is complete (``_SUCCESS``), so a writer that
dies leaves the last version readable and its own files unreferenced; the next
writer takes a new number. One writer at a time.

The driver sees manifests (a row per bucket, a parameter of the collection),
never points or bitmaps. Defined cases: a missing collection reads as empty;
points without a path share the bucket of null and are not replaced or deleted
by path; ``mode='append'`` keeps equal points; all points of a collection have
one dimension.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import vectors as V
from quarry.session import materialize

BUCKETS = 16
COMPACT_SHARE = 0.3
_HEADER = -1  # bucket of the manifest's row about the collection: rows = n_buckets
MANIFEST = "bucket int, version int, rows bigint, dimension int"
DELETED = "bucket int, block bigint, bits binary"
_STORED = T.StructType([*V.POINTS.fields, T.StructField("pos", T.LongType()), T.StructField("version", T.IntegerType()),
                        T.StructField("bucket", T.IntegerType())])


def _fs(spark: SparkSession, path: str):
    """The Hadoop file system of a path (local, HDFS or an object store alike)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path, jvm.org.apache.hadoop.fs.Path


def _numbers(spark: SparkSession, folder: str, prefix: str, complete: str | None = None) -> list[int]:
    """Numbers of the folders ``<prefix><number>``, those that hold ``complete``."""
    fs, path, join = _fs(spark, folder)
    if not fs.exists(path):
        return []
    found = [status.getPath() for status in fs.listStatus(path)]
    return sorted(int(p.getName()[len(prefix):]) for p in found
                  if p.getName().startswith(prefix) and p.getName()[len(prefix):].isdigit()
                  and (complete is None or fs.exists(join(p, complete))))


@dataclass
class Version:
    """A manifest: ``at`` maps a bucket to (version that holds it, rows)."""
    number: int
    at: dict[int, tuple[int, int]]
    n_buckets: int
    dimension: int | None


def _current(spark: SparkSession, collection: str) -> Version | None:
    numbers = _numbers(spark, f"{collection}/manifests", "v=", "buckets/_SUCCESS")
    if not numbers:
        return None
    rows = spark.read.schema(MANIFEST).parquet(f"{collection}/manifests/v={numbers[-1]}/buckets").collect()
    (header,) = [r for r in rows if r["bucket"] == _HEADER]
    return Version(numbers[-1], {r["bucket"]: (r["version"], r["rows"]) for r in rows if r["bucket"] != _HEADER},
                   header["rows"], header["dimension"])


def _next_number(spark: SparkSession, collection: str) -> int:
    """A number that no writer has used, also none that died."""
    used = (_numbers(spark, f"{collection}/data", "version=") + _numbers(spark, f"{collection}/manifests", "v="))
    return max(used, default=-1) + 1


def _commit(spark: SparkSession, collection: str, v: Version, deleted: DataFrame) -> None:
    """Writes the manifest; the bitmaps first, the buckets' ``_SUCCESS`` last."""
    folder = f"{collection}/manifests/v={v.number}"
    deleted.select("bucket", "block", "bits").write.mode("overwrite").parquet(f"{folder}/deleted")
    rows = [(_HEADER, v.number, v.n_buckets, v.dimension)]
    rows += [(b, version, n, v.dimension) for b, (version, n) in sorted(v.at.items())]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/buckets")


def _deleted(spark: SparkSession, collection: str, v: Version) -> DataFrame:
    return spark.read.schema(DELETED).parquet(f"{collection}/manifests/v={v.number}/deleted")


def _stored(spark: SparkSession, collection: str, v: Version, buckets=None) -> DataFrame:
    """Rows of the version's buckets (or some of them), without deleted ones."""
    base = f"{collection}/data"
    paths = [f"{base}/version={version}/bucket={b}" for b, (version, _) in sorted(v.at.items())
             if buckets is None or b in buckets]
    if not paths:
        return spark.createDataFrame([], _STORED)
    rows = spark.read.schema(_STORED).option("basePath", base).parquet(*paths)
    deleted = _deleted(spark, collection, v)
    if not deleted.limit(1).count():
        return rows
    # bitmap blocks are 4 KB for 32,768 rows; joined by bucket and block
    byte = F.conv(F.hex(F.substring("bits", (F.floor(F.bitmap_bit_position("pos") / 8) + 1).cast("int"), F.lit(1))), 16, 10)
    gone = F.getbit(byte.cast("int"), (F.bitmap_bit_position("pos") % 8).cast("int")) == 1
    return (rows.withColumn("block", F.bitmap_bucket_number("pos"))
            .join(deleted, ["bucket", "block"], "left")
            .where(~F.coalesce(gone, F.lit(False))).select(*[f.name for f in _STORED.fields]))


def bucket_of(path: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(n)).cast("int")


def _write(spark: SparkSession, collection: str, v: Version, number: int, rows: DataFrame,
           touched: set[int], dimension: int | None) -> None:
    """The next version: ``rows`` (points and bucket) are what the touched
    buckets hold from now on."""
    target = f"{collection}/data/version={number}"
    # a bucket of one hot file is written by several tasks
    spread = F.pmod(F.xxhash64("point_id"), F.lit(8))
    (rows.select(*[f.name for f in V.POINTS.fields], "bucket").repartition("bucket", spread)
     .withColumn("pos", F.monotonically_increasing_id())
     .write.mode("errorifexists").partitionBy("bucket").parquet(target))
    held = {}
    if _numbers(spark, target, "bucket="):
        counts = spark.read.schema("pos bigint, bucket int").parquet(target).groupBy("bucket").count()
        held = {r["bucket"]: (number, r["count"]) for r in counts.collect()}
    at = {b: x for b, x in v.at.items() if b not in touched} | held
    deleted = _deleted(spark, collection, v).where(~F.col("bucket").isin(*touched)) if touched else \
        _deleted(spark, collection, v)
    _commit(spark, collection, Version(number, at, v.n_buckets, dimension), deleted)


def create_collection(spark: SparkSession, collection: str, n_buckets: int = BUCKETS) -> Version:
    """V9: an empty first version, if the collection has none."""
    found = _current(spark, collection)
    if found is None:
        found = Version(_next_number(spark, collection), {}, n_buckets, None)
        _commit(spark, collection, found, spark.createDataFrame([], DELETED))
    return found


def clear_collection(spark: SparkSession, collection: str) -> None:
    """A version without points (of any dimension from then on)."""
    v = create_collection(spark, collection)
    empty = Version(_next_number(spark, collection), {}, v.n_buckets, None)
    _commit(spark, collection, empty, spark.createDataFrame([], DELETED))


def current_points(spark: SparkSession, collection: str) -> DataFrame:
    """The points of the latest complete version (none without one)."""
    v = _current(spark, collection)
    if v is None:
        return spark.createDataFrame([], V.POINTS)
    return _stored(spark, collection, v).select(*[f.name for f in V.POINTS.fields])


def upsert_points(spark: SparkSession, collection: str, new_points: DataFrame, mode: str = "replace") -> str:
    """S7 with replace-by-path: points of re-indexed files replace the old
    ones (``mode='append'`` keeps duplicates). Touches the new points' buckets."""
    v = create_collection(spark, collection)
    # embedded once: the buckets, the paths and the rows are read from this table
    new = materialize(new_points.withColumn("embedding", F.col("embedding").cast("array<float>"))
                      .withColumn("bucket", bucket_of(F.col("file_path"), v.n_buckets)), "new-points")
    facts = new.agg(F.collect_set("bucket").alias("buckets"),
                    F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
    sizes = {s for s in (facts["least"], facts["most"], v.dimension) if s is not None and s >= 0}
    if len(sizes) > 1:
        raise ValueError(f"points of different dimensions: {sorted(sizes)}")
    touched = set(facts["buckets"])
    old = _stored(spark, collection, v, touched)
    if mode == "replace":
        old = old.join(new.select("bucket", "file_path").distinct(), ["bucket", "file_path"], "left_anti")
    fields = [*[f.name for f in V.POINTS.fields], "bucket"]
    number = _next_number(spark, collection)
    _write(spark, collection, v, number, old.select(*fields).unionByName(new.select(*fields)), touched,
           next(iter(sizes), None))
    return f"{collection}/manifests/v={number}"


def delete_file(spark: SparkSession, collection: str, file_path: str) -> int:
    """V7: deletes every point of a path; returns how many there were. Reads
    the path's bucket and writes its bitmap."""
    v = create_collection(spark, collection)
    bucket = spark.range(1).select(bucket_of(F.lit(file_path), v.n_buckets)).first()[0]
    if bucket not in v.at:
        return 0
    hit = _stored(spark, collection, v, {bucket}).where(F.col("file_path") == file_path)
    bits = materialize(
        hit.groupBy("bucket", F.bitmap_bucket_number("pos").alias("block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("pos")).alias("bits")), "deleted")
    n = bits.agg(F.sum(F.bitmap_count("bits"))).first()[0] or 0
    if not n:
        return 0
    deleted = (_deleted(spark, collection, v).unionByName(bits)
               .groupBy("bucket", "block").agg(F.bitmap_or_agg("bits").alias("bits")))
    number = _next_number(spark, collection)
    _commit(spark, collection, Version(number, v.at, v.n_buckets, v.dimension), deleted)
    compact(spark, collection)
    return n


def compact(spark: SparkSession, collection: str, share: float = COMPACT_SHARE) -> list[int]:
    """Rewrites the buckets of which more than ``share`` is deleted; returns them."""
    v = create_collection(spark, collection)
    gone = {r["bucket"]: r["n"] for r in _deleted(spark, collection, v).groupBy("bucket")
            .agg(F.sum(F.bitmap_count("bits")).alias("n")).collect()}
    worn = {b for b, n in gone.items() if n > share * v.at[b][1]}
    if worn:
        _write(spark, collection, v, _next_number(spark, collection),
               _stored(spark, collection, v, worn), worn, v.dimension)
    return sorted(worn)
