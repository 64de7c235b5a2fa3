"""Session helpers: configuration the library relies on, and stage
materialisation that survives executor loss."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Settings every query in the library assumes. Timestamps are naive
# (TIMESTAMP_NTZ) like the file times they model, and the session zone is
# pinned so string renderings never depend on the host.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches carry whole texts: Spark bounds their bytes, this their rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}


# the string forms of timestamps depend on it
NEEDED = ("spark.sql.session.timeZone",)


def local_session(cores: int = 8, shuffle_partitions: int | None = None,
                  app: str = "quarry") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
               .config("spark.driver.memory", "16g")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def apply_conf(spark: SparkSession) -> SparkSession:
    """The settings the library needs; other settings stay the session's own."""
    for key, value in DEFAULT_CONF.items():
        if key in NEEDED or not spark.conf.isModifiable(key):
            continue
        spark.conf.set(key, spark.conf.get(key, value))
    for key in NEEDED:
        spark.conf.set(key, DEFAULT_CONF[key])
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable in Python workers (Arrow jobs) by adding a
    zip of the package to the session's py-files, once per context."""
    import os
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    target = os.path.join(tempfile.mkdtemp(prefix="quarry-pyfiles-"), "quarry.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``.

    Only when the session has none (local runs, tests) a fresh scratch folder
    is created; on a cluster the setting names a shared file system.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all machines share")
        configured = tempfile.mkdtemp(prefix="quarry-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df: DataFrame, name: str = "stage", options: dict | None = None) -> DataFrame:
    """Cut lineage with a table written under the shared checkpoint folder.

    Used for stages that several downstream branches read (the parsed-file
    table): the expensive parse runs exactly once (a reliable RDD
    checkpoint would compute it twice without a cache), a lost executor
    does not force a recompute from the raw listing, and the read-back is a
    plain parquet scan whose statistics AQE can use. ``options`` are the
    writer's.
    """
    path = stage_path(df.sparkSession, name)
    df.write.mode("errorifexists").options(**(options or {})).parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize_observed(df: DataFrame, name: str, then: Callable[[DataFrame], DataFrame] | None = None,
                         **metrics: Column) -> tuple[DataFrame, dict]:
    """Writes ``then(df)`` as a stage (``df`` itself without ``then``), and
    aggregates of the rows of ``df`` taken on their way there
    (``DataFrame.observe``), without another pass."""
    from pyspark.sql import Observation
    seen = Observation(name)
    observed = df.observe(seen, *[c.alias(k) for k, c in metrics.items()])
    stage = materialize(then(observed) if then else observed, name)
    return stage, seen.get


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder for a stage's files under the shared checkpoint folder."""
    import uuid
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quarry-{name}-{uuid.uuid4().hex}"
    _STAGES.append(path)
    return path


_STAGES: list[str] = []


def stage_mark() -> int:
    """Place in the list of this process's stage tables, for ``release``."""
    return len(_STAGES)


def release(spark: SparkSession, mark: int, keep_last: bool = False) -> None:
    """Deletes the stage tables written since ``mark`` (but the last one, if
    asked). For runs whose results are written: frames that read a released
    table can not be used any more."""
    paths = _STAGES[mark:len(_STAGES) - 1 if keep_last else len(_STAGES)]
    _STAGES[mark:mark + len(paths)] = []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def spread(df: DataFrame, key: str | None = None, target: int | None = None) -> DataFrame:
    """Give the per-row stages after a small scan enough tasks.

    Apply to a file scan (no shuffle upstream: the partition count is then
    known from planning alone). Large inputs already arrive in many
    partitions and are returned as they are; an input with fewer partitions
    than the cluster's default parallelism (a single small file with one
    row group) is hash partitioned on ``key``.
    """
    target = target or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key) if key else df.repartition(target)
