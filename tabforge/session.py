"""Session helpers: a tuned local session for tests/bench and checkpoint-dir lookup."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tabforge") -> SparkSession:
    """Session for tests and the bench. On a cluster, build your own session;
    every operator only relies on the settings below being sensible."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    shuffle_partitions = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for reliable checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` (set by the cluster). Only when it is unset
    (local tests) a fresh scratch folder is created and registered.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a Spark Connect session has no SparkContext
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    configured = spark.conf.get(_CKPT_KEY, None)
    if not configured and sc is not None:
        configured = sc.getConf().get(_CKPT_KEY, None)
    if not configured:
        master = sc.master if sc is not None else ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tabforge-ckpt-", dir="/tmp")
        if _settable(spark):
            spark.conf.set(_CKPT_KEY, configured)
    if sc is not None:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a written intermediate table, under the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"


def _settable(spark: SparkSession) -> bool:
    try:
        return spark.conf.isModifiable(_CKPT_KEY)
    except Exception:  # pragma: no cover - older API
        return False


#: Paths that ``materialize`` has written in this process.
_WRITTEN: list[str] = []

#: Shuffle files of a finished query go at once, not when the driver next collects garbage.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _delete(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))


def drop_scratch(spark: SparkSession) -> int:
    """Deletes the tables that ``materialize`` has written so far and returns their number.
    For the owner of the session, once the results that read them have been consumed."""
    n = 0
    while _WRITTEN:
        n += _delete(spark, _WRITTEN.pop())
    return n


def release(*frames) -> None:
    """Deletes the tables behind frames that ``materialize`` returned. For an operator whose
    later tables are written, so that nothing reads these any more."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            _delete(df.sparkSession, path)


#: Bytes of an Arrow batch of texts. Spark's own bound (64 MB) is held several times over by each
#: task: in the JVM's buffers, as it arrives in the Python worker, and as Python strings.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on an Arrow batch to BATCH_BYTES, unless its owner has set one.
    Operators whose Python functions read whole texts call it: the frames they return run later,
    so the setting stays. Batches are cut elsewhere, the rows are the same."""
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def materialize(df, name: str = "t"):
    """Cut lineage: write ``df`` once as parquet under the shared checkpoint folder
    and read it back. One job (a reliable RDD checkpoint of an unpersisted
    DataFrame computes it twice), and a lost executor never replays the
    lineage before this point. The write's shuffle files are removed when it is done."""
    import uuid
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)
    _WRITTEN.append(path)
    out = spark.read.parquet(path)
    out._scratch_path = path
    return out
