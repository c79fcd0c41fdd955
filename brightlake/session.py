"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cpus: str = "8", memory: str = "12g") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("brightlake")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master, where driver and executors share one disk, may fall back to a temporary
    folder.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if found is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        found = tempfile.mkdtemp(prefix="brightlake-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path for an intermediate table in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of the queries begun inside go when these end, not when the driver next collects its garbage.

    Only for queries whose frame nobody runs again: a second run would have to shuffle anew.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    with freed_shuffles(df.sparkSession):
        return df.select("*").checkpoint()


BROADCAST_ROWS = 50_000


def small_side(df: DataFrame) -> DataFrame:
    """The narrow, aggregated side of a join: broadcast once its counted rows are few.

    Spark guesses the size of an aggregate from its input and would shuffle the large side first;
    counting the finished aggregate spares that. Beyond the bound the join is left to Spark.
    """
    kept = materialize(df)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    For wide frames that several passes read: unlike a checkpoint, the copy is columnar, so every
    pass reads only its columns.
    """
    path = scratch_path(df.sparkSession, name)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Python gets at most ``BATCH_BYTES`` of rows at a time (one row at least), unless the session sets a limit itself.

    Spark's own limit of 64 MB takes several times that of an executor for each task. The setting is read when a
    query runs, so it stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


SHARE_ROWS = 100_000


def even_shares(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` in partitions of about ``rows`` rows (counted) if it comes in fewer and larger ones. For fits that keep
    far more per row than the table does, such as the draws of every tree of a forest."""
    parts = -(-df.count() // (rows or SHARE_ROWS))
    return df.repartition(parts) if parts > df.rdd.getNumPartitions() else df
