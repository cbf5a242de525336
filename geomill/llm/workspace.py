"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from spark.checkpoint.dir; one of its own only on a local master that names none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="geomill-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Rows of whole texts in one Arrow batch.
TEXT_ROWS = 1000


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Keep Arrow batches of whole texts small in this session; Spark's default of 10,000 rows suits narrow rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def _prefix(spark: SparkSession) -> str:
    """Begins the names of this application's tables, and of no other's."""
    return f"geomill-{spark.sparkContext.applicationId}-"


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{_prefix(spark)}{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder, for the small frames of iterations."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Free shuffle files of frames that nothing refers to any more; Spark's cleaner acts on the driver's collections."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: A frame is broadcast only if its counted rows fit in this many bytes; beyond it Spark shuffles both sides.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a frame that is already written or checkpointed for broadcasting, if rows times row_bytes stay within the limit."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def clear(spark: SparkSession) -> int:
    """Delete the tables that `written` left in the shared folder for this application, once no frame needs them; returns their number. For the end of a job."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith(_prefix(spark))] if fs.exists(path) else []
    for p in found:
        fs.delete(p, True)
    return len(found)
