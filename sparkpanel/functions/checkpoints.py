"""Checkpoint folder and written intermediate tables for iterative operators."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use the folder of spark.checkpoint.dir; make one only in local mode, where none is set."""
    if spark.sparkContext.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparkpanel-"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    ensure_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


#: Intermediate tables of this process that haven't been dropped.
_tables: set[str] = set()


def remember(spark: SparkSession, path: str) -> None:
    """Drop a table when the driver's process ends, if it isn't dropped before."""
    _tables.add(path)
    atexit.register(drop_table, spark, path)


def release(df: DataFrame) -> None:
    """Delete the intermediate tables that a result reads; the result can't be computed again after that.

    For long sessions: results of operators that write tables are lazy, so their last tables
    stay until someone says that they have been used. What wasn't written by this library stays.
    """
    read = df.inputFiles()
    for path in [p for p in _tables if any(f"/{p.rsplit('/', 1)[-1]}/" in f for f in read)]:  # names are unique
        drop_table(df.sparkSession, path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate table; nothing happens once the session has ended."""
    _tables.discard(path)
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001
        pass


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now.

    Spark does so when the driver collects its garbage, which a driver with
    little to do may not for long while executors' disks fill.
    """
    for _ in range(2):  # the first collection lets go of finished plans, the second of their shuffles
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared checkpoint folder, read again, and its path.

    Lineage ends there, and values that depend on how Spark dealt the rows
    (partition numbers, positions) stay as they are when a task runs again. The
    table goes by ``drop_table`` or with the driver's process.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    remember(spark, path)
    return spark.read.schema(df.schema).parquet(path), path
