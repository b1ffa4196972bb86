"""Lineage cuts in the folder that all executors and the driver share.

The folder is the session's ``spark.checkpoint.dir``. Only a session without one (a local test) gets a
temporary folder of its own. Tables that only a step of an operator reads are deleted with `forget` as soon as what was
made of them is written; those that a returned DataFrame still reads stay until `clear`.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ours: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; sets one for a session that has none."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: later reads don't compute it again, and survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _ours.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_path = path
    return back


def _deleted(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    if path in _ours:
        _ours.remove(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `written` gave, which nothing reads any more; other DataFrames are left alone."""
    for table in tables:
        if path := getattr(table, "_written_path", None):
            _deleted(table.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now, rather than when the driver's memory next runs full."""
    for _ in range(2):  # what the first round frees on the Python side, the second frees in the JVM
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this process wrote and that are still there; results that read them can't be read again."""
    for path in list(_ours):
        _deleted(spark, path)
