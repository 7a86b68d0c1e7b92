"""Where intermediate tables go: the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_WRITTEN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.  Where none is set, a single-JVM session gets a folder of its own;
    on a cluster that is an error, since executors would each write to their own disks."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folioscope-"))
        base = spark.sparkContext.getCheckpointDir()
        _WRITTEN.add(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def delete(path: str) -> None:
    jvm, context = SparkContext._jvm, SparkContext._active_spark_context
    if jvm is None:
        return
    conf = context._jsc.hadoopConfiguration() if context is not None else jvm.org.apache.hadoop.conf.Configuration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)
    _WRITTEN.discard(path)


@atexit.register
def sweep() -> None:
    """Delete all that this process has written: frames that read it are lazy and do not outlive it."""
    for path in list(_WRITTEN):
        try:
            delete(path)
        except Exception:  # noqa: BLE001 - the JVM may be gone; nothing is left to do then
            return


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and any executor may be lost."""
    return materialise_at(df, new_path(df.sparkSession, name))


def materialise_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
