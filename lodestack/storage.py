"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a temporary folder in local mode, and an error on a cluster, whose executors couldn't read one."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="lodestack-")
        spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed through Hadoop's file system when the driver ends."""
    path = f"{shared_dir(spark)}/lodestack-{name}-{uuid.uuid4().hex}"
    if not _FOLDERS:
        atexit.register(_clean)
    _FOLDERS.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _FOLDERS:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: its owner clears the shared folder
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` once as Parquet in the shared folder and read it back.

    Unlike a cache, the table survives the loss of executors, and unlike checkpoint() it stays columnar,
    so later scans prune columns.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
