"""Cutting lineage through tables in the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session is used when it is set. Where it is
    unset, a session on one machine (tests) gets a new folder once, kept in its
    checkpoint setting; on a cluster, whose executors would not see it, that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="placelens-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it again.

    The result's lineage starts at files that survive the loss of any executor.
    Shuffle files that nothing refers to any more are let go of.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._placelens_path = path
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()  # Spark's cleaner follows the driver's garbage collection
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by ``materialize``."""
    path = getattr(df, "_placelens_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session sets; it does not follow the size of the data by itself."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
