"""Folders and checkpoints that all executors share, and small tables dealt to all cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A table up to this size is dealt anew if it is read by fewer tasks than there are cores.
SMALL_TABLE = 256 << 20


def base(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where that is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="folioflow-")
    return found


def folder(spark: SparkSession) -> str:
    """The name of a new folder there."""
    return f"{base(spark)}/folioflow-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder.

    Spark hands its estimate of df's size on to what is read back, and that of a join is a product: a loop that checkpoints joins
    of joins squares it in each round, until reckoning with it takes longer than the work.  Loops write tables instead."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base(spark))
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of one's own that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores, if it is small and few tasks read it: one row group is one task's, whatever there is to do with each row.

    A table beyond SMALL_TABLE is left where it lies."""
    plan = df._jdf.queryExecution()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) > SMALL_TABLE or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)
