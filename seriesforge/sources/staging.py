"""Intermediate tables in the shared checkpoint folder.

A table that two branches of a job read is written once and read back: the branches then share
one computation, a lost executor costs at most the tasks it ran, and Spark knows the size of
what it joins next, so its own size limit decides between a broadcast and a shuffle.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. A temporary one is set only for a local session."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="seriesforge-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path nothing has been written to."""
    return f"{shared_folder(spark)}/seriesforge/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to a fresh path and return it as a scan of that path."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
