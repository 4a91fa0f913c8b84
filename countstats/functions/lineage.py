"""Steps that later ones read more than once are written to the checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where none is set and all runs on one machine, as in tests, a temporary folder becomes it.
    On a cluster that would be a folder of the driver alone, so there it is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return named or context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """``df`` computed once, with its lineage cut; the copy survives lost executors.

    Without this a chain of steps, each used by several others, makes a plan that doubles with each
    step. See ``shared_folder``; ``spark.cleaner.referenceTracking.cleanCheckpoints`` has Spark remove
    the copies that nothing refers to any more.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this session wrote, through the file system that holds it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
