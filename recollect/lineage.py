"""Cutting lineage so that jobs survive the loss of executors and repeat nothing."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    One of our own is taken only on a local master; a cluster without the setting is an error, as data in
    a machine-local folder would be lost.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if context.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir isn't set: name a folder that all executors share")
    return "file:///tmp/recollect-checkpoints"


def scratch(spark: SparkSession) -> str:
    """A new folder of one's own within the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


def discard(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes for each core, up to which a table of few files is small.
SMALL = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table read from fewer files than there are cores, over as many partitions as cores; any other as it is.

    One row group is read by one task, whatever the work on its rows. Large tables have more of them than cores.
    """
    context = df.sparkSession.sparkContext
    files, cores = df.inputFiles(), context.defaultParallelism
    if not 0 < len(files) < cores:
        return df
    paths = [context._jvm.org.apache.hadoop.fs.Path(f) for f in files]
    size = sum(p.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)
    return df.repartition(cores) if size < SMALL * cores else df


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder, so a lost executor costs no recomputation before it."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)



@contextmanager
def sweeping(spark: SparkSession):
    """Has what is settled within drop its shuffle files as soon as it is done, not when the driver collects garbage.

    Only for frames that are run once: one that is made within and run again has to shuffle again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
