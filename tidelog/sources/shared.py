"""Intermediate tables in the folder that driver and executors share."""

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_checkpointing: list = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, and driver and executors are one process, a folder of our own."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidelog-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and reread from the shared folder; its lineage is cut. The files go when this process ends."""
    folder, context = shared_folder(df.sparkSession), df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    if context not in _checkpointing:
        _checkpointing.append(context)
        atexit.register(remove, df.sparkSession, context.getCheckpointDir())  # a folder of this context's own below the one that was set
    return df.checkpoint(eager=True)


class SharedTables:
    """Parquet tables in the shared folder. They go with ``drop``, or else when this process ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []
        atexit.register(self.drop)

    def folder(self) -> str:
        """A path of its own, for whatever is written there."""
        self.paths.append(f"{shared_folder(self.spark)}/tidelog-{uuid.uuid4().hex}")
        return self.paths[-1]

    def put(self, df: DataFrame) -> DataFrame:
        path = self.folder()
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths.clear()


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    with contextlib.suppress(Exception):
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
