"""The folder that executors and driver share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-shared-")


def scratch_dir(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir; where that is unset a folder of this machine, if all of Spark runs on it."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _local_dir(spark.sparkContext.applicationId)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: computed once, and there when an executor is lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def place_files(lines: DataFrame, folder: str, compression: str = "none") -> None:
    """Lines (file, line_no, raw) as files of just these names, packed or not; a file that is there is replaced."""
    spark, path = lines.sparkSession, fresh_path(lines.sparkSession, "files")
    lines.repartition("file").sortWithinPartitions("file", "line_no").select("file", F.col("raw").alias("value")).write.option("compression", compression).partitionBy("file").text(path)
    place = spark._jvm.org.apache.hadoop.fs.Path
    system = place(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(place(folder))
    for part in system.globStatus(place(f"{path}/file=*/part-*")):
        name = place(folder, part.getPath().getParent().getName().removeprefix("file="))
        system.delete(name, False)
        system.rename(part.getPath(), name)
