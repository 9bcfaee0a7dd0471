"""What the operators share: tables, the shared folder, Arrow helpers."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-shared-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver can see, as the cluster names it in ``spark.checkpoint.dir``.

    Where that is unset a folder of this machine serves, but only if all of Spark runs on it.
    """
    if found := spark.conf.get(CHECKPOINT_KEY, None):
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
    return _local_dir(spark.sparkContext.applicationId)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    return Tables().written(df, name)


class Tables:
    """Tables written on the way to a result; dropped once the result itself is written, as nothing reads them then."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
        self.paths.append((df.sparkSession, path))
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for spark, path in self.paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = []


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, list[bytes]]]:
    """UTF-8 texts (null: empty) in runs of about ``most_bytes``: (first row, texts)."""
    first, size, out = 0, 0, []
    for row, value in enumerate(texts):
        data = value.as_py()
        data = b"" if data is None else data.encode("utf-8", "surrogatepass") if isinstance(data, str) else data
        out.append(data)
        size += len(data)
        if size >= most_bytes:
            yield first, out
            first, size, out = row + 1, 0, []
    if out:
        yield first, out
