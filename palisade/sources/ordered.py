"""Events laid out in time, with the times of each file kept beside them, so that a page opens few files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.reports import events_page

RANGES = "file string, rows long, first struct<t:long,id:long>, last struct<t:long,id:long>"


class OrderedEvents:
    """Files of events in (ts, id) order under a path. Batches may overlap in time; the ranges of their files say where."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def step(self, batch: DataFrame, batch_id: int, rows_a_file: int = 1_000_000) -> None:
        """Write a batch by ranges of time, each in order; taking it in again replaces it."""
        place = f"{self.path}/events/batch={batch_id}"
        batch.repartitionByRange("ts", "id").sortWithinPartitions("ts", "id").write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).parquet(place)
        at = F.struct(F.unix_micros("ts").alias("t"), "id")
        ranges = self.spark.read.parquet(place).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), F.min(at).alias("first"), F.max(at).alias("last"))
        ranges.write.mode("overwrite").parquet(f"{self.path}/ranges/batch={batch_id}")

    def ranges(self) -> DataFrame:
        try:
            return self.spark.read.schema(RANGES).parquet(f"{self.path}/ranges").drop("batch")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], RANGES)

    def _read(self, files: list[str]) -> DataFrame:
        whole = self.spark.read.parquet(f"{self.path}/events").drop("batch")
        return self.spark.read.schema(whole.schema).parquet(*files) if files else whole.where("false")

    def between(self, start_us: int, end_us: int) -> DataFrame:
        """Events with start <= ts < end; other files are not opened, and in these row groups are left out by their statistics."""
        met = self.ranges().where((F.col("last.t") >= start_us) & (F.col("first.t") < end_us))
        ts = F.unix_micros("ts")
        bounds = (F.col("ts") >= F.timestamp_micros(F.lit(start_us))) & (F.col("ts") < F.timestamp_micros(F.lit(end_us)))
        return self._read([r.file for r in met.select("file").collect()]).where(bounds & (ts >= start_us))

    def page(self, after: tuple | None = None, order: str = "asc", limit: int = 100) -> DataFrame:
        """events_page, from as few files as surely hold the page.

        ``after`` is (microseconds, id). Of the files wholly past it, those that end first
        hold a page's rows together at some point; no file that begins after that is needed.
        """
        near, far, rising = ("first", "last", True) if order == "asc" else ("last", "first", False)
        past = lambda c: F.lit(True) if after is None else _beyond(c, after, rising)
        files = self.ranges().where(past(far))
        wholly = files.where(past(near)).orderBy(F.col(far).asc() if rising else F.col(far).desc())
        # A file holds a row at least: the first limit + 1 of them are enough.
        bound, held = None, 0
        for r in wholly.select("rows", far).limit(limit + 1).collect():
            held += r.rows
            bound = r[far]
            if held > limit:
                break
        if held > limit:
            edge = F.struct(F.lit(bound.t).cast("long").alias("t"), F.lit(bound.id).cast("long").alias("id"))
            files = files.where(F.col(near) <= edge if rising else F.col(near) >= edge)
        cursor = None if after is None else (F.timestamp_micros(F.lit(after[0])), after[1])
        return _page(self._read([r.file for r in files.select("file").collect()]), cursor, order, limit)


def _beyond(column: str, after: tuple, rising: bool):
    at = F.struct(F.lit(after[0]).cast("long").alias("t"), F.lit(after[1]).cast("long").alias("id"))
    return F.col(column) > at if rising else F.col(column) < at


def _page(events: DataFrame, cursor: tuple | None, order: str, limit: int) -> DataFrame:
    if cursor is None:
        return events_page(events, None, order, limit)
    ts, id_ = cursor
    past = (F.col("ts") > ts) | ((F.col("ts") == ts) & (F.col("id") > id_)) if order == "asc" else (F.col("ts") < ts) | ((F.col("ts") == ts) & (F.col("id") < id_))
    bound = F.col("ts") >= ts if order == "asc" else F.col("ts") <= ts
    return events_page(events.where(bound & past), None, order, limit)
