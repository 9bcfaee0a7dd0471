"""Rollups: counts that add up and sketches that unite, by hour and by source and day, kept batch by batch.

A report over any range is read from these instead of the events: whole hours from the
table, and only the ragged ends of a range from events. Counts are exact. Different
sources and ports are estimated: with 2**SKETCH_BITS registers the standard error is
1.04 / sqrt(2**SKETCH_BITS), 0.8 %, and BOUND is four times that.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR, DAY = 3600, 86_400
SKETCH_BITS, BOUND = 14, 0.033
HOURLY = "hour long, events long, parsed long, warnings long, first_us long, last_us long, sources binary"
DAILY = "day long, src_ip string, packets long, blocked long, allowed long, ports binary"


def _sketch(value: Column) -> Column:
    return F.hll_sketch_agg(value, F.lit(SKETCH_BITS))


def hourly(events: DataFrame, bucket: int = HOUR) -> DataFrame:
    """A row for each hour with events."""
    t = F.unix_micros("ts")
    return events.groupBy(F.floor(F.unix_seconds("ts") / bucket).cast("long").alias("hour")).agg(
        F.count("*").alias("events"), F.count_if(F.col("parsed")).alias("parsed"), F.count_if(F.col("level") == "warning").alias("warnings"), F.min(t).alias("first_us"), F.max(t).alias("last_us"), _sketch(F.col("src_ip")).alias("sources")
    )


def daily_packets(events: DataFrame) -> DataFrame:
    """A row for each source and day with packets."""
    packets = events.where("src_ip IS NOT NULL AND dst_port IS NOT NULL")
    verdict = lambda v: F.count_if(F.col("action") == v)
    return packets.groupBy(F.floor(F.unix_seconds("ts") / DAY).cast("long").alias("day"), "src_ip").agg(F.count("*").alias("packets"), verdict("conn_block").alias("blocked"), verdict("conn_allow").alias("allowed"), _sketch(F.col("dst_port")).alias("ports"))


def united(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of any number of batches as one for each key: sums, first and last, and united sketches."""
    how = {"sources": F.hll_union_agg, "ports": F.hll_union_agg, "first_us": F.min, "last_us": F.max}
    return rows.groupBy(*by).agg(*[how.get(c, F.sum)(c).alias(c) for c in rows.columns if c not in by])


def totals_of(rows: DataFrame) -> DataFrame:
    """One row of all: events, parsed, unparsed, ratio, first_us, last_us, sources (estimated)."""
    one = united(rows.drop("hour"), [])
    count = lambda c: F.coalesce(c, F.lit(0))
    ratio = F.when(F.col("events") > 0, F.round(F.col("parsed") / F.col("events"), 4)).otherwise(F.lit(0.0))
    return one.select(
        count("events").alias("events"), count("parsed").alias("parsed"), (count("events") - count("parsed")).alias("unparsed"), F.coalesce(ratio, F.lit(0.0)).alias("ratio"), "first_us", "last_us", F.coalesce(F.hll_sketch_estimate("sources"), F.lit(0)).alias("sources")
    )


class Rollup:
    """Rollups under a path; a batch that is taken in again replaces its rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def step(self, batch: DataFrame, batch_id: int) -> None:
        """Add a batch. Late events simply add rows to hours that are there already."""
        hourly(batch).write.mode("overwrite").parquet(f"{self.path}/hourly/batch={batch_id}")
        daily_packets(batch).repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/daily/batch={batch_id}")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").drop("batch")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def hours(self) -> DataFrame:
        return united(self._read("hourly", HOURLY), ["hour"])

    def timeline(self, bucket_seconds: int = HOUR, start_hour: int | None = None, end_hour: int | None = None) -> DataFrame:
        """(bucket_start, events, warnings, sources) for buckets of whole hours."""
        rows = self._read("hourly", HOURLY)
        rows = rows if start_hour is None else rows.where(F.col("hour") >= start_hour)
        rows = rows if end_hour is None else rows.where(F.col("hour") < end_hour)
        start = F.floor(F.col("hour") * HOUR / bucket_seconds).cast("long") * bucket_seconds
        return united(rows.withColumn("bucket_start", start).drop("hour", "first_us", "last_us"), ["bucket_start"]).select("bucket_start", "events", "warnings", F.hll_sketch_estimate("sources").alias("sources"))

    def totals(self, start: datetime, end: datetime, events: DataFrame) -> DataFrame:
        """Totals of start <= ts < end: whole hours from the table, the hours that the range cuts from the events."""
        a, b = int(start.timestamp() * 1_000_000), int(end.timestamp() * 1_000_000)
        width = HOUR * 1_000_000
        first, last = -(-a // width), max(b // width, -(-a // width))
        t = F.unix_micros("ts")
        inside = (t >= a) & (t < b) & ((t < first * width) | (t >= last * width))
        ends = hourly(events.where(inside))
        whole = self._read("hourly", HOURLY).where((F.col("hour") >= first) & (F.col("hour") < last))
        return totals_of(whole.unionByName(ends))

    def port_totals(self, first_day: int | None = None, end_day: int | None = None) -> DataFrame:
        """(src_ip, packets, blocked, allowed, ports) of some days, or all; ports are estimated."""
        rows = self._read("daily", DAILY)
        rows = rows if first_day is None else rows.where(F.col("day") >= first_day)
        rows = rows if end_day is None else rows.where(F.col("day") < end_day)
        return united(rows.drop("day"), ["src_ip"]).withColumn("ports", F.hll_sketch_estimate("ports"))
