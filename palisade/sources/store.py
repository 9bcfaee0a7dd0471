"""The store of events: asked for the lines of a batch, not read through.

Beside the events (``<path>``, by step and day) stand slim tables:

* ``<path>.lines``: (source_file, line_no, digest of the text) of every line stored, in
  buckets by source and range of lines. New lines meet the buckets they fall into only.
* ``<path>.sources``: stored names and the SHA-256 of their first lines.
* ``<path>.marks``: for each file and step the last line stored, its digest, and what
  parsing on from there has to know: the last dated line, and the last one with a classic
  stamp and its year.

A step writes all of these, the marks last; with them it counts. What a failed step has left
is deleted by the next one. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.operators.parse import CLASSIC
from palisade.sources.lines import ingest_report
from palisade.sources.scratch import stored

#: Lines of a file that share a bucket, and the buckets.
RANGE, BUCKETS = 1 << 20, 512
INDEX = "source_file string, line_no long, digest string"
SOURCES = "name string, fingerprint string"
MARKS = "source_file string, last_line long, digest string, dated struct<line_no:long,raw:string>, clock struct<line_no:long,raw:string,year:int>"
TABLES = (".lines", ".sources", ".marks", "")


def bucket_of(source: Column, line_no: Column) -> Column:
    return F.pmod(F.xxhash64(source, F.floor(line_no / RANGE)), F.lit(BUCKETS)).cast("int")


def once_each(classified: DataFrame) -> DataFrame:
    """Of several fresh lines with one file and number the first text stays fresh; the others are its duplicates or in conflict with it."""
    same = Window.partitionBy("source_file", "line_no").orderBy("raw")
    again = (F.col("status") == "fresh") & (F.row_number().over(same) > 1)
    other = F.when(F.col("raw") == F.first("raw").over(same), "duplicate").otherwise("conflict")
    return classified.withColumn("status", F.when(again, other).otherwise(F.col("status")))


class EventStore:
    """Events under a path, each line once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, table: str, step: int | None = None):
        """A folder as Hadoop's path and file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}{table}" + (f"/step={step}" if step is not None else ""))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _steps(self, table: str) -> list[int]:
        path, system = self._place(table)
        found = [x.getPath().getName() for x in system.listStatus(path)] if system.exists(path) else []
        return sorted(int(x.removeprefix("step=")) for x in found if x.startswith("step="))

    def _done(self, step: int) -> bool:
        path, system = self._place(".marks", step)
        return system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))

    def begin(self) -> int:
        """The number of the next step; what a failed one has left is deleted."""
        done = {s for s in self._steps(".marks") if self._done(s)}
        for table in TABLES:
            for step in set(self._steps(table)) - done:
                path, system = self._place(table, step)
                system.delete(path, True)
        return max(done, default=-1) + 1

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def sources(self) -> DataFrame:
        return self._read(".sources", SOURCES)

    def marks(self) -> DataFrame:
        """One row for each file: its last line, and what comes of all steps for parsing on."""
        rows = self._read(".marks", MARKS)
        return rows.groupBy("source_file").agg(F.max("last_line").alias("last_line"), F.max_by("digest", "last_line").alias("digest"), F.max("dated").alias("dated"), F.max("clock").alias("clock"))

    def known_lines(self, buckets: Iterable[int]) -> DataFrame:
        """(source_file, line_no, digest) of the lines in some buckets."""
        return self._read(".lines", f"{INDEX}, bucket int").where(F.col("bucket").isin(*buckets))

    def classified(self, lines: DataFrame) -> DataFrame:
        """Lines with ``status``, asked of the buckets they fall into: BUCKETS numbers at most come to the driver."""
        placed = lines.withColumns({"digest": F.md5("raw"), "bucket": bucket_of(F.col("source_file"), F.col("line_no"))})
        buckets = sorted(r[0] for r in placed.select("bucket").distinct().collect())
        if not buckets:
            return lines.withColumn("status", F.lit("fresh"))
        held = self.known_lines(buckets).withColumnRenamed("digest", "held")
        status = F.when(F.col("held").isNull(), "fresh").when(F.col("held") == F.col("digest"), "duplicate").otherwise("conflict")
        return placed.join(held, ["bucket", "source_file", "line_no"], "left").withColumn("status", status).select(*lines.columns, "status")

    def append(self, events: DataFrame, sources: DataFrame | None = None, zone: str = "UTC") -> DataFrame:
        """Store the events whose line is not stored yet; the report of ingest_report.

        A line stored with another text is not stored again and counts as a conflict.
        """
        self.begin()  # before anything of a failed step is read
        return self.write(self.classified(events), sources, zone)

    def write(self, classified: DataFrame, sources: DataFrame | None = None, zone: str = "UTC", once: bool = False) -> DataFrame:
        """One step: the fresh ones of classified events (with ``dated`` where that is known), and new names.

        With ``once`` no two of them have one file and number.
        """
        step = self.begin()
        told = stored(classified if once else once_each(classified), "classified")
        fresh = told.where("status = 'fresh'").drop("status")
        fresh.drop("dated").withColumn("event_date", F.to_date("ts")).write.partitionBy("event_date").parquet(f"{self.path}/step={step}")
        index = fresh.select("source_file", "line_no", F.md5("raw").alias("digest"), bucket_of(F.col("source_file"), F.col("line_no")).alias("bucket"))
        index.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}.lines/step={step}")
        if sources is not None:
            sources.select("name", "fingerprint").distinct().write.parquet(f"{self.path}.sources/step={step}")
        dated = F.col("dated") if "dated" in fresh.columns else F.lit(False)
        classic = dated & F.col("raw").rlike(CLASSIC)
        last = F.when(dated, F.struct("line_no", "raw"))
        clock = F.when(classic, F.struct("line_no", "raw", F.year(F.from_utc_timestamp("ts", zone)).alias("year")))
        marks = fresh.groupBy("source_file").agg(F.max("line_no").alias("last_line"), F.md5(F.max_by("raw", "line_no")).alias("digest"), F.max(last).alias("dated"), F.max(clock).alias("clock"))
        marks.write.parquet(f"{self.path}.marks/step={step}")
        return ingest_report(told)


def append_events(events: DataFrame, table_path: str) -> DataFrame:
    """Append events whose (source_file, line_no) the table does not have; the report of ingest_report."""
    return EventStore(events.sparkSession, table_path).append(events)
