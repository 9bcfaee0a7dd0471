"""Live jobs: following log files, exact alerts after each batch, and watermark-bounded views."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palisade.operators.alerts import ALERT_FIELDS, reconcile, reconcile_counts
from palisade.operators.detect import Machine, keyword_condition, steps_of
from palisade.operators.filters import counted_events
from palisade.operators.parse import parse_events, split_header
from palisade.operators.reports import BUCKETS
from palisade.operators.rules import Keyword, Rule
from palisade.sources.lines import read_if_there, read_log_lines, resolve_sources
from palisade.sources.scratch import stored
from palisade.sources.store import EventStore
from palisade.streaming.keeper import AlertTables

LINE_COLUMNS = ("source_file", "line_no", "raw")
REPORT = "batch_id long, lines long, alerts long"


def stream_lines(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """The files that land in a folder, as a stream of (value, file); the checkpoint remembers which were read."""
    text = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", most_files).text(folder)
    return text.select("value", F.col("_metadata.file_path").alias("file"))


def store_logs(spark: SparkSession, files: str | list[str], table_path: str, parser: str = "auto", year: int | None = None, zone: str = "UTC", modified_after: str | None = None, resume: bool = False) -> DataFrame:
    """Store the lines of files that the table does not have yet, as events; the report per file.

    A file is known by its first line: one that has grown, or was renamed when logs
    rotated, goes on under its stored name, and two files of one name are kept apart. All
    lines are compared with what is stored of their file. With ``resume`` a file whose last
    stored line is still in its place is parsed from there on only, and what stands before
    counts as duplicates. A step that failed half-way can be run again.
    """
    store = EventStore(spark, table_path)
    store.begin()
    lines = read_log_lines(spark, files, with_path=True, modified_after=modified_after)
    begins = lines.groupBy("path").agg(F.min("line_no").alias("line_no"))
    first = lines.join(F.broadcast(begins), ["path", "line_no"]).withColumn("fingerprint", F.sha2("raw", 256))  # one row a file
    known = stored(first.join(store.sources(), "fingerprint", "left"), "files")
    parsed = lines.withColumn("clock_year", F.lit(None).cast("int"))
    skipped = None
    if resume:
        marks = known.where("name IS NOT NULL").join(store.marks().withColumnRenamed("source_file", "name"), "name").select("path", "name", "last_line", "digest", "dated", "clock")
        at_mark = lines.join(marks, "path").where((F.col("line_no") == F.col("last_line")) & (F.md5("raw") == F.col("digest")))
        intact = stored(at_mark.select("path", "name", "last_line", "dated", "clock"), "intact")
        placed = lines.join(intact.select("path", "name", "last_line"), "path", "left")
        skipped = placed.where("line_no <= last_line").groupBy(F.col("name").alias("source_file")).agg(F.count("*").alias("skipped"))
        # What the clock and the undated lines of the rest go on from.
        clock = intact.where("clock IS NOT NULL").select("path", "clock.line_no", "clock.raw", F.col("clock.year").alias("clock_year"))
        dated = intact.where("dated IS NOT NULL AND (clock IS NULL OR dated.line_no <> clock.line_no)").select("path", "dated.line_no", "dated.raw", F.lit(None).cast("int").alias("clock_year"))
        rest = placed.where("last_line IS NULL OR line_no > last_line").withColumn("clock_year", F.lit(None).cast("int"))
        parsed = rest.select("path", "line_no", "raw", "clock_year").unionByName(clock).unionByName(dated)
    headed = stored(split_header(parsed.select(F.col("path").alias("source_file"), *LINE_COLUMNS[1:], "clock_year")), "headed")
    events = parse_events(headed, parser, year, zone, with_dated=True).withColumnRenamed("source_file", "path")
    if resume:
        events = events.join(intact.select("path", "last_line"), "path", "left").where("last_line IS NULL OR line_no > last_line").drop("last_line")
    events = stored(events, "parsed")
    new = events.groupBy("path").agg(F.min("ts").alias("ts")).join(known.where("name IS NULL").select("path", "source_file", *LINE_COLUMNS[1:]), "path")
    names = stored(resolve_sources(new, store.sources()), "sources")
    named = known.where("name IS NOT NULL").select("path", "name").unionByName(names.select("path", "name"))
    told = events.join(named, "path").select(F.col("name").alias("source_file"), *(c for c in events.columns if c != "path"), "path")
    if resume:
        asked = store.classified(told.join(intact, "path", "left_anti").join(names.select("path"), "path", "left_anti"))
        fresh = told.join(intact.select("path").unionByName(names.select("path")), "path", "left_semi").withColumn("status", F.lit("fresh"))
        classified = asked.unionByName(fresh)
    else:
        classified = store.classified(told)
    # Lines of one path are there once; only files that go by one name can have the same line.
    once = named.groupBy("name").agg(F.count("*").alias("files")).where("files > 1").isEmpty()
    report = store.write(classified.drop("path"), names.where("is_new"), zone, once)
    if skipped is None:
        return report
    both = report.join(skipped, "source_file", "full_outer")
    count = lambda c: F.coalesce(c, F.lit(0))
    return both.select("source_file", (count("lines") + count("skipped")).alias("lines"), count("parsed").alias("parsed"), count("unparsed").alias("unparsed"), (count("duplicates") + count("skipped")).alias("duplicates"), count("conflicts").alias("conflicts"))


def changed_files(spark: SparkSession, folder: str, seen: DataFrame, most: int) -> list[tuple]:
    """(path, length, modified) of files under a folder that are new or have changed since they were seen; the oldest ``most``."""
    try:
        there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    listed = there.select("path", "length", F.unix_micros("modificationTime").alias("modified"))
    return [tuple(r) for r in listed.join(seen, ["path", "length", "modified"], "left_anti").orderBy("modified", "path").limit(most).collect()]


FILES = "path string, length long, modified long"


def poll_logs(spark: SparkSession, folder: str, table_path: str, batch_id: int, parser: str = "auto", year: int | None = None, zone: str = "UTC", most_files: int = 1000) -> int:
    """Store what is new in the files of a folder; the number of files that had changed.

    Files that have not changed are not opened; of one that has grown only the new lines
    are parsed. At most ``most_files`` names come to the driver at a time.
    """
    taken = 0
    while True:
        seen = read_if_there(spark, f"{table_path}.files", FILES)
        files = changed_files(spark, folder, seen, most_files)
        if not files:
            return taken
        report = store_logs(spark, [f[0] for f in files], table_path, parser, year, zone, resume=True)
        report.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{table_path}.reports/batch={batch_id}/part={taken}")
        spark.createDataFrame(files, FILES).write.mode("append").parquet(f"{table_path}.files")
        taken += len(files)


def follow_logs(spark: SparkSession, folder: str, table_path: str, checkpoint: str, parser: str = "auto", year: int | None = None, zone: str = "UTC", every: str | None = None):
    """Follow the files of a folder as a running query: new ones, those that grow in place, and those that are renamed when logs rotate.

    Each trigger stores what is new, as events, each line once, and keeps its report at
    ``<table_path>.reports``. ``every`` (as "10 seconds") polls again and again; without it
    there is one trigger, and running it again goes on where it stopped. A trigger that
    failed is run again by the next start.
    """

    def poll(batch: DataFrame, batch_id: int) -> None:
        poll_logs(batch.sparkSession, folder, table_path, batch_id, parser, year, zone)

    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    writer = ticks.writeStream.foreachBatch(poll).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stream_alerts_exact(events: DataFrame, rules: list[Rule], path: str, checkpoint: str):
    """After each batch the tables under path equal a run over all events so far; a report row tells lines and alerts."""

    def run(batch: DataFrame, batch_id: int) -> None:
        tables = AlertTables(batch.sparkSession, path, rules)
        tables.step(batch, batch_id)
        stream_report(batch.sparkSession, tables, path, batch_id)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_report(spark: SparkSession, tables: AlertTables, path: str, batch_id: int) -> None:
    """One row a batch: lines added, alerts in all."""
    row = (batch_id, tables.read_batch(batch_id).count(), tables.read("alerts", batch_id).count())
    spark.createDataFrame([row], REPORT).write.mode("overwrite").parquet(f"{path}/report/of={batch_id}")


def batch_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    return reconcile_counts(reconcile(old.select("alert_key", *ALERT_FIELDS), new.select("alert_key", *ALERT_FIELDS)))


def stream_timeline(events: DataFrame, bucket: str = "1h", watermark: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and warnings per window of the stream; lines later than the watermark may be left out."""
    width = f"{BUCKETS[bucket]} seconds"
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counts = events.withWatermark("ts", watermark).groupBy(window.alias("w")).agg(F.count("*").alias("events"), F.count_if(F.col("level") == "warning").alias("warnings"))
    return counts.select(F.unix_seconds("w.start").alias("bucket_start"), "events", "warnings")


def stream_bursts(events: DataFrame, rule: Rule, watermark: str = "10 minutes") -> DataFrame:
    """(group_key, first_seen, last_seen, count) of closed bursts of a keyword or rare-port rule."""
    kept = events.where(keyword_condition(rule)) if isinstance(rule, Keyword) else events
    kept = counted_events(kept, rule).withWatermark("ts", watermark)
    if rule.cooldown_seconds == 0:
        window = F.window("ts", "1 microsecond")
    else:
        # A session ends at last + gap, and a row at that very time still joins.
        window = F.session_window("ts", f"{rule.cooldown_seconds} seconds")
    grouped = kept.groupBy("key", window.alias("w")).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("count"))
    return grouped.select(F.col("key").alias("group_key"), "first_seen", "last_seen", "count")


#: Rows that wait for the watermark, or stand in the window of a group, and the open alert of a group.
ROW, OPEN = "key string, t long, id long, port int, steps long", "key string, first_id long, last_t long"
EVIDENCE = "group_key string, event_id long, first_id long"
ROCKS_DB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: What groups are dealt to. A trigger asks the state some times for each of these, not for each group.
GROUP_BUCKETS = 1024


class RuleProcessor(StatefulProcessor):
    """The walks of the groups of one bucket along the watermark, their state in pieces.

    New rows are appended to those that wait and nothing else is touched. A timer, of which
    a bucket has one at a time, goes off once the watermark has passed the first row that waits: then all rows
    that it has passed are taken in order, group by group. What is held of a group goes as soon
    as nothing can follow any more.
    """

    def __init__(self, rule: Rule):
        self.rule, self.hold_ms = rule, max(rule.cooldown_seconds, rule.window) * 1000 + 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.recent, self.open = handle.getListState("waiting", ROW), handle.getListState("recent", ROW), handle.getListState("open", OPEN)

    def close(self) -> None:
        pass

    def ring_at(self, when_ms: int) -> None:
        """One timer: the earlier of what is set and what is asked for."""
        timers = list(self.handle.listTimers())
        if not timers or when_ms < min(timers):
            for other in timers:
                self.handle.deleteTimer(other)
            self.handle.registerTimer(when_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        first = None
        for batch in rows:
            ports = [None if pd.isna(p) else int(p) for p in batch["port"]]
            new = list(zip(batch["key"].tolist(), batch["t"].tolist(), batch["id"].tolist(), ports, batch["steps"].tolist(), strict=True))
            if new:
                self.waiting.appendList(new)
                first = min([first, *(w[1] for w in new)], key=lambda t: (t is None, t))
        if first is not None:
            self.ring_at(max(first // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        waiting, ready, recent = [], {}, {}
        for group, *row in self.waiting.get():
            if row[0] // 1000 < mark:
                ready.setdefault(group, []).append(tuple(row))
            else:
                waiting.append((group, *row))
        for group, *row in self.recent.get():
            recent.setdefault(group, []).append(tuple(row))
        opened = {group: (first_id, last_t) for group, first_id, last_t in self.open.get()}
        found, held, still_open, ends = [], [], [], []
        for group in sorted({*ready, *recent, *opened}):
            machine = Machine(self.rule, recent.get(group), *opened.get(group, (None, 0)))
            found += [(group, *out) for row in sorted(ready.get(group, ()), key=lambda w: w[:2]) for out in machine.push(*row)]
            last = max([machine.last_t, *(r[0] for r in machine.recent)]) // 1000 + self.hold_ms
            if mark < last:
                held += [(group, *row) for row in machine.recent]
                if machine.first_id is not None:
                    still_open.append((group, machine.first_id, machine.last_t))
                if machine.recent or machine.first_id is not None:
                    ends.append(last)
        for state, rows in ((self.waiting, waiting), (self.recent, held), (self.open, still_open)):
            state.clear()
            if rows:
                state.put(rows)
        for other in list(self.handle.listTimers()):
            self.handle.deleteTimer(other)
        if waiting or ends:
            self.handle.registerTimer(max(mark + 1, min(w[1] for w in waiting) // 1000 + 1 if waiting else min(ends)))
        if found:
            yield pd.DataFrame(found, columns=["group_key", "event_id", "first_id"])


def stream_detect(events: DataFrame, rule: Rule, watermark: str = "10 minutes") -> DataFrame:
    """Evidence (group_key, event_id, first_id) of a threshold, sequence or port-scan rule.

    Rows wait until the watermark has passed them and are then taken in (ts, id)
    order, so the evidence is that of the batch detector over all rows but those that came
    behind the watermark. State of this kind needs RocksDB, to which the session's state store is set.
    """
    events.sparkSession.conf.set(*ROCKS_DB)
    rows = counted_events(events, rule)
    bucket = F.pmod(F.xxhash64("key"), F.lit(GROUP_BUCKETS)).cast("int").alias("bucket")
    slim = rows.select(bucket, "key", "id", "ts", "t", F.col("dst_port").cast("int").alias("port"), steps_of(rule).alias("steps")).withWatermark("ts", watermark)
    return slim.groupBy("bucket").transformWithStateInPandas(RuleProcessor(rule), EVIDENCE, "append", "eventTime")


def dropped_behind_watermark(query) -> int:
    """Rows that a query's operators left out, of its last progress reports, as they came too late."""
    return sum(int(o["numRowsDroppedByWatermark"]) for p in query.recentProgress for o in p["stateOperators"])
