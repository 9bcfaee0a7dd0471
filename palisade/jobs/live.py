"""Registered queries: streams run over the supplied events until all is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palisade.jobs.detection import ALERTS, ALL_SQL, GUESSED, GUESSED_SQL, RARE, RARE_SQL, RULES, SCAN, SCAN_SQL, THRESHOLD, THRESHOLD_SQL, shown
from palisade.jobs.reporting import E
from palisade.operators.rules import Rule
from palisade.registry import query
from palisade.sources.scratch import fresh_path, place_files
from palisade.sources.views import LOG_EVENTS_SQL, log_events, log_lines
from palisade.streaming import live as S

LAST = "sentinel"


#: Time slices, one a trigger, and what comes later than its slice: a tenth of the events three triggers later, which is
#: behind the watermark (that of the trigger before the last one decides), and of a slice's last day another tenth one
#: trigger later, which is not.
SLICES, TOO_LATE, LATE, WATERMARK = 5, 3, 5, "2 days"
_SLICE = f"(epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) * {SLICES} // (SELECT max(epoch_us(ts)) - min(epoch_us(ts)) + 1 FROM events)"
#: The events that are in time.
IN_TIME_SQL = LOG_EVENTS_SQL.replace("log_events AS (", "whole AS (", 1) + f", log_events AS (SELECT * FROM whole WHERE NOT (id % 10 = {TOO_LATE} AND {_SLICE} < {SLICES - 1}))"


#: Rows, about, of a file that lands; a trigger has as many files as its rows need.
ROWS_A_FILE = 50_000


def land(dealt: DataFrame, triggers: int, path: str) -> int:
    """Rows with their ``trigger`` into a folder, trigger by trigger and each in the same number of files, which is returned."""
    spark, staged = dealt.sparkSession, fresh_path(dealt.sparkSession, "staged")
    dealt = dealt.withColumn("trigger", F.col("trigger").cast("int"))
    dealt.write.partitionBy("trigger").parquet(staged)
    rows = spark.read.schema(dealt.schema).parquet(staged)
    most = rows.groupBy("trigger").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    files = max(1, -(-most // ROWS_A_FILE))
    for k in range(triggers):
        rows.where(F.col("trigger") == k).drop("trigger").repartition(files, "id").write.mode("append").parquet(path)
        fill_up(spark, path, dealt.drop("trigger").schema, files * (k + 1))
    return files


def fill_up(spark: SparkSession, path: str, schema: StructType, files: int) -> None:
    """Files without rows into a folder that has fewer than so many."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    system = place(path).getFileSystem(conf)
    missing = files - len(system.globStatus(place(f"{path}/part-*")))
    if missing > 0:
        empty = fresh_path(spark, "empty")
        spark.createDataFrame([], schema).coalesce(1).write.parquet(empty)
        [source] = system.globStatus(place(f"{empty}/part-*"))
        for k in range(missing):
            spark._jvm.org.apache.hadoop.fs.FileUtil.copy(system, source.getPath(), system, place(path, f"part-none-{files - k}.parquet"), False, conf)


def landed(spark: SparkSession, sf_dir: str, closing: bool = True) -> DataFrame:
    """log_events as a stream of eight triggers, some lines late and some too late; the last has events a year later, which move the watermark past all others."""
    path, events = fresh_path(spark, "landed"), log_events(spark, sf_dir)
    t = F.unix_micros("ts")
    first, last = events.agg(F.min(t), F.max(t)).first()
    piece = F.expr(f"(unix_micros(ts) - {first or 0}) * {SLICES} DIV {(last or 0) - (first or 0) + 1}")
    end = F.lit(first or 0) + (piece + 1) * (((last or 0) - (first or 0) + 1) // SLICES)
    too_late = (F.pmod("id", F.lit(10)) == TOO_LATE) & (piece < SLICES - 1)
    late = (F.pmod("id", F.lit(10)) == LATE) & (t >= end - 86_400_000_000)
    dealt = events.withColumn("trigger", piece + F.when(too_late, 3).when(late, 1).otherwise(0))
    files = land(dealt, SLICES + 2, path)
    if closing:
        newest = events.orderBy(F.desc("ts")).limit(1)
        ends = [newest.withColumns({"id": F.lit(-k).cast("long"), "ts": F.col("ts") + F.expr("INTERVAL 365 DAYS"), "src_ip": F.lit(LAST), **own}) for k, own in ((1, {"action": F.lit("auth_fail")}), (2, {"action": F.lit("conn_allow"), "dst_port": F.lit(22)}))]
        ends[0].unionByName(ends[1]).coalesce(1).write.mode("append").parquet(path)
        fill_up(spark, path, events.schema, files * (SLICES + 3))
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)


def finished(stream: DataFrame, spark: SparkSession, mode: str = "append", told=None) -> DataFrame:
    """All rows of a stream that reads what there is: appended, or the last complete result."""
    out = fresh_path(spark, "stream-out")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}" if mode == "append" else f"{out}/batch=0")

    writer = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", fresh_path(spark, "stream-state"))
    # Each trigger opens every partition of the state; a stream keeps the number that is set when it first starts.
    many = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(many), 2 * spark.sparkContext.defaultParallelism)))
    try:
        running = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", many)
    running.awaitTermination()
    if told is not None:
        told(running)
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


def in_time(*ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join((IN_TIME_SQL, *ctes))}"


@query("stream_timeline", f"{in_time()} SELECT epoch_us(ts) // 3600000000 * 3600 AS bucket_start, count(*) AS events, count(*) FILTER (level = 'warning') AS warnings FROM log_events GROUP BY 1")
def stream_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed hours, without the lines that came behind the watermark."""
    first = log_events(spark, sf_dir).agg(F.max("ts")).first()[0]
    out = finished(S.stream_timeline(landed(spark, sf_dir), "1h", WATERMARK), spark)
    return out.where(F.timestamp_seconds("bucket_start") <= F.lit(first))


@query("stream_bursts", f"{in_time(RARE_SQL)} SELECT group_key, min(t) AS first_us, max(t) AS last_us, count(*) AS count FROM rare GROUP BY group_key, alert_key")
def stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = finished(S.stream_bursts(landed(spark, sf_dir), RARE, WATERMARK), spark)
    return out.where(F.col("group_key") != LAST).select("group_key", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "count")


def _stream_detect(rule: Rule):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = finished(S.stream_detect(landed(spark, sf_dir), rule, WATERMARK), spark)
        return out.where(F.col("group_key") != LAST).select("group_key", "event_id", F.concat_ws(":", F.lit(rule.id), "group_key", F.col("first_id").cast("string")).alias("alert_key"))

    return run


query("stream_threshold", f"{in_time(THRESHOLD_SQL)} SELECT group_key, event_id, alert_key FROM thr")(_stream_detect(THRESHOLD))
query("stream_port_scan", f"{in_time(SCAN_SQL)} SELECT group_key, event_id, alert_key FROM scan")(_stream_detect(SCAN))
query("stream_sequence", f"{in_time(GUESSED_SQL, recursive=True)} SELECT group_key, event_id, alert_key FROM guessed")(_stream_detect(GUESSED))


@query("stream_dropped", f"{in_time()} SELECT (SELECT count(*) FROM whole WHERE action = 'auth_fail') - (SELECT count(*) FROM log_events WHERE action = 'auth_fail') AS dropped")
def stream_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the threshold rule's lines came behind the watermark, by the query's own progress."""
    n: list[int] = []
    finished(S.stream_detect(landed(spark, sf_dir), THRESHOLD, WATERMARK), spark, told=lambda q: n.append(S.dropped_behind_watermark(q)))
    return spark.range(1).select(F.lit(n[0]).cast("long").alias("dropped"))


BATCHES = 5


def in_batches(spark: SparkSession, sf_dir: str, batches: int = BATCHES) -> DataFrame:
    """log_events as a stream of so many triggers, each with events of all times: later ones come late for most groups."""
    path, events = fresh_path(spark, "landed"), log_events(spark, sf_dir)
    files = land(events.withColumn("trigger", F.pmod("id", F.lit(batches))), batches, path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)


def _kept(spark: SparkSession, sf_dir: str, rules: list[Rule]) -> tuple[S.AlertTables, str]:
    """Alert tables after five batches."""
    path = fresh_path(spark, "alert-tables")
    S.stream_alerts_exact(in_batches(spark, sf_dir), rules, path, fresh_path(spark, "stream-state")).awaitTermination()
    return S.AlertTables(spark, path, rules), path


@query("stream_alerts", f"{ALL_SQL} {ALERTS.format(n='every')}")
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_kept(spark, sf_dir, RULES)[0].read("alerts"))


@query("stream_evidence", f"{ALL_SQL} SELECT rule_id, group_key, alert_key, event_id, t AS ts_us, port FROM every")
def stream_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence after five batches, each of which redoes only the buckets it touches."""
    evidence = _kept(spark, sf_dir, RULES)[0].read("evidence")
    return evidence.select("rule_id", "group_key", "alert_key", "event_id", F.unix_micros("ts").alias("ts_us"), "port")


#: log_events as often as there are batches from its own on, the batch's number at the end of each source: what every batch has seen.
_SO_FAR_SQL = LOG_EVENTS_SQL.replace("log_events AS (", "whole AS (", 1) + f", log_events AS (SELECT w.* REPLACE (w.src_ip || '/' || k AS src_ip) FROM whole w, range({BATCHES}) r(k) WHERE w.id % {BATCHES} <= k)"


@query("stream_report", f"{ALL_SQL.replace(LOG_EVENTS_SQL, _SO_FAR_SQL)}, a AS (SELECT split_part(group_key, '/', 2)::BIGINT AS batch_id, count(DISTINCT alert_key) AS alerts FROM every GROUP BY 1), b AS (SELECT event_id % {BATCHES} AS batch_id, count(*) AS lines FROM events GROUP BY 1) SELECT batch_id, lines, coalesce(alerts, 0) AS alerts FROM b LEFT JOIN a USING (batch_id)")
def stream_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines added by each of five batches, and the alerts of all rules after it."""
    _, path = _kept(spark, sf_dir, RULES)
    return spark.read.schema(S.REPORT).parquet(f"{path}/report").select("batch_id", "lines", "alerts")


_ROWS = ("host", "service", "action", "user", "src_ip", "dst_port", "message")
_SHOWN = ", ".join(f'"{c}"' for c in _ROWS)
_SECONDS = "CASE WHEN service = 'kernel' THEN epoch_us(date_trunc('second', ts)) ELSE epoch_us(ts) END AS ts_us"


@query("stream_lines", f"{E} SELECT {_SHOWN}, {_SECONDS} FROM log_events")
def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, store, state = (fresh_path(spark, n) for n in ("logs", "events", "stream-state"))
    lines = log_lines(spark, sf_dir)
    lines.repartition("source_file").sortWithinPartitions("source_file", "line_no").select(F.col("raw").alias("value")).write.text(folder)
    for _ in range(2):  # the second run finds nothing new
        S.follow_logs(spark, folder, store, state, year=2024).awaitTermination()
    return spark.read.parquet(store).select(*_ROWS, F.unix_micros("ts").alias("ts_us"))


# Each file grows to two thirds; then it is renamed, with a few more lines, and the rest goes to a new file of its name.
_THIRDS = "n AS (SELECT max(event_id) + 1 AS n FROM events), parts AS (SELECT l.*, CASE WHEN id < 2 * n // 3 + n // 30 THEN 0 ELSE 1 END AS part FROM log_events l, n)"
_DAYS = "days AS (SELECT host, strftime(arg_min(ts, id), '%Y-%m-%d') AS day FROM parts WHERE part = 1 GROUP BY host)"


@query("followed_logs", f"{E}, {_THIRDS}, {_DAYS} SELECT host || CASE WHEN part = 0 THEN '.log' ELSE '.log (' || day || ')' END AS source_file, row_number() OVER (PARTITION BY host, part ORDER BY id) AS line_no, {_SHOWN}, {_SECONDS} FROM parts LEFT JOIN days USING (host)")
def followed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs that grow in place and rotate, followed in four triggers: what is parsed later goes on from what is stored."""
    folder, store, state = (fresh_path(spark, n) for n in ("logs", "events", "stream-state"))
    lines = log_lines(spark, sf_dir)
    n = lines.agg(F.max("line_no") + 1).first()[0] or 0
    old = lambda upto, name: lines.where(F.col("line_no") < upto).select(F.concat("source_file", F.lit(name)).alias("file"), "line_no", "raw")
    turned = 2 * n // 3 + n // 30
    rest = lines.where(F.col("line_no") >= turned).select(F.col("source_file").alias("file"), "line_no", "raw")
    for files in (old(n // 3, ""), old(2 * n // 3, ""), old(turned, ".1").unionByName(rest.where(F.col("line_no") < turned + n // 10)), rest):
        place_files(files, folder)
        S.follow_logs(spark, folder, store, state, year=2024).awaitTermination()
    return spark.read.parquet(store).select("source_file", "line_no", *_ROWS, F.unix_micros("ts").alias("ts_us"))
