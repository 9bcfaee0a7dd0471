"""Registered queries: reading, parsing, identity and accounting of log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators import parse as G
from palisade.registry import query, table
from palisade.sources import lines as L
from palisade.sources.scratch import fresh_path, place_files
from palisade.sources.store import append_events
from palisade.sources.views import LOG_EVENTS_SQL, log_events, log_lines

E = f"WITH {LOG_EVENTS_SQL}"
_TS = "CASE WHEN service = 'kernel' THEN epoch_us(date_trunc('second', ts)) ELSE epoch_us(ts) END"


@query("parsed_lines", f'{E} SELECT source_file, line_no, {_TS} AS ts_us, host, service, level, action, "user", src_ip, src_port, dst_ip, dst_port, message, parsed FROM log_events')
def parsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = G.parse_events(log_lines(spark, sf_dir), "auto", 2024)
    return e.select("source_file", "line_no", F.unix_micros("ts").alias("ts_us"), "host", "service", "level", "action", "user", "src_ip", "src_port", "dst_ip", "dst_port", "message", "parsed")


@query("parsed_auth_only", f"{E} SELECT line_no, CASE WHEN service = 'sshd' THEN action END AS action, CASE WHEN service = 'sshd' THEN src_ip END AS src_ip FROM log_events")
def parsed_auth_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.parse_events(log_lines(spark, sf_dir), "auth", 2024).select("line_no", "action", "src_ip")


@query("parsed_packets_only", f"{E} SELECT line_no, CASE WHEN service = 'kernel' THEN action END AS action, dst_port FROM log_events")
def parsed_packets_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.parse_events(log_lines(spark, sf_dir), "ufw", 2024).select("line_no", "action", "dst_port")


@query("packet_fields", f"{E} SELECT id, src_ip AS src, dst_ip AS dst, 'TCP' AS proto, dst_port AS dpt, CASE WHEN message LIKE '[UFW BLOCK]%' THEN 'conn_block' ELSE 'conn_allow' END AS verdict FROM log_events WHERE service = 'kernel'")
def packet_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = log_events(spark, sf_dir).where("service = 'kernel'").withColumn("f", G.parse_fields(F.col("message")))
    get = lambda k: F.try_element_at("f", F.lit(k))
    return e.select("id", get("SRC").alias("src"), get("DST").alias("dst"), get("PROTO").alias("proto"), G.port_or_null(get("DPT")).alias("dpt"), G.packet_verdict(F.col("message")).alias("verdict"))


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classic stamps of all events, moved so that the month crosses New Year."""
    e = log_events(spark, sf_dir).withColumn("ts", F.col("ts") - F.expr("INTERVAL 18 DAYS"))
    stamp = F.concat(F.date_format("ts", "MMM"), F.lit(" "), F.lpad(F.date_format("ts", "d"), 2, " "), F.date_format("ts", " HH:mm:ss"))
    return e.select("source_file", "line_no", F.concat(stamp, F.lit(" "), "host", F.lit(" shop: "), "message").alias("raw"))


@query("resolved_years", f"{E} SELECT line_no, epoch(date_trunc('second', ts - INTERVAL 18 DAYS))::BIGINT AS local_s FROM log_events")
def resolved_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.resolve_years(G.split_header(_shifted(spark, sf_dir)), 2023).select("line_no", F.col("local").alias("local_s"))


@query("guessed_years", f"{E} SELECT line_no, CASE WHEN make_date(2024, month(ts), day(ts)) <= DATE '2024-01-16' THEN 2024 ELSE 2023 END AS year FROM log_events")
def guessed_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = log_events(spark, sf_dir)
    return e.select("line_no", G.guess_year(F.month("ts"), F.dayofmonth("ts"), F.lit("2024-01-15").cast("date")).alias("year"))


@query("zoned_times", f"{E} SELECT line_no, epoch_us(ts - INTERVAL 3 HOURS) AS utc_us FROM log_events WHERE service <> 'kernel'")
def zoned_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = log_lines(spark, sf_dir).withColumn("raw", F.regexp_replace("raw", r"\+00:00 ", " "))
    dated = G.dated_lines(bare, 2024, "Europe/Istanbul")
    return dated.where(~F.col("message").startswith("[")).select("line_no", F.unix_micros("ts").alias("utc_us"))


_GAPS = "CASE WHEN line_no % 5 IN (0, 1) THEN 'continued ' || line_no ELSE NULL END"


@query("filled_lines", f"{E}, g AS (SELECT source_file, line_no, {_GAPS} AS gap, {_TS} AS t, message, host FROM log_events), d AS (SELECT *, last_value(CASE WHEN gap IS NULL THEN t END IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY line_no) AS up, first_value(CASE WHEN gap IS NULL THEN t END IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS down FROM g) SELECT line_no, coalesce(up, down) AS ts_us, host, coalesce(gap, message) AS message FROM d")
def filled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = log_lines(spark, sf_dir).withColumn("raw", F.when(F.col("line_no") % 5 <= 1, F.concat(F.lit("continued "), F.col("line_no").cast("string"))).otherwise(F.col("raw")))
    return G.parse_events(lines, "auto", 2024).select("line_no", F.unix_micros("ts").alias("ts_us"), "host", "message")


def _text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents as files of lines by source, numbered in order of documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    return d.select(F.col("source").alias("source_file"), (F.col("doc_id") * 100_000 + F.col("at")).alias("line_no"), "raw").where("trim(raw) <> ''")


@query("refused_files", "SELECT DISTINCT source AS source_file FROM documents WHERE trim(replace(replace(text, chr(10), ''), chr(13), '')) <> ''")
def refused_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = log_lines(spark, sf_dir).unionByName(_text_lines(spark, sf_dir))
    return G.split_refused(G.dated_lines(lines, 2024))[1]


@query("numbered_lines", f"{E} SELECT source_file, row_number() OVER (PARTITION BY source_file ORDER BY line_no) AS line_no, message FROM log_events")
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "lines")
    files = log_lines(spark, sf_dir).withColumn("file", F.regexp_replace("source_file", r"\.log$", ""))
    files.repartition("file").sortWithinPartitions("file", "line_no").select("file", F.col("raw").alias("value")).write.partitionBy("file").text(path)
    read = L.read_log_lines(spark, path)
    host = F.regexp_extract("raw", r"(host-\d+) (?:kernel|sshd|shop)", 1)
    return read.select(F.concat(host, F.lit(".log")).alias("source_file"), "line_no", F.regexp_extract("raw", r"(?:kernel: \[12345\.678901\]|sshd\[77\]:|shop\[77\]:) (.*)$", 1).alias("message"))


@query("packed_lines", f"{E} SELECT source_file, row_number() OVER (PARTITION BY source_file ORDER BY id) AS line_no, message FROM log_events")
def packed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files packed in three ways, all under plain names: told by their first bytes."""
    folder, lines = fresh_path(spark, "packed"), log_lines(spark, sf_dir).withColumn("file", F.col("source_file"))
    for k, way in enumerate(("gzip", "bzip2", "none")):
        place_files(lines.where(F.substring("file", 6, 1).cast("int") % 3 == k), folder, way)
    read = L.read_log_lines(spark, folder, sniff=True)
    return read.select("source_file", "line_no", F.regexp_extract("raw", r"(?:kernel: \[12345\.678901\]|sshd\[77\]:|shop\[77\]:) (.*)$", 1).alias("message"))


_FIRST = "SELECT source_file, sha256(arg_min(message, line_no)) AS fingerprint FROM log_events GROUP BY source_file"


@query("file_identity", f"{E}, f AS ({_FIRST}) SELECT source_file, fingerprint, CASE WHEN source_file IN ('host-0.log', 'host-2.log') THEN 'stored-' || source_file WHEN source_file = 'host-1.log' THEN 'host-1.log (2024-02-01)' WHEN source_file = 'host-3.log' THEN 'host-3.log (2024-02-01, 2)' ELSE source_file END AS name, source_file NOT IN ('host-0.log', 'host-2.log') AS is_new FROM f")
def file_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = log_events(spark, sf_dir).select("source_file", "line_no", F.col("message").alias("raw"))
    known = L.file_fingerprints(lines).where("source_file IN ('host-0.log', 'host-2.log')").select(F.concat(F.lit("stored-"), "source_file").alias("name"), "fingerprint")
    taken = spark.createDataFrame([("host-1.log", "x"), ("host-3.log", "y"), ("host-3.log (2024-02-01)", "z")], "name string, fingerprint string")
    return L.resolve_sources(lines, known.unionByName(taken), "2024-02-01")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the lines as if stored before, some with another text."""
    lines = log_lines(spark, sf_dir).where("line_no % 3 <> 0")
    return lines.withColumn("raw", F.when(F.col("line_no") % 7 == 0, F.concat("raw", F.lit(" edited"))).otherwise(F.col("raw")))


_STATUS = "CASE WHEN line_no % 3 = 0 THEN 'fresh' WHEN line_no % 7 = 0 THEN 'conflict' ELSE 'duplicate' END"


@query("classified_lines", f"{E} SELECT source_file, line_no, {_STATUS} AS status FROM log_events")
def classified_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.classify_lines(log_lines(spark, sf_dir), _stored(spark, sf_dir)).select("source_file", "line_no", "status")


@query("ingest_report", f"{E}, s AS (SELECT *, {_STATUS} AS status FROM log_events) SELECT source_file, count(*) AS lines, count(*) FILTER (status = 'fresh' AND parsed) AS parsed, count(*) FILTER (status = 'fresh' AND NOT parsed) AS unparsed, count(*) FILTER (status = 'duplicate') AS duplicates, count(*) FILTER (status = 'conflict') AS conflicts FROM s GROUP BY source_file")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = G.parse_events(log_lines(spark, sf_dir), "auto", 2024)
    return L.ingest_report(L.classify_lines(parsed, _stored(spark, sf_dir)))


@query("lines_after_stored", f"{E}, m AS (SELECT source_file, max(line_no) AS last FROM log_events WHERE line_no % 3 <> 0 AND line_no < (SELECT max(line_no) FROM log_events) // 2 GROUP BY source_file) SELECT l.source_file, l.line_no FROM log_events l LEFT JOIN m ON m.source_file = l.source_file WHERE last IS NULL OR l.line_no > last")
def lines_after_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = log_lines(spark, sf_dir)
    middle = lines.agg(F.floor(F.max("line_no") / 2).alias("middle"))
    stored = _stored(spark, sf_dir).join(F.broadcast(middle), F.col("line_no") < F.col("middle"), "left_semi")
    return L.lines_after(lines, stored).select("source_file", "line_no")


@query("appended_events", f"{E} SELECT source_file, line_no, message, strftime(ts, '%Y-%m-%d') AS event_date, CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END AS step FROM log_events")
def appended_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the events, then all of them: each line once, with the step that stored it."""
    path = fresh_path(spark, "events")
    events = log_events(spark, sf_dir).withColumn("raw", F.col("message"))
    append_events(events.where("id % 2 = 0"), path)
    append_events(events, path)
    return spark.read.parquet(path).select("source_file", "line_no", "message", F.col("event_date").cast("string").alias("event_date"), F.col("step").cast("int").alias("step"))


@query("cleaned_lines", "SELECT page_id, (replace(rtrim(html, chr(13) || chr(10)), chr(0), ''))[1:8192] AS line FROM pages")
def cleaned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", L.clean_line(F.concat("html", F.lit("\r\n"))).alias("line"))
