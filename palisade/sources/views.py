"""Log-shaped views of the supplied tables, as DataFrames and as the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.registry import table

#: event_type of the supplied events to what a log line says.
ACTIONS = {"error": "auth_fail", "signup": "auth_ok", "click": "conn_block", "view": "conn_allow"}


def micros(column: str = "ts") -> Column:
    """Microseconds since 1970 in UTC."""
    return F.unix_micros(column)


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as log events: logins, packets, and lines nothing recognises."""
    e = table(spark, sf_dir, "events")
    user_id, event_id = F.col("user_id"), F.col("event_id")
    mapping = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    e = e.select(
        event_id.alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("host-"), (user_id % 8).cast("string")).alias("host"),
        F.element_at(mapping, F.col("event_type")).alias("action"),
        F.concat(F.lit("198.18."), F.floor(user_id / 250).cast("string"), F.lit("."), (user_id % 250 + 1).cast("string")).alias("ip"),
        F.concat(F.lit("user"), (user_id % 20).cast("string")).alias("name"),
        (event_id % 60000 + 1024).cast("int").alias("sport"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.concat(F.lit("192.0.2."), (event_id % 200 + 1).cast("string")).alias("target"),
    )
    login, packet = F.col("action").isin("auth_fail", "auth_ok"), F.col("action").isin("conn_block", "conn_allow")
    said = F.when(F.col("action") == "auth_fail", "Failed").otherwise("Accepted")
    verdict = F.when(F.col("action") == "conn_block", "[UFW BLOCK]").otherwise("[UFW ALLOW]")
    message = (
        F.when(login, F.format_string("%s password for %s from %s port %d ssh2", said, F.col("name"), F.col("ip"), F.col("sport")))
        .when(packet, F.format_string("%s IN=eth0 OUT= SRC=%s DST=%s LEN=60 PROTO=TCP SPT=%d DPT=%d SYN", verdict, F.col("ip"), F.col("target"), F.col("sport"), F.col("k")))
        .otherwise(F.format_string("order %d done", F.col("id")))
    )
    return e.select(
        "id",
        "ts",
        "host",
        F.when(login, "sshd").when(packet, "kernel").otherwise("shop").alias("service"),
        F.when(F.col("action").isin("auth_fail", "conn_block"), "warning").otherwise("info").alias("level"),
        "action",
        F.when(login, F.col("name")).alias("user"),
        F.when(login | packet, F.col("ip")).alias("src_ip"),
        F.when(login | packet, F.col("sport")).alias("src_port"),
        F.when(packet, F.col("target")).alias("dst_ip"),
        F.when(packet, F.col("k")).alias("dst_port"),
        message.alias("message"),
        F.concat("host", F.lit(".log")).alias("source_file"),
        F.col("id").alias("line_no"),
        F.col("action").isNotNull().alias("parsed"),
    )


LOG_EVENTS_SQL = """
log_events AS (
  SELECT id, ts, host,
    CASE WHEN login THEN 'sshd' WHEN packet THEN 'kernel' ELSE 'shop' END AS service,
    CASE WHEN action IN ('auth_fail', 'conn_block') THEN 'warning' ELSE 'info' END AS level, action,
    CASE WHEN login THEN name END AS "user", CASE WHEN login OR packet THEN ip END AS src_ip,
    CASE WHEN login OR packet THEN sport END AS src_port, CASE WHEN packet THEN target END AS dst_ip,
    CASE WHEN packet THEN k END AS dst_port,
    CASE WHEN login THEN (CASE WHEN action = 'auth_fail' THEN 'Failed' ELSE 'Accepted' END) || ' password for ' || name || ' from ' || ip || ' port ' || sport || ' ssh2'
      WHEN packet THEN (CASE WHEN action = 'conn_block' THEN '[UFW BLOCK]' ELSE '[UFW ALLOW]' END) || ' IN=eth0 OUT= SRC=' || ip || ' DST=' || target || ' LEN=60 PROTO=TCP SPT=' || sport || ' DPT=' || k || ' SYN'
      ELSE 'order ' || id || ' done' END AS message,
    host || '.log' AS source_file, id AS line_no, action IS NOT NULL AS parsed
  FROM (
    SELECT *, coalesce(action IN ('auth_fail', 'auth_ok'), false) AS login, coalesce(action IN ('conn_block', 'conn_allow'), false) AS packet
    FROM (
      SELECT event_id AS id, ts, 'host-' || user_id % 8 AS host,
        CASE event_type WHEN 'error' THEN 'auth_fail' WHEN 'signup' THEN 'auth_ok' WHEN 'click' THEN 'conn_block' WHEN 'view' THEN 'conn_allow' END AS action,
        '198.18.' || (user_id // 250) || '.' || (user_id % 250 + 1) AS ip, 'user' || user_id % 20 AS name,
        (event_id % 60000 + 1024)::INT AS sport, json_extract_string(props, '$.k')::INT AS k, '192.0.2.' || (event_id % 200 + 1) AS target
      FROM events)))"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_file, line_no, raw): log_events as the text a log file would hold.

    Packets carry the classic stamp (seconds, no year), all else an ISO stamp.
    """
    e = log_events(spark, sf_dir)
    classic = F.concat(F.date_format("ts", "MMM"), F.lit(" "), F.lpad(F.date_format("ts", "d"), 2, " "), F.date_format("ts", " HH:mm:ss"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    packet = F.col("service") == "kernel"
    program = F.when(packet, F.lit("kernel: [12345.678901] ")).otherwise(F.concat("service", F.lit("[77]: ")))
    return e.select("source_file", "line_no", F.concat(F.when(packet, classic).otherwise(iso), F.lit(" "), "host", F.lit(" "), program, "message").alias("raw"))


def text_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as events for keyword rules: one a minute, the source as program and host."""
    d = table(spark, sf_dir, "documents")
    ts = F.timestamp_micros(F.lit(1704067200000000) + F.col("doc_id") * 60000000)
    return d.select(F.col("doc_id").alias("id"), ts.alias("ts"), F.col("lang").alias("host"), F.col("source").alias("service"), F.lit("info").alias("level"), F.lit(None).cast("string").alias("action"), F.lit(None).cast("string").alias("user"), F.lit(None).cast("string").alias("src_ip"), F.lit(None).cast("int").alias("dst_port"), F.col("text").alias("message"))


TEXT_EVENTS_SQL = """
text_events AS (
  SELECT doc_id AS id, make_timestamp(1704067200000000 + doc_id * 60000000) AS ts, lang AS host, source AS service, text AS message FROM documents)"""
