"""Registered queries: filters, reports, pages and message functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import text as X
from palisade.operators import filters as P
from palisade.operators import reports as R
from palisade.registry import query
from palisade.sources.views import LOG_EVENTS_SQL, TEXT_EVENTS_SQL, log_events, text_events

E = f"WITH {LOG_EVENTS_SQL}"
T = f"WITH {TEXT_EVENTS_SQL}"
COUNTS = "count(*) AS packets, count(*) FILTER (action = 'conn_block') AS blocked, count(*) FILTER (action = 'conn_allow') AS allowed"
PACKETS = "src_ip IS NOT NULL AND dst_port IS NOT NULL"


@query("events_filtered", f"{E} SELECT id, message FROM log_events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20 12:00:00' AND level = 'warning' AND host = 'host-3' AND parsed AND (src_ip = '198.18.0.12' OR dst_ip = '198.18.0.12')")
def events_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = P.filter_events(log_events(spark, sf_dir), "2024-01-05", "2024-01-20 12:00:00", ip="198.18.0.12", parsed=True, level="warning", host="host-3")
    return kept.select("id", "message")


@query("events_matched", f"{E} SELECT id FROM log_events WHERE action IN ('auth_fail', 'conn_block') AND host IN ('host-1', 'host-2') AND service IN ('sshd', 'kernel')")
def events_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_events(spark, sf_dir).where(P.match_filter({"action": ("auth_fail", "conn_block"), "host": ("host-1", "host-2"), "service": ("sshd", "kernel"), "user": ()})).select("id")


def _timeline(bucket: str):
    return lambda spark, sf_dir: R.timeline(log_events(spark, sf_dir), bucket)


def _timeline_sql(seconds: int) -> str:
    return f"{E} SELECT (epoch_us(ts) // {seconds * 1_000_000} * {seconds})::BIGINT AS bucket_start, count(*) AS events, count(*) FILTER (level = 'warning') AS warnings FROM log_events GROUP BY 1"


for _name, _seconds in R.BUCKETS.items():
    query(f"timeline_{_name}", _timeline_sql(_seconds))(_timeline(_name))
# A month of events has more than 180 hours, so the automatic bucket is a day.
query("timeline_auto", _timeline_sql(86_400))(_timeline("auto"))


@query("timeline_one_source", f"{E} SELECT (epoch_us(ts) // 3600000000 * 3600)::BIGINT AS bucket_start, count(*) AS events, count(*) FILTER (level = 'warning') AS warnings FROM log_events WHERE src_ip = '198.18.0.12' OR dst_ip = '198.18.0.12' GROUP BY 1")
def timeline_one_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.timeline(P.filter_events(log_events(spark, sf_dir), ip="198.18.0.12"), "1h")


@query("event_totals", f"{E} SELECT count(*) AS events, count(*) FILTER (parsed) AS parsed, count(*) FILTER (NOT parsed) AS unparsed, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (parsed) / count(*), 4) ELSE 0.0 END AS parsed_ratio, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(DISTINCT src_ip) AS sources FROM log_events")
def event_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = R.event_totals(log_events(spark, sf_dir))
    return t.select("events", "parsed", "unparsed", "parsed_ratio", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "sources")


@query("action_counts", f"{E} SELECT action, count(*) AS events FROM log_events WHERE action IS NOT NULL GROUP BY action")
def action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.action_counts(log_events(spark, sf_dir))


@query("top_sources", f"{E} SELECT src_ip, count(*) AS events, count(*) FILTER (action = 'auth_fail') AS failures FROM log_events WHERE src_ip IS NOT NULL GROUP BY src_ip ORDER BY failures DESC, events DESC, src_ip LIMIT 5")
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_sources(log_events(spark, sf_dir))


@query("port_totals", f"{E} SELECT src_ip, {COUNTS}, count(DISTINCT dst_port) AS ports FROM log_events WHERE {PACKETS} GROUP BY src_ip")
def port_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.port_totals(log_events(spark, sf_dir))


@query("port_stats", f"{E}, c AS (SELECT src_ip, dst_port, {COUNTS}, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM log_events WHERE {PACKETS} GROUP BY src_ip, dst_port), o AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY packets DESC, dst_port) AS place FROM c) SELECT src_ip, dst_port, packets, blocked, allowed, first_us, last_us, place::INT AS place FROM o WHERE place <= 5")
def port_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.port_stats(log_events(spark, sf_dir), k=5)
    return s.select("src_ip", "dst_port", "packets", "blocked", "allowed", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "place")


@query("packet_grid", f"{E} SELECT dst_port, action, (epoch_us(ts) // 21600000000)::BIGINT AS cell, count(*) AS packets, (sum(epoch_us(ts)) // count(*))::BIGINT AS mean_us, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM log_events WHERE {PACKETS} GROUP BY 1, 2, 3")
def packet_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.packet_grid(log_events(spark, sf_dir), 21_600)


@query("events_page", f"{E} SELECT id, epoch_us(ts) AS ts_us FROM log_events WHERE (ts, id) > (TIMESTAMP '2024-01-10 00:00:00', 0) ORDER BY ts, id LIMIT 51")
def events_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.events_page(log_events(spark, sf_dir), ("2024-01-10 00:00:00", 0), limit=50).select("id", F.unix_micros("ts").alias("ts_us"))


@query("events_newest", f"{E} SELECT id, epoch_us(ts) AS ts_us FROM log_events ORDER BY ts DESC, id DESC LIMIT 51")
def events_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.events_page(log_events(spark, sf_dir), order="desc", limit=50).select("id", F.unix_micros("ts").alias("ts_us"))


@query("source_connections", f"{E}, o AS (SELECT src_ip, id, row_number() OVER (PARTITION BY src_ip ORDER BY ts, id) AS place, count(*) OVER (PARTITION BY src_ip) AS n FROM log_events WHERE {PACKETS}) SELECT src_ip, id, place::INT AS place, n > 20 AS truncated FROM o WHERE place <= 20")
def source_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.connections(log_events(spark, sf_dir), n=20).select("src_ip", "id", "place", "truncated")


@query("group_spans", f"{E} SELECT id, CASE WHEN strpos(message, src_ip) > 0 THEN '[[' || (strpos(message, src_ip) - 1) || ',' || (strpos(message, src_ip) - 1 + length(src_ip)) || ']]' ELSE '[]' END AS spans FROM log_events WHERE src_ip IS NOT NULL")
def group_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_events(spark, sf_dir).where("src_ip IS NOT NULL").select("id", X.spans_to_json(X.span_of(F.col("message"), F.col("src_ip"))).alias("spans"))


@query("port_spans", f"{E} SELECT id, strpos(message || ' ', 'DPT=' || dst_port || ' ') + 3 AS span_start, strpos(message || ' ', 'DPT=' || dst_port || ' ') + 3 + length(dst_port::VARCHAR) AS span_end FROM log_events WHERE dst_port IS NOT NULL")
def port_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = X.spans_from_json(X.spans_to_json(X.port_span(F.col("message"), F.col("dst_port"))))
    return log_events(spark, sf_dir).where("dst_port IS NOT NULL").select("id", F.get(spans, F.lit(0))["start"].cast("long").alias("span_start"), F.get(spans, F.lit(0))["end"].cast("long").alias("span_end"))


# The pieces of a message before, between and after the marks of "tion", laid end to end again.
@query("keyword_spans", f"{T} SELECT id, (length(message) - length(replace(lower(message), 'edblere', ''))) // 7 AS n_spans, message AS again FROM text_events WHERE contains(lower(message), 'edblere') AND length(lower(message)) = length(message)")
def keyword_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = text_events(spark, sf_dir).where(F.contains(F.lower("message"), F.lit("edblere")))
    pattern = X.keyword_regex(["edblere"])
    e = e.withColumn("spans", X.pattern_spans(F.col("message"), F.lit(0), F.col("message"), [(pattern, False)]))
    segments = X.highlight_segments(F.col("message"), F.col("spans"))
    return e.select("id", F.aggregate("spans", F.lit(0), lambda n, s: n + F.floor((s["end"] - s["start"]) / 7).cast("int")).cast("long").alias("n_spans"), F.array_join(F.transform(segments, lambda s: s["text"]), "").alias("again"))


@query("highlight_segments", f"{E} SELECT id, message[1:strpos(message, src_ip) - 1] || '<' || src_ip || '>' || message[strpos(message, src_ip) + length(src_ip):] AS marked FROM log_events WHERE src_ip IS NOT NULL AND strpos(message, src_ip) > 1")
def highlight_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = log_events(spark, sf_dir).where("src_ip IS NOT NULL")
    segments = X.highlight_segments(F.col("message"), X.span_of(F.col("message"), F.col("src_ip")))
    said = F.transform(segments, lambda s: F.when(s["n"] > 0, F.concat(F.lit("<"), s["text"], F.lit(">"))).otherwise(s["text"]))
    return e.select("id", F.array_join(said, "").alias("marked"))


@query("merged_spans", f"{E} SELECT id, CASE WHEN id % 10 <= 3 THEN '[[0,' || greatest(3, id % 10 + 4) || ']]' ELSE '[[0,3],[' || id % 10 || ',' || id % 10 + 4 || ']]' END AS spans FROM log_events")
def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("id") % 10).cast("int")
    return log_events(spark, sf_dir).select("id", X.spans_to_json(X.merge_spans(X.spans_array((at, at + 4), (F.lit(0), F.lit(3))))).alias("spans"))


@query("rule_lines", f"{E} SELECT id, CASE WHEN coalesce(service, '') <> '' THEN service || ': ' || message ELSE message END AS line FROM log_events")
def rule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_events(spark, sf_dir).select("id", X.rule_line(F.col("service"), F.col("message")).alias("line"))


@query("port_labels", f"{E} SELECT DISTINCT dst_port, CASE dst_port {' '.join(f'WHEN {p} THEN {chr(39)}{p} ({n}){chr(39)}' for p, n in X.PORT_NAMES.items())} ELSE dst_port::VARCHAR END AS label FROM log_events WHERE dst_port IS NOT NULL")
def port_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ports = log_events(spark, sf_dir).where("dst_port IS NOT NULL").select("dst_port").distinct()
    return ports.select("dst_port", X.port_label(F.col("dst_port")).alias("label"))


@query("source_names", "SELECT page_id, coalesce(nullif(trim(regexp_extract(url, '([^/\\\\]*)$', 1)), ''), 'upload')[1:255] AS name FROM pages")
def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.registry import table

    return table(spark, sf_dir, "pages").select("page_id", X.source_name(F.col("url")).alias("name"))


@query("top_severities", f"{E} SELECT src_ip, CASE WHEN bool_or(action = 'auth_fail') THEN 'high' WHEN bool_or(action = 'conn_block') THEN 'medium' ELSE 'low' END AS severity FROM log_events WHERE src_ip IS NOT NULL GROUP BY src_ip")
def top_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("action") == "auth_fail", "high").when(F.col("action") == "conn_block", "medium").otherwise("low")
    return log_events(spark, sf_dir).where("src_ip IS NOT NULL").groupBy("src_ip").agg(X.top_severity(F.collect_set(level)).alias("severity"))
