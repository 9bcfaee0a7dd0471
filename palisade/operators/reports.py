"""Reports over events and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = {"1m": 60, "5m": 300, "1h": 3600, "1d": 86_400}
MOST_BUCKETS = 180


def choose_bucket(first, last) -> str:
    """The finest of 1m, 5m and 1h with at most 180 buckets over the range (datetimes), else 1d."""
    seconds = (last - first).total_seconds() if first is not None and last is not None else 0
    return next((name for name in ("1m", "5m", "1h") if seconds / BUCKETS[name] <= MOST_BUCKETS), "1d")


def timeline(events: DataFrame, bucket: str = "1h") -> DataFrame:
    """(bucket_start seconds, events, warnings) of the buckets that have events; ``auto`` looks at the range first."""
    if bucket == "auto":
        bucket = choose_bucket(*events.agg(F.min("ts"), F.max("ts")).first())
    width = BUCKETS[bucket]
    start = (F.floor(F.unix_micros("ts") / (width * 1_000_000)) * width).cast("long")
    return events.groupBy(start.alias("bucket_start")).agg(F.count("*").alias("events"), F.count_if(F.col("level") == "warning").alias("warnings"))


def event_totals(events: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: events, parsed, unparsed, share parsed (4 digits), first and last, distinct sources."""
    sources = F.approx_count_distinct("src_ip") if approximate else F.countDistinct("src_ip")
    parsed = F.count_if(F.col("parsed"))
    share = F.when(F.count("*") > 0, F.round(parsed / F.count("*"), 4)).otherwise(0.0)
    return events.agg(F.count("*").alias("events"), parsed.alias("parsed"), F.count_if(~F.col("parsed")).alias("unparsed"), share.alias("parsed_ratio"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), sources.alias("sources"))


def action_counts(events: DataFrame) -> DataFrame:
    return events.where("action IS NOT NULL").groupBy("action").agg(F.count("*").alias("events"))


def severity_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count("*").alias("alerts"))


def rule_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("rule_id").agg(F.count("*").alias("alerts"))


def top_sources(events: DataFrame, k: int = 5) -> DataFrame:
    """The k addresses with most failed logins, then most events, then in order of text."""
    counts = events.where("src_ip IS NOT NULL").groupBy("src_ip").agg(F.count("*").alias("events"), F.count_if(F.col("action") == "auth_fail").alias("failures"))
    return counts.orderBy(F.desc("failures"), F.desc("events"), "src_ip").limit(k)


def _packets(events: DataFrame, ip: str | None) -> DataFrame:
    kept = events.where("src_ip IS NOT NULL AND dst_port IS NOT NULL")
    return kept if ip is None else kept.where(F.col("src_ip") == ip)


def _verdicts() -> list[Column]:
    return [F.count("*").alias("packets"), F.count_if(F.col("action") == "conn_block").alias("blocked"), F.count_if(F.col("action") == "conn_allow").alias("allowed")]


def port_totals(events: DataFrame, ip: str | None = None) -> DataFrame:
    """Per source: packets, blocked, allowed, different ports."""
    return _packets(events, ip).groupBy("src_ip").agg(*_verdicts(), F.countDistinct("dst_port").alias("ports"))


def port_stats(events: DataFrame, ip: str | None = None, k: int = 500) -> DataFrame:
    """Per source its k busiest ports (ties: lower port first) with verdicts and first and last time."""
    counts = _packets(events, ip).groupBy("src_ip", "dst_port").agg(*_verdicts(), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    busiest = Window.partitionBy("src_ip").orderBy(F.desc("packets"), "dst_port")
    return counts.withColumn("place", F.row_number().over(busiest)).where(F.col("place") <= k)


def packet_grid(events: DataFrame, cell_seconds: int) -> DataFrame:
    """Packets merged per (port, verdict, time cell): count, mean (cut to microseconds), first and last time in microseconds.

    Means are taken of the time since the cell's start, as decimals: sums of times since 1970 would soon be too large.
    """
    t, width = F.unix_micros("ts"), cell_seconds * 1_000_000
    placed = _packets(events, None).withColumn("cell", F.floor(t / width).cast("long"))
    since = F.sum((t - F.col("cell") * width).cast("decimal(20,0)"))
    cells = placed.groupBy("dst_port", "action", "cell").agg(F.count("*").alias("packets"), since.alias("since"), F.min(t).alias("first_us"), F.max(t).alias("last_us"))
    mean = F.col("cell") * width + F.expr("since DIV packets")
    return cells.select("dst_port", "action", "cell", "packets", mean.cast("long").alias("mean_us"), "first_us", "last_us")


def events_page(events: DataFrame, after: tuple | None = None, order: str = "asc", limit: int = 100) -> DataFrame:
    """The next rows in (ts, id) order past a cursor (ts, id); one row more than ``limit`` tells that there is a next page."""
    kept = events
    if after is not None:
        ts, id_ = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        later = (F.col("ts") > ts) | ((F.col("ts") == ts) & (F.col("id") > id_))
        earlier = (F.col("ts") < ts) | ((F.col("ts") == ts) & (F.col("id") < id_))
        kept = kept.where(later if order == "asc" else earlier)
    keys = [F.asc("ts"), F.asc("id")] if order == "asc" else [F.desc("ts"), F.desc("id")]
    return kept.orderBy(*keys).limit(limit + 1)


def next_cursor(page: DataFrame, limit: int = 100) -> tuple | None:
    """(ts, id) of the page's last row where a further row exists; the page is bounded by its limit."""
    rows = page.select("ts", "id").collect()
    return tuple(rows[limit - 1]) if len(rows) > limit else None


def alerts_page(alerts: DataFrame, limit: int = 100) -> tuple[DataFrame, int]:
    """The newest alerts (ties: key) and how many there are in all."""
    return alerts.orderBy(F.desc("first_seen"), F.desc("alert_key")).limit(limit), alerts.count()


def connections(events: DataFrame, ip: str | None = None, n: int = 2000) -> DataFrame:
    """Per source its first n packets in time order, with ``truncated`` where it has more."""
    by_source = Window.partitionBy("src_ip")
    placed = _packets(events, ip).withColumn("place", F.row_number().over(by_source.orderBy("ts", "id")))
    # A source has more than n packets where its place n + 1 exists.
    more = F.max(F.when(F.col("place") > n, True).otherwise(False)).over(by_source)
    return placed.withColumn("truncated", more).where(F.col("place") <= n)
