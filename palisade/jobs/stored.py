"""Registered queries: reports read from rollups and from files in time order, both kept over five batches."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.jobs.reporting import COUNTS, PACKETS, E, _timeline_sql
from palisade.operators import reports as R
from palisade.operators.rollup import BOUND, Rollup
from palisade.registry import query
from palisade.sources.ordered import OrderedEvents
from palisade.sources.scratch import fresh_path
from palisade.sources.views import log_events

BATCHES = 5
START, END = datetime(2024, 1, 3, 10, 17, 3, tzinfo=timezone.utc), datetime(2024, 1, 21, 5, 44, 59, tzinfo=timezone.utc)
_RANGE = "ts >= TIMESTAMP '2024-01-03 10:17:03' AND ts < TIMESTAMP '2024-01-21 05:44:59'"


def rolled_up(spark: SparkSession, sf_dir: str) -> tuple[Rollup, DataFrame]:
    """Every batch has events of all times, so all but the first add to hours that are there."""
    events, rollup = log_events(spark, sf_dir), Rollup(spark, fresh_path(spark, "rollup"))
    for k in range(BATCHES):
        rollup.step(events.where(F.pmod("id", F.lit(BATCHES)) == k), k)
    rollup.step(events.where(F.pmod("id", F.lit(BATCHES)) == 1), 1)  # once more: nothing changes
    return rollup, events


def laid_out(spark: SparkSession, sf_dir: str) -> OrderedEvents:
    """Five batches in files of a thousand events."""
    events, ordered = log_events(spark, sf_dir), OrderedEvents(spark, fresh_path(spark, "ordered"))
    for k in range(BATCHES):
        ordered.step(events.where(F.pmod("id", F.lit(BATCHES)) == k), k, rows_a_file=1000)
    return ordered


def close(estimate: str, exact: str):
    """Whether an estimate is within its bound, or by one of a small number."""
    return F.abs(F.col(estimate) - F.col(exact)) <= F.greatest(F.lit(1.0), F.col(exact) * BOUND)


def _rollup_timeline(seconds: int):
    return lambda spark, sf_dir: rolled_up(spark, sf_dir)[0].timeline(seconds).drop("sources")


query("rollup_timeline_1h", _timeline_sql(3600))(_rollup_timeline(3600))
query("rollup_timeline_1d", _timeline_sql(86_400))(_rollup_timeline(86_400))


@query("rollup_totals", f"{E} SELECT count(*) AS events, count(*) FILTER (parsed) AS parsed, count(*) FILTER (NOT parsed) AS unparsed, round(count(*) FILTER (parsed) / count(*), 4) AS ratio, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, true AS sources_close FROM log_events WHERE {_RANGE}")
def rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a range that begins and ends within hours; different sources within the sketch's bound of the exact count."""
    rollup, events = rolled_up(spark, sf_dir)
    exact = R.event_totals(events.where((F.col("ts") >= F.lit(START)) & (F.col("ts") < F.lit(END)))).select(F.col("sources").alias("exact"))
    both = rollup.totals(START, END, events).join(F.broadcast(exact))  # one row each
    return both.withColumn("sources_close", close("sources", "exact")).drop("sources", "exact")


@query("rollup_port_totals", f"{E} SELECT src_ip, {COUNTS}, true AS ports_close FROM log_events WHERE {PACKETS} AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' GROUP BY src_ip")
def rollup_port_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollup, events = rolled_up(spark, sf_dir)
    days = [int(datetime(2024, 1, d, tzinfo=timezone.utc).timestamp()) // 86_400 for d in (5, 25)]
    exact = R.port_totals(events.where("ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'")).select("src_ip", F.col("ports").alias("exact"))
    return rollup.port_totals(*days).join(exact, "src_ip").withColumn("ports_close", close("ports", "exact")).drop("ports", "exact")


def _micros(*when: int) -> int:
    return int(datetime(*when, tzinfo=timezone.utc).timestamp() * 1_000_000)


@query("page_of_files", f"{E} SELECT id, epoch_us(ts) AS ts_us FROM log_events WHERE (ts, id) > (TIMESTAMP '2024-01-10 00:00:00', 0) ORDER BY ts, id LIMIT 51")
def page_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laid_out(spark, sf_dir).page((_micros(2024, 1, 10), 0), limit=50).select("id", F.unix_micros("ts").alias("ts_us"))


@query("newest_of_files", f"{E} SELECT id, epoch_us(ts) AS ts_us FROM log_events ORDER BY ts DESC, id DESC LIMIT 51")
def newest_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laid_out(spark, sf_dir).page(order="desc", limit=50).select("id", F.unix_micros("ts").alias("ts_us"))


@query("range_of_files", f"{E} SELECT id, message FROM log_events WHERE ts >= TIMESTAMP '2024-01-12 06:00:00' AND ts < TIMESTAMP '2024-01-12 18:00:00'")
def range_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laid_out(spark, sf_dir).between(_micros(2024, 1, 12, 6), _micros(2024, 1, 12, 18)).select("id", "message")
