"""Alerts from evidence, and what joins them with events and rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.functions.text import render_summary
from palisade.operators.detect import evidence_of
from palisade.operators.rules import OBSERVED, Rule

ALERT_FIELDS = ("rule_id", "rule_name", "severity", "group_by", "group_key", "first_seen", "last_seen", "count", "summary")
#: Buckets, about, that the time around an alert is cut into.
PIECES = 8


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rule settings as a small table."""
    rows = [(r.id, r.name, r.severity, r.group_by, r.author, r.enabled) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, rule_name string, severity string, group_by string, author string, enabled boolean")


def summarize_alerts(evidence: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per alert: span in time, count, summary, in order of the first event."""
    facts = evidence.groupBy("rule_id", "group_key", "alert_key").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("count"), F.size(F.collect_set("port")).cast("long").alias("ports")
    )
    seconds = ((F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 1_000_000).cast("long")
    summary, name, severity, group_by = F.lit(""), F.lit(""), F.lit(""), F.lit("")
    for rule in rules:
        mine = F.col("rule_id") == rule.id
        own = {n: F.lit(str(getattr(rule, n))) for n in re.findall(r"\{(\w+)\}", rule.summary) if n not in OBSERVED and hasattr(rule, n)}
        values = own | {"key": F.col("group_key"), "count": F.col("count"), "seconds": seconds, "ports": F.col("ports"), "rule_id": F.lit(rule.id), "rule_name": F.lit(rule.name)}
        summary = F.when(mine, render_summary(rule.summary, values)).otherwise(summary)
        name, severity, group_by = (F.when(mine, F.lit(v)).otherwise(c) for v, c in ((rule.name, name), (rule.severity, severity), (rule.group_by, group_by)))
    return facts.select("alert_key", "rule_id", name.alias("rule_name"), severity.alias("severity"), group_by.alias("group_by"), "group_key", "first_seen", "last_seen", "count", seconds.alias("seconds"), "ports", summary.alias("summary"))


def evaluate(events: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(alerts, evidence) of all enabled rules."""
    evidence = evidence_of(events, rules)
    return summarize_alerts(evidence, rules), evidence


def with_highlights(events: DataFrame, evidence: DataFrame, alerts: DataFrame) -> DataFrame:
    """events with ``highlights``: (alert_key, rule_id, severity, start, end) in order; a piece without span marks the whole line."""
    told = evidence.join(alerts.select("alert_key", "severity"), "alert_key")
    pieces = told.select(F.col("event_id").alias("id"), "alert_key", "rule_id", "severity", F.explode_outer("spans").alias("s"))
    mark = F.struct("alert_key", "rule_id", "severity", F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    marks = pieces.groupBy("id").agg(F.array_sort(F.collect_list(mark)).alias("highlights"))
    return events.join(marks, "id", "left").withColumn("highlights", F.coalesce("highlights", F.expr("CAST(array() AS array<struct<alert_key:string,rule_id:string,severity:string,start:int,end:int>>)")))


def alert_evidence(evidence: DataFrame, events: DataFrame, n: int = 100) -> DataFrame:
    """The first n evidence events of every alert, with their place, in time order."""
    order = Window.partitionBy("alert_key").orderBy("ts", "event_id")
    first = evidence.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("alert_key", "event_id", "place", "spans")
    return first.join(events.withColumnRenamed("id", "event_id"), "event_id")


def with_rule_author(alerts: DataFrame, rules: list[Rule]) -> DataFrame:
    authors = rules_frame(alerts.sparkSession, rules).select("rule_id", "author")
    # Rules are settings on the driver, so this table is as small as they are.
    return alerts.join(F.broadcast(authors), "rule_id", "left").withColumn("author", F.coalesce("author", F.lit("")))


def context_bounds(first: Column, last: Column, fixed_seconds: int | None = None) -> tuple[Column, Column]:
    """[lo, hi) in microseconds around an alert: a quarter of its duration, at least a minute; or a fixed margin."""
    a, b = F.unix_micros(first), F.unix_micros(last)
    margin = F.lit(fixed_seconds * 1_000_000) if fixed_seconds is not None else F.greatest(F.lit(60_000_000), F.round((b - a) * 0.25).cast("long"))
    return a - margin, b + margin + F.lit(1_000_000)


def events_around(alerts: DataFrame, events: DataFrame, fixed_seconds: int | None = None) -> DataFrame:
    """(alert_key, id) of all events in the time around each alert.

    A span of time is cut into at most PIECES aligned buckets of one power of two of
    microseconds, as wide as a span of its length needs; events meet them by (width, bucket),
    once for each width in use, so an event only meets alerts that are near it.
    """
    lo, hi = context_bounds(F.col("first_seen"), F.col("last_seen"), fixed_seconds)
    bounds = alerts.select("alert_key", lo.alias("lo"), hi.alias("hi"))
    width = F.ceil(F.log2(F.greatest((F.col("hi") - F.col("lo")) / PIECES, F.lit(1.0)))).cast("int")
    bounds = bounds.withColumn("width", F.least(width, F.lit(62)))
    widths = [r[0] for r in bounds.select("width").distinct().collect()]  # 63 at most
    at = lambda t, w: F.shiftright(t, w) if isinstance(w, int) else F.expr(f"shiftright({t}, {w})")
    pieces = bounds.select("alert_key", "lo", "hi", "width", F.explode(F.sequence(at("lo", "width"), F.expr("shiftright(hi - 1, width)"))).alias("piece"))
    placed = events.select("id", F.unix_micros("ts").alias("t"))
    every = F.array(*[F.struct(F.lit(w).alias("width"), at(F.col("t"), w).alias("piece")) for w in sorted(widths)]) if widths else F.expr("CAST(array() AS array<struct<width:int,piece:bigint>>)")
    placed = placed.select("id", "t", F.explode(every).alias("p")).select("id", "t", "p.width", "p.piece")
    return placed.join(pieces, ["width", "piece"]).where((F.col("t") >= F.col("lo")) & (F.col("t") < F.col("hi"))).select("alert_key", "id")


#: Microseconds of time that are put in order together.
STRETCH = 600_000_000


def context_counts(alerts: DataFrame, events: DataFrame, fixed_seconds: int | None = None) -> DataFrame:
    """(alert_key, n_events, first_id, last_id): how many events there are around each alert, and the first and last of them in time.

    No event meets an alert. Both ends of an alert's time take their places among the
    events, dealt once by stretches of time; counts are differences of places. Only a row
    of each stretch, and the ends, are looked at by anything else. An alert without any
    events around it has a count of 0 and no ids.
    """
    lo, hi = context_bounds(F.col("first_seen"), F.col("last_seen"), fixed_seconds)
    ends = F.explode(F.array(F.struct(F.lit("lo").alias("end"), lo.alias("t")), F.struct(F.lit("hi").alias("end"), hi.alias("t"))))
    bounds = alerts.select("alert_key", ends.alias("b")).select("alert_key", "b.end", "b.t", F.lit(None).cast("long").alias("id"))
    placed = events.select(F.lit(None).cast("string").alias("alert_key"), F.lit(None).cast("string").alias("end"), F.unix_micros("ts").alias("t"), "id")
    rows = placed.unionByName(bounds).withColumn("stretch", F.expr(f"t DIV {STRETCH}"))
    # An end stands before the events of its very time.
    is_event = F.col("end").isNull()
    up = Window.partitionBy("stretch").orderBy("t", is_event, "id").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("stretch").orderBy(F.desc("t"), F.desc(is_event), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"n": F.count("id").over(up), "back": F.last("id", ignorenulls=True).over(up), "ahead": F.last("id", ignorenulls=True).over(down)})
    newest = F.max_by("id", F.when(is_event, F.struct("t", "id")))
    totals = rows.groupBy("stretch").agg(F.count("id").alias("events"), F.min_by("id", F.when(is_event, F.struct("t", "id"))).alias("first"), newest.alias("last"))
    order = Window.partitionBy(F.lit(0)).orderBy("stretch")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0)).orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("stretch", F.coalesce(F.sum("events").over(earlier), F.lit(0)).alias("before"), F.last("first", ignorenulls=True).over(later).alias("next"), F.last("last", ignorenulls=True).over(earlier).alias("previous"))
    ends = rows.where(~is_event).join(totals, "stretch")
    lo_, hi_ = F.col("end") == "lo", F.col("end") == "hi"
    at = F.col("before") + F.col("n")
    met = ends.groupBy("alert_key").agg(
        (F.max(F.when(hi_, at)) - F.max(F.when(lo_, at))).alias("n_events"), F.max(F.when(lo_, F.coalesce("ahead", "next"))).alias("first_id"), F.max(F.when(hi_, F.coalesce("back", "previous"))).alias("last_id")
    )
    some = F.col("n_events") > 0
    return met.select("alert_key", "n_events", F.when(some, F.col("first_id")).alias("first_id"), F.when(some, F.col("last_id")).alias("last_id"))


def drop_orphans(alerts: DataFrame, rules: list[Rule]) -> DataFrame:
    """Alerts whose rule is still enabled."""
    live = rules_frame(alerts.sparkSession, rules).where("enabled").select("rule_id")
    return alerts.join(F.broadcast(live), "rule_id", "left_semi")


def reconcile(old: DataFrame, new: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """alert_key and status: created, updated, removed or unchanged.

    With ``groups`` (rule_id, group_key) only old alerts of these groups can be removed
    or changed; the others are left out.
    """
    if groups is not None:
        old = old.join(groups, ["rule_id", "group_key"], "left_semi")
    a = old.select("alert_key", F.struct(*ALERT_FIELDS).alias("was"))
    b = new.select("alert_key", F.struct(*ALERT_FIELDS).alias("now"))
    status = F.when(F.col("was").isNull(), "created").when(F.col("now").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("updated")
    return a.join(b, "alert_key", "full_outer").select("alert_key", status.alias("status"))


def reconcile_counts(status: DataFrame) -> DataFrame:
    """One row: created, updated, removed, unchanged and alerts in all after."""
    n = {s: F.count_if(F.col("status") == s).alias(s) for s in ("created", "updated", "removed", "unchanged")}
    return status.agg(*n.values(), F.count_if(F.col("status") != "removed").alias("total"))


def affected_groups(new_events: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule_id, group_key) with a new event."""
    out = None
    for rule in (r for r in rules if r.enabled):
        keys = new_events.select(F.lit(rule.id).alias("rule_id"), F.col(rule.group_by).alias("group_key")).where("group_key IS NOT NULL AND group_key <> ''").distinct()
        out = keys if out is None else out.unionByName(keys)
    return out if out is not None else new_events.sparkSession.createDataFrame([], "rule_id string, group_key string")


def events_of_affected_groups(events: DataFrame, new_events: DataFrame, rule: Rule) -> DataFrame:
    """All events of the rule's groups that have a new event."""
    keys = new_events.select(rule.group_by).where(F.col(rule.group_by).isNotNull() & (F.col(rule.group_by) != "")).distinct()
    return events.join(keys, rule.group_by, "left_semi")


def keyword_candidates(new_hits: DataFrame, old_evidence: DataFrame) -> DataFrame:
    """(event_id, rule_id) that count for keyword rules: new hits and what counted before."""
    return new_hits.select("event_id", "rule_id").union(old_evidence.select("event_id", "rule_id")).distinct()
