"""Detectors: events and a rule to evidence rows (rule_id, group_key, alert_key, event_id, ts, port, spans).

First what a rule counts of the events, with the spans it marks (``hits``): from there on
no text is looked at, so stored hits do as well as events. Then the hits of each group to
alerts (``detect_hits``). Events of a group are cut into islands at gaps beyond a limit; all later windows run
inside islands. Up to MOST_IN_TASK events in all, no group can be too large for a
task, and rows are dealt by group once. Beyond that gaps are found within (group, day)
and between the days of a group, so a very frequent group is spread over many tasks.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.text import SPANS, folded, has_keyword, keyword_regex, merge_spans, pattern_spans, port_span, rule_line, span_of, spans_from_json, spans_to_json
from palisade.operators.filters import counted_events, match_filter
from palisade.operators.rules import Keyword, PortScan, RarePort, Rule, Sequence, Threshold
from palisade.operators.triggers import walked_in_bulk

SECOND = 1_000_000
DAY = 86_400 * SECOND
#: Events in all up to which each group may be sorted in one task.
MOST_IN_TASK = 5_000_000
#: Windows so many cooldowns long are walked in order: a port scan's candidates could be too close together.
MOST_COOLDOWNS = 64
HITS = f"key string, t long, id long, port int, steps long, spans {SPANS}"
EVIDENCE = f"rule_id string, group_key string, alert_key string, event_id long, ts timestamp, port int, spans {SPANS}"


def is_spread(events: DataFrame) -> bool:
    """Whether there are so many events that groups must be spread over tasks."""
    return events.select("id").limit(MOST_IN_TASK + 1).count() > MOST_IN_TASK


def islands(events: DataFrame, limit: int, inclusive: bool = False, spread: bool = True, bucket: int = DAY) -> DataFrame:
    """Rows (key, t, id, ...) with the number of their island: a new one where the gap is above limit (or equal, if inclusive).

    Spread rows are dealt by (key, bucket); only a row for each bucket meets by key.
    """
    beyond = (lambda gap: gap >= limit) if inclusive else (lambda gap: gap > limit)
    if not spread:
        by_key = Window.partitionBy("key").orderBy("t", "id")
        cut = F.when(beyond(F.col("t") - F.lag("t").over(by_key)), 1).otherwise(0)
        return events.withColumn("cut", cut).withColumn("island", F.sum("cut").over(by_key).cast("long")).drop("cut")
    inside = Window.partitionBy("key", "bucket").orderBy("t", "id")
    placed = events.withColumn("bucket", F.floor(F.col("t") / bucket))
    cut = F.when(beyond(F.col("t") - F.lag("t").over(inside)), 1).otherwise(0)
    marked = placed.withColumn("cut", cut).withColumn("local", F.sum("cut").over(inside))
    buckets = marked.groupBy("key", "bucket").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.sum("cut").alias("cuts"))
    by_key = Window.partitionBy("key").orderBy("bucket")
    at_start = F.when(beyond(F.col("first_t") - F.lag("last_t").over(by_key)), 1).otherwise(0)
    buckets = buckets.withColumn("at_start", at_start)
    base = F.sum(F.col("cuts") + F.col("at_start")).over(by_key) - F.col("cuts")
    buckets = buckets.select("key", "bucket", base.alias("base"))
    return marked.join(buckets, ["key", "bucket"]).withColumn("island", (F.col("base") + F.col("local")).cast("long")).drop("bucket", "cut", "local", "base")


def bursts(events: DataFrame, rule: Rule, spread: bool = True) -> DataFrame:
    """Counted events with the burst they belong to: a gap equal to the cooldown still joins."""
    return islands(counted_events(events, rule), rule.cooldown_seconds * SECOND, spread=spread)


def in_island() -> Window:
    return Window.partitionBy("key", "island").orderBy("t", "id")


def whole_island() -> Window:
    return Window.partitionBy("key", "island")


def as_evidence(rows: DataFrame, rule: Rule, alert: tuple[str, ...] = ("key", "island")) -> DataFrame:
    """Hits of alerts to evidence; an alert is named after its first event."""
    return named_evidence(rows.withColumn("first_id", F.min(F.struct("t", "id")).over(Window.partitionBy(*alert))["id"]), rule)


def named_evidence(rows: DataFrame, rule: Rule) -> DataFrame:
    """(key, first_id, t, id, port, spans) to evidence."""
    alert = F.concat_ws(":", F.lit(rule.id), "key", F.col("first_id").cast("string"))
    return rows.select(F.lit(rule.id).alias("rule_id"), F.col("key").alias("group_key"), alert.alias("alert_key"), F.col("id").alias("event_id"), F.timestamp_micros("t").alias("ts"), "port", "spans")


def keyword_condition(rule: Keyword, line: Column | None = None, plain: Column | None = None) -> Column:
    """(a keyword or the regex) and one of each ``require`` and none of ``exclude``; with the line and its folded text where these are at hand."""
    line = rule_line(F.col("service"), F.col("message")) if line is None else line
    has = (lambda words: line.rlike(keyword_regex(list(words)))) if plain is None else (lambda words: has_keyword(words, line, plain))
    found = F.lit(False)
    if rule.keywords:
        found |= has(rule.keywords)
    if rule.regex is not None:
        # A match of nothing is none: some match must have a character.
        found |= F.exists(F.regexp_extract_all("message", F.lit(rule.regex), F.lit(0)), lambda m: m != "")
    for group in rule.require:
        found &= has(group)
    if rule.exclude:
        found &= ~has(rule.exclude)
    return F.coalesce(found, F.lit(False))


def keyword_spans(rule: Keyword) -> Column:
    patterns = [(keyword_regex(list(k)), True) for k in (rule.keywords, *rule.require) if k]
    patterns += [(rule.regex, False)] if rule.regex is not None else []
    prefix = F.char_length(rule_line(F.col("service"), F.col("message"))) - F.char_length("message")
    return pattern_spans(F.col("message"), prefix, rule_line(F.col("service"), F.col("message")), patterns)


def spans_for(rule: Rule) -> Column:
    """What a rule marks in the message of an event that it counts."""
    if isinstance(rule, Keyword):
        return keyword_spans(rule)
    port = port_span(F.col("message"), F.col("dst_port"))
    if isinstance(rule, RarePort):
        return port
    group = span_of(F.col("message"), F.col("key"))
    return merge_spans(F.concat(group, port)) if isinstance(rule, PortScan) else group


def steps_of(rule: Rule) -> Column:
    """The steps of a sequence that an event serves, as bits."""
    steps = F.lit(0)
    if isinstance(rule, Sequence):
        steps = sum((F.when(match_filter(s.match), 1 << k).otherwise(0) for k, s in enumerate(rule.steps)), F.lit(0))
    return steps.cast("long")


def hits(events: DataFrame, rule: Rule) -> DataFrame:
    """What a rule counts: (key, t, id, port, steps, spans), all that is needed of the events from here on."""
    seen = events.where(keyword_condition(rule)) if isinstance(rule, Keyword) else events
    return counted_events(seen, rule).select("key", "t", "id", F.col("dst_port").cast("int").alias("port"), steps_of(rule).alias("steps"), spans_for(rule).alias("spans"))


def every_hit(rows: DataFrame, rule: Rule, spread: bool = True) -> DataFrame:
    """Every hit alerts; hits close in time share an alert."""
    return as_evidence(islands(rows, rule.cooldown_seconds * SECOND, spread=spread), rule)


def scan_keywords(events: DataFrame, rules: list[Keyword]) -> DataFrame:
    """(event_id, rule_id) for many keyword rules in one pass over the lines.

    Each line is folded once, and plain words are looked for in that; patterns are tried
    only where a plain piece of them is found.
    """
    live = [r for r in rules if r.enabled]
    if not live:
        return events.select(F.col("id").alias("event_id"), F.lit(None).cast("string").alias("rule_id")).where("false")
    line = rule_line(F.col("service"), F.col("message"))

    def found(x: Column) -> Column:
        return F.array_compact(F.array(*[F.when(match_filter(r.match) & keyword_condition(r, x["line"], x["plain"]), F.lit(r.id)) for r in live]))

    told = F.transform(F.array(F.struct(line.alias("line"), folded(line).alias("plain"))), found)
    return events.select(F.col("id").alias("event_id"), F.explode(told[0]).alias("rule_id"))


def thresholds(rows: DataFrame, rule: Threshold, spread: bool = True) -> DataFrame:
    """At least N hits closer than the window. One pass over islands where the cooldown covers the window."""
    if rule.cooldown_seconds < rule.window_seconds:
        return named_evidence(walked_in_bulk(rows, rule), rule)
    rows = islands(rows, rule.cooldown_seconds * SECOND, spread=spread).withColumn("rn", F.row_number().over(in_island()))
    hit = F.col("t") - F.lag("t", rule.threshold - 1).over(in_island()) < rule.window_seconds * SECOND
    rows = rows.withColumn("hit", F.when(hit, F.col("rn"))).withColumn("trigger", F.min("hit").over(whole_island()))
    return as_evidence(rows.where(F.col("rn") >= F.col("trigger") - (rule.threshold - 1)), rule)


def port_scans(rows: DataFrame, rule: PortScan, spread: bool = True) -> DataFrame:
    """At least K different ports of a group within the window.

    A port is active from a packet until the window after its last packet; the number
    of active ports at each packet is a running sum of starts and ends.
    """
    if rule.cooldown_seconds < rule.window_seconds:
        if rule.window_seconds > MOST_COOLDOWNS * rule.cooldown_seconds:
            return by_segment(rows, rule, spread)
        return named_evidence(walked_in_bulk(rows, rule), rule)
    window = rule.window_seconds * SECOND
    rows = islands(rows, rule.cooldown_seconds * SECOND, spread=spread)
    by_port = Window.partitionBy("key", "island", "port").orderBy("t", "id")
    back, ahead = F.lag("t").over(by_port), F.lead("t").over(by_port)
    rows = rows.withColumn("back", back).withColumn("ahead", ahead)
    starts = F.when(F.col("back").isNull() | (F.col("t") - F.col("back") >= window), 1).otherwise(0)
    is_last = F.col("ahead").isNull() | (F.col("ahead") - F.col("t") >= window)
    start = F.struct(F.col("t").alias("at"), F.lit(1).alias("kind"), starts.alias("step"))
    end = F.struct((F.col("t") + window).alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("step"))
    changes = rows.withColumn("c", F.explode(F.when(is_last, F.array(start, end)).otherwise(F.array(start)))).drop("back", "ahead")
    order = Window.partitionBy("key", "island").orderBy("c.at", "c.kind", "id").rowsBetween(Window.unboundedPreceding, 0)
    active = changes.withColumn("n", F.sum("c.step").over(order))
    full = F.when((F.col("c.kind") == 1) & (F.col("n") >= rule.min_ports), F.col("t"))
    active = active.withColumn("trigger_t", F.min(full).over(whole_island()))
    return as_evidence(active.where((F.col("c.kind") == 1) & (F.col("t") > F.col("trigger_t") - window)).drop("c", "n", "trigger_t"), rule)


class Machine:
    """The state of one group: rows that may still become evidence, the latest time of each port, and the open alert.

    Rows (t, id, port, steps, ...) come in (t, id) order. No more is held than the rows of one window.
    """

    def __init__(self, rule: Rule, recent: list | None = None, first_id: int | None = None, last_t: int = 0):
        self.rule, self.recent, self.first_id, self.last_t = rule, deque(map(tuple, recent or [])), first_id, last_t
        self.reach, self.window = rule.cooldown_seconds * SECOND, rule.window * SECOND
        self.ports: OrderedDict[int | None, int] = OrderedDict()
        for row in self.recent:
            self.see(row)

    def see(self, row: tuple) -> None:
        self.ports[row[2]] = row[0]
        self.ports.move_to_end(row[2])

    def push(self, *row) -> list[tuple[int, int]]:
        """(event_id, first event_id of its alert) of the rows that became evidence."""
        return [(x[1], first) for x, first in self.walk(row)]

    def walk(self, row: tuple) -> list[tuple[tuple, int]]:
        """The same with whole rows."""
        t = row[0]
        if self.first_id is not None and t <= self.last_t + self.reach:
            found = [row]
        else:
            self.first_id, gone = None, t - self.window
            self.recent.append(row)
            self.see(row)
            while self.recent and self.recent[0][0] <= gone:
                self.recent.popleft()
            while self.ports and next(iter(self.ports.values())) <= gone:
                self.ports.popitem(last=False)
            if not self.is_full(row[3]):
                return []
            found = list(self.recent)
            self.first_id = found[0][1]
            self.recent, self.ports = deque(), OrderedDict()
        self.last_t = t
        return [(x, self.first_id) for x in found]

    def is_full(self, steps: int) -> bool:
        if isinstance(self.rule, Threshold):
            return len(self.recent) >= self.rule.threshold
        if isinstance(self.rule, PortScan):
            return len(self.ports) >= self.rule.min_ports
        if isinstance(self.rule, Sequence):
            return bool(steps >> (len(self.rule.steps) - 1) & 1) and completes([row[3] for row in self.recent], [s.count for s in self.rule.steps])
        return True


def completes(steps: list[int], counts: list[int]) -> bool:
    """Whether the rows serve all steps in order, each row at most one."""
    todo = iter(steps)
    return all(sum(1 for _ in zip(range(n), (s for s in todo if s >> k & 1))) == n for k, n in enumerate(counts))


def by_segment(rows: DataFrame, rule: Rule, spread: bool = True) -> DataFrame:
    """Any windowed rule: hits are dealt by group (spread: by segment of a group, cut where nothing is carried over a gap) and walked in order.

    A task walks its groups one after the other, in batches, so a group of any length needs the memory of one window.
    """
    group = ["key"]
    if spread:
        limit = max(rule.cooldown_seconds * SECOND + 1, rule.window * SECOND)
        rows, group = islands(rows, limit, inclusive=True), ["key", "island"]
    slim = rows.select(*group, "t", "id", "port", "steps", spans_to_json(F.col("spans")).alias("marks"))
    fields = ("key", "t", "id", "port", "marks", "first_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, machine = None, Machine(rule)
        for batch in batches:
            out = []
            groups = zip(*(batch.column(c).to_pylist() for c in group), strict=True)
            for of, *row in zip(groups, *(batch.column(c).to_pylist() for c in ("t", "id", "port", "steps", "marks")), strict=True):
                if of != last:
                    last, machine = of, Machine(rule)
                out += [(of[0], t, i, port, marks, first) for (t, i, port, _, marks), first in machine.walk(tuple(row))]
            columns = list(zip(*out, strict=True)) or [()] * len(fields)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(fields))

    dealt = slim.repartition(*group).sortWithinPartitions(*group, "t", "id")
    chosen = dealt.mapInArrow(run, "key string, t long, id long, port int, marks string, first_id long")
    return named_evidence(chosen.withColumn("spans", spans_from_json(F.col("marks"))), rule)


#: Detector by kind of rule, from its hits.
DETECTORS = {Keyword: every_hit, Threshold: thresholds, Sequence: by_segment, PortScan: port_scans, RarePort: every_hit}

#: The columns rules see, and no others.
RULE_COLUMNS = ("id", "ts", "host", "service", "level", "action", "user", "src_ip", "dst_port", "message")


def detect_hits(rows: DataFrame, rule: Rule, spread: bool = True) -> DataFrame:
    """Evidence from the hits of one rule."""
    return DETECTORS[type(rule)](rows, rule, spread)


def detect(events: DataFrame, rule: Rule, spread: bool | None = None) -> DataFrame:
    return detect_hits(hits(events, rule), rule, is_spread(events) if spread is None else spread)


def evidence_of(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Evidence of all enabled rules."""
    seen = events.select(*RULE_COLUMNS)
    spread = is_spread(seen)
    out = None
    for rule in rules:
        if rule.enabled:
            found = detect(seen, rule, spread)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else events.sparkSession.createDataFrame([], EVIDENCE)


