"""Alerts of counting rules without a walk: from each event where a trigger would fire, then which of these are reached.

A window starts empty at the first event of a burst (events no further apart than the
cooldown). From there the first *base* counts: an event from which on enough is seen
within the window. The alert goes from the base to the end of the burst in which that much
is seen, and the next window starts with the next burst. So each burst needs one
candidate, its first base and the burst it lasts until; which candidates are reached is
found by doubling pointers, and only among candidates that overlap.

Events are dealt by (group, stretch of time), each stretch with what follows it closely, so
a group without any gap is spread; only facts of each stretch meet by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.operators.rules import PortScan, Rule, Threshold
from palisade.sources.scratch import stored

SECOND = 1_000_000
#: Overlapping candidates that are gone through in one array; longer chains of them are halved again and again.
SHORT_CHAIN = 64
#: A stretch of time is so many times as long as what it has to see of the next one.
STRETCH = 16


def in_stretch(*more: str) -> Window:
    return Window.partitionBy("key", "stretch", *more).orderBy("t", "id")


def stretched(hits: DataFrame, ahead: int) -> DataFrame:
    """hits dealt by stretch: those within ``ahead`` microseconds of a stretch's start also stand, not as its ``own``, at the end of the one before."""
    width = max(STRETCH * ahead, SECOND)
    of = F.floor(F.col("t") / width).cast("long")
    both = F.when(F.col("t") - of * width < ahead, F.array(of, of - 1)).otherwise(F.array(of))
    return hits.withColumn("of", of).withColumn("stretch", F.explode(both)).withColumn("own", F.col("stretch") == F.col("of")).drop("of").repartition("key", "stretch")


def with_bursts(rows: DataFrame, cooldown: int) -> DataFrame:
    """rows with ``ends``, how many bursts of their stretch have ended before them; right for own rows and for those a window later."""
    gap = F.lead("t").over(in_stretch()) - F.col("t")
    is_last = F.when(gap.isNull() | (gap > cooldown), 1).otherwise(0)
    before = in_stretch().rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("is_last", is_last).withColumn("ends", F.coalesce(F.sum("is_last").over(before), F.lit(0)))


def threshold_bases(rows: DataFrame, rule: Threshold) -> DataFrame:
    """Adds ``base``, and for a base ``later``: how many bursts later the trigger fires."""
    far = rule.threshold - 1
    seen = F.lead("t", far).over(in_stretch()) - F.col("t") if far else F.lit(0)
    later = F.lead("ends", far).over(in_stretch()) - F.col("ends") if far else F.lit(0)
    return rows.withColumn("base", F.coalesce(seen < rule.window_seconds * SECOND, F.lit(False))).withColumn("later", F.when(F.col("base"), later).cast("long"))


def scan_bases(rows: DataFrame, rule: PortScan) -> DataFrame:
    """Adds ``base``: from here on so many ports are seen within the window.

    Backwards in time a port is ahead from its packet until the window before it; the number
    of ports ahead of each packet is a running sum of these starts and ends.
    """
    window = rule.window_seconds * SECOND
    near = lambda other: F.coalesce(F.abs(other - F.col("t")) < window, F.lit(False))
    by_port = in_stretch("port")
    rows = rows.withColumns({"starts": (~near(F.lead("t").over(by_port))).cast("int"), "is_first": ~near(F.lag("t").over(by_port))})
    here = F.struct(F.col("t").alias("at"), F.lit(1).alias("kind"), F.col("starts").alias("step"))
    gone = F.struct((F.col("t") - window).alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("step"))
    changes = rows.withColumn("c", F.explode(F.when(F.col("is_first"), F.array(here, gone)).otherwise(F.array(here)))).drop("starts", "is_first")
    back = Window.partitionBy("key", "stretch").orderBy(F.desc("c.at"), "c.kind", F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    counted = changes.withColumn("ports", F.sum("c.step").over(back)).where("c.kind = 1")
    return counted.withColumn("base", F.col("ports") >= rule.min_ports).drop("c", "ports")


def numbered(rows: DataFrame) -> DataFrame:
    """rows with ``burst``, the number of their burst in the group: the ends in earlier stretches and in their own."""
    ended = rows.where("own").groupBy("key", "stretch").agg(F.sum("is_last").alias("n"))
    earlier = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = ended.select("key", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ended"))
    return rows.join(base, ["key", "stretch"]).withColumn("burst", F.col("ended") + F.col("ends")).drop("ended", "ends", "is_last")


def scan_lasts(candidates: DataFrame, own: DataFrame, rule: PortScan) -> DataFrame:
    """candidates with ``until``, the burst of the packet that completes the ports.

    Candidates are a cooldown apart at least, so a packet meets at most a window's worth of
    them; each meets its ports' first packets only, by (group, width of a window).
    """
    window = rule.window_seconds * SECOND
    cell = lambda t: F.floor(t / window)
    asked = candidates.select("key", "burst", F.col("t").alias("base_t"), F.col("id").alias("base_id"), F.explode(F.array(cell(F.col("t")), cell(F.col("t")) + 1)).alias("cell"))
    met = own.select("key", "t", "id", "port", F.col("burst").alias("found"), cell(F.col("t")).alias("cell")).join(asked, ["key", "cell"])
    met = met.where((F.col("t") < F.col("base_t") + window) & ((F.col("t") > F.col("base_t")) | (F.col("t") == F.col("base_t")) & (F.col("id") >= F.col("base_id"))))
    firsts = met.groupBy("key", "burst", "port").agg(F.min(F.struct("t", "id", "found")).alias("first"))
    # A port's first packet: 65,536 at most for each candidate.
    full = firsts.withColumn("n", F.row_number().over(Window.partitionBy("key", "burst").orderBy("first"))).where(F.col("n") == rule.min_ports)
    return candidates.join(full.select("key", "burst", F.col("first.found").alias("until")), ["key", "burst"])


def running_max(rows: DataFrame, value: Column, name: str, inclusive: bool) -> DataFrame:
    """rows (key, stretch, burst, ...) with the greatest value of those before in the group: inside stretches, then over stretches."""
    local = Window.partitionBy("key", "stretch").orderBy("burst").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    whole = rows.groupBy("key", "stretch").agg(F.max(value).alias("most"))
    earlier = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select("key", "stretch", F.max("most").over(earlier).alias("carried"))
    return rows.withColumn(name, F.max(value).over(local)).join(carried, ["key", "stretch"]).withColumn(name, F.greatest(name, "carried")).drop("carried")


def in_turn(chains: DataFrame) -> DataFrame:
    """(key, burst) of what is reached when each chain is gone through from its head."""
    start = F.expr("named_struct('last', -1L, 'on', CAST(array() AS array<bigint>))")
    step = lambda acc, x: F.when(x["burst"] > acc["last"], F.struct(x["until"].alias("last"), F.concat(acc["on"], F.array(x["burst"])).alias("on"))).otherwise(acc)
    links = chains.groupBy("key", "chain").agg(F.array_sort(F.collect_list(F.struct("burst", "until"))).alias("links"))
    return links.select("key", F.explode(F.aggregate("links", start, step)["on"]).alias("burst"))


def reached(candidates: DataFrame) -> DataFrame:
    """The candidates (key, stretch, burst, t, id, until) that become alerts, when each group is gone through from its first one.

    A candidate that no earlier one reaches into is reached. The others stand in chains
    behind it; there pointers to the next candidate are doubled until the longest chain is
    covered, so rounds grow with the logarithm of the longest overlap.
    """
    prior = running_max(candidates, F.col("until"), "prior", inclusive=False)
    free = F.col("prior").isNull() | (F.col("prior") < F.col("burst"))
    chains = stored(running_max(prior.withColumn("head", F.when(free, F.col("burst"))), F.col("head"), "chain", inclusive=True).drop("prior"), "chains")
    longest = chains.groupBy("key", "chain").count().agg(F.max("count")).first()[0] or 0
    alone = chains.where(F.col("burst") == F.col("chain"))
    if longest <= 1:
        return alone
    if longest <= SHORT_CHAIN:
        return chains.join(in_turn(chains), ["key", "burst"], "left_semi")
    # The next candidate after ``until``: both stand in one order, from the back.
    node = F.struct(F.col("burst").alias("at"), F.lit(0).alias("asks"), F.col("burst").alias("node"))
    ask = F.struct(F.col("until").alias("at"), F.lit(1).alias("asks"), F.lit(None).cast("long").alias("node"))
    order = Window.partitionBy("key", "chain").orderBy(F.desc("m.at"), F.desc("m.asks")).rowsBetween(Window.unboundedPreceding, 0)
    both = chains.select("key", "chain", "burst", F.explode(F.array(node, ask)).alias("m"))
    asked = both.withColumn("next", F.last("m.node", ignorenulls=True).over(order)).where("m.asks = 1")
    state = stored(asked.select("key", "burst", "next", (F.col("burst") == F.col("chain")).alias("on")), "pointers")
    for _ in range(longest.bit_length()):
        hit = state.where("on AND next IS NOT NULL").select("key", F.col("next").alias("burst"), F.lit(True).alias("hit")).distinct()
        further = state.select("key", F.col("burst").alias("next"), F.col("next").alias("further"))
        moved = state.join(hit, ["key", "burst"], "left").join(further, ["key", "next"], "left")
        state = stored(moved.select("key", "burst", F.col("further").alias("next"), (F.col("on") | F.coalesce("hit", F.lit(False))).alias("on")), "pointers")
    return chains.join(state.where("on").select("key", "burst"), ["key", "burst"], "left_semi")


def walked_in_bulk(hits: DataFrame, rule: Rule) -> DataFrame:
    """(key, first_id, t, id, port, spans) of the evidence of a threshold or port-scan rule, for any cooldown and window."""
    window, cooldown = rule.window * SECOND, rule.cooldown_seconds * SECOND
    rows = with_bursts(stretched(hits, window + cooldown), cooldown)
    rows = scan_bases(rows, rule) if isinstance(rule, PortScan) else threshold_bases(rows, rule)
    # Read four times from here on.
    own = stored(numbered(rows).where("own").select("key", "stretch", "burst", "t", "id", "port", "spans", "base", *(["later"] if isinstance(rule, Threshold) else [])), "placed")
    if isinstance(rule, PortScan):
        first = own.where("base").groupBy("key", "burst").agg(F.min(F.struct("t", "id", "stretch")).alias("b"))
        candidates = scan_lasts(first.select("key", "burst", "b.*"), own, rule)
    else:
        first = own.where("base").groupBy("key", "burst").agg(F.min(F.struct("t", "id", "stretch", "later")).alias("b"))
        candidates = first.select("key", "burst", "b.*").withColumn("until", F.col("burst") + F.col("later")).drop("later")
    alerts = reached(stored(candidates, "candidates")).select("key", F.col("burst").alias("first_burst"), F.col("t").alias("first_t"), F.col("id").alias("first_id"), F.explode(F.sequence("burst", "until")).alias("burst"))
    # By stretch, so that the events of one long burst meet their alert in many places.
    spots = own.select("key", "stretch", "burst").distinct().join(alerts, ["key", "burst"])
    met = own.join(spots, ["key", "stretch", "burst"])
    since = (F.col("burst") > F.col("first_burst")) | (F.col("t") > F.col("first_t")) | (F.col("t") == F.col("first_t")) & (F.col("id") >= F.col("first_id"))
    return met.where(since).select("key", "first_id", "t", "id", "port", "spans")
