"""Predicates on events and alerts."""

from __future__ import annotations

import ipaddress
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators.rules import PortScan, RarePort, Rule, Sequence

IPV4 = r"^(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}\z"


def time_range(column: str, start: datetime | str | None, end: datetime | str | None) -> Column:
    """start <= time < end; bounds without a zone are UTC (the session's)."""
    out = F.lit(True)
    if start is not None:
        out &= F.col(column) >= F.lit(start).cast("timestamp")
    if end is not None:
        out &= F.col(column) < F.lit(end).cast("timestamp")
    return out


def filter_events(
    events: DataFrame,
    start=None,
    end=None,
    ip: str | None = None,
    parsed: bool | None = None,
    alert_key: str | None = None,
    rule_id: str | None = None,
    evidence: DataFrame | None = None,
    **equal: str,
) -> DataFrame:
    """Events that meet every given condition; ``ip`` is source or target, host, service, level, action are equalities."""
    kept = events.where(time_range("ts", start, end))
    if ip is not None:
        kept = kept.where((F.col("src_ip") == ip) | (F.col("dst_ip") == ip))
    if parsed is not None:
        kept = kept.where(F.col("parsed") == parsed)
    for name, value in equal.items():
        if value is not None:
            kept = kept.where(F.col(name) == value)
    if alert_key is not None or rule_id is not None:
        chosen = evidence
        if alert_key is not None:
            chosen = chosen.where(F.col("alert_key") == alert_key)
        if rule_id is not None:
            chosen = chosen.where(F.col("rule_id") == rule_id)
        kept = kept.join(chosen.select(F.col("event_id").alias("id")), "id", "left_semi")
    return kept


def match_filter(match: dict[str, tuple]) -> Column:
    """AND over fields of IN-lists; an empty list accepts all."""
    out = F.lit(True)
    for name, accepted in match.items():
        if accepted:
            out &= F.coalesce(F.col(name).isin(*accepted), F.lit(False))
    return out


def ip4_number(column: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    octets = F.split(column, r"\.")
    number = sum((F.get(octets, F.lit(k)).try_cast("bigint") * 256 ** (3 - k) for k in range(4)), F.lit(0).cast("bigint"))
    return F.when(column.rlike(IPV4), number)


def ip4_digits(column: Column) -> Column:
    """An IPv4 address as 8 hexadecimal digits; null for anything else."""
    return F.lower(F.lpad(F.hex(ip4_number(column)), 8, "0"))


def ip6_digits(column: Column) -> Column:
    """An IPv6 address as 32 hexadecimal digits, whatever its spelling (``::``, an IPv4 tail, a zone); null for anything else."""
    groups = lambda text: F.when(text == "", F.expr("CAST(array() AS array<string>)")).otherwise(F.split(text, ":"))

    def read(x: Column) -> Column:
        tail = F.substring_index(x, ":", -1)
        four = ip4_digits(tail)
        dotted = F.concat(F.left(x, F.char_length(x) - F.char_length(tail)), F.left(four, F.lit(4)), F.lit(":"), F.right(four, F.lit(4)))
        return F.transform(F.array(F.split(F.when(F.contains(tail, F.lit(".")), dotted).otherwise(x), "::")), halves)[0]

    def halves(parts: Column) -> Column:
        left, right = groups(parts[0]), groups(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
        return F.transform(F.array(F.struct(left.alias("left"), right.alias("right"), F.size(parts).alias("halves"))), whole)[0]

    def whole(h: Column) -> Column:
        missing = 8 - F.size(h["left"]) - F.size(h["right"])
        sound = F.when(h["halves"] == 1, missing == 0).otherwise((h["halves"] == 2) & (missing > 0))
        sound &= F.forall(F.concat(h["left"], h["right"]), lambda g: g.rlike(r"^[0-9a-f]{1,4}\z"))
        every = F.concat(h["left"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), h["right"])
        return F.when(sound, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    zone = F.instr(column, "%")
    bare = F.lower(F.when(zone == 0, column).when((zone < F.char_length(column)) & (F.instr(F.substr(column, zone + 1), "%") == 0), F.left(column, zone - 1)))
    return F.when(F.contains(column, F.lit(":")), F.transform(F.array(bare), read)[0])


def inside_ranges(value: Column, ranges: list[tuple[str, str]]) -> Column:
    """Whether a text lies in one of some disjoint, sorted ranges: a binary search, and an expression as large for ten thousand of them as for ten.

    The ranges stand in the plan as two constants, which go to the executors with it.
    """
    firsts, lasts = (F.split(F.lit(",".join(side)), ",") for side in zip(*ranges, strict=True))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(ranges).bit_length()))])

    def search(x: Column) -> Column:
        # How many ranges begin at or before x.
        found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(firsts, at + step - 1) <= x, F.lit(False)), at + step).otherwise(at))
        return F.coalesce(F.get(lasts, found - 1) >= x, F.lit(False))

    return F.transform(F.array(value), search)[0]


def merged_ranges(nets: list, version: int) -> list[tuple[str, str]]:
    """Nets of one version as disjoint ranges of digits, in order."""
    digits = "{:08x}" if version == 4 else "{:032x}"
    whole = ipaddress.collapse_addresses(n for n in nets if n.version == version)
    return [(digits.format(int(n.network_address)), digits.format(int(n.broadcast_address))) for n in whole]


def not_allowlisted(column: Column, nets: tuple[str, ...] | list[str]) -> Column:
    """False where an address lies in one of any number of nets of its own version; nulls and non-addresses stay."""
    parsed = [ipaddress.ip_network(n, strict=False) for n in nets]
    inside = F.lit(False)
    for version, read in ((4, ip4_digits), (6, ip6_digits)):
        if ranges := merged_ranges(parsed, version):
            inside |= inside_ranges(read(column), ranges)
    return ~F.coalesce(inside, F.lit(False))


def counts_for(rule: Rule) -> Column:
    """Which events a rule looks at, by its match and its kind."""
    if isinstance(rule, Sequence):
        out = F.lit(False)
        for step in rule.steps:
            out |= match_filter(step.match)
        return out & match_filter(rule.match)
    out = match_filter(rule.match)
    if isinstance(rule, PortScan):
        out &= F.col("dst_port").isNotNull()
    if isinstance(rule, RarePort):
        listed = F.col("dst_port").isin(*rule.ports)
        out &= F.col("dst_port").isNotNull() & (listed if rule.mode == "watchlist" else ~listed)
    return out


def counted_events(events: DataFrame, rule: Rule) -> DataFrame:
    """Events a rule counts: not allow-listed, with a group, and matching; columns key and t (microseconds) added."""
    kept = events.where(counts_for(rule))
    if rule.allowlist:
        kept = kept.where(not_allowlisted(F.col("src_ip"), rule.allowlist))
    kept = kept.withColumn("key", F.col(rule.group_by)).where(F.col("key").isNotNull() & (F.col("key") != ""))
    return kept.withColumn("t", F.unix_micros("ts"))


def filter_alerts(alerts: DataFrame, start=None, end=None, **equal: str) -> DataFrame:
    """Alerts by rule_id, severity, group_key, and overlap with [start, end)."""
    kept = alerts
    for name, value in equal.items():
        if value is not None:
            kept = kept.where(F.col(name) == value)
    if start is not None:
        kept = kept.where(F.col("last_seen") >= F.lit(start).cast("timestamp"))
    if end is not None:
        kept = kept.where(F.col("first_seen") < F.lit(end).cast("timestamp"))
    return kept
