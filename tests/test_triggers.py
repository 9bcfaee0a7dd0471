"""Threshold and port-scan rules whose windows outlast their cooldowns: in bulk, as against one group's walk event by event."""

import random

import pytest
from pyspark.sql import functions as F

from palisade.operators import triggers as T
from palisade.operators.detect import HITS, SECOND, Machine, detect_hits
from palisade.operators.rules import PortScan, Threshold

RULES = [
    Threshold(id="A", threshold=3, window_seconds=40, cooldown_seconds=5),
    Threshold(id="B", threshold=1, window_seconds=3, cooldown_seconds=0),
    Threshold(id="C", threshold=6, window_seconds=100, cooldown_seconds=2),
    PortScan(id="D", min_ports=3, window_seconds=40, cooldown_seconds=5),
    PortScan(id="E", min_ports=2, window_seconds=30, cooldown_seconds=1),
    PortScan(id="F", min_ports=4, window_seconds=70, cooldown_seconds=20),
    PortScan(id="G", min_ports=3, window_seconds=70, cooldown_seconds=0),
]


def random_hits(seed, n=500):
    rng = random.Random(seed)
    out = []
    for key, spread in (("a", 4000), ("b", 900), ("c", 30_000), ("tie", 60)):
        out += [(key, rng.randint(0, spread) * SECOND, k, rng.randint(1, 6), 0, []) for k in range(n if key != "tie" else 120)]
    return out


def walked(rows, rule):
    out, groups = set(), {}
    for key, t, i, port, *_ in rows:
        groups.setdefault(key, []).append((t, i, port, 0))
    for key, own in groups.items():
        machine = Machine(rule)
        for row in sorted(own, key=lambda r: r[:2]):
            out |= {(key, i, f"{rule.id}:{key}:{first}") for i, first in machine.push(*row)}
    return out


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.id)
def test_bulk_equals_the_walk(spark, rule):
    for seed in (1, 2):
        rows = random_hits(seed)
        got = [(r.group_key, r.event_id, r.alert_key) for r in detect_hits(spark.createDataFrame(rows, HITS), rule).collect()]
        assert len(got) == len(set(got)) and set(got) == walked(rows, rule)
    assert detect_hits(spark.createDataFrame([], HITS), rule).collect() == []


def test_long_chains_by_doubling(spark, monkeypatch):
    monkeypatch.setattr(T, "SHORT_CHAIN", 1)
    rows = random_hits(3)
    for rule in (RULES[2], RULES[4]):
        got = {(r.group_key, r.event_id, r.alert_key) for r in detect_hits(spark.createDataFrame(rows, HITS), rule).collect()}
        assert got == walked(rows, rule)


def test_chains_of_any_length(spark):
    """Every candidate reaches into the next but one: a single chain, of which each second one is reached."""
    rows = spark.range(2000).select(F.lit("k").alias("key"), (F.col("id") / 50).cast("long").alias("stretch"), (F.col("id") * 2).alias("burst"), F.col("id").alias("t"), "id", (F.col("id") * 2 + 3).alias("until"))
    assert sorted(r.burst for r in T.reached(rows).collect()) == list(range(0, 4000, 4))


def test_a_group_of_a_million_events_is_spread(spark):
    """One group without any gap beyond the cooldown's, over several tasks and without Python."""
    rule = Threshold(id="M", threshold=4, window_seconds=60, cooldown_seconds=10)
    hits = spark.range(1_000_000).select(F.lit("one").alias("key"), (F.col("id") * 3 * SECOND + F.when(F.col("id") % 1000 == 0, 8 * SECOND).otherwise(0)).alias("t"), "id", F.lit(1).alias("port"), F.lit(0).cast("long").alias("steps"), F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("spans"))
    found = detect_hits(hits, rule)
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
    assert found.count() == 1_000_000 and found.select("alert_key").distinct().count() == 1
    # Small partitions are put together here, where all of them are small.
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        sizes = [r["count"] for r in T.stretched(hits, 70 * SECOND).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset(setting)
    assert len(sizes) == 4 and max(sizes) < 400_000
