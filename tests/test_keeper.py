"""Alert tables batch by batch: what a step reads and writes."""

import random
from pathlib import Path

from pyspark.sql import functions as F
from support import event, frame

from palisade.operators import alerts as A
from palisade.operators.rules import Keyword, PortScan, RarePort, Sequence, Step, Threshold
from palisade.streaming.keeper import AlertTables, bucket_of

RULES = [
    Threshold(id="T", match={"action": ("auth_fail",)}, threshold=3, window_seconds=60, cooldown_seconds=20),
    PortScan(id="S", min_ports=3, window_seconds=60, cooldown_seconds=120),
    Sequence(id="Q", steps=(Step(match={"action": ("auth_fail",)}, count=2), Step(match={"action": ("auth_ok",)})), within_seconds=90, cooldown_seconds=10),
    RarePort(id="R", ports=(2, 4), cooldown_seconds=30),
    Keyword(id="K", keywords=("x 192*y",), group_by="src_ip", cooldown_seconds=5),
]


def random_rows(n, seed, groups=6):
    rng = random.Random(seed)
    return [event(i, rng.randint(0, 2000), rng.choice(("auth_fail", "auth_ok", "conn_block")), f"192.0.2.{rng.randint(1, groups)}", rng.choice((None, 1, 2, 3, 4))) for i in range(n)]


def files_of(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("part-*")}


def is_full_run(spark, tables, rows, rules):
    alerts, evidence = A.evaluate(frame(spark, rows), rules)
    assert sorted(tables.read("alerts").collect()) == sorted(alerts.collect())
    facts = lambda e: sorted((r.alert_key, r.event_id, r.port, str(r.spans)) for r in e.collect())
    assert facts(tables.read("evidence")) == facts(evidence)


def test_five_batches_of_all_kinds_of_rules(spark, tmp_path):
    rows = random_rows(300, 5)
    tables, before = AlertTables(spark, str(tmp_path), RULES, buckets=8), {}
    for k in range(5):
        changes = {r.alert_key: r.status for r in tables.step(frame(spark, rows[k * 60 : (k + 1) * 60]), k).collect()}
        if k == 2:
            tables.compact()
        is_full_run(spark, tables, rows[: (k + 1) * 60], RULES)
        now = {r.alert_key: r for r in tables.read("alerts").collect()}
        assert {a for a, s in changes.items() if s == "created"} == now.keys() - before.keys()
        assert {a for a, s in changes.items() if s == "removed"} == before.keys() - now.keys()
        assert {a for a, s in changes.items() if s == "updated"} == {a for a in now.keys() & before.keys() if now[a] != before[a]}
        before = now
    # Running the last batch again changes nothing.
    assert {r.status for r in tables.step(frame(spark, rows[240:]), 4).collect()} == {"unchanged"}
    is_full_run(spark, tables, rows, RULES)


def test_changed_rules(spark, tmp_path):
    rows = random_rows(120, 6)
    AlertTables(spark, str(tmp_path), RULES[:2], buckets=4).step(frame(spark, rows[:60]), 0)
    other = [RULES[1], Threshold(id="T", match={"action": ("auth_fail",)}, threshold=2, window_seconds=60, cooldown_seconds=20), RULES[4]]
    tables = AlertTables(spark, str(tmp_path), other, buckets=4)
    tables.step(frame(spark, rows[60:]), 1)
    is_full_run(spark, tables, rows, other)
    last = AlertTables(spark, str(tmp_path), other[:1], buckets=4)
    last.step(frame(spark, []), 2)
    is_full_run(spark, last, rows, other[:1])


def test_a_small_batch_writes_few_files_and_searches_no_old_text(spark, tmp_path):
    """Of 600 groups six get new events: only their buckets are written, and only they and no messages are read."""
    rules, places = [RULES[0], RULES[4]], 128
    address = lambda k: f"198.51.{k // 250}.{k % 250 + 1}"
    rows = [event(g * 10 + k, k * 10, ip=address(g), message=f"x 192 {g} y") for g in range(600) for k in range(4)]
    tables = AlertTables(spark, str(tmp_path), rules, buckets=places)
    tables.step(frame(spark, rows), 0)
    before = {n: files_of(tmp_path / n) for n in ("alerts", "evidence")}
    few = [event(100_000 + g, 45, ip=address(g), message="x 192 new y") for g in range(6)]
    tables.step(frame(spark, few), 1)
    touched = tables.touched(1)
    assert all(1 <= len(b) <= 6 for b in touched.values())
    for name, old in before.items():
        now = files_of(tmp_path / name)
        assert len(old) > 1.9 * places * 0.9
        # About six of each rule's buckets: files are replaced there and nowhere else.
        assert len(now.items() - old.items()) == sum(map(len, touched.values())) and len(now) == len(old)
    is_full_run(spark, tables, rows + few, rules)
    place = F.lit(False)
    for v, b in touched.items():
        place = place | ((F.col("rule_version") == v) & F.col("bucket").isin(*b))
    evidence = tables.evidence_from(tables.stored_hits(1, -1).where(place))
    plan = evidence._jdf.queryExecution().executedPlan().toString()
    assert "message" not in plan and "/events" not in plan and "PartitionFilters: [" in plan and "bucket#" in plan
    read = spark.createDataFrame([(f,) for f in evidence.inputFiles()], "f string").count()
    scanned = tables.stored_hits(1, -1).where(place).select(F.input_file_name().alias("f")).distinct().count()
    assert scanned <= 2 * sum(map(len, touched.values())) < read
    only = tables.stored_hits(1, -1).where(place).select("key").distinct().collect()
    assert {r.key for r in only} <= {r.key for r in spark.createDataFrame([(address(g),) for g in range(600)], "key string").where(bucket_of(F.col("key"), places).isin(*{b for x in touched.values() for b in x})).collect()}


def test_evidence_is_written_once(spark, tmp_path):
    """A step writes the evidence of its buckets in its place and nowhere else, and alerts stand in the buckets of their groups."""
    rows = random_rows(120, 9)
    tables = AlertTables(spark, str(tmp_path), RULES[:2], buckets=4)
    for k in range(2):
        tables.step(frame(spark, rows[k * 60 : (k + 1) * 60]), k)
    holding = {f.relative_to(tmp_path).parts[0] for f in tmp_path.rglob("part-*") if {"alert_key", "event_id"} <= set(spark.read.parquet(str(f)).columns)}
    assert holding == {"evidence"}
    placed = spark.read.parquet(f"{tmp_path}/alerts").select("alert_key", "rule_id", "rule_version", "bucket", bucket_of(F.col("group_key"), 4).alias("own")).collect()
    assert placed and all(r.bucket == r.own and r.rule_version.startswith(f"{r.rule_id}@") for r in placed)
    is_full_run(spark, tables, rows, RULES[:2])
