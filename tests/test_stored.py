"""Rollups and files in time order: what they answer, and what they read for it."""

import random
from datetime import timedelta

from pyspark.sql import functions as F
from support import T0, event, frame

from palisade.operators import reports as R
from palisade.operators.rollup import BOUND, Rollup, hourly, totals_of
from palisade.sources.ordered import OrderedEvents


def logged(spark, n, seed, spread=200_000):
    rng = random.Random(seed)
    rows = [event(k, rng.randint(0, spread), rng.choice(("auth_fail", "conn_block", "conn_allow")), f"192.0.{rng.randint(0, 9)}.{rng.randint(1, 200)}", rng.choice((None, rng.randint(1, 3000)))) for k in range(n)]
    return frame(spark, rows).withColumn("parsed", F.col("id") % 3 > 0)


def test_totals_of_any_range(spark, tmp_path):
    events, rollup = logged(spark, 4000, 1), Rollup(spark, str(tmp_path))
    for k in (0, 1, 2, 1):
        rollup.step(events.where(F.col("id") % 3 == k), k)
    hour = lambda h, s=0: T0 + timedelta(hours=h, seconds=s)
    for start, end in ((hour(1), hour(9)), (hour(1, 5), hour(30, 59)), (hour(2, 5), hour(2, 900)), (hour(2, 5), hour(3, 5)), (hour(2), hour(2)), (hour(900), hour(901))):
        got = rollup.totals(start, end, events).first()
        inside = events.where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)))
        want = R.event_totals(inside).first()
        assert (got.events, got.parsed, got.unparsed, got.ratio) == (want.events, want.parsed, want.unparsed, want.parsed_ratio)
        assert abs(got.sources - want.sources) <= max(1, BOUND * want.sources)
        assert got.first_us == (inside.agg(F.min(F.unix_micros("ts"))).first()[0])
    assert sorted(tuple(r)[:3] for r in rollup.timeline(86_400).collect()) == sorted(tuple(r) for r in R.timeline(events, "1d").collect())
    exact = {r.src_ip: r for r in R.port_totals(events).collect()}
    for r in rollup.port_totals().collect():
        e = exact.pop(r.src_ip)
        assert (r.packets, r.blocked, r.allowed) == (e.packets, e.blocked, e.allowed) and abs(r.ports - e.ports) <= max(1, BOUND * e.ports)
    assert not exact
    empty = Rollup(spark, str(tmp_path / "none"))
    assert empty.timeline().collect() == [] and empty.totals(hour(0), hour(1), events.limit(0)).first().events == 0


def test_estimates_stay_within_the_bound(spark):
    many = spark.range(300_000).selectExpr("timestamp_seconds(id % 7200) AS ts", "true AS parsed", "'info' AS level", "concat('a', id DIV 3) AS src_ip")
    assert abs(totals_of(hourly(many)).first().sources - 100_000) <= BOUND * 100_000


def test_pages_of_files(spark, tmp_path):
    events, ordered = logged(spark, 5000, 2), OrderedEvents(spark, str(tmp_path))
    for k in (0, 1, 2):
        ordered.step(events.where(F.col("id") % 3 == k), k, rows_a_file=50)
    rows = [(r.t, r.id) for r in events.select(F.unix_micros("ts").alias("t"), "id").orderBy("ts", "id").collect()]
    files = ordered.ranges().count()
    assert files >= 100
    for at in (0, 1234, 4990, 4999):
        for order, want in (("asc", rows[at + 1 : at + 22]), ("desc", rows[max(at - 21, 0) : at][::-1])):
            page = ordered.page(rows[at], order, 20)
            assert [(r.t, r.id) for r in page.select(F.unix_micros("ts").alias("t"), "id").collect()] == want
            assert len(page.inputFiles()) <= 9 if want else True
    newest = ordered.page(order="desc", limit=20)
    assert [r.id for r in newest.collect()] == [i for _, i in rows[::-1][:21]] and len(newest.inputFiles()) <= 6
    assert [r.id for r in ordered.page(limit=6000).collect()] == [i for _, i in rows]
    a, b = rows[2000][0], rows[2100][0]
    some = ordered.between(a, b)
    assert sorted(r.id for r in some.collect()) == sorted(i for t, i in rows if a <= t < b) and len(some.inputFiles()) <= 12
    assert "PushedFilters: [" in (plan := some._jdf.queryExecution().executedPlan().toString()) and "GreaterThanOrEqual(ts" in plan
    none = OrderedEvents(spark, str(tmp_path / "none"))
    assert none.ranges().collect() == []


def test_packet_means_of_full_cells(spark):
    """Six thousand packets in a cell: sums of times since 1970 would not fit, and a mean through a double would be off."""
    rows = [event(k, 0, "conn_block", "192.0.2.1", 22) for k in range(6000)]
    events = frame(spark, rows).withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + F.col("id") * 599_999 + 1))
    t = [r.t for r in events.select(F.unix_micros("ts").alias("t")).collect()]
    cell = R.packet_grid(events, 3600).first()
    assert (cell.packets, cell.mean_us, cell.first_us, cell.last_us) == (6000, sum(t) // 6000, min(t), max(t))
