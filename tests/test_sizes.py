"""Queries over tables with more sources and events than the supplied ones have."""

from datetime import datetime, timedelta

import duckdb
import pytest

from palisade.jobs import catalog, live
from palisade.streaming import live as streaming


def tables(spark, folder, users, events=None):
    """An events table of given sources, a row for each unless more are asked for."""
    kinds = ("error", "view", "click", "signup", "purchase")
    rows = [(k, datetime(2024, 1, 1) + timedelta(minutes=30 * k), users[k % len(users)], kinds[k // len(users) % 5], 1.0, f'{{"k": {k % 90}}}') for k in range(events or len(users))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def from_sql(folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    found = con.execute(catalog.oracle_sql()[name])
    return [c[0] for c in found.description], found.fetchall()


def test_sources_beyond_the_last_block_of_the_space(spark, tmp_path):
    users = [base + k for base in (0, 63_990, 64_000, 90_000, 127_990, 128_000, 540_000) for k in range(24)]
    folder = tables(spark, tmp_path, users)
    columns, want = from_sql(folder, "allowlisted_by_ten_thousand_nets")
    got = catalog.queries()["allowlisted_by_ten_thousand_nets"](spark, folder).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want) and 0 < len(want) < len(users)


@pytest.mark.parametrize("name", ["stream_bursts", "stream_threshold", "stream_port_scan", "stream_sequence", "stream_dropped"])
def test_triggers_of_several_files_and_few_state_keys(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(live, "ROWS_A_FILE", 100)
    monkeypatch.setattr(streaming, "GROUP_BUCKETS", 3)
    folder = tables(spark, tmp_path, [7, 8, 9, 250, 251], 1400)
    columns, want = from_sql(folder, name)
    got = catalog.queries()[name](spark, folder).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_report_tells_alerts_of_all_rules_after_every_batch():
    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.01/events.parquet'")
    report = dict((r[0], r[2]) for r in con.execute(catalog.oracle_sql()["stream_report"]).fetchall())
    every = con.execute(catalog.oracle_sql()["stream_alerts"]).fetchall()
    assert report[4] == len(every) and sorted(report.values()) == [report[k] for k in range(5)] and len(report) == 5
