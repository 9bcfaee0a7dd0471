import random
from datetime import timedelta

from support import SCHEMA, T0, event, frame

from palisade.operators import alerts as A
from palisade.operators.rules import PortScan, Threshold
from palisade.streaming import live as S

RULES = [Threshold(id="T", match={"action": ("auth_fail",)}, threshold=3, window_seconds=60, cooldown_seconds=120), PortScan(id="S", min_ports=3, window_seconds=60, cooldown_seconds=30)]


def random_rows(n, seed):
    rng = random.Random(seed)
    return [event(i, rng.randint(0, 2000), rng.choice(("auth_fail", "auth_ok", "conn_block")), f"192.0.2.{rng.randint(1, 6)}", rng.choice((None, 1, 2, 3, 4))) for i in range(n)]


def test_steps_equal_a_full_run(spark, tmp_path):
    rows = random_rows(240, 1)
    tables = S.AlertTables(spark, str(tmp_path), RULES)
    for k in range(3):
        tables.step(frame(spark, rows[k * 80 : (k + 1) * 80]), k)
        full, evidence = A.evaluate(frame(spark, rows[: (k + 1) * 80]), RULES)
        assert sorted(tables.read("alerts", k).collect()) == sorted(full.collect())
        key = lambda r: (r.alert_key, r.event_id)
        assert sorted(map(key, tables.read("evidence", k).collect())) == sorted(map(key, evidence.collect()))
    changed = S.AlertTables(spark, str(tmp_path), RULES[:1])
    changed.step(frame(spark, []), 3)
    assert {r.rule_id for r in changed.read("alerts", 3).collect()} <= {"T"}


def test_streams_equal_batches(spark, tmp_path):
    rows = random_rows(200, 2) + [event(1000, 100_000, "auth_fail", "192.0.2.99"), event(1001, 100_000, "conn_block", "192.0.2.99", 9)]
    frame(spark, rows).write.parquet(str(tmp_path / "in"))
    for rule in RULES:
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        out = str(tmp_path / f"out-{rule.id}")
        q = S.stream_detect(stream, rule).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-c").trigger(availableNow=True).start()
        q.awaitTermination()
        got = {(r.event_id, r.first_id) for r in spark.read.parquet(out).collect()}
        _, evidence = A.evaluate(frame(spark, rows), [rule])
        assert got == {(r.event_id, int(r.alert_key.rsplit(":", 1)[1])) for r in evidence.collect()}


def test_following_files(spark, tmp_path):
    folder, store, state = (str(tmp_path / n) for n in ("logs", "events", "state"))
    (tmp_path / "logs").mkdir()
    line = lambda k: f"{(T0 + timedelta(seconds=k)).strftime('%Y-%m-%dT%H:%M:%S+00:00')} web sshd[1]: Invalid user u{k} from 192.0.2.1\n"
    (tmp_path / "logs" / "a.log").write_text("".join(map(line, range(5))))
    S.follow_logs(spark, folder, store, state).awaitTermination()
    (tmp_path / "logs" / "b.log").write_text("".join(map(line, range(5, 8))))
    S.follow_logs(spark, folder, store, state).awaitTermination()
    S.follow_logs(spark, folder, store, state).awaitTermination()
    assert sorted((r.source_file, r.line_no, r.user) for r in spark.read.parquet(store).collect()) == [("a.log", k + 1, f"u{k}") for k in range(5)] + [("b.log", k - 4, f"u{k}") for k in range(5, 8)]


def test_names_growth_and_conflicts(spark, tmp_path):
    store = str(tmp_path / "events")
    line = lambda k, n="x": f"{(T0 + timedelta(seconds=k)).strftime('%Y-%m-%dT%H:%M:%S+00:00')} web sshd[1]: Invalid user {n}{k} from 192.0.2.1\n"
    for host, n in (("h1", "a"), ("h2", "b"), ("h3", "a")):
        (tmp_path / host).mkdir()
        (tmp_path / host / "auth.log").write_text("".join(line(k, n) for k in range(3)))
    rows = lambda: sorted((r.source_file, r.line_no, r.user) for r in spark.read.parquet(store).collect())
    report = lambda r: sorted(tuple(x) for x in r.collect())
    folders = [str(tmp_path / h) for h in ("h1", "h2", "h3")]
    day = T0.strftime("%Y-%m-%d")
    first = S.store_logs(spark, folders, store)
    names = {r.user: r.source_file for r in spark.read.parquet(store).collect()}
    assert {names["a0"], names["b0"]} == {"auth.log", f"auth.log ({day})"}
    # h3 has the lines of h1, so it is the same file.
    assert report(first) == sorted([(names["a0"], 6, 3, 0, 3, 0), (names["b0"], 3, 3, 0, 0, 0)])
    (tmp_path / "h1" / "auth.log").rename(tmp_path / "h1" / "auth.log.1")
    with (tmp_path / "h1" / "auth.log.1").open("a") as f:
        f.write(line(3, "a"))
    (tmp_path / "h1" / "auth.log").write_text(line(9, "c"))
    (tmp_path / "h2" / "auth.log").write_text(line(0, "b") + line(1, "edited") + line(2, "b"))
    second = S.store_logs(spark, folders, store)
    assert {r[0]: r[1:] for r in report(second)} == {names["a0"]: (7, 1, 0, 6, 0), names["b0"]: (3, 0, 0, 2, 1), f"auth.log ({day}, 2)": (1, 1, 0, 0, 0)}
    assert (names["a0"], 4, "a3") in rows() and len(rows()) == 8 and (names["b0"], 2, "b1") in rows()
    both = spark.createDataFrame([("f", 1, "p", True, T0), ("f", 1, "q", True, T0), ("f", 1, "p", True, T0)], "source_file string, line_no long, raw string, parsed boolean, ts timestamp")
    from palisade.sources.store import append_events

    assert report(append_events(both, str(tmp_path / "other"))) == [("f", 3, 1, 0, 1, 1)]
