"""The store of events and what follows files: what is asked of it, and what is left when a step fails."""

from datetime import timedelta

from pyspark.sql import functions as F
from support import T0

from palisade.sources.store import EventStore, append_events, bucket_of
from palisade.streaming import live as S

SCHEMA = "source_file string, line_no long, raw string, parsed boolean, ts timestamp"


def rows_of(spark, store):
    return sorted((r.source_file, r.line_no, r.raw) for r in spark.read.parquet(store).collect())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lines_of(spark, names, numbers, text="x"):
    return spark.createDataFrame([(n, k, f"{text}{k}", True, T0) for n in names for k in numbers], SCHEMA)


def test_only_the_buckets_of_new_lines_are_asked(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "events"))
    append_events(lines_of(spark, [f"f{k}" for k in range(40)], range(1, 4)), store.path)
    held = store.known_lines([3])
    plan = plan_of(held)
    assert "PartitionFilters: [isnotnull(bucket" in plan and "bucket#" in plan and "raw" not in plan
    whole, files = store.known_lines(range(512)), len(held.inputFiles())
    assert files == len(whole.inputFiles())  # listed, but only some are read:
    scanned = held.withColumn("file", F.input_file_name()).select("file").distinct().count()
    assert scanned <= 1 < files
    status = store.classified(lines_of(spark, ["f1"], [1, 2, 9]).unionByName(lines_of(spark, ["f2"], [3], "other")))
    assert sorted((r.source_file, r.line_no, r.status) for r in status.collect()) == [("f1", 1, "duplicate"), ("f1", 2, "duplicate"), ("f1", 9, "fresh"), ("f2", 3, "conflict")]
    assert "event_date" not in plan_of(status)


def test_long_files_share_no_bucket(spark):
    rows = spark.range(64).select(bucket_of(F.lit("one.log"), F.col("id") * (1 << 20)).alias("b"))
    assert rows.distinct().count() > 40


def test_a_failed_step_is_taken_back(spark, tmp_path):
    path = str(tmp_path / "events")
    append_events(lines_of(spark, ["a"], [1, 2]), path)
    append_events(lines_of(spark, ["a"], [2, 3]), path)
    # As if the last step had been lost before its marks were written.
    (tmp_path / "events.marks" / "step=1" / "_SUCCESS").unlink()
    assert len(rows_of(spark, path)) == 3
    append_events(lines_of(spark, ["a"], [2, 3, 4]), path)
    assert rows_of(spark, path) == [("a", k, f"x{k}") for k in (1, 2, 3, 4)]
    assert append_events(lines_of(spark, ["a"], [1, 4]), path).first()["duplicates"] == 2
    assert append_events(lines_of(spark, ["a"], []), path).collect() == []


def classic(k, text="sshd[1]: Invalid user u{k} from 192.0.2.1"):
    return f"{(T0 + timedelta(seconds=k)).strftime('%b %e %H:%M:%S')} web {text.format(k=k)}\n"


def test_growing_and_rotated_files(spark, tmp_path, monkeypatch):
    """Each trigger parses new lines only, and these go on from the stored ones: year, time of undated lines, name."""
    logs, store, state = tmp_path / "logs", str(tmp_path / "events"), str(tmp_path / "state")
    logs.mkdir()
    parsed = []
    whole = S.parse_events
    monkeypatch.setattr(S, "parse_events", lambda lines, *a, **k: (parsed.append(lines.count()), whole(lines, *a, **k))[1])
    follow = lambda: S.follow_logs(spark, str(logs), store, state, year=T0.year).awaitTermination()
    late = T0.replace(month=12, day=31, hour=23, minute=59, second=50)
    stamp = lambda k: (late + timedelta(seconds=k)).strftime("%b %e %H:%M:%S")
    line = lambda k: f"{stamp(k)} web sshd[1]: Invalid user u{k} from 192.0.2.1\n"
    (logs / "a.log").write_text("".join(map(line, range(100))))
    follow()
    with (logs / "a.log").open("a") as f:
        f.write("  an undated line\n" + line(100) + "\n" + line(101))
    follow()
    follow()
    (logs / "a.log").rename(logs / "a.log.1")
    (logs / "a.log").write_text(line(200) + line(201))
    with (logs / "a.log.1").open("a") as f:
        f.write("last words\n")
    follow()
    assert parsed == [100, 3 + 1, 1 + 2 + 1]
    rows = {(r.source_file, r.line_no): r for r in spark.read.parquet(store).collect()}
    new = f"a.log ({(late + timedelta(seconds=200)).replace(year=T0.year).strftime('%Y-%m-%d')})"
    assert sorted(n for f, n in rows if f == "a.log") == [*range(1, 103), 104, 105] and sorted(n for f, n in rows if f != "a.log") == [1, 2]
    assert {f for f, _ in rows} == {"a.log", new}
    at = lambda n: rows["a.log", n].ts.strftime("%Y-%m-%d %H:%M:%S")
    following = late.year + 1
    assert at(1) == f"{late.year}-12-31 23:59:50" and at(100) == f"{following}-01-01 00:01:29"
    assert at(101) == at(100) and rows["a.log", 101].host == "web" and rows["a.log", 101].message == "  an undated line"
    assert at(102) == f"{following}-01-01 00:01:30" and at(104) == at(105) == f"{following}-01-01 00:01:31"
    told = {(r.batch_id, r.source_file): (r.lines, r.parsed, r.unparsed, r.duplicates, r.conflicts) for r in spark.read.parquet(f"{store}.reports").collect()}
    assert told[0, "a.log"] == (100, 100, 0, 0, 0) and told[1, "a.log"] == (103, 2, 1, 100, 0) and (2, "a.log") not in told and told[3, "a.log"] == (104, 0, 1, 103, 0)
    assert told[3, new] == (2, 2, 0, 0, 0)


def test_an_edited_file_is_compared_line_by_line(spark, tmp_path):
    logs, store, state = tmp_path / "logs", str(tmp_path / "events"), str(tmp_path / "state")
    logs.mkdir()
    (logs / "a.log").write_text("".join(map(classic, range(5))))
    follow = lambda: S.follow_logs(spark, str(logs), store, state, year=T0.year).awaitTermination()
    follow()
    (logs / "a.log").write_text("".join(map(classic, range(4))) + classic(4, "sshd[1]: Invalid user changed from 192.0.2.1") + classic(5))
    follow()
    told = spark.read.parquet(f"{store}.reports").where("batch_id = 1").first()
    assert (told.lines, told.parsed, told.duplicates, told.conflicts) == (6, 1, 4, 1)
    assert len(rows_of(spark, store)) == 6


def test_lines_of_many_blocks_are_read_once(spark, tmp_path):
    """Numbers come from places in blocks that were stored with the lines: no line is shuffled or read again for them."""
    from palisade.sources.lines import read_log_lines

    for name, n in (("a.log", 120), ("b.log", 7)):
        (tmp_path / name).write_text("".join(f"{name} {k}\n" if k % 5 else "\n" for k in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        lines = read_log_lines(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.source_file, r.line_no, r.raw) for r in lines.collect()) == sorted((name, k, f"{name} {k}") for name, n in (("a.log", 120), ("b.log", 7)) for k in range(1, n + 1) if k % 5)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Scan text" not in plan and "raw" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x or "Sort [" in x)
    assert "row_number" not in plan
