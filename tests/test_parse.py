from datetime import datetime

import pytest

from palisade.operators import parse as G
from palisade.sources import lines as L

H = "2024-03-01T10:00:00+00:00 web "


def parsed(spark, *raw, year=2024, **kw):
    df = spark.createDataFrame([("f.log", i + 1, r) for i, r in enumerate(raw)], L.LINE_SCHEMA)
    return sorted(G.parse_events(df, kw.pop("parser", "auto"), year, **kw).collect(), key=lambda r: r.line_no)


LOGINS = [
    ("sshd[1]: Accepted publickey for ann from 192.0.2.4 port 22 ssh2: ED25519 SHA256:x", "auth_ok", "ann", "192.0.2.4", 22),
    ("sshd[1]: Failed password for invalid user bob from 192.0.2.4 port 22 ssh2", "auth_fail", "bob", "192.0.2.4", 22),
    ("sshd[1]: Failed password for x from 198.51.100.1 port 1 from 192.0.2.4 port 22 ssh2", "auth_fail", "x from 198.51.100.1 port 1", "192.0.2.4", 22),
    ("sshd[1]: Failed none for  from 2001:db8::1 port 22", "auth_fail", None, "2001:db8::1", 22),
    ("sshd[1]: Invalid user eve from 192.0.2.4", "invalid_user", "eve", "192.0.2.4", None),
    ("sshd-session[1]: Invalid user eve from 192.0.2.4 port 99", "invalid_user", "eve", "192.0.2.4", 99),
    ("sshd[1]: Received disconnect from 192.0.2.4 port 22:11: bye", "disconnect", None, "192.0.2.4", 22),
    ("sshd[1]: Disconnected from authenticating user root 192.0.2.4 port 22 [preauth]", "disconnect", "root", "192.0.2.4", 22),
    ("sshd[1]: Connection reset by 192.0.2.4 port 22", "disconnect", None, "192.0.2.4", 22),
    ("sshd[1]: Connection reset by 192.0.2.4 port 222222", None, None, None, None),
    ("sudo:  ann : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/ls", "sudo_exec", "ann", None, None),
    ("sudo:  bob : user NOT in sudoers ; TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/ls", "sudo_denied", "bob", None, None),
    ("cron[1]: Accepted password for ann from 192.0.2.4 port 22 ssh2", None, None, None, None),
]


def test_logins(spark):
    rows = parsed(spark, *[H + m for m, *_ in LOGINS])
    for r, (text, action, user, ip, port) in zip(rows, LOGINS):
        assert (r.action, r.user, r.src_ip, r.src_port, r.parsed) == (action, user, ip, port, action is not None), text
    assert {r.level for r in rows if r.action in ("auth_fail", "invalid_user", "sudo_denied")} == {"warning"}
    assert [r.action for r in parsed(spark, *[H + m for m, *_ in LOGINS], parser="ufw") if r.action] == []


PACKETS = [
    ("[UFW BLOCK] IN=eth0 OUT= SRC=192.0.2.1 DST=192.0.2.2 PROTO=TCP SPT=1 DPT=23 SYN", "conn_block", 23),
    ("[ 12.5] [UFW ALLOW] IN=eth0 OUT= SRC=192.0.2.1 DST=192.0.2.2 SPT=1 DPT=23", "conn_allow", 23),
    ("[UFW LIMIT BLOCK] IN= SRC=a DST=b DPT=70000", "conn_block", None),
    ("[UFW AUDIT] IN=eth0 SRC=a DST=b DPT=1", None, 1),
    ("my drop allow: IN=eth0 SRC=a DST=b", "conn_block", None),
    ("[UFW BLOCK] IN=eth0 SRC=a DPT=1", None, None),
    ("[UFW ALLOW] IN=eth0 SRC=a DST=b DPT=1 DPT=2 URG=0=1", "conn_allow", 2),
    ("usb 1-1: new device", None, None),
]


def test_packets(spark):
    for r, (text, action, port) in zip(parsed(spark, *[H + "kernel: " + m for m, *_ in PACKETS]), PACKETS):
        assert (r.action, r.dst_port) == (action, port), text
    r = parsed(spark, H + "kernel: " + PACKETS[3][0])[0]
    assert (r.src_ip, r.dst_ip, r.parsed, r.level) == ("a", "b", False, "info")
    assert parsed(spark, H + "kernel: " + PACKETS[1][0])[0].message.startswith("[UFW ALLOW]")


def test_headers(spark):
    rows = parsed(spark, "Mar  1 10:00:05 web prog[7]:   text  ", "Mar 1 10:00:06 web no program part", "Mar 30 10:00:07 web", "Feb 30 10:00:00 web a: b", "2024-03-31T10:00:00.25+03:00 db x: y", "2024-04-01T10:00:00 db x: y", "Mrz  1 10:00:00 web a: b")
    assert [r.ts for r in rows[:3]] == [datetime(2024, 3, 1, 10, 0, 5), datetime(2024, 3, 1, 10, 0, 6), datetime(2024, 3, 30, 10, 0, 7)]
    assert (rows[0].service, rows[0].message) == ("prog", "text")
    assert (rows[1].service, rows[1].message) == (None, "no program part")
    assert rows[3].ts == rows[2].ts and rows[3].message == "Feb 30 10:00:00 web a: b" and rows[3].host == "web"
    assert rows[4].ts == datetime(2024, 3, 31, 7, 0, 0, 250000)
    assert rows[6].ts == rows[5].ts


def test_years_and_zones(spark):
    rows = parsed(spark, "Dec 31 23:59:58 a x: 1", "Jan  1 00:00:01 a x: 2", "Dec 31 23:59:59 a x: 3", "Jan  1 00:00:02 a x: 4", "Feb 29 10:00:00 a x: 5", year=2023)
    assert [r.ts.year for r in rows] == [2023, 2024, 2023, 2024, 2024]
    bad = parsed(spark, "Dec 31 23:59:58 a x: 1", "Feb 28 00:00:01 a x: 2", "Feb 29 00:00:00 a x: 3", year=2021)
    assert bad[2].message == "Feb 29 00:00:00 a x: 3"
    leap = parsed(spark, "Feb 28 10:00:00 a x: 1", "Feb 29 10:00:00 a x: 2", "Mar  1 10:00:00 a x: 3", year=2023)
    assert [r.ts for r in leap] == [datetime(2023, 2, 28, 10), datetime(2024, 2, 29, 10), datetime(2024, 3, 1, 10)]
    summer = parsed(spark, "Jan 15 12:00:00 a x: 1", "Mar 15 12:00:00 a x: 1", "Jul 15 12:00:00 a x: 2", zone="Europe/Berlin")
    assert [r.ts.hour for r in summer] == [11, 11, 10]
    guessed = parsed(spark, "Mar  5 12:00:00 a x: 1", year=None, today="2024-03-04")
    assert guessed[0].ts.year == 2024
    assert parsed(spark, "Mar  6 12:00:00 a x: 1", year=None, today="2024-03-04")[0].ts.year == 2023


def test_undated_and_refused(spark):
    rows = parsed(spark, "head", H + "a: b", "tail")
    assert [r.message for r in rows] == ["head", "b", "tail"] and len({(r.ts, r.host) for r in rows}) == 1
    assert parsed(spark, "no", "dates", "here") == []
    lines = [("big", i, "x") for i in range(1, 1002)] + [("big", 1002, H + "a: b")] + [("ok", i, "x") for i in range(1, 1001)] + [("ok", 1001, H + "a: b")]
    kept, refused = G.split_refused(G.dated_lines(spark.createDataFrame(lines, L.LINE_SCHEMA), 2024))
    assert [r.source_file for r in refused.collect()] == ["big"] and kept.count() == 1001


def test_blocks_do_not_matter(spark, monkeypatch):
    raw = [f"{m} {d:2d} 10:00:{k % 60:02d} a sshd: Invalid user u{k} from 192.0.2.1" if k % 4 else f"undated {k}" for k, (m, d) in enumerate((m, d) for m in ("Nov", "Dec", "Jan", "Feb") for d in range(1, 30) for _ in range(2))]
    whole = [tuple(r) for r in parsed(spark, *raw, year=2022)]
    assert {r[3].year for r in whole} == {2022, 2023, 2024}
    monkeypatch.setattr(G, "BLOCK", 7)
    assert [tuple(r) for r in parsed(spark, *raw, year=2022)] == whole


def test_files(spark, tmp_path):
    import bz2
    import gzip
    import lzma

    text = b"one\n\n  \ntwo\r\nbad \xff\nnul\0led\n" + b"x" * 9000 + b"\nlast"
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a b.log").write_bytes(text)
    want = [(1, "one"), (4, "two"), (5, "bad \ufffd"), (6, "nulled"), (7, "x" * 8192), (8, "last")]
    got = L.read_log_lines(spark, str(tmp_path / "plain")).collect()
    assert sorted((r.line_no, r.raw) for r in got) == want and {r.source_file for r in got} == {"a b.log"}
    packed = tmp_path / "packed"
    packed.mkdir()
    (packed / "g.txt").write_bytes(gzip.compress(text))
    (packed / "b.log").write_bytes(bz2.compress(text))
    (packed / "x.gz").write_bytes(lzma.compress(text))
    (packed / "p.bin").write_bytes(text)
    (packed / "cut").write_bytes(gzip.compress(b"".join(b"line %d\n" % k for k in range(200_000)))[:-2000])
    rows = L.read_log_lines(spark, str(packed), sniff=True).collect()
    for name in ("g.txt", "b.log", "x.gz", "p.bin"):
        assert sorted((r.line_no, r.raw) for r in rows if r.source_file == name) == want
    assert 1000 < sum(r.source_file == "cut" for r in rows) < 200_000


def test_numbers_across_blocks(spark, tmp_path):
    (tmp_path / "n.log").write_text("".join(f"line {k}\n" for k in range(1, 20_001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        rows = L.read_log_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 20_000 and all(r.raw == f"line {r.line_no}" for r in rows)


def test_storing_once(spark, tmp_path):
    from palisade.sources.store import append_events

    df = spark.createDataFrame([("f", 1, H + "a: b"), ("f", 2, H + "sshd: Invalid user x from y")], L.LINE_SCHEMA)
    more = spark.createDataFrame([("f", 1, H + "a: changed"), ("f", 2, H + "sshd: Invalid user x from y"), ("f", 3, H + "a: c"), ("g", 1, H + "a: d")], L.LINE_SCHEMA)
    store = str(tmp_path / "events")
    append_events(G.parse_events(df, year=2024), store)
    classified = L.classify_lines(G.parse_events(more, year=2024), spark.read.parquet(store))
    report = {r.source_file: (r.lines, r.parsed, r.unparsed, r.duplicates, r.conflicts) for r in L.ingest_report(classified).collect()}
    assert report == {"f": (3, 0, 1, 1, 1), "g": (1, 0, 1, 0, 0)}
    append_events(G.parse_events(more, year=2024), store)
    assert sorted((r.source_file, r.line_no, r.message) for r in spark.read.parquet(store).collect())[0] == ("f", 1, "b")
    assert spark.read.parquet(store).count() == 4
    assert sorted((r.source_file, r.line_no) for r in L.lines_after(more, df).collect()) == [("f", 3), ("g", 1)]


@pytest.mark.parametrize("path, name", [("/a/b.log", "b.log"), ("c:\\x\\y.log", "y.log"), ("", "upload"), (None, "upload"), ("/d/", "upload"), ("n" * 300, "n" * 255)])
def test_source_names(spark, path, name):
    from pyspark.sql import functions as F

    from palisade.functions.text import source_name

    assert spark.range(1).select(source_name(F.lit(path).cast("string"))).first()[0] == name
