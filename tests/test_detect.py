import random
from datetime import datetime, timedelta, timezone

import pytest
from palisade.operators import alerts as A
from palisade.operators import detect as D
from palisade.operators.rules import Keyword, PortScan, RarePort, Sequence, Step, Threshold

T0 = datetime(2024, 3, 1, tzinfo=timezone.utc)
SCHEMA = "id long, ts timestamp, host string, service string, level string, action string, user string, src_ip string, dst_port int, message string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def event(i, seconds, action="auth_fail", ip="192.0.2.1", port=None, message="x 192.0.2.1 y", host="web", service="sshd"):
    return (i, T0 + timedelta(seconds=seconds), host, service, "info", action, None, ip, port, message)


def found(spark, rows, rule):
    evidence = D.detect(frame(spark, rows), rule)
    out = {}
    for r in evidence.collect():
        out.setdefault(r.alert_key, []).append(r.event_id)
    return {k: sorted(v) for k, v in out.items()}


def threshold(**kw):
    return Threshold(**({"id": "T", "match": {"action": ("auth_fail",)}, "threshold": 5, "window_seconds": 60} | kw))


def at(*seconds, **kw):
    return [event(i + 1, s, **kw) for i, s in enumerate(seconds)]


@pytest.mark.parametrize("cooldown", [300, 30])
def test_threshold_edges(spark, cooldown):
    rule = threshold(cooldown_seconds=cooldown)
    assert found(spark, at(0, 10, 20, 30), rule) == {}
    assert found(spark, at(0, 10, 20, 30, 40), rule) == {"T:192.0.2.1:1": [1, 2, 3, 4, 5]}
    assert found(spark, at(0, 15, 30, 45, 60), rule) == {}
    assert found(spark, at(0, 15, 30, 45, 59), rule) == {"T:192.0.2.1:1": [1, 2, 3, 4, 5]}
    assert found(spark, at(0, 1, 2, 3, 4, 4 + cooldown), rule) == {"T:192.0.2.1:1": [1, 2, 3, 4, 5, 6]}
    assert found(spark, at(0, 1, 2, 3, 4, 5 + cooldown), rule) == {"T:192.0.2.1:1": [1, 2, 3, 4, 5]}
    two = at(0, 1, 2, 3, 4, 1000, 1001, 1002, 1003, 1004)
    assert set(found(spark, two, rule)) == {"T:192.0.2.1:1", "T:192.0.2.1:6"}


def test_cooldown_zero_merges_what_is_simultaneous(spark):
    rule = threshold(threshold=1, cooldown_seconds=0)
    assert found(spark, at(0, 0, 1), rule) == {"T:192.0.2.1:1": [1, 2], "T:192.0.2.1:3": [3]}


def test_allowlist_groups_and_match(spark):
    rows = at(0, 1, 2, 3, 4)
    assert found(spark, rows, threshold(allowlist=("192.0.2.0/24",))) == {}
    assert found(spark, rows, threshold(allowlist=("0.0.0.0/0",))) == {}
    assert len(found(spark, rows, threshold(allowlist=("2001:db8::/32", "::/0")))) == 1
    six = at(0, 1, 2, 3, 4, ip="2001:db8::5")
    assert found(spark, six, threshold(allowlist=("2001:db8::/32",))) == {}
    assert found(spark, at(0, 1, 2, 3, 4, ip=None) + at(0, 1, 2, 3, 4, ip=""), threshold()) == {}
    assert found(spark, at(0, 1, 2, 3, 4, action="auth_ok"), threshold()) == {}
    assert found(spark, [], threshold()) == {}


def scan(**kw):
    return PortScan(**({"id": "S", "min_ports": 3, "window_seconds": 60} | kw))


def ports(*pairs):
    return [event(i + 1, s, "conn_block", port=p, message=f"SRC=192.0.2.1 DPT={p} x") for i, (s, p) in enumerate(pairs)]


@pytest.mark.parametrize("cooldown", [300, 30])
def test_port_scan_edges(spark, cooldown):
    rule = scan(cooldown_seconds=cooldown)
    assert found(spark, ports((0, 1), (1, 2), (2, 2)), rule) == {}
    assert found(spark, ports((0, 1), (1, 1), (2, 2), (3, 3)), rule) == {"S:192.0.2.1:1": [1, 2, 3, 4]}
    assert found(spark, ports((0, 1), (30, 2), (60, 3)), rule) == {}
    assert found(spark, ports((0, 1), (30, 2), (59, 3)), rule) == {"S:192.0.2.1:1": [1, 2, 3]}
    assert found(spark, ports((0, 1), (1, 2), (2, None)), rule) == {}
    assert set(found(spark, ports((0, 1), (1, 2), (2, 3), (900, 1), (901, 2), (902, 3)), rule)) == {"S:192.0.2.1:1", "S:192.0.2.1:4"}


def sequence(**kw):
    steps = (Step(match={"action": ("auth_fail",)}, count=3), Step(match={"action": ("auth_ok",)}))
    return Sequence(**({"id": "Q", "steps": steps, "within_seconds": 600} | kw))


def logins(text, gap=10):
    return [event(i + 1, i * gap, "auth_fail" if c == "f" else "auth_ok") for i, c in enumerate(text)]


def test_sequence_edges(spark):
    assert found(spark, logins("fffo"), sequence()) == {"Q:192.0.2.1:1": [1, 2, 3, 4]}
    assert found(spark, logins("offf"), sequence()) == {}
    assert found(spark, logins("ffo"), sequence()) == {}
    assert found(spark, logins("fofffo"), sequence()) == {"Q:192.0.2.1:1": [1, 2, 3, 4, 5, 6]}
    assert found(spark, logins("fffo", gap=200), sequence()) == {}
    assert found(spark, logins("fffo", gap=199), sequence()) == {"Q:192.0.2.1:1": [1, 2, 3, 4]}
    again = logins("fffo") + [event(10 + i, 1000 + i, a) for i, a in enumerate(("auth_ok", "auth_fail", "auth_fail"))]
    assert found(spark, again, sequence()) == {"Q:192.0.2.1:1": [1, 2, 3, 4]}
    same = Sequence(id="Q", steps=(Step(match={"host": ("web",)}, count=2), Step(match={"host": ("web",)}, count=1)), within_seconds=60)
    assert found(spark, at(0, 1), same) == {}
    assert found(spark, at(0, 1, 2), same) == {"Q:192.0.2.1:1": [1, 2, 3]}


def test_rare_ports(spark):
    rows = ports((0, 23), (1, 80), (2, None), (500, 23))
    watch = RarePort(id="R", ports=(23,), cooldown_seconds=300)
    assert found(spark, rows, watch) == {"R:192.0.2.1:1": [1], "R:192.0.2.1:4": [4]}
    assert found(spark, rows, RarePort(id="R", ports=(23,), mode="allowlist")) == {"R:192.0.2.1:2": [2]}


def test_random_events_closed_forms_equal_the_machine(spark):
    rng = random.Random(11)
    rows = []
    for k in range(40):
        t = 0
        for _ in range(rng.randint(1, 40)):
            t += rng.choice((0, 0, 1, 5, 20, 29, 30, 31, 60, 61, 90, 400))
            rows.append(event(len(rows) + 1, t, rng.choice(("auth_fail", "auth_ok")), f"192.0.2.{k}", rng.randint(1, 5)))
    events = frame(spark, rows).cache()
    rules = [
        threshold(threshold=3, cooldown_seconds=60),
        threshold(threshold=3, cooldown_seconds=20),
        threshold(threshold=1, cooldown_seconds=0, window_seconds=30),
        scan(cooldown_seconds=90),
        scan(cooldown_seconds=29),
        sequence(within_seconds=61, cooldown_seconds=30),
    ]
    for rule, spread in [(r, s) for r in rules for s in (True, False)]:
        got = {(r.event_id, int(r.alert_key.rsplit(":", 1)[1])) for r in D.detect(events, rule, spread).collect()}
        want = set()
        for k in range(40):
            machine = D.Machine(rule)
            mine = sorted((r for r in rows if r[7] == f"192.0.2.{k}"), key=lambda r: (r[1], r[0]))
            for r in mine:
                steps = 0
                if isinstance(rule, Sequence):
                    steps = 1 if r[5] == "auth_fail" else 2
                elif rule.match and r[5] not in rule.match["action"]:
                    continue
                want |= set(machine.push(round((r[1] - T0).total_seconds() * 1e6), r[0], r[8], steps))
        assert got == want, rule


TRUTH = [
    (dict(keywords=("root",)), "sshd", "login as ROOT", True),
    (dict(keywords=("sshd",)), "sshd", "anything", True),
    (dict(keywords=("sshd: any",)), "sshd", "anything", True),
    (dict(keywords=("sshd",)), None, "anything", False),
    (dict(keywords=("wget *; chmod",)), None, "wget http://x ; chmod +x", True),
    (dict(keywords=("wget *; chmod",)), None, "chmod; wget", False),
    (dict(keywords=(r"a\*b",)), None, "a*b", True),
    (dict(keywords=(r"a\*b",)), None, "axb", False),
    (dict(keywords=("100%_",)), None, "at 100%_", True),
    (dict(keywords=("100%_",)), None, "at 100xx", False),
    (dict(keywords=("kiss",)), None, "\u212ais\u017f", True),
    (dict(regex="^pam"), "pam", "not at start pam", False),
    (dict(regex="^pam"), "sudo", "pam first", True),
    (dict(regex="x*"), None, "nothing", False),
    (dict(keywords=("a",), require=(("b", "c"), ("d",))), None, "a c d", True),
    (dict(keywords=("a",), require=(("b", "c"), ("d",))), None, "a c", False),
    (dict(keywords=("a",), exclude=("z",)), "z", "a", False),
    (dict(regex="a", exclude=("z",)), "z", "a", False),
]


def test_keyword_truth_table(spark):
    for fields, service, message, counts in TRUTH:
        rule = Keyword(id="K", **fields)
        rows = [event(1, 0, message=message, service=service)]
        assert bool(found(spark, rows, rule)) == counts, (fields, message)
        if "keywords" in fields:
            assert D.scan_keywords(frame(spark, rows), [rule]).count() == counts


def test_keyword_spans(spark):
    rule = Keyword(id="K", keywords=("ab", "sudo"), require=(("bc",),))
    rows = [event(1, 0, message="\U0001f600 abc and AB sudo", service="sudo"), event(2, 0, message="bc", service="sudo")]
    spans = {r.event_id: [(s.start, s.end) for s in r.spans] for r in D.detect(frame(spark, rows), rule).collect()}
    assert spans == {1: [(2, 5), (10, 12), (13, 17)], 2: [(0, 2)]}


def test_scan_of_many_rules_misses_nothing(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gam*ma", "delta", "eps"]
    rows = [event(i, i, message=" ".join(rng.choice(("alpha", "Beta", "gam ma", "delt", "eps", "x")) for _ in range(4))) for i in range(60)]
    rules = [Keyword(id=w, keywords=(w,), exclude=("delta",) if w == "eps" else ()) for w in words]
    events = frame(spark, rows)
    one = {(r.event_id, r.rule_id) for r in D.scan_keywords(events, rules).collect()}
    assert one == {(r.event_id, rule.id) for rule in rules for r in D.detect(events, rule).collect()}


def test_life_of_alerts(spark):
    rule = threshold(summary="{key}: {count} in {seconds} s, limit {threshold}, {{ok}}", author="me")
    old_rows, new_rows = at(0, 1, 2, 3, 4, ip="192.0.2.9"), at(0, 1, 2, 3, 4, ip="192.0.2.9") + [event(6, 5, ip="192.0.2.9")] + [event(10 + i, i, ip="192.0.2.8") for i in range(5)]
    old, _ = A.evaluate(frame(spark, old_rows), [rule])
    new, evidence = A.evaluate(frame(spark, new_rows), [rule])
    assert {r.summary for r in old.collect()} == {"192.0.2.9: 5 in 4 s, limit 5, {ok}"}
    assert {r.alert_key: r.status for r in A.reconcile(old, new).collect()} == {"T:192.0.2.9:1": "updated", "T:192.0.2.8:10": "created"}
    assert A.reconcile_counts(A.reconcile(new, new)).first().asDict() == {"created": 0, "updated": 0, "removed": 0, "unchanged": 2, "total": 2}
    assert A.reconcile_counts(A.reconcile(new, old)).first().removed == 1
    assert A.with_rule_author(new, [rule]).first().author == "me"
    assert A.drop_orphans(new, []).count() == 0
    marks = A.with_highlights(frame(spark, new_rows), evidence, new).where("id = 6").first().highlights
    assert [(m.alert_key, m.start) for m in marks] == [("T:192.0.2.9:1", None)]
    for margin in (None, 2, 5000):
        spread = [event(100 + k, k * 37 - 3000, ip="192.0.2.7") for k in range(200)]
        bounds = {r.alert_key: (r.first_seen, r.last_seen) for r in new.collect()}
        extra = {k: timedelta(seconds=margin if margin is not None else max(60, (b - a).total_seconds() / 4)) for k, (a, b) in bounds.items()}
        want = {(k, r[0]) for k, (a, b) in bounds.items() for r in new_rows + spread if a - extra[k] <= r[1].replace(tzinfo=None) < b + extra[k] + timedelta(seconds=1)}
        got = A.events_around(new, frame(spark, new_rows + spread), margin).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want) > 10
    assert A.events_around(new.limit(0), frame(spark, new_rows)).collect() == []


def test_days_do_not_cut_islands(spark):
    rule = threshold(threshold=2, window_seconds=86_400 * 3, cooldown_seconds=86_400 * 3)
    rows = at(0, 86_400 * 2, 86_400 * 5 - 1, 86_400 * 9)
    for spread in (True, False):
        evidence = D.detect(frame(spark, rows), rule, spread)
        assert sorted(r.event_id for r in evidence.collect()) == [1, 2, 3]
