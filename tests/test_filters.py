"""Allow-lists against the address library, and contexts of alerts against a plain count."""

import ipaddress
import random

from pyspark.sql import functions as F
from support import event, frame

from palisade.operators import alerts as A
from palisade.operators import filters as P

ODD = ["", "x", ":", "::", "1::", "::1", ":::", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8::", "::ffff:192.0.2.7", "::ffff:192.0.2.777", "2001:DB8::A", "fe80::1%eth0", "fe80::1%", "fe80::1%a%b", "12345::", "g::", "192.0.2.7", "192.0.2.07", "192.0.2", "1.2.3.4.5", "0.0.0.0", "255.255.255.255", "::192.0.2.1", "1:192.0.2.1", " ::1", "::1 ", None]


def plain(text, nets):
    try:
        address = ipaddress.ip_address(text or "")
    except ValueError:
        return True
    return not any(address.version == n.version and address in n for n in nets)


def test_spellings_of_addresses(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "a string").select("a", P.ip6_digits(F.col("a")).alias("six"), P.ip4_digits(F.col("a")).alias("four")).collect()
    for r in rows:
        try:
            address = ipaddress.ip_address(r.a or "")
        except ValueError:
            assert (r.six, r.four) == (None, None), r.a
        else:
            assert (r.six if address.version == 6 else r.four) == address.packed.hex(), r.a


def test_nets_of_any_number(spark):
    rng = random.Random(4)
    nets = [f"{rng.randint(1, 223)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.0/{rng.randint(18, 30)}" for _ in range(3000)]
    nets += [f"2001:{rng.randint(0, 65535):x}:{rng.randint(0, 65535):x}::/{rng.randint(30, 64)}" for _ in range(3000)]
    parsed = [ipaddress.ip_network(n, strict=False) for n in nets]
    near = [str(n[0] + rng.choice((-1, 0, 1, n.num_addresses - 1, n.num_addresses))) for n in parsed if n.version == 6 or 0 < int(n[0]) < 2**31] + ODD
    got = spark.createDataFrame([(t,) for t in near], "a string").select("a", P.not_allowlisted(F.col("a"), nets).alias("stays")).collect()
    by_version = {v: sorted(((int(n[0]), int(n[-1])) for n in parsed if n.version == v)) for v in (4, 6)}
    for r in got:
        try:
            address = ipaddress.ip_address(r.a or "")
        except ValueError:
            assert r.stays, r.a
        else:
            assert r.stays == (not any(a <= int(address) <= b for a, b in by_version[address.version])), r.a
    few, many = (len(str(P.not_allowlisted(F.col("a"), n)._jc.toString()).split("lambda")) for n in (nets[:1030], nets[:1999]))
    assert few == many
    for small in ([], ["0.0.0.0/0"], ["::/0"], ["192.0.2.7"], ["192.0.2.6/31", "192.0.2.7/32", "2001:db8::/32"]):
        own = [ipaddress.ip_network(n) for n in small]
        rows = spark.createDataFrame([(t,) for t in ODD], "a string").select("a", P.not_allowlisted(F.col("a"), small).alias("stays")).collect()
        assert all(r.stays == plain(r.a, own) for r in rows)


def test_context_counts(spark):
    rng = random.Random(9)
    rows = [event(k, rng.choice((rng.randint(0, 9000), 600, 1200, 4000)) + rng.choice((0, 0.5))) for k in range(300)]
    events = frame(spark, rows)
    spans = [(f"a{k}", *sorted(rng.sample([0, 1, 599, 600, 1200, 2400, 5000, 9000, 50_000], 2))) for k in range(30)]
    t0 = min(r[1] for r in rows).replace(hour=0, minute=0, second=0, microsecond=0)
    alerts = spark.createDataFrame(spans, "alert_key string, a int, b int").select("alert_key", *[F.timestamp_seconds(F.lit(int(t0.timestamp())) + F.col(c)).alias(n) for c, n in (("a", "first_seen"), ("b", "last_seen"))])
    for fixed in (None, 60):
        got = {r.alert_key: (r.n_events, r.first_id, r.last_id) for r in A.context_counts(alerts, events, fixed).collect()}
        pairs = {}
        for r in A.events_around(alerts, events, fixed).collect():
            pairs.setdefault(r.alert_key, []).append(r.id)
        order = {r[0]: (r[1], r[0]) for r in rows}
        want = {a: (len(pairs.get(a, [])), min(pairs[a], key=order.get) if a in pairs else None, max(pairs[a], key=order.get) if a in pairs else None) for a, *_ in spans}
        assert got == want and (None, None) in {v[1:] for v in want.values()} and len(got) == 30
    assert A.context_counts(alerts.limit(0), events).collect() == []
    assert {r.n_events for r in A.context_counts(alerts, events.limit(0)).collect()} == {0}
    plan = A.context_counts(alerts, events)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
