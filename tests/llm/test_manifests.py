"""Merkle manifests, shards and importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from palisade.llm import merkle, order, resample, sharding
from palisade.llm.common import Tables

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 200_000
EDGES = [
    (1, "one", "en", "a", 3),
    (1, "one", "en", "a", 3),
    (1, "other", "en", "a", 5),
    (None, None, None, None, None),
    (None, "", "", "", 0),
    (2, LONG, "en", "a", len(LONG)),
    (7, "é漢\U0001f600", "de", "a", 3),
    (29, "x", "é", None, None),
    *[(k, f"text {k}", "fr", "hot", k) for k in range(100, 170)],
]


def frame(spark, rows=EDGES):
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS grp", "1 AS leaf", "2 AS place", "3 AS digest", "4 AS item", "5 AS steps", "6 AS part", "7 AS start")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    doc_id, text, lang, source, n_chars = row
    said = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join(said))


def plain_tree(hashes, arity):
    """(root, steps of each leaf)."""
    steps, of, level = [[] for _ in hashes], [[k] for k in range(len(hashes))], list(hashes)
    while len(level) > 1:
        above, above_of = [], []
        for a in range(0, len(level), arity):
            run = level[a : a + arity]
            for i in range(len(run)):
                for k in of[a + i]:
                    steps[k].append(("".join(run[:i]), "".join(run[i + 1 :])))
            above.append(sha("".join(run)))
            above_of.append(sum(of[a : a + arity], []))
        level, of = above, above_of
    return level[0], steps


def plain_checked(rows, arity=2):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
    trees = {g: plain_tree([plain_leaf(r) for r in groups[g]], arity) for g in names}
    root, tops = plain_tree([trees[g][0] for g in names], arity)
    out = []
    for g, top in zip(names, tops, strict=True):
        for r, low in zip(groups[g], trees[g][1], strict=True):
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = plain_leaf((*r[:4], r[4] + 1) if hit else r)
            for before, after in low + top:
                folded = sha(before + folded + after)
            out.append((str(r[0]), plain_leaf(r), trees[g][0], root, sha("".join(a + b for a, b in low + top)), folded, folded == root))
    return sorted(out)


def test_merkle_equals_plain_trees(spark):
    got = sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in merkle.checked(frame(spark)).collect())
    want = plain_checked(EDGES)
    assert got == want
    assert {v for *_, v in want} == {True, False}
    assert merkle.checked(frame(spark).limit(0)).collect() == []
    one = merkle.checked(frame(spark, EDGES[:1])).collect()
    assert [(r.leaf, r.root, r.proof_sha256) for r in one] == [(plain_leaf(EDGES[0]), plain_leaf(EDGES[0]), sha(""))]


def test_merkle_of_other_arity_and_a_proof_by_hand(spark):
    rows = merkle.manifest(frame(spark), arity=3).collect()
    want = plain_checked(EDGES, 3)
    assert {r.root for r in rows} == {want[0][3]}
    assert sorted(hashlib.sha256("".join(s.before + s.after for s in r.steps).encode()).hexdigest() for r in rows) == sorted(w[4] for w in want)
    for r in rows:
        at = r.leaf
        for s in r.steps:
            at = sha(s.before + at + s.after)
        assert at == r.root


def test_merkle_levels_share_a_shuffle(spark):
    nodes = spark.range(100).selectExpr("concat('g', id % 2) AS grp", "id DIV 2 AS place", "50L AS n", "sha2(string(id), 256) AS hash", "id AS item")
    plan = merkle.block_of(nodes, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Window [collect_list") == merkle.LEVELS


def test_merkle_differences(spark):
    docs = frame(spark)
    known = merkle.manifest(docs)
    assert merkle.differences(docs, known).collect() == []
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 7, "new").otherwise(F.col("text"))).where("doc_id IS NULL OR doc_id <> 29").unionByName(docs.where("doc_id = 100"))
    told = sorted((str(r.doc_id), r.in_docs, r.in_manifest) for r in merkle.differences(changed, known).collect())
    assert told == [("100", 2, 1), ("29", 0, 1), ("7", 0, 1), ("7", 1, 0)]


def test_places_of_a_hot_group_and_of_equal_rows(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 'a', 'hot') AS g", "if(id % 2 = 0, 5L, id) AS k", "1L AS size")
    got = order.placed(rows, ["k"], Tables(), group="g", size="size").collect()
    for g, n in (("a", 1000), ("hot", 2000)):
        mine = sorted((r.place, r.k) for r in got if r.g == g)
        assert [p for p, _ in mine] == list(range(n)) and [k for _, k in mine] == sorted(k for _, k in mine)
        assert {r.among for r in got if r.g == g} == {n}
        assert sorted(r.start for r in got if r.g == g) == list(range(n))


def plain_shards(rows, shards):
    """By one loop: documents in order, each cut at the nearer edge of what its target falls into."""
    sized = [(hashlib.md5((r[1] or "").encode()).hexdigest(), r[0], len((r[1] or "").encode()) + 1) for r in rows]
    sized.sort(key=lambda x: (x[0], x[1] is not None, x[1] or 0))
    total, largest, at, spans, groups = sum(x[2] for x in sized), max(x[2] for x in sized), 0, [], {}
    for d, _, n in sized:
        spans.append((at, n, d))
        lo, size = groups.get(d, (at, 0))
        groups[d] = (lo, size + n)
        at += n
    cuts = []
    for k in range(1, shards):
        t = k * total // shards
        lo, n, d = next(s for s in spans if s[0] <= t < s[0] + s[1])
        if groups[d][1] <= largest:
            lo, n = groups[d]
        cuts.append(lo if t - lo <= lo + n - t else lo + n)
    out, slots = [], Counter()
    for (d, doc_id, n), (start, *_) in zip(sized, spans, strict=True):
        shard = sum(c <= start for c in cuts)
        out.append((str(doc_id), n, shard, slots[shard]))
        slots[shard] += 1
    return sorted(out)


@pytest.mark.parametrize("shards", [1, 3, 8, 200])
def test_shards_equal_a_plain_loop(spark, shards):
    got = sharding.shard_documents(frame(spark), shards).collect()
    assert sorted((str(r.doc_id), r.size, r.shard, r.slot) for r in got) == plain_shards(EDGES, shards)
    texts = {str(r[0]): r[1] or "" for r in EDGES}
    assert all(r.text_crc32 == zlib.crc32(texts[str(r.doc_id)].encode()) for r in got if str(r.doc_id) not in ("1", "None"))
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_shards_are_near_equal_whatever_the_copies(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('copy ', 40) WHEN id % 50 = 1 THEN concat('twin ', id DIV 100) ELSE repeat(concat('w', id, ' '), cast(id % 37 AS int)) END AS text")
    sharded = sharding.shard_documents(docs)
    rows = sharded.collect()
    sizes, largest = Counter(), max(r.size for r in rows)
    for r in rows:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    # A group is cut only where it is larger than any document.
    held, bytes_of = defaultdict(set), Counter()
    for r in rows:
        held[r.text_crc32].add(r.shard)
        bytes_of[r.text_crc32] += r.size
    assert all(len(v) == 1 for k, v in held.items() if bytes_of[k] <= largest)
    told = {r.shard: (r.documents, r.bytes) for r in sharding.shard_sizes(sharded).collect()}
    assert told == {s: (sum(r.shard == s for r in rows), sizes[s]) for s in range(8)}
    assert sharding.shard_documents(docs.limit(0)).collect() == []
    assert [r.bytes for r in sharding.shard_sizes(sharding.shard_documents(docs.limit(0))).collect()] == [0] * 8


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_resample(rows, target, longest=1, buckets=10_000, percent=10):
    def features(text):
        w = plain_words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for r in rows:
        s.update(features(r[1]))
    for text in target:
        t.update(features(text))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    scored = []
    for r in rows:
        f = features(r[1])
        h = int(sha(f"2024:{'' if r[0] is None else r[0]}")[:8], 16)
        weight = sum(gain[b] for b in f)
        scored.append((r[0], len(plain_words(r[1])), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((x for x in scored if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = [(x, k + 1) for k, x in enumerate(fit[: percent * len(fit) // 100])]
    ranked = Counter({(x, k): 1 for x, k in drawn})
    rest = Counter(scored) - Counter(x for x, _ in drawn)
    return sorted([(str(x[0]), *x[2:], k) for x, k in ranked] + [(str(x[0]), *x[2:], None) for x in rest.elements()], key=str)


def got_rows(df):
    return sorted(((str(r.doc_id), r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


WORDY = [(k, f"Alpha bêta {k} _ALPHAİ {'gamma 漢 ' * (k % 23)}\x00 x\x7fy" + " z" * 20, "en", "a", 1) for k in range(150)]


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (3, 50)])
def test_resampling_equals_plain_python(spark, longest, buckets):
    rows, target = [*EDGES, *WORDY], ["Alpha x", None, "", "gamma gamma z"]
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(frame(spark, rows), wanted, longest=longest, buckets=buckets)
    assert got_rows(got) == plain_resample(rows, target, longest, buckets)


def test_resampling_edges(spark, monkeypatch):
    empty = spark.createDataFrame([], "text string")
    assert got_rows(resample.resample(frame(spark), empty)) == plain_resample(EDGES, [])
    assert resample.resample(frame(spark).limit(0), empty).collect() == []
    # Any cut into lots gives the same counts.
    rows = frame(spark, WORDY).select(F.col("doc_id").alias("id"), "text")
    whole = sorted(resample.bucket_counts(rows).collect())
    monkeypatch.setattr(resample, "MOST_BYTES", 300)
    assert sorted(resample.bucket_counts(rows).collect()) == whole


def test_resampling_draws_what_is_like_the_target(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "repeat(if(id % 10 = 0, 'law court judge ', 'fish chips peas '), 10) AS text")
    target = spark.createDataFrame([("the court and the judge of law",)], "text string")
    drawn = resample.resample(docs, target).where("rank IS NOT NULL").collect()
    assert sorted(r["rank"] for r in drawn) == list(range(1, 201))
    assert all(r.doc_id % 10 == 0 for r in drawn)
