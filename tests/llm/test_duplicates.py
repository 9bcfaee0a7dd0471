import random

import numpy as np
import xxhash
from tests.llm import brute

from palisade.llm import graph, simhash, suffixes
from palisade.llm.common import table

SF = "/root/testdata/sf0.001"


def components(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def plain_fingerprint(text):
    words = brute.WORD.findall(brute.low(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    tops = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {}
    for (doc_id, _), top in zip(rows, tops):
        if doc_id is not None:
            least[top] = min(doc_id, least.get(top, doc_id))
    return [(doc_id, fp, least.get(top)) for (doc_id, _), fp, top in zip(rows, fps, tops)]


def test_groups_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    rows += [(900, None), (901, ""), (902, "  \n"), (903, "One two"), (904, "one TWO"), (903, "One two"), (None, "alone and without an id"), (905, "a b c d e f g" * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS fp", "'x' AS root")
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicate_groups(df).collect()]
    assert sorted(got, key=str) == sorted(plain_groups(rows), key=str)
    assert simhash.near_duplicate_groups(df.limit(0)).collect() == []


def test_sharded_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 1200, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(0, 5)))) for b in np.concatenate((np.repeat(base[:150], 4), np.repeat(base[:1], 500)))]
    fps = np.unique(np.concatenate((base, np.array(near, np.uint64))))
    at = {int(f): k for k, f in enumerate(fps)}
    for radius in (2, 4, 7):
        links = []
        for mask in simhash.block_masks(radius):
            tree = simhash.Tree(fps[::3], mask, 5)
            index, leaf, guest = tree.route(fps)
            assert sorted(index[~guest]) == list(range(len(fps)))
            for one in np.unique(leaf):
                here = leaf == one
                for a, b in simhash.shard_links(fps[index[here & ~guest]], fps[index[here & guest]], np.uint64(mask), radius):
                    assert (np.bitwise_count(a ^ b) <= radius).all()
                    links += [(at[int(x)], at[int(y)]) for x, y in zip(a, b)]
        every = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)
        assert components(len(fps), links) == components(len(fps), every.tolist())


def test_components_of_chains_stars_and_repeats(spark):
    rng = random.Random(2)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(0, k) for k in range(1, 60)] + [(200, 200), (201, 202), (202, 201)]
    pairs += [(rng.randint(300, 500), rng.randint(300, 500)) for _ in range(90)]
    df = spark.createDataFrame([*pairs, (None, 7)], "a long, b long")
    roots = {r.node: r.root for r in graph.connected_components(df).collect()}
    want = components(600, pairs)
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert set(roots) == touched
    for a in touched:
        for b in touched:
            if a < b:
                assert (roots[a] == roots[b]) == (want[a] == want[b])
    assert graph.connected_components(df.limit(0)).collect() == []


def test_one_of_each_group_stays(spark):
    copy = "the same words in every copy"
    rows = [(5, copy), (3, copy), (3, copy), (8, "something else entirely here"), (None, "no id"), (None, "no id"), (None, copy), (11, "two texts of"), (13, "two texts of"), (13, "one id, and this one is alone"), (14, None), (15, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS component_id", "1 AS node", "2 AS k1")
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    want = [(3, copy), (8, "something else entirely here"), (None, "no id"), (11, "two texts of"), (13, "one id, and this one is alone"), (14, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert simhash.keep_one_of_each(df.limit(0)).collect() == []


def repeating_texts():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(200)]
    passage = " ".join(rng.choice(words) for _ in range(90))
    out = []
    for _ in range(70):
        text, kind = " ".join(rng.choice(words) for _ in range(rng.randint(5, 90))), rng.random()
        if kind < 0.5:
            cut, a = rng.randint(0, len(text)), rng.randint(0, 40)
            text = text[:cut] + passage[a : len(passage) - rng.randint(0, 40)] + text[cut:]
        elif kind < 0.6:
            text = "ab" * rng.randint(90, 300)
        elif kind < 0.7:
            text = "z" * rng.randint(150, 700)
        elif kind < 0.8 and out:
            text = out[-1]
        out.append(text)
    return out + [None, "", "short", out[3], out[3]]


def test_removed_bytes_equal_brute_force(spark, monkeypatch):
    texts = repeating_texts()
    ids = [*range(len(texts) - 2), 3, None]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").selectExpr("*", "1 AS k1", "2 AS found")
    want = sorted([(i, *w) for i, w in zip(ids, brute.repeats(texts, 200))], key=str)
    for most in (2000, 3):  # the second number makes most keys very frequent ones
        monkeypatch.setattr(suffixes, "HOT_RUNS", most)
        assert sorted([tuple(r)[:5] for r in suffixes.remove_repeats(df).collect()], key=str) == want
    assert suffixes.remove_repeats(df.limit(0)).collect() == []


def test_runs_of_long_texts_cover_every_window_once():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 101, 2 * suffixes.CHUNK_BYTES + 5000, dtype=np.uint8).tobytes()
    covered = np.zeros(len(text) - 199, int)
    windows = suffixes.Windows(200)
    for data, starts, stops, parts in suffixes._buffers([b"x" * 50, text], 200):
        at, n, _, _ = windows.of(data, starts, stops)
        which = np.searchsorted(starts, at, side="right") - 1
        for a, m, w in zip(at, n, which):
            first = a - starts[w] + parts[w][1]
            covered[first : first + m] += 1
    assert (covered == 1).all()


def test_refinement_of_random_pieces():
    rng = random.Random(4)
    pieces = ["".join(rng.choice("ab") for _ in range(rng.randint(12, 60))).encode() for _ in range(40)]
    from collections import Counter

    seen = Counter(p[k : k + 12] for p in pieces for k in range(len(p) - 11))
    for piece, buckets in zip(pieces, suffixes.refine(pieces, 12)):
        assert (buckets >= 0).tolist() == [seen[piece[k : k + 12]] > 1 for k in range(len(piece) - 11)]


def plain_similar(rows):
    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets = [shingles(t) for _, t in rows]
    tops = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])
    least = {}
    for (doc_id, _), top in zip(rows, tops):
        least[top] = min(doc_id, least.get(top, doc_id))
    return {doc_id: least[top] for (doc_id, _), top in zip(rows, tops)}


def test_similar_groups_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    n = 1000
    for size in (30, 60, 200):
        for copies in (3, 40):
            base = [f"w{rng.randrange(5000)}" for _ in range(size)]
            for k in range(copies):
                words = list(base)
                for at in rng.sample(range(size), min(k, rng.randrange(1 + size // 30))):
                    words[at] = f"new{rng.randrange(5000)}"
                rows.append((n := n + 1, " ".join(words)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO"), (905, "one two three four five"), (906, "one two three four six")]
    long = " ".join(f"v{k}" for k in range(60_000))
    rows += [(907, long), (908, long + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    want = plain_similar(rows)
    assert got == want
    far = {d for d, _, c in plain_groups([r for r in rows if r[0] >= 1000]) if c == d}
    assert any(want[d] != d for d in far)  # near copies beyond four bits
    kept = simhash.keep_one_of_each(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.similar_groups(df.limit(0)).collect() == []


def test_similar_groups_go_through_the_trees_and_lose_no_link(spark, monkeypatch):
    met, real = [], simhash.fingerprint_links
    monkeypatch.setattr(simhash, "fingerprint_links", lambda nodes, radius: met.append((nodes.count(), radius)) or real(nodes, radius))
    rng = random.Random(3)
    rows = []
    for k in range(12):
        words = [f"w{rng.randint(0, 400)}" for _ in range(120)]
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join([*words, "end"])), (3 * k + 2, " ".join([*words[:60], "other", *words[61:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    assert got == plain_similar(rows) and met == [(len({simhash._majority(simhash._shingles(t.encode(), 5)[1]) for _, t in rows}), 4)]
