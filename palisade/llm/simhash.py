"""SimHash near-duplicate groups over shards of vantage-point trees.

Every text gets a 64-bit SimHash of its word shingles. Equal fingerprints are one
node. Links between nodes at most ``radius`` bits apart are found exactly:

* The fingerprint's bits are cut into ``radius // 2 + 1`` blocks, so two linked
  fingerprints differ by at most one bit in some block. (Distances between whole
  64-bit fingerprints pile up around 32, where a ball of radius 4 overlaps two
  thirds of every shell; on a block with radius 1 the bounds do prune.)
* Each block has a vantage-point tree, fitted on a bounded sample: a node splits
  by the Hamming distance to its vantage point at the median. A fingerprint lives
  in one leaf (shard). Where the triangle bound cannot rule the other side out, it
  is sent there as a guest; a pair meets in the leaf of one of the two.
* In a shard the same split goes on in memory until the sides are small; balls
  with many members are linked to their centre instead of pair by pair.

The sample shapes the shards only; links never depend on it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import Tables, slices, written
from palisade.llm.graph import connected_components

SEED = 42
CHUNK_BYTES = 1 << 20
#: Fingerprints at most that shape the trees, whatever the number of documents.
TREE_SAMPLE = 20_000
#: Residents of a shard aimed at, and the most splits on the way to one.
LEAF_SIZE, MOST_DEPTH = 256, 14
BRUTE = 48
DENSE = 32
#: One of so many documents has its shingles counted to put frequent ones last; the most that are told apart.
SAMPLE_SHARE, MOST_FREQUENT = 8, 400_000
#: Pairs up to which the ids of their documents (16 bytes each) are broadcast.
MOST_BROADCAST = 1_000_000
#: Stands for a null doc_id.
NO_ID = -(2**63)


def fingerprint(text: bytes, words_per_shingle: int = 4) -> int:
    """SimHash of one text: a bit is 1 if set in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-words_per_shingle])).tolist()
    stops = (ends[words_per_shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some hashes; 0 of none."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words_per_shingle: int = 4) -> DataFrame:
    """(doc_id, fp long) for each row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1), CHUNK_BYTES):
                fps = np.array([fingerprint(t, words_per_shingle) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def block_masks(radius: int) -> list[int]:
    """Masks of blocks of which some one differs by at most one bit."""
    n = min(64, radius // 2 + 1)
    edges = [round(64 * k / n) for k in range(n + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]


class Tree:
    """Vantage points and radii in heap order; a node without a vantage point is a leaf."""

    def __init__(self, sample: np.ndarray, mask: int, depth: int):
        self.mask = np.uint64(mask)
        nodes = 2**depth - 1
        self.vantage, self.middle, self.split = np.zeros(nodes, np.uint64), np.zeros(nodes, np.int64), np.zeros(nodes, bool)
        held = {0: sample}
        for node in range(nodes):
            here = held.pop(node, sample[:0])
            if len(here) < 8:
                continue
            point = here[len(here) // 2]
            far = np.bitwise_count((here ^ point) & self.mask).astype(np.int64)
            middle = int(np.sort(far)[(len(far) - 1) // 2])
            inner = far <= middle
            if inner.all():
                continue
            self.vantage[node], self.middle[node], self.split[node] = point, middle, True
            held[2 * node + 1], held[2 * node + 2] = here[inner], here[~inner]

    def route(self, fps: np.ndarray, reach: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into fps, leaf, guest) of every shard that a fingerprint must visit."""
        index, node, guest = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.zeros(len(fps), bool)
        done = []
        while len(index):
            inside = node < len(self.split)
            inside[inside] = self.split[node[inside]]
            done.append((index[~inside], node[~inside], guest[~inside]))
            index, node, guest = index[inside], node[inside], guest[inside]
            far = np.bitwise_count((fps[index] ^ self.vantage[node]) & self.mask).astype(np.int64)
            middle = self.middle[node]
            home_in, home_out = ~guest & (far <= middle), ~guest & (far > middle)
            to_in = (far <= middle + reach) & (guest | home_out)
            to_out = guest & (far > middle - reach)
            moves = ((home_in, 1, False), (home_out, 2, False), (to_in, 1, True), (to_out, 2, True))
            index, node, guest = (
                np.concatenate([index[m] for m, _, _ in moves]),
                np.concatenate([2 * node[m] + side for m, side, _ in moves]),
                np.concatenate([np.full(int(m.sum()), g) for m, _, g in moves]),
            )
        return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (index, node, guest)


def shard_links(home: np.ndarray, guests: np.ndarray, mask: np.uint64, radius: int, reach: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever is within radius of a resident, not every pair of them."""
    todo = [(home, guests)]
    while todo:
        here, there = todo.pop()
        if not len(here):
            continue
        point = here[len(here) // 2]
        everyone = np.concatenate((here, there))
        whole = np.bitwise_count(everyone ^ point)
        near = whole <= radius
        if int(near.sum()) > DENSE:
            yield np.full(int(near.sum()), point), everyone[near]
            near_here, near_there = near[: len(here)], near[len(here) :]
            close = whole <= 2 * radius
            yield from _attach(everyone[near], here[~near_here & close[: len(here)]], radius)
            yield from _attach(here[near_here], there[~near_there & close[len(here) :]], radius)
            todo.append((here[~near_here], there[~near_there]))
            continue
        if len(here) > BRUTE:
            far = np.bitwise_count((everyone ^ point) & mask).astype(np.int64)
            a, b = far[: len(here)], far[len(here) :]
            middle = int(np.sort(a)[(len(a) - 1) // 2])
            if a.max() > middle:
                inner = a <= middle
                todo.append((here[inner], np.concatenate((here[~inner & (a <= middle + reach)], there[b <= middle + reach]))))
                todo.append((here[~inner], there[b > middle - reach]))
                continue
        for k in range(0, len(here), BRUTE):
            rows = here[k : k + BRUTE]
            for c in range(0, len(everyone), 1 << 15):
                part = everyone[c : c + (1 << 15)]
                i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ part[None, :]) <= radius)
                yield rows[i], part[j]


def _attach(ball: np.ndarray, others: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """One link into a ball that is connected already for each other that has any."""
    for k in range(0, len(ball), 256):
        if not len(others):
            return
        hit = np.bitwise_count(others[:, None] ^ ball[None, k : k + 256]) <= radius
        found = hit.any(axis=1)
        yield others[found], ball[k : k + 256][hit[found].argmax(axis=1)]
        others = others[~found]


def fingerprint_links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """Distinct fingerprints (fp long) to links (a, b) with the components of all pairs within radius."""
    spark = nodes.sparkSession
    masks = block_masks(radius)
    count = nodes.count()
    depth = min(MOST_DEPTH, max(0, math.ceil(math.log2(max(1, count) / LEAF_SIZE))))
    sampled = nodes.orderBy(F.xxhash64("fp", F.lit(1))).limit(TREE_SAMPLE).toPandas() if depth else None
    sample = np.zeros(0, np.uint64) if sampled is None else sampled["fp"].to_numpy(np.int64).view(np.uint64)
    trees = [Tree(sample, m, depth) for m in masks]
    leaves = 2 ** (depth + 1)
    kept = spark.sparkContext.broadcast(trees)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(fps), 4096):
                part = fps[k : k + 4096]
                for t, tree in enumerate(kept.value):
                    index, leaf, guest = tree.route(part)
                    yield pa.RecordBatch.from_arrays([pa.array(leaf + t * leaves), pa.array(part[index].view(np.int64)), pa.array(guest)], ["shard", "fp", "guest"])

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        fps = np.concatenate([b.column("fp").to_numpy(zero_copy_only=False) for b in got]).view(np.uint64)
        guest = np.concatenate([b.column("guest").to_numpy(zero_copy_only=False) for b in got])
        mask = np.uint64(masks[key[0].as_py() // leaves])
        for a, b in shard_links(fps[~guest], fps[guest], mask, radius):
            other = a != b
            if other.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[other].view(np.int64)), pa.array(b[other].view(np.int64))], ["a", "b"])

    sent = nodes.select("fp").mapInArrow(send, "shard long, fp long, guest boolean")
    return sent.groupBy("shard").applyInArrow(meet, "a long, b long")


def near_duplicate_groups(docs: DataFrame, words_per_shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): documents linked by fingerprints within radius, transitively.

    component_id is the smallest doc_id of the group. Null texts count as empty,
    texts without words have fingerprint zero and link like any other; rows with a
    null doc_id take part but never name a group; repeated rows stay repeated. An
    empty table gives no rows; other columns are ignored.
    """
    hashed = written(fingerprints(docs, words_per_shingle), "simhash")
    nodes = written(hashed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    roots = connected_components(fingerprint_links(nodes, radius))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(groups, "root").select("fp", "component_id")
    return hashed.join(named, "fp").select("doc_id", "fp", "component_id")


def _whole(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), SEED + 1)


def _shingles(text: bytes, words_per_shingle: int) -> tuple[int, np.ndarray]:
    """A hash of the text's words, and the hashes of its different shingles (none without words)."""
    words = text.lower().split()
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    whole = _whole(words)
    if not words:
        return whole, np.zeros(0, np.uint64)
    if len(words) <= words_per_shingle:
        return whole, np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-words_per_shingle])).tolist()
    stops = (ends[words_per_shingle - 1 :] - 1).tolist()
    return whole, np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64))


def _frequent_shingles(docs: DataFrame, words_per_shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent shingles, sorted, and the place of each by rising frequency.

    Counted in a fixed share of the texts, so that the same number of documents makes a
    shingle frequent whatever the size of the corpus; what is kept has a bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch.column(0), CHUNK_BYTES):
                found = [_shingles(t, words_per_shingle)[1] for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["key"])

    sampled = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(SAMPLE_SHARE)) == 0).select("text").mapInArrow(run, "key long")
    found = sampled.groupBy("key").count().where("count >= 3").orderBy(F.desc("count"), "key").limit(MOST_FREQUENT).toPandas()
    keys = found["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], (len(keys) - np.arange(len(keys)))[order]


def _links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words_per_shingle: int, up: int, down: int, tables: Tables) -> DataFrame:
    """The candidate pairs (a, b) of nodes whose shingle sets are alike.

    First by their first shingles, which bound what two sets can share; the few pairs
    left by their whole sets, made anew from the texts. Small lists of nodes are
    broadcast (their number is counted), larger ones joined by a shuffle.
    """

    def ends_of(found: DataFrame) -> DataFrame:
        ends = found.select(F.col("a").alias("node")).union(found.select(F.col("b").alias("node"))).distinct()
        return F.broadcast(ends) if found.count() <= MOST_BROADCAST else ends

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1), CHUNK_BYTES):
                keys = [_shingles(t, words_per_shingle)[1].view(np.int64) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(keys, pa.list_(pa.int64()))], ["node", "keys"])

    pairs = tables.written(pairs, "similar-pairs")
    known = nodes.join(ends_of(pairs), "node", "left_semi").select("node", F.struct("size", F.struct("end_rank", "end_key").alias("end"), "prefix").alias("n"))
    known = tables.written(known, "similar-near")
    met = pairs.join(known.toDF("a", "x"), "a").join(known.toDF("b", "y"), "b")
    # Up to the nearer end of the two lists every shared shingle is in both; beyond it at most the rest of that set.
    beyond = F.when(F.col("x.end") <= F.col("y.end"), F.col("x.size") - F.size("x.prefix")).otherwise(F.col("y.size") - F.size("y.prefix"))
    most = F.size(F.array_intersect("x.prefix", "y.prefix")) + beyond
    plausible = tables.written(met.where(F.lit(up + down) * most >= F.lit(up) * (F.col("x.size") + F.col("y.size"))).select("a", "b"), "similar-plausible")
    wanted = nodes.join(ends_of(plausible), "node", "left_semi").select("node", F.col("row.k1").alias("k1"), F.col("row.k2").alias("k2"))
    if plausible.count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    texts = _keyed_texts(docs).join(wanted, ["k1", "k2"]).select("node", "text").mapInArrow(whole_sets, "node long, keys array<long>")
    sets = tables.written(texts.groupBy("node").agg(F.first("keys").alias("keys")), "similar-sets")
    both = plausible.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return tables.written(both.where(F.lit(up + down) * shared >= F.lit(up) * (F.size("x") + F.size("y"))).select("a", "b"), "similar-links")


def _keyed_texts(docs: DataFrame) -> DataFrame:
    """(k1, k2, text): rows told apart by doc_id (null: a value of its own) and a hash of the text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k1"), F.xxhash64("text").alias("k2"), "text")


def similar_nodes(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """(node, row, root) of each different text: texts linked by a Jaccard similarity of shingle sets, transitively.

    First the SimHash trees: sets whose fingerprints are linked within ``radius`` bits are
    compared exactly. Sets that similar can be further apart, so an exact way finds the rest:
    two of them share one of the first shingles of each in any order that
    holds for all documents, here rare ones first. A node is compared with
    one centre outside its component, of those of its shared shingles the one with the fewest rare shingles;
    then nodes that share a shingle and are in different components yet are compared
    pair by pair. The sample behind the order decides the work only, never the links.
    ``row`` is the first row (k1, k2) of the node, a null doc_id last.
    """
    share = Fraction(similarity).limit_denominator(1000)
    up, down = share.numerator, share.denominator
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent_shingles(docs, words_per_shingle))
    tables = Tables()

    def rank_of(keys: np.ndarray) -> np.ndarray:
        known, place = frequent.value
        if not len(known):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, place[at], 0)

    def first_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "node", "fp", "size", "rare", "end_rank", "end_key", "prefix"]
        for batch in batches:
            for first, texts in slices(batch.column(2), CHUNK_BYTES):
                numbers, prefixes = [], []
                for text in texts:
                    node, keys = _shingles(text, words_per_shingle)
                    rank, signed = rank_of(keys), keys.view(np.int64)
                    n = len(keys) - -(-up * len(keys) // down) + 1 if len(keys) else 0
                    chosen = np.lexsort((signed, rank))[:n]
                    prefixes.append(signed[chosen])
                    end = (rank[chosen[-1]], signed[chosen[-1]]) if n else (0, 0)
                    numbers.append((np.uint64(node).view(np.int64), np.uint64(_majority(keys)).view(np.int64), len(keys), int((rank == 0).sum()), *end))
                own = (batch.column(c).slice(first, len(texts)) for c in range(2))
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(np.array(c, np.int64)) for c in zip(*numbers, strict=True)), pa.array(prefixes, pa.list_(pa.int64()))], names)

    fields = "k1 long, k2 long, node long, fp long, size long, rare long, end_rank long, end_key long, prefix array<long>"
    first_row = F.min(F.struct((F.col("k1") == NO_ID).alias("nameless"), "k1", "k2")).alias("row")
    rows = _keyed_texts(docs).mapInArrow(first_shingles, fields)
    nodes = tables.written(rows.groupBy("node").agg(first_row, *(F.first(c).alias(c) for c in ("fp", "size", "rare", "end_rank", "end_key", "prefix"))), "similar-nodes")

    def possible(size_a: str, at_a: str, size_b: str, at_b: str) -> Column:
        """From these places on, enough can be shared; holds at the first shingle that a similar pair shares."""
        return F.expr(f"{up + down} * least({size_a} - {at_a}, {size_b} - {at_b}) >= {up} * ({size_a} + {size_b})")

    def pair(a: str, b: str) -> tuple[Column, Column]:
        return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")

    def links(pairs: DataFrame) -> DataFrame:
        return _links(pairs.distinct(), nodes, docs, words_per_shingle, up, down, tables)

    heads = tables.written(nodes.groupBy("fp").agg(F.min("node").alias("head")), "similar-heads")
    met = fingerprint_links(heads.select("fp"), radius).join(heads.toDF("a", "head_a"), "a").join(heads.toDF("b", "head_b"), "b")
    near = met.select(*pair("head_a", "head_b")).union(nodes.join(heads, "fp").where("node <> head").select(*pair("node", "head")))
    near = links(near)
    trees = connected_components(near).toDF("node", "tree")

    keyed = nodes.select("node", F.posexplode("prefix").alias("at", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("held")).where("held > 1").select("key")
    placed = nodes.select("node", "size", "rare").join(trees, "node", "left").withColumn("tree", F.coalesce("tree", "node"))
    held = tables.written(keyed.join(shared, "key").join(placed, "node"), "similar-held")
    centres = held.groupBy("key").agg(F.min(F.struct("rare", "node", "size", "at", "tree")).alias("best"))
    stars = held.join(centres, "key").where("tree <> best.tree").where(possible("size", "at", "best.size", "best.at"))
    stars = stars.groupBy("node").agg(F.min("best").alias("best")).select(*pair("node", "best.node"))
    roots = connected_components(near.unionByName(links(stars)))
    rooted = tables.written(held.join(roots, "node", "left").select("key", "node", "size", "at", F.coalesce("root", "node").alias("root")), "similar-rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    left = tables.written(rooted.join(mixed, "key"), "similar-left")
    other = left.toDF("key", "node_b", "size_b", "at_b", "root_b")
    rest = left.join(other, "key").where("node < node_b AND root <> root_b").where(possible("size", "at", "size_b", "at_b"))
    more = links(rest.select(*pair("node", "node_b")))
    for end in ("a", "b"):
        more = more.join(roots.toDF(end, f"root_{end}"), end, "left").withColumn(end, F.coalesce(f"root_{end}", end))
    last = connected_components(more.select("a", "b")).toDF("root", "last")
    rooted = nodes.join(roots, "node", "left").select("node", "row", F.coalesce("root", "node").alias("root"))
    out = written(rooted.join(last, "root", "left").select("node", "row", F.coalesce("last", "root").alias("root")), "similar-roots")
    tables.drop()
    return out


def similar_groups(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) per row of docs: the smallest doc_id of the documents linked by similarity, transitively.

    Texts of equal words (by 64 bits of hash) are alike, and so are null texts and
    texts without words. A component of null doc_ids only has a null id. Whole texts,
    very long ones too; repeated rows stay repeated; an empty table gives no rows.
    """
    rooted = similar_nodes(docs, words_per_shingle, similarity)
    heads = rooted.groupBy("root").agg(F.min("row").alias("head"))
    named = rooted.join(heads, "root").select("node", F.nullif(F.col("head.k1"), F.lit(NO_ID)).alias("component_id"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1), CHUNK_BYTES):
                nodes = np.array([_whole(t.lower().split()) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(nodes)], ["doc_id", "node"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(whole, "doc_id long, node long")
    return rows.join(named, "node").select("doc_id", "component_id")


def keep_one_of_each(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stay: one of each group of similar_groups.

    It is the row with the smallest doc_id, a null one last, then the smallest hash of
    the text; of repeated rows with one doc_id and text, any one. Other columns are
    kept, whatever their names.
    """
    rooted = similar_nodes(docs, words_per_shingle, similarity)
    heads = rooted.groupBy("root").agg(F.min("row").alias("head")).select(F.col("head.k1").alias("k1"), F.col("head.k2").alias("k2"))
    keyed = docs.select(F.struct(*docs.columns).alias("document"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k1"), F.xxhash64("text").alias("k2"))
    kept = keyed.join(heads.hint("merge"), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return kept.select("document.*")
