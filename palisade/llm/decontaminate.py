"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

1. Word shingles of documents are matched to those of the items. In a window similar
   enough to an item at most (1 - s) / (1 + s) of the shingles are strangers to it, so
   some shingle at a multiple of STRIDE is shared, and only windows over such a match
   are made: this loses nothing. (The stride is 1 where windows are too short for that.)
2. Each such window of an item's number of words gets a SimHash of its shingles.
3. Multi-index blocks: fingerprints within RADIUS bits agree on at least one of
   RADIUS + 1 blocks of 10 bits or more, so joining on (window size, block, value)
   finds every pair within the radius.
4. Windows of similarity 0.8 have fingerprints 9.7 bits apart on average, so the blocks
   alone would miss many. The exact way for the rest: a window that similar holds one
   of the item's first (1 - s) m + 1 shingles in any order, here the rarest among the
   items first, and s m places with a shingle of the item.
5. The pairs of 3 and 4 are verified by the exact similarity of their weighted shingles
   (sum of smaller over sum of larger counts), which must reach ``similarity``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import Tables, written

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 5
STRIDE = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of the items' tables up to which they are broadcast; more go through shuffled joins.
MOST_BROADCAST = 400_000
#: Counters of a fingerprint's bits: three of 21 bits to a long, so items may have 2**21 - 1 words.
LANE, LANES = 21, 3
NO_ID = -(2**63)
#: Window starts of a piece of a stretch.
PIECE = 128


def words_of(text: Column) -> Column:
    """Words between ASCII blanks, A-Z lower-cased; none for a null."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, r"[\x20\x09-\x0D]+", -1), "")


def shingles(words: Column, size: int | Column, step: int | Column = 1) -> Column:
    """Hash of the shingle at each ``step``-th word; of the whole sequence where it is shorter."""
    size, step = (F.lit(x) if isinstance(x, int) else x for x in (size, step))
    last = F.greatest(F.size(words) - size, F.lit(0))
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), last, step), lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, size), " ")))).otherwise(F.expr("CAST(array() AS array<bigint>)"))


def fingerprint_lanes(shingle: Column) -> list[Column]:
    """Sums, over a window's rows, of the shingles' bits, three counters to a long; bit 63 has its own."""
    mask = sum(1 << (LANE * j) for j in range(LANES))
    sums = [F.sum(F.shiftrightunsigned(shingle, k).bitwiseAND(F.lit(mask))).alias(f"lane{k}") for k in range(LANE)]
    return [*sums, F.sum(F.shiftrightunsigned(shingle, 63)).alias("lane63")]


def fingerprint_of(n: Column) -> Column:
    """The fingerprint from the lanes: a bit is set if over half of n shingles have it."""
    fp: Column = F.lit(0).cast("long")
    for bit in range(64):
        count = F.col("lane63") if bit == 63 else F.shiftrightunsigned(f"lane{bit % LANE}", LANE * (bit // LANE)).bitwiseAND(F.lit((1 << LANE) - 1))
        value = F.lit(-(2**63) if bit == 63 else 1 << bit)
        fp = fp.bitwiseOR(F.when(2 * count > n, value).otherwise(F.lit(0).cast("long")))
    return fp


def blocks(fp: Column, radius: int = RADIUS) -> Column:
    """(block number, value) of radius + 1 blocks."""
    n = min(radius + 1, 64)
    edges = [round(64 * k / n) for k in range(n + 1)]
    parts = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return F.array(*parts)


def prepared_items(benchmark: DataFrame, size: int) -> DataFrame:
    """(item, item_id, n, size, shs): a number of its own, words and shingle hashes of each item that has words."""
    items = benchmark.select(F.col("item_id").cast("long"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    n = F.size("words")
    items = items.select("item_id", n.alias("n"), F.least(n, F.lit(size)).alias("size"), shingles(F.col("words"), size).alias("shs")).distinct()
    return items.select(F.monotonically_increasing_id().alias("item"), "*")


def item_weights(items: DataFrame) -> DataFrame:
    """(item, n, size, item_m, sh, b): how often each item holds each of its shingles."""
    return items.select("item", "n", "size", F.size("shs").alias("item_m"), F.explode("shs").alias("sh")).groupBy("item", "n", "size", "item_m", "sh").agg(F.count("*").alias("b"))


def first_shingles(weights: DataFrame, similarity: float) -> DataFrame:
    """(item, n, sh): shingles of which every window at least ``similarity`` alike holds one."""
    held = weights.groupBy("size", "sh").agg(F.count("*").alias("held"))
    before = F.sum("b").over(Window.partitionBy("item").orderBy("held", "sh").rowsBetween(Window.unboundedPreceding, -1))
    placed = weights.join(held, ["size", "sh"]).withColumn("before", F.coalesce(before, F.lit(0)))
    return placed.where(F.col("before") <= F.col("item_m") - least_shared(F.col("item_m"), similarity)).select("item", "n", "sh")


def least_shared(item_m: Column, similarity: float) -> Column:
    """Places of a window that hold a shingle of the item, at least, in a window at least ``similarity`` alike."""
    return F.ceil(F.lit(similarity) * item_m - F.lit(1e-9))


def stride_for(least: int, similarity: float) -> int:
    """The largest step up to STRIDE that meets a shared shingle in each window of ``least`` shingles and more."""
    strangers = (1 - similarity) / (1 + similarity)
    good = (k for k in range(STRIDE, 1, -1) if all(w // k > strangers * w + 1e-9 for w in range(least, least + 20 * STRIDE)))
    return next(good, 1)


def window_bounds(hits: DataFrame) -> DataFrame:
    """Rows (k1, k2, n, size, pos, doc_words) to the starts of all n-word windows over them, as disjoint ranges (lo, hi)."""
    last = F.greatest(F.col("doc_words") - F.col("n"), F.lit(0))
    reach = hits.select("k1", "k2", "n", "size", F.least(F.greatest(F.col("pos") - F.col("n") + F.col("size"), F.lit(0)), last).alias("lo"), F.least("pos", last).alias("hi")).distinct()
    order = Window.partitionBy("k1", "k2", "n", "size").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = reach.withColumn("island", F.sum(F.when(F.col("lo") > F.coalesce(before, F.lit(-1)), 1).otherwise(0)).over(order))
    return marked.groupBy("k1", "k2", "n", "size", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def pieces(stretch: Column) -> Column:
    """A stretch (n, size, lo, hi) of window starts in pieces of PIECE at most: what a window is made from is bounded, however long a match goes on."""
    return F.transform(F.sequence(stretch["lo"], stretch["hi"], F.lit(PIECE)), lambda lo: F.struct(stretch["n"].alias("n"), stretch["size"].alias("size"), lo.alias("lo"), F.least(lo + (PIECE - 1), stretch["hi"]).alias("hi")))


def matched_shingles(worded: DataFrame, sizes: list[tuple[int, int]], similarity: float) -> DataFrame:
    """(k1, k2, size, doc_words, pos, sh): shingles of each size in use, at a stride that loses no window."""

    def of_size(s: int, least: int) -> Column:
        # A document with few shingles is one short window.
        step = F.when(F.size("words") - s + 1 < STRIDE, 1).otherwise(stride_for(min(least, STRIDE), similarity))
        return F.transform(shingles(F.col("words"), s, step), lambda sh, at: F.struct(F.lit(s).alias("size"), (at * step).alias("pos"), sh.alias("sh")))

    every = [of_size(*x) for x in sizes]
    found = F.concat(*every) if every else F.expr("CAST(array() AS array<struct<size:int,pos:int,sh:bigint>>)")
    return worded.select("k1", "k2", F.size("words").alias("doc_words"), F.explode(found).alias("m")).select("k1", "k2", "doc_words", "m.size", "m.pos", "m.sh")


def plausible_windows(near: DataFrame, items: DataFrame, weights: DataFrame, similarity: float, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(k1, k2, n, first_word, item): windows of the stretches in ``near`` that can be ``similarity`` alike to the item."""
    region = ["k1", "k2", "n", "lo"]
    marked = near.select(*region, F.explode("shs").alias("sh")).join(small(first_shingles(weights, similarity)), ["n", "sh"])
    met = near.join(marked.select(*region, "item").distinct(), region)
    wanted = items.select("item", F.array_distinct("shs").alias("own"), F.size("shs").alias("item_m"))
    met = met.join(small(wanted), "item")
    hit = F.transform("shs", lambda sh: F.array_contains(F.col("own"), sh))
    met = met.select(*region, "item", "item_m", "more", (F.col("n") - F.col("size") + 1).alias("m"), hit.alias("hit"))
    count = lambda k: F.size(F.filter(F.slice("hit", k + 1, F.col("m")), lambda x: x))
    good = F.filter(F.sequence(F.lit(0), "more"), lambda k: count(k) >= least_shared(F.col("item_m"), similarity))
    return met.select("k1", "k2", "n", "lo", "item", F.explode(good).alias("k")).select("k1", "k2", "n", (F.col("lo") + F.col("k")).alias("first_word"), "item")


def contaminated_windows(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(k1, k2, item_id, first_word, n_words, shared, total): windows at least ``similarity`` alike to an item.

    k1, k2 tell rows apart by doc_id (null: a value of its own) and a hash of the text.
    """
    tables = Tables()
    items = tables.written(prepared_items(benchmark, size), "bench-items")
    weights = tables.written(item_weights(items), "bench-weights")
    few = weights.count() + (radius + 1) * items.count() <= MOST_BROADCAST
    small = F.broadcast if few else lambda df: df
    # Shingle sizes in use (at most ``size`` numbers), with the fewest shingles that an item has.
    sizes = sorted(tuple(r) for r in items.groupBy("size").agg(F.min(F.size("shs"))).collect())
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k1"), F.xxhash64("text").alias("k2"), "text")
    placed = matched_shingles(rows.select("k1", "k2", words_of(F.col("text")).alias("words")), sizes, similarity)
    hits = placed.join(small(weights.select("n", "size", "sh").distinct()), ["size", "sh"]).select("k1", "k2", "n", "size", "pos", "doc_words")
    bounds = tables.written(window_bounds(hits), "bench-bounds")
    chosen = bounds.groupBy("k1", "k2").agg(F.collect_list(F.struct("n", "size", "lo", "hi")).alias("ranges"))
    # Texts are moved once here, at every size alike; what is left is small and written.
    near = rows.join(chosen.hint("merge"), ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("k1", "k2", words_of(F.col("text")).alias("words"), F.explode("ranges").alias("r"))
    near = near.select("k1", "k2", "words", F.explode(pieces(F.col("r"))).alias("r"))
    cut = F.slice("words", F.col("r.lo") + 1, F.col("r.hi") - F.col("r.lo") + F.col("r.n"))
    near = tables.written(near.select("k1", "k2", "r.n", "r.lo", shingles(cut, F.col("r.size")).alias("shs"), (F.col("r.hi") - F.col("r.lo")).alias("more"), F.col("r.size").alias("size")), "bench-near")
    windows = near.select("k1", "k2", "n", "lo", F.explode(F.sequence(F.lit(0), "more")).alias("k"), "shs", "size")
    windows = windows.select("k1", "k2", "n", (F.col("lo") + F.col("k")).alias("first_word"), F.slice("shs", F.col("k") + 1, F.col("n") - F.col("size") + 1).alias("shs"))
    key = ["k1", "k2", "n", "first_word"]
    lanes = windows.select(*key, F.explode("shs").alias("sh")).groupBy(*key).agg(F.count("*").alias("m"), *fingerprint_lanes(F.col("sh")))
    window_fps = lanes.select(*key, fingerprint_of(F.col("m")).alias("fp"))
    item_lanes = items.select("item", "n", F.explode("shs").alias("sh")).groupBy("item", "n").agg(F.count("*").alias("m"), *fingerprint_lanes(F.col("sh")))
    item_fps = item_lanes.select("item", "n", fingerprint_of(F.col("m")).alias("item_fp"))
    left = window_fps.select(*key, "fp", F.explode(blocks(F.col("fp"), radius)).alias("b")).select(*key, "fp", "b.block", "b.value")
    right = item_fps.select("item", "n", "item_fp", F.explode(blocks(F.col("item_fp"), radius)).alias("b")).select("item", "n", "item_fp", "b.block", "b.value")
    within = left.join(small(right), ["n", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select(*key, "item")
    pairs = tables.written(within.unionByName(plausible_windows(near, items, weights, similarity, small)).distinct(), "bench-pairs")
    counted = windows.join(pairs, key).select(*key, "item", F.size("shs").alias("m"), F.explode("shs").alias("sh")).groupBy(*key, "item", "m", "sh").agg(F.count("*").alias("a"))
    shared = counted.join(small(weights.select("item", "item_m", "sh", "b")), ["item", "sh"]).groupBy(*key, "item", "m", "item_m").agg(F.sum(F.least("a", "b")).alias("shared"))
    shared = shared.withColumn("total", F.col("m") + F.col("item_m") - F.col("shared")).where(F.col("shared") >= F.lit(similarity) * F.col("total"))
    found = shared.join(small(items.select("item", "item_id")), "item").select("k1", "k2", "item_id", "first_word", F.col("n").alias("n_words"), "shared", "total")
    found = written(found, "bench-found")
    tables.drop()
    return found


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): the best window of each document for each item it holds.

    Ties go to the earliest window. Null or empty texts and items without words hold
    nothing; an item of fewer words than a shingle is one shingle; a document shorter
    than an item is one window. Whole texts, very long ones too. Rows with equal doc_id
    and text are reported once; rows with a null doc_id are reported with a null, and
    so are items with a null item_id; of several items with one item_id the best
    counts. Other columns are ignored. Empty tables give no rows.
    """
    found = contaminated_windows(docs, benchmark, size, similarity, radius)
    alike = F.col("shared") / F.col("total")
    best = found.groupBy("k1", "k2", "item_id").agg(F.max(F.struct(alike.alias("similarity"), (-F.col("first_word")).alias("back"), "n_words")).alias("best"))
    return best.select(F.nullif("k1", F.lit(NO_ID)).alias("doc_id"), "item_id", (-F.col("best.back")).alias("first_word"), F.col("best.n_words").alias("n_words"), F.col("best.similarity").alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a window alike to a benchmark item; repeated rows stay repeated, all columns stay."""
    found = contaminated_windows(docs, benchmark).select("k1", "k2").distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("document"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k1"), F.xxhash64("text").alias("k2"))
    return keyed.join(found.hint("merge"), ["k1", "k2"], "left_anti").select("document.*")
