"""Removal of every byte inside a 200-byte string that starts more than once: bucket-pointer refinement in shards.

1. Windows of ``length`` bytes are keyed by the smallest hash of their ``GRAM``-byte
   grams. Equal windows have equal keys. Windows in a row with one key form a run; a
   key met once in the corpus has no repeated window, and its run goes no further.
2. The bytes of the remaining runs are dealt by key. In a shard, runs with equal bytes
   are settled at once. On the others, q-gram buckets are refined to twice their depth
   by sorting on the pair of bucket numbers at an offset and at that offset plus the
   depth, the new numbers serving the next depth, until the depth is ``length``; a
   position alone in its bucket is settled and drops out.
3. Keys with very many runs are not gathered in one task: their runs are salted, each
   salt is settled by itself, and what it holds once is looked for in the other salts
   by digest, as an aggregate.
4. Repeated windows become byte ranges, are merged per document and cut out.

Only whole windows found equal are removed: the refinement compares bytes, the path
for very frequent keys 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import shuffle_partitions, slices, written

LENGTH = 200
GRAM = 32
CHUNK_BYTES = 1 << 20
#: Runs of one key that one task may hold; keys with more are salted.
HOT_RUNS = 8_000
#: Bytes of runs refined together.
REFINE_BYTES = 1 << 21
BASE = 0x9E3779B97F4A7C15
NO_ID = -(2**63)
U = np.uint64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    mask = 2**64
    up, down = np.full(n, BASE, U), np.full(n, pow(BASE, -1, mask), U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Windows:
    """Runs of windows with one key, for texts joined in one buffer."""

    def __init__(self, length: int):
        self.length, self.gram = length, min(GRAM, length)
        self.width = length - self.gram + 1
        self.up, self.down = _powers(CHUNK_BYTES * 2 + length)

    def _slide(self, x: np.ndarray, width: int, take) -> np.ndarray:
        done = 1
        while 2 * done <= width:
            x = take(x[:-done], x[done:])
            done *= 2
        return take(x[: len(x) - (width - done)], x[width - done :]) if width > done else x

    def of(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first window, windows, key) of each run, and the keys with a further place inside one run; texts are data[start:stop]."""
        n, g, length = len(data), self.gram, self.length
        sums = np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * self.up[:n], out=sums[1:])
        h = (sums[g:] - sums[:-g]) * self.down[: n - g + 1]
        h ^= h >> U(31)
        h *= U(0xBF58476D1CE4E5B9)
        h ^= h >> U(29)
        h |= U(1)
        least = self._slide(h, self.width, np.minimum)
        edges = np.zeros(n + 1, np.int8)
        np.add.at(edges, starts, 1)
        np.add.at(edges, np.maximum(stops - length + 1, starts), -1)
        valid = np.cumsum(edges[: len(least)]) > 0
        changed = least[1:] != least[:-1]
        first = valid.copy()
        first[1:] &= ~valid[:-1] | changed
        at = np.flatnonzero(first)
        last = np.zeros(len(valid), bool)
        last[:-1] = first[1:] | ~valid[1:]
        last[-1:] = True
        ends = np.flatnonzero(last & valid)
        keys = least[at]
        # A place is chosen if it is the least of some valid window; places beyond one per run repeat inside a run.
        padded = np.zeros(len(least) + 2 * (self.width - 1), U)
        padded[self.width - 1 : self.width - 1 + len(least)] = np.where(valid, least, U(0))
        chosen = h[self._slide(padded, self.width, np.maximum) == h]
        found, times = np.unique(chosen, return_counts=True)
        runs, per = np.unique(keys, return_counts=True)
        extra = found[times > per[np.minimum(np.searchsorted(runs, found), len(runs) - 1)]] if len(runs) else found[:0]
        return at, ends - at + 1, keys, extra


def _buffers(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """Joined texts of some size: (bytes, starts, stops, (text, offset of its part)); long texts in parts that overlap."""
    parts: list[tuple[int, int]] = []
    held: list[bytes] = []
    size = 0

    def out():
        lengths = np.array([len(x) for x in held])
        stops = np.cumsum(lengths)
        return np.frombuffer(b"".join(held), np.uint8), stops - lengths, stops, list(parts)

    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), CHUNK_BYTES):
            piece = text[at : at + CHUNK_BYTES + length - 1]
            if len(piece) < length:
                continue
            if held and size + len(piece) > CHUNK_BYTES:
                yield out()
                parts, held, size = [], [], 0
            parts.append((k, at))
            held.append(piece)
            size += len(piece)
    if held:
        yield out()


def window_runs(docs: DataFrame, length: int) -> DataFrame:
    """(k1, k2, key, first, n): the runs of each text; n = 0 marks a key that repeats inside a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(length)
        for batch in batches:
            k1s, k2s = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for row, texts in slices(batch.column(2), 2 * CHUNK_BYTES):
                for data, starts, stops, parts in _buffers(texts, length):
                    at, n, keys, extra = windows.of(data, starts, stops)
                    which = np.searchsorted(starts, at, side="right") - 1
                    text = np.array([p[0] for p in parts])[which] + row
                    first = at - starts[which] + np.array([p[1] for p in parts])[which]
                    none = np.zeros(len(extra), np.int64)
                    columns = (
                        np.concatenate((k1s[text], none)),
                        np.concatenate((k2s[text], none)),
                        np.concatenate((keys, extra)).view(np.int64),
                        np.concatenate((first, none)),
                        np.concatenate((n, none)).astype(np.int32),
                    )
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k1", "k2", "key", "first", "n"])

    return docs.mapInArrow(run, "k1 long, k2 long, key long, first long, n int")


def run_bytes(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """(key, runs, k1, k2, first, bytes) for the chosen runs of each document."""
    lists = runs.groupBy("k1", "k2").agg(F.collect_set(F.struct("key", "runs", "first", "n")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                text, chosen = (batch.column(2)[k].as_py() or "").encode(), batch.column(3)[k].values
                keys, times, first, n = (chosen.field(f) for f in ("key", "runs", "first", "n"))
                pieces = [text[a : a + m + length - 1] for a, m in zip(first.to_pylist(), n.to_pylist(), strict=True)]
                k1, k2 = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                yield pa.RecordBatch.from_arrays(
                    [keys, times, pa.array([k1] * len(pieces), pa.int64()), pa.array([k2] * len(pieces), pa.int64()), first, pa.array(pieces, pa.binary())],
                    ["key", "runs", "k1", "k2", "first", "bytes"],
                )

    return docs.join(lists, ["k1", "k2"]).select("k1", "k2", "text", "runs").mapInArrow(cut, "key long, runs long, k1 long, k2 long, first long, bytes binary")


def refine(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each run's bytes the bucket of each of its windows among all of them; -1 for a window that starts once."""
    lengths = np.array([len(p) for p in pieces])
    stops = np.cumsum(lengths)
    starts = stops - lengths
    data = np.frombuffer(b"".join(pieces) + bytes(length), np.uint8)
    total = int(stops[-1])
    left = np.repeat(stops, lengths) - np.arange(total)
    depth = 8 if length >= 8 else 1
    word = np.zeros(total, U)
    for k in range(depth):
        word = (word << U(8)) | data[k : k + total]
    active = np.flatnonzero(left >= depth)
    bucket = np.full(total, -1, np.int64)
    _, number, times = np.unique(word[active], return_inverse=True, return_counts=True)
    bucket[active] = np.where(times[number] > 1, number, -1)
    while depth < length:
        step = min(depth, length - depth)
        active = np.flatnonzero((bucket >= 0) & (left >= depth + step))
        later = bucket[active + step]
        active, later = active[later >= 0], later[later >= 0]
        pair = bucket[active] * np.int64(total + 1) + later
        _, number, times = np.unique(pair, return_inverse=True, return_counts=True)
        bucket = np.full(total, -1, np.int64)
        bucket[active] = np.where(times[number] > 1, number, -1) if len(active) else bucket[:0]
        depth += step
    return [bucket[a : b - length + 1] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


def ranges(flags: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges, relative to the run, of its repeated windows."""
    edges = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1 + length


COLUMNS = ("key", "k1", "k2", "first", "bytes", "runs")


def dealt(runs: DataFrame) -> DataFrame:
    """Runs with bytes by key, those of very frequent keys by key and salt."""
    salts = F.ceil(F.col("runs") / F.lit(HOT_RUNS)).cast("long")
    salted = runs.withColumn("salt", F.when(F.col("runs") > HOT_RUNS, F.pmod(F.xxhash64("k1", "k2", "first"), salts)).otherwise(F.lit(0)))
    return salted.repartition(shuffle_partitions(runs.sparkSession), "key", "salt").sortWithinPartitions("key", "salt")


def chunks(batches: Iterator[pa.RecordBatch], least: int = REFINE_BYTES) -> Iterator[list[tuple]]:
    """Rows of whole (key, salt) groups together, about ``least`` bytes at a time; 0: each group by itself."""
    held: list[tuple] = []
    size, last = 0, None
    for batch in batches:
        salts = batch.column("salt").to_pylist()
        for salt, row in zip(salts, zip(*(batch.column(c).to_pylist() for c in COLUMNS), strict=True), strict=True):
            if size > least and (row[0], salt) != last:
                yield held
                held, size = [], 0
            held.append(row)
            size += len(row[4])
            last = row[0], salt
    if held:
        yield held


def by_bytes(rows: list[tuple]) -> dict[int, dict[bytes, list[tuple]]]:
    """Rows by key and bytes."""
    out: dict[int, dict[bytes, list[tuple]]] = {}
    for row in rows:
        out.setdefault(row[0], {}).setdefault(row[4], []).append(row)
    return out


def repeated_ranges(runs: DataFrame, length: int) -> DataFrame:
    """Dealt runs to (k1, k2, a, b) byte ranges of windows repeated among the runs of one task."""

    def settle(rows: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
        unsettled: list[tuple[bytes, list[tuple]]] = []
        for same in by_bytes(rows).values():
            for piece, owners in same.items():
                if len(owners) > 1:
                    yield from ((row[1], row[2], row[3], row[3] + len(piece)) for row in owners)
                if len(same) > 1 or len(owners) == 1:
                    unsettled.append((piece, owners))
        if unsettled:
            for (_, owners), buckets in zip(unsettled, refine([p for p, _ in unsettled], length), strict=True):
                if len(owners) == 1 and (buckets >= 0).any():
                    _, k1, k2, first, *_ = owners[0]
                    yield from ((k1, k2, first + int(a), first + int(b)) for a, b in zip(*ranges(buckets >= 0, length), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches):
            yield rows_of(settle(rows))

    return runs.mapInArrow(run, "k1 long, k2 long, a long, b long")


def rows_of(found: Iterator[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["k1", "k2", "a", "b"])


def hot_ranges(runs: DataFrame, length: int) -> DataFrame:
    """(k1, k2, a, b) of windows of very frequent keys that a salt holds once and another salt holds too.

    A salt gives the digest of each of its different windows once: with its place
    where it holds the window once, with weight 2 where it is settled already.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, 0):
            distinct = [(piece, owners) for same in by_bytes(rows).values() for piece, owners in same.items()]
            given: set[int] = set()
            for (piece, owners), buckets in zip(distinct, refine([p for p, _ in distinct], length), strict=True):
                _, k1, k2, first, *_ = owners[0]
                once = (buckets < 0) & (len(owners) == 1)
                places = [k for k, bucket in enumerate(buckets.tolist()) if bucket < 0 or not (bucket in given or given.add(bucket))]
                digests = [xxhash.xxh3_128_digest(piece[k : k + length]) for k in places]
                n = len(places)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array(np.where(once[places], 1, 2), pa.int32()), pa.array([k1] * n, pa.int64()), pa.array([k2] * n, pa.int64()), pa.array(first + np.array(places, np.int64))],
                    ["window", "weight", "k1", "k2", "a"],
                )

    # The id keeps this filter above the exchange, which repeated_ranges shares.
    runs = runs.where((F.col("runs") > HOT_RUNS) & (F.monotonically_increasing_id() >= 0))
    every = runs.mapInArrow(windows, "window binary, weight int, k1 long, k2 long, a long")
    twice = every.groupBy("window").agg(F.sum("weight").alias("times")).where("times > 1").select("window")
    return every.where("weight = 1").join(twice, "window", "left_semi").select("k1", "k2", "a", (F.col("a") + length).alias("b"))


def merge(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges made one."""
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(keyed docs (k1, k2, text), (k1, k2, a, b) ranges to remove).

    Rows are told apart by doc_id (null: a value of its own) and a hash of the text,
    so repeated rows share their ranges, which are the same for each.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k1"), F.xxhash64("text").alias("k2"), "text")
    runs = written(window_runs(keyed.where(F.octet_length("text") >= length), length), "suffix-runs")
    keys = written(runs.groupBy("key").agg(F.count("*").alias("runs")).where("runs > 1"), "suffix-keys")
    chosen = written(runs.where("n > 0").join(keys, "key"), "suffix-chosen")
    shards = dealt(run_bytes(keyed, chosen, length))
    found = repeated_ranges(shards, length)
    if not keys.where(F.col("runs") > HOT_RUNS).isEmpty():
        found = found.unionByName(hot_ranges(shards, length))
    return keyed, found


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) per row of docs.

    Texts are UTF-8 bytes, null counts as empty; texts shorter than ``length`` lose
    nothing; a window that overlaps its own copy counts as repeated. Removal is judged
    on the input. Repeated rows lose everything from ``length`` bytes on and stay
    repeated. An empty table gives no rows; other columns are ignored.
    """
    keyed, found = repeated_spans(docs, length)
    lists = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                data = (text.as_py() or "").encode()
                spans = merge([(s["a"], s["b"]) for s in found.as_py() or []])
                digest, at = hashlib.sha256(), 0
                for a, b in spans:
                    digest.update(data[at:a])
                    at = b
                digest.update(data[at:])
                rows.append((len(data), sum(b - a for a, b in spans), len(spans), digest.hexdigest(), [{"a": a, "b": b} for a, b in spans]))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            )

    joined = keyed.join(lists, ["k1", "k2"], "left").select(F.nullif("k1", F.lit(NO_ID)).alias("doc_id"), "text", "found")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:long,b:long>>")
