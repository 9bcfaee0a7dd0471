"""Quality rules: boosted trees over document statistics, scored as flat numpy arrays.

Fixed base rules reject first; what passes them is scored by gradient-boosted trees
fitted on a bounded sample of labelled documents. Chosen features are monotonic:
more symbols, repeats, duplicate lines or capitals never raise a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import slices

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS, MOST_REPEATED_PERCENT = 10, 20
#: Labelled documents at most that the trees are fitted on, and the share held out for the threshold.
LABEL_SAMPLE, HELD_OUT = 20_000, 4
#: Good held-out documents that the threshold may reject, as a share.
FALSE_REJECTS = 0.0005
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_digits", "n_punct", "n_lines", "n_bytes")
#: Feature to the sign its effect on the score must have; 0: free.
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "distinct": 0, "upper": -1, "digits": 0, "punctuation": 0, "line_words": 0}
UPPER = re.compile(rb"[A-Z]|\xc3[\x80-\x9e]")
NOT_DIGITS = bytes(set(range(256)) - set(b"0123456789"))
NOT_PUNCT = bytes(set(range(256)) - set(b".,;:!?\"'()-"))


def repeated_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that occur twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
    if len(numbers) == len(words):
        return 0
    ids = np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))
    mixed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        mixed = (mixed ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    places = np.flatnonzero(twice)
    if not len(places):
        return 0
    exact = Counter(windows := [ids[p : p + WINDOW].tobytes() for p in places.tolist()])
    edges = np.zeros(len(words) + 1, np.int64)
    for p, w in zip(places.tolist(), windows, strict=True):
        if exact[w] > 1:
            edges[p] += 1
            edges[p + WINDOW] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


def statistics(text: bytes) -> tuple[int, ...]:
    """STATS of one UTF-8 text."""
    words = text.split()
    solid = text.translate(None, WHITE)
    lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
    return (
        len(words),
        len(solid.decode("utf-8", "surrogatepass")),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(set(words)),
        len(UPPER.findall(text)),
        len(text.translate(None, NOT_DIGITS)),
        len(text.translate(None, NOT_PUNCT)),
        len(lines),
        len(text),
    )


def base_failed(stats: np.ndarray) -> np.ndarray:
    n_words, repeats = stats[:, 0], stats[:, STATS.index("n_repeat_words")]
    return (n_words < MIN_WORDS) | (100 * repeats > MOST_REPEATED_PERCENT * n_words)


def features(stats: np.ndarray) -> np.ndarray:
    """Rows of STATS to rows of FEATURES."""
    x = {name: stats[:, k].astype(np.float64) for k, name in enumerate(STATS)}
    words, chars, lines = np.maximum(x["n_words"], 1), np.maximum(x["word_chars"], 1), np.maximum(x["n_lines"], 1)
    return np.column_stack(
        [
            np.log1p(x["n_words"]),
            x["word_chars"] / words,
            x["n_symbols"] / chars,
            x["n_dup_lines"] / lines,
            x["n_repeat_words"] / words,
            x["n_distinct"] / words,
            x["n_upper"] / chars,
            x["n_digits"] / chars,
            x["n_punct"] / chars,
            words / lines,
        ]
    )


@dataclass
class Forest:
    """Trees as flat arrays of nodes: a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float
    cut: float = -np.inf

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                goes_left = x[rows, self.feature[t, node]] <= self.threshold[t, node]
                node = np.where(goes_left, self.left[t, node], self.right[t, node])
            total += self.value[t, node]
        return total

    def keeps(self, x: np.ndarray) -> np.ndarray:
        return self.margin(x) >= self.cut


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 5.0) -> Forest:
    """Histogram boosting on logistic loss; a split against a feature's sign is not taken, and children keep within their parent's bounds."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)])
    nodes = 2 ** (depth + 1) - 1
    forest = Forest(np.zeros((trees, nodes), np.int64), np.zeros((trees, nodes)), np.tile(np.arange(nodes), (trees, 1)), np.tile(np.arange(nodes), (trees, 1)), np.zeros((trees, nodes)), depth, 0.0)
    share = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    forest.start = float(np.log(share / (1 - share)))
    margin = np.full(len(y), forest.start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        held: list[tuple[int, np.ndarray, float, float]] = [(0, np.arange(len(y)), -np.inf, np.inf)]
        while held:
            node, rows, low, high = held.pop()
            forest.value[t, node] = rate * np.clip(g[rows].sum() / (h[rows].sum() + 1.0), low, high)
            margin_of = forest.value[t, node]
            best = _best_split(binned, cuts, g, h, rows, signs, least, low, high) if 2 * node + 2 < nodes else None
            if best is None:
                margin[rows] += margin_of
                continue
            k, bin_, a, b = best
            goes = binned[rows, k] <= bin_
            forest.feature[t, node], forest.threshold[t, node] = k, cuts[k][bin_]
            forest.left[t, node], forest.right[t, node] = 2 * node + 1, 2 * node + 2
            middle = (a + b) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[signs[k]]
            held += [(2 * node + 1, rows[goes], *bounds[0]), (2 * node + 2, rows[~goes], *bounds[1])]
    return forest


def _best_split(binned, cuts, g, h, rows, signs, least, low, high):
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best, gain = None, 1e-6
    for k, c in enumerate(cuts):
        if not len(c):
            continue
        gs = np.bincount(binned[rows, k], g[rows], len(c) + 1).cumsum()[:-1]
        hs = np.bincount(binned[rows, k], h[rows], len(c) + 1).cumsum()[:-1]
        a, b = np.clip(gs / (hs + 1.0), low, high), np.clip((total_g - gs) / (total_h - hs + 1.0), low, high)
        won = gs**2 / (hs + 1.0) + (total_g - gs) ** 2 / (total_h - hs + 1.0) - total_g**2 / (total_h + 1.0)
        won[(hs < least / 4) | (total_h - hs < least / 4) | (signs[k] * (b - a) < 0)] = -np.inf
        if won.max() > gain:
            j = int(won.argmax())
            best, gain = (k, j, a[j], b[j]), won[j]
    return best


def document_statistics(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The key columns and STATS of each row; a null text has no words."""
    at = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(at), 4 << 20):
                stats = np.array([statistics(t) for t in texts], np.int64).reshape(-1, len(STATS))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, len(texts)) for k in range(at)), *(pa.array(stats[:, k]) for k in range(len(STATS)))], [*keys, *STATS])

    keyed = docs.select(*keys, "text")
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema.fields[:at]] + [f"{s} long" for s in STATS])
    return keyed.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, sample: int = LABEL_SAMPLE) -> Forest:
    """Fit on at most ``sample`` labelled documents; the cut spares all but FALSE_REJECTS of the good ones.

    The trees are fitted without every HELD_OUT-th document; the cut is set on all good ones,
    those included.

    Labels with a null doc_id or quality are left out. With fewer than 50 usable
    labels, or one class only, the trees reject nothing.
    """
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    one_each = docs.select(F.col("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = document_statistics(one_each, ["doc_id", "quality"]).orderBy(F.xxhash64("doc_id"), "doc_id", *STATS).limit(2 * sample).toPandas()
    rows = rows.drop_duplicates("doc_id").reset_index(drop=True)
    stats, y = rows[list(STATS)].to_numpy(np.int64), rows["quality"].to_numpy(np.float64)
    passed = ~base_failed(stats) if len(stats) else np.zeros(0, bool)
    x, y = features(stats)[passed], (y[passed] > 0).astype(np.float64)
    empty = Forest(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 1), np.int64), np.zeros((0, 1), np.int64), np.zeros((0, 1)), 0, 0.0)
    held = np.arange(len(y)) % HELD_OUT == 0
    if len(y) < 50 or len(set(y[~held])) < 2 or not (y[held] > 0).any():
        return empty
    forest = fit(x[~held], y[~held], list(FEATURES.values()))
    good = np.sort(forest.margin(x[y > 0]))
    forest.cut = min(0.0, float(good[int(FALSE_REJECTS * len(good))]) - 1e-9)
    return forest


def judge(docs: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Key columns, STATS, base_failed and kept for each row of docs.

    A null text has no words and fails the base rules; repeated rows are judged row
    by row; an empty table gives no rows.
    """
    forest = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    stats = document_statistics(docs, keys)
    at = [stats.columns.index(s) for s in STATS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in at])
            failed = base_failed(table)
            kept = ~failed & forest.value.keeps(features(table))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(failed), pa.array(kept)], [*batch.schema.names, "base_failed", "kept"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in stats.schema.fields]
    return stats.mapInArrow(run, ", ".join([*fields, "base_failed boolean", "kept boolean"]))


def reject_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, unchanged."""
    forest = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(at), 4 << 20):
                stats = np.array([statistics(t) for t in texts], np.int64).reshape(-1, len(STATS))
                keep = ~base_failed(stats) & forest.value.keeps(features(stats))
                yield batch.slice(first, len(texts)).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
