"""Token counts: pieces counted once per distinct pre-token, joined to per-document pre-token frequencies.

1. Texts are cut into pre-tokens, and a document's pre-tokens into (pre-token, times).
2. The most frequent pre-tokens of a sample of documents, of bounded number, go
   through the tokenizer's merges once and are broadcast (long ones by a digest, so an
   entry's size is bounded whatever its pre-token); their share of each document is
   summed on the spot, so frequent pre-tokens are never shuffled.
3. All other pairs are dealt and sorted by pre-token. Where the pairs of one pre-token
   meet, it is counted once and joined to its frequencies; products are summed by row.

Results do not depend on the sample: it only says which pairs need no shuffle.
No token ids are ever kept.
"""

from __future__ import annotations

import functools
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import shuffle_partitions, slices

#: Fixed value: the byte-level pre-tokenizer's pattern.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Text outside these blocks (where all versions of Unicode agree) is cut by the library itself.
PLAIN = regex.compile(r"[\x00-\x1b\x20-\u024f\u2010-\u2027\u2030-\u205e\u20ac]*")
#: Frequent pre-tokens that are broadcast: so many at most, from about so many documents.
HEAD_ROWS, SAMPLE_DOCS = 50_000, 20_000
#: Characters from which a pre-token stands in the broadcast table by its digest.
LONG_PIECE = 48
#: Bytes of text, and pre-tokens, that a task works on at a time.
CHUNK_BYTES, LOT_BYTES, LOT_PIECES = 1 << 18, 1 << 16, 1000
ROWS = "row long, doc_id long, n_bytes long, n long, piece string, times int"
LIMIT = 1024


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PreTokens:
    """Cuts a text as the library does, special strings first."""

    def __init__(self, path: str):
        # Spark's tasks are the parallelism; a thread pool in each worker only adds memory.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cut = regex.compile(PRETOKEN).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def pieces(self, text: str) -> list[str]:
        if self.at_special is None or not any(s in text for s in self.special):
            return self.plain(text)
        out: list[str] = []
        for k, part in enumerate(self.at_special.split(text)):
            out += [part] if k % 2 else self.plain(part)
        return out

    def plain(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return self.cut(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def n_tokens(self, texts: list[str]) -> list[int]:
        """Tokens of each text, in lots of bounded size to keep few encodings in memory."""
        out: list[int] = []
        lot: list[str] = []
        held = 0
        for text in texts:
            lot.append(text)
            held += len(text)
            if held >= LOT_BYTES or len(lot) >= LOT_PIECES:
                out += self._lot(lot)
                lot, held = [], 0
        return out + self._lot(lot)

    def _lot(self, lot: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(lot, add_special_tokens=False)] if lot else []


@functools.lru_cache(maxsize=2)
def pre_tokens(path: str) -> PreTokens:
    """One tokenizer for each worker process, whatever the number of its tasks."""
    return PreTokens(path)


def head_key(piece: str) -> str:
    """What the broadcast table knows a pre-token by; a digest's first character is in no pre-token of that length alone."""
    return piece if len(piece) < LONG_PIECE else f"\0{xxhash.xxh3_128_hexdigest(piece.encode('utf-8', 'surrogatepass'))}"


def frequent_pieces(docs: DataFrame, path: str) -> dict[str, int]:
    """Tokens of the most frequent pre-tokens, by documents of a sample that hold them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = pre_tokens(path)
        for batch in batches:
            for _, texts in slices(batch.column(0), CHUNK_BYTES):
                held = Counter(p for t in texts for p in set(cutter.pieces(t.decode("utf-8"))))
                counts = cutter.n_tokens(list(held))
                yield pa.RecordBatch.from_arrays([pa.array(list(map(head_key, held)), pa.string()), pa.array(held.values(), pa.int64()), pa.array(counts, pa.int64())], ["piece", "n_docs", "n"])

    share = min(1.0, SAMPLE_DOCS / max(docs.count(), 1))
    sampled = docs.select("text").sample(False, share, 7).mapInArrow(cut, "piece string, n_docs long, n long")
    counts = sampled.groupBy("piece").agg(F.sum("n_docs").alias("n_docs"), F.first("n").alias("n"))
    head = counts.where("n_docs > 1").orderBy(F.desc("n_docs"), "piece").limit(HEAD_ROWS).select("piece", "n").toArrow()
    return dict(zip(head["piece"].to_pylist(), head["n"].to_pylist(), strict=True))


def document_pairs(docs: DataFrame, path: str, head: dict[str, int]) -> DataFrame:
    """For each row one with its bytes and the sum over frequent pre-tokens (times null), and a pair for each other pre-token."""
    known = docs.sparkSession.sparkContext.broadcast(head)
    names = ["row", "doc_id", "n_bytes", "n", "piece", "times"]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, tokens_of = pre_tokens(path), known.value.get
        for batch in batches:
            for first, texts in slices(batch.column(2), CHUNK_BYTES):
                n = len(texts)
                rows, ids = (batch.column(c).slice(first, n).to_pylist() for c in (0, 1))
                sums, pair_rows, pieces, times = [], [], [], []
                for row, text in zip(rows, texts, strict=True):
                    total = 0
                    for piece, often in Counter(cutter.pieces(text.decode("utf-8"))).items():
                        if (tokens := tokens_of(head_key(piece))) is not None:
                            total += often * tokens
                        else:
                            pair_rows.append(row)
                            pieces.append(piece)
                            times.append(often)
                    sums.append(total)
                # Spread over tasks by the row's own number; times tells them from pairs.
                own = (rows, ids, list(map(len, texts)), sums, list(map(str, rows)), [None] * n)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(own, kinds, strict=True)], names)
                for k in range(0, len(pieces), 1 << 13):
                    part = [x[k : k + (1 << 13)] for x in (pair_rows, pieces, times)]
                    nothing = [pa.nulls(len(part[0]), pa.int64())] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), *nothing, pa.array(part[1], pa.string()), pa.array(part[2], pa.int32())], names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, ROWS)


def counted_pairs(pairs: DataFrame, path: str) -> DataFrame:
    """Pairs dealt by pre-token to (row, doc_id, n_bytes, n) with the product of times and tokens; each pre-token is counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = pre_tokens(path)
        last: tuple[str, int] | None = None
        for batch in batches:
            pieces = batch.column(4).dictionary_encode()
            distinct = pieces.dictionary.to_pylist()
            new = distinct[1:] if last and distinct and distinct[0] == last[0] else distinct
            counts = ([last[1]] if len(new) < len(distinct) else []) + counter.n_tokens(new)
            last = (distinct[-1], counts[-1]) if distinct else last
            products = pc.multiply(batch.column(5).cast(pa.int64()), pa.array(counts, pa.int64()).take(pieces.indices))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pc.coalesce(batch.column(3), products)], ["row", "doc_id", "n_bytes", "n"])

    n = shuffle_partitions(pairs.sparkSession)
    dealt = pairs.repartition(n, "piece").sortWithinPartitions("piece")
    return dealt.mapInArrow(run, "row long, doc_id long, n_bytes long, n long")


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of docs.

    A null text counts as empty (no bytes, no tokens). Repeated rows and null
    doc_ids are counted row by row. Whole texts, no truncation, a very long one like any
    other; an empty table gives no rows; other columns are ignored.
    """
    path = path or vocabulary_path()
    counted = counted_pairs(document_pairs(docs, path, frequent_pieces(docs, path)), path)
    summed = counted.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
