"""Importance resampling towards a target: hashed features counted by DuckDB in every partition, merged and scored by Spark.

Each task runs one small DuckDB over its Arrow batches: SQL unnests the words, makes the
windows and counts each document's buckets, with zlib's CRC-32 as a registered function.
These counts are written as Parquet to the shared folder once; bucket totals of both
tables, and then every document's weight, come from there, so texts are read once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import Tables
from palisade.llm.order import placed

BUCKETS = 10_000
#: Longest run of words that is a feature.
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bytes of text that one statement takes at a time (one text of any length at least), and what DuckDB may hold before it spills.
MOST_BYTES, DUCK_MEMORY = 4_000_000, "256MB"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
COUNTED = "n_words long, n_features long, buckets array<int>, counts array<long>"


def features_sql(longest: int, buckets: int) -> str:
    """Per row of ``texts`` (row, text) with a word: its words, features, and the count of each bucket."""
    ahead = lambda n: " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER o" for k in range(1, n))])
    runs = " UNION ALL ".join(f'SELECT "row", {ahead(n)} AS feature FROM placed' + (' WINDOW o AS (PARTITION BY "row" ORDER BY i)' if n > 1 else "") for n in range(1, longest + 1))
    return rf"""
WITH words AS MATERIALIZED (SELECT "row", regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM texts),
placed AS (SELECT "row", unnest(w) AS word{", generate_subscripts(w, 1) AS i" if longest > 1 else ""} FROM words),
counted AS (SELECT "row", feature, count(*) AS n FROM ({runs}) WHERE feature IS NOT NULL GROUP BY ALL),
hashed AS (SELECT feature, crc(feature) % {buckets} AS bucket FROM (SELECT DISTINCT feature FROM counted)),
sums AS (SELECT "row", bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (feature) GROUP BY ALL),
lists AS (SELECT "row", list(bucket::INT ORDER BY bucket) AS buckets, list(n ORDER BY bucket) AS counts, sum(n)::BIGINT AS n_features FROM sums GROUP BY "row")
SELECT l."row" AS at, len(w)::BIGINT AS n_words, n_features, buckets, counts FROM lists l JOIN words USING ("row")"""


def lots(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about MOST_BYTES."""
    sizes = np.fromiter((len(x) for x in texts.cast(pa.binary()).fill_null(b"").to_pylist()), np.int64, len(texts))
    first, size = 0, 0
    for row, n in enumerate(sizes.tolist()):
        size += n
        if size >= MOST_BYTES:
            yield first, row + 1
            first, size = row + 1, 0
    if first < len(texts):
        yield first, len(texts)


def bucket_counts(rows: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """rows (id, text) to (id, n_words, n_features, buckets, counts): each row's buckets in order and how often they occur.

    A null text has no words. Whole texts are counted, in lots of about MOST_BYTES.
    """
    sql = features_sql(longest, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": DUCK_MEMORY})
        crc = lambda words: pa.array([zlib.crc32(w.encode()) for w in words.to_pylist()], pa.int64())
        con.create_function("crc", crc, ["VARCHAR"], "BIGINT", type="arrow")
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, end in lots(texts):
                n = end - first
                con.register("texts", pa.table({"row": pa.array(range(n), pa.int64()), "text": texts.slice(first, n).cast(pa.string())}))
                found = con.sql(sql).to_arrow_table().combine_chunks().sort_by("at")
                con.unregister("texts")
                at = np.full(n, -1)
                at[found["at"].to_numpy()] = np.arange(len(found))
                picked = found.drop_columns("at").take(pa.array(at, pa.int64(), mask=at < 0)).combine_chunks()
                empty = [pa.scalar(0, pa.int64()), pa.scalar(0, pa.int64())]
                columns = [picked[c].combine_chunks().fill_null(v) for c, v in zip(("n_words", "n_features"), empty, strict=True)]
                columns += [filled(picked[c], kind) for c, kind in (("buckets", pa.int32()), ("counts", pa.int64()))]
                yield pa.RecordBatch.from_arrays([ids.slice(first, n), *columns], ["id", "n_words", "n_features", "buckets", "counts"])
        con.close()

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text").mapInArrow(run, f"id {kind}, {COUNTED}")


def filled(lists: pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
    """Lists of one kind, an empty one for null."""
    whole = lists.combine_chunks()
    lengths = np.nan_to_num(pa.compute.list_value_length(whole).to_numpy(zero_copy_only=False)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), whole.flatten().cast(kind))


def totals(counted: DataFrame, name: str) -> DataFrame:
    """(bucket, <name>) summed over all rows: at most one row a bucket from each task is shuffled."""
    each = counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("c"))
    return each.groupBy(F.col("c.buckets").alias("bucket")).agg(F.sum("c.counts").alias(name))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """For every bucket how much likelier it is in the target: thousandths of a natural logarithm, add-one smoothed.

    ``buckets`` numbers come to the driver, whatever the tables.
    """
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    met = every.join(totals(source, "s"), "bucket", "left").join(totals(target, "t"), "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    sums = met.agg(F.sum("s"), F.sum("t")).first()
    whole_s, whole_t = (F.lit(float(x + buckets)) for x in sums)
    ratio = (F.col("t") + 1).cast("double") * whole_s / ((F.col("s") + 1).cast("double") * whole_t)
    gains = dict(met.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).collect())
    return [int(gains[b]) for b in range(buckets)]


def weighed(counted: DataFrame, gains: list[int]) -> DataFrame:
    """counted with ``weight``, the sum of the gains of a row's features; none: 0."""
    table = np.array(gains, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, counts = batch.column(3), batch.column(4)
            worth = table[lists.flatten().to_numpy()] * counts.flatten().to_numpy()
            ends = np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            sums = np.concatenate([[0], np.cumsum(worth)])
            weight = sums[ends] - sums[np.concatenate([[0], ends[:-1]]).astype(np.int64)] if len(ends) else ends
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], ["id", "n_words", "n_features", "weight"])

    kind = counted.schema["id"].dataType.simpleString()
    return counted.select("id", "n_words", "n_features", "buckets", "counts").mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int = SEED) -> Column:
    """A Gumbel number in thousandths that follows from seed and key; a null key counts as an empty text."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document, drawn ones ranked.

    A document's score is its weight and a Gumbel number, so the highest scores are a draw
    without replacement by importance. Of the documents with ``least_words`` words that many
    percent are drawn; ties go to the smaller doc_id, null last. Empty and null texts have
    weight 0 and are never drawn, very long ones count whole. Repeated rows score alike and
    take neighbouring ranks. Other columns are not looked at. An empty table gives no rows,
    and an empty target weighs all documents against no counts at all.
    """
    tables = Tables()
    source = tables.written(bucket_counts(docs.select(F.col("doc_id").alias("id"), "text"), longest, buckets), "resample-documents")
    wanted = tables.written(bucket_counts(target.select(F.lit(0).alias("id"), "text"), longest, buckets), "resample-target")
    scored = weighed(source, bucket_gains(source, wanted, buckets)).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    # The order is by score from above, null keys last.
    keyed = tables.written(scored.select("id", "n_words", "n_features", "weight", "score", (-F.col("score")).alias("falling"), F.col("id").isNull().alias("no_id")), "resample-scores")
    fit = placed(keyed.where(F.col("n_words") >= least_words), ["falling", "no_id", "id"], tables)
    ranked = fit.select("id", "n_words", "n_features", "weight", "score", F.when(F.col("place") < F.expr(f"among * {percent} DIV 100"), F.col("place") + 1).alias("rank"))
    rest = keyed.where(F.col("n_words") < least_words).select("id", "n_words", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest).withColumnRenamed("id", "doc_id")


def oracle(source: str = "documents", target: str = "benchmark") -> str:
    """SQL for (doc_id, n_features, weight, score, rank) of ``resample`` with single words."""
    words = lambda name, key: f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM {name}"
    return rf"""
WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, x: xor(a >> 1, (a & 1) * 3988292384))) AS t),
docs AS ({words(source, "doc_id, row_number() OVER () AS k")}),
items AS ({words(target, "item_id")}),
doc_words AS (SELECT k, unnest(w) AS f FROM docs),
item_words AS (SELECT unnest(w) AS f FROM items),
bytes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM doc_words UNION SELECT f FROM item_words)),
buckets AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || substr(h, (2 * i - 1)::BIGINT, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM bytes, crc),
s AS (SELECT bucket, count(*) AS n FROM doc_words JOIN buckets USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM item_words JOIN buckets USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM doc_words) + {BUCKETS})::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM item_words) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM buckets) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
sums AS (SELECT k, sum(gain) AS weight FROM doc_words JOIN buckets USING (f) JOIN gains USING (bucket) GROUP BY k),
scored AS (
  SELECT k, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296))))::BIGINT AS score
  FROM docs LEFT JOIN sums USING (k)),
ranks AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {PERCENT} * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranks USING (k)"""
