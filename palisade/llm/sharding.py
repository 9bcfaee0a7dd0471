"""Contiguous shards of about equal bytes: prefix sums from the totals of ranges, cut at equal targets.

Documents stand in the order of their text's MD5, then of doc_id. That order deals every
source and language evenly, is the same whatever the table's files, and puts equal texts
next to each other, so a group of copies is cut only where it has to be.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import Tables
from palisade.llm.order import placed

SHARDS = 8
LAW = "bytes"


def cuts(rows: DataFrame, shards: int) -> list[int]:
    """Where shards 1, 2, ... start, in bytes of the whole order.

    Each target is moved to the nearer edge of the document that it falls into; or of that
    document's group of equal texts, if the group is no larger than the largest
    document. So a shard is off its target by no more than the largest document. One
    document and one group for each target are brought to the driver.
    """
    total, largest = rows.agg(F.sum("size"), F.max("size")).first()
    if not total:
        return [0] * (shards - 1)
    targets = [k * total // shards for k in range(1, shards)]
    # No document crosses more targets than there are; the last byte's target is the end of all.
    inside = F.exists(F.array(*[F.lit(t).cast("long") for t in targets]), lambda t: (F.col("start") <= t) & (t < F.col("start") + F.col("size"))) if targets else F.lit(False)
    crossed = rows.where(inside).select("digest", "start", "size").collect()
    names = list({r.digest for r in crossed})
    groups = {r.digest: (r.lo, r.n) for r in rows.where(F.col("digest").isin(names)).groupBy("digest").agg(F.min("start").alias("lo"), F.sum("size").alias("n")).collect()}
    crossed.sort(key=lambda r: r.start)
    starts, out = [r.start for r in crossed], []
    for target in targets:
        row = crossed[bisect_right(starts, target) - 1]
        lo, n = groups[row.digest] if groups[row.digest][1] <= largest else (row.start, row.size)
        out.append(lo if target - lo <= lo + n - target else lo + n)
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): every document's shard and its place there, from 0.

    A document's size is its text's UTF-8 bytes and one more; a null text has no bytes, as an
    empty one, and equals it. Shards are off their equal share by no more than the largest
    document; with fewer documents than shards some stay empty. Repeated rows and null
    doc_ids (first) are documents like any other; of wholly equal rows it is open which comes
    first, as nothing tells them apart. A very long text leaves the scan as its digest only.
    Other columns are not looked at. An empty table gives no rows.
    """
    tables = Tables()
    text = F.coalesce("text", F.lit("")).cast("binary")
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("digest"))
    rows = tables.written(placed(slim, ["digest", "doc_id"], tables, size="size"), "shard-places")
    bounds = F.array(F.lit(0).cast("long"), *[F.lit(c).cast("long") for c in cuts(rows, shards)])
    # An empty shard's cut is the next one's too: the last of equal cuts holds the rows.
    shard = F.size(F.filter(bounds, lambda c: c <= F.col("start"))) - 1
    told = rows.withColumn("shard", shard)
    first = told.groupBy("shard").agg(F.min("place").alias("first"))
    slots = told.join(F.broadcast(first), "shard")  # a row for each shard
    return slots.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def shard_sizes(sharded: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(shard, documents, bytes, share): every shard, empty ones too, with its bytes over an equal share."""
    every = sharded.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    sums = sharded.groupBy("shard").agg(F.count("*").alias("documents"), F.sum("size").alias("bytes"))
    filled = every.join(sums, "shard", "left").select("shard", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
    total = F.sum("bytes").over(Window.partitionBy(F.lit(0)))
    return filled.withColumn("share", F.col("bytes") * shards / F.nullif(total, F.lit(0)))


def oracle(table: str = "documents", shards: int = SHARDS) -> str:
    """SQL for ``shard_documents``: one window over the whole table; CRC-32 bit by bit from a table of bytes."""
    return rf"""
WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, x: xor(a >> 1, (a & 1) * 3988292384))) AS t),
sized AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size, md5(coalesce(text, '')) AS digest FROM {table}),
texts AS (SELECT DISTINCT digest, hex(encode(text)) AS h FROM sized),
sums AS (
  SELECT digest, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || substr(h, (2 * i - 1)::BIGINT, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM texts, crc),
ordered AS (
  SELECT *, row_number() OVER o - 1 AS place, sum(size) OVER o - size AS start, sum(size) OVER () AS total, max(size) OVER () AS largest, sum(size) OVER (PARTITION BY digest) AS group_size
  FROM sized WINDOW o AS (ORDER BY digest, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
edges AS (SELECT *, min(start) OVER (PARTITION BY digest) AS group_start FROM ordered),
bounded AS (
  SELECT *, CASE WHEN group_size <= largest THEN group_start ELSE start END AS lo, CASE WHEN group_size <= largest THEN group_size ELSE size END AS n FROM edges),
cuts AS (
  SELECT k, CASE WHEN k * total // {shards} - lo <= lo + n - k * total // {shards} THEN lo ELSE lo + n END AS cut
  FROM bounded JOIN range(1, {shards}) r(k) ON start <= k * total // {shards} AND k * total // {shards} < start + size),
dealt AS (SELECT *, (SELECT count(*) FROM cuts WHERE cut <= o.start) AS shard FROM ordered o)
SELECT doc_id, size::BIGINT AS size, text_crc32, '{LAW}' AS law, shard::INT AS shard, place - min(place) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard
FROM dealt JOIN sums USING (digest)"""
