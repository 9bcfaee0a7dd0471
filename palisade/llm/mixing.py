"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's mean repetition rate is its share of the target over its share of the
corpus. Each document's count is the inverse of the Poisson distribution with that
mean at a uniform number hashed from (seed, doc_id); copies are exploded and dealt out
and ordered by another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import shuffle_partitions, written

SEED = "mix-1"
#: Target share of a source is proportional to (its documents) ** TEMPERATURE where no weights are given.
TEMPERATURE = 0.5
#: Steps of the inverse; mean rates above RATE_STEP are sums of Poisson numbers with smaller means.
STEPS, RATE_STEP = 40, 8.0
HASH_DIGITS = 13
#: Sources whose rates are broadcast, and the parts that each source's rows are dealt to beyond that.
MOST_BROADCAST, SALTS = 100_000, 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of MD5."""
    digits = F.substring(F.md5(F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])), 1, HASH_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**HASH_DIGITS))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """(source, n_docs, rate): mean copies per document, so that the expected sum is epochs times the corpus.

    Sources missing from ``weights`` get weight 0; without weights all sources count,
    by temperature. Null is a source like any other.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    if weights is None:
        weight: Column = F.pow(F.col("n_docs").cast("double"), F.lit(TEMPERATURE))
    else:
        given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]) if weights else F.expr("CAST(map() AS map<string,double>)")
        weight = F.coalesce(F.element_at(given, F.col("source")), F.lit(0.0))
    weighed = written(counts.withColumn("weight", weight), "mix-weights")
    all_weight, all_docs = weighed.agg(F.sum("weight"), F.sum("n_docs")).first()
    rate = F.lit(epochs) * F.col("weight") * F.lit(all_docs) / (F.lit(all_weight) * F.col("n_docs")) if all_weight else F.lit(0.0)
    return weighed.select("source", "n_docs", rate.alias("rate"))


def poisson_count(u: Column, rate: Column) -> Column:
    """The smallest k whose distribution function at ``rate`` is above u."""
    first = F.exp(-rate)
    start = F.struct(first.alias("term"), first.alias("below"), F.when(u < first, F.lit(0)).otherwise(F.lit(1)).alias("k"))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] * rate / j
        below = acc["below"] + term
        return F.struct(term.alias("term"), below.alias("below"), (acc["k"] + F.when(u >= below, F.lit(1)).otherwise(F.lit(0))).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda acc: acc["k"])


def with_rate(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """rows (source, ...) with their source's rate.

    Up to MOST_BROADCAST sources the rates are broadcast and no row moves; more meet
    the rows by (source, salt), so that a source with many rows is spread.
    """
    named = rates.select(F.col("source").alias("of"), "rate")
    same = F.col("source").eqNullSafe(F.col("of"))
    if named.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(named), same).drop("of")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    spread = named.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return salted.join(spread, same & (F.col("salt") == F.col("of_salt"))).drop("of", "salt", "of_salt")


def replicated(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: str = SEED) -> DataFrame:
    """docs' columns with ``mix_copy`` (from 0) and ``mix_key``, every row as often as its count says, shuffled globally.

    The result is in the order of the hash ``mix_key``: as that is uniform, partitions are
    equal ranges of it, known beforehand. Counts depend on seed, doc_id and the
    source's rate only: repeated rows are repeated alike; a null doc_id is hashed as a
    value of its own. Means above RATE_STEP are drawn as sums, which keeps the
    distribution exact. Texts are moved once, very long ones too, and never looked at.
    Columns of docs named mix_copy or mix_key are replaced; all others stay, whatever
    their names. An empty table gives no rows.
    """
    own = [c for c in docs.columns if c not in ("mix_copy", "mix_key")]
    rows = docs.select(F.struct(*own).alias("document"), F.col("doc_id").alias("id"), F.col("source").alias("source"))
    joined = with_rate(rows, source_rates(docs, weights, epochs))
    parts = F.greatest(F.ceil(F.col("rate") / F.lit(RATE_STEP)), F.lit(1)).cast("int")
    each = F.col("rate") / parts
    draws = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: poisson_count(uniform(F.lit(seed), F.col("id"), i), each))
    copies = joined.withColumn("n", F.aggregate(draws, F.lit(0), lambda a, b: a + b)).where("n > 0")
    copies = copies.select("document", "id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("mix_copy"))
    key = F.md5(F.concat_ws("/", F.lit(seed), F.lit("order"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("mix_copy").cast("string")))
    n = shuffle_partitions(docs.sparkSession)
    place = F.shiftright(F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long") * n, 32)
    dealt = copies.withColumn("mix_key", key).repartitionById(n, place.cast("int")).sortWithinPartitions("mix_key")
    return dealt.select("document.*", "mix_copy", "mix_key")


def oracle(table: str = "documents", seed: str = SEED) -> str:
    """SQL for (doc_id, source, mix_copy, mix_key) of ``replicated`` without weights, in one step per count."""
    return f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n_docs FROM {table} GROUP BY source),
rates AS (
  SELECT source, n_docs, 1.0::DOUBLE * pow(n_docs::DOUBLE, {TEMPERATURE}::DOUBLE) * (SELECT sum(n_docs) FROM counts)::DOUBLE
    / ((SELECT sum(pow(n_docs::DOUBLE, {TEMPERATURE}::DOUBLE)) FROM counts) * n_docs::DOUBLE) AS rate FROM counts),
steps AS (
  SELECT source, rate, greatest(ceil(rate / {RATE_STEP}::DOUBLE), 1)::INT AS parts, 0 AS j, exp(-(rate / greatest(ceil(rate / {RATE_STEP}::DOUBLE), 1))) AS term,
    exp(-(rate / greatest(ceil(rate / {RATE_STEP}::DOUBLE), 1))) AS below FROM rates
  UNION ALL
  SELECT source, rate, parts, j + 1, term * (rate / parts) / (j + 1), below + term * (rate / parts) / (j + 1) FROM steps WHERE j < {STEPS}),
draws AS (
  SELECT d.doc_id, d.source, i, ('0x' || substr(md5('{seed}/' || coalesce(d.doc_id::VARCHAR, 'null') || '/' || i), 1, {HASH_DIGITS}))::BIGINT::DOUBLE / {float(16**HASH_DIGITS)!r}::DOUBLE AS u
  FROM (SELECT DISTINCT doc_id, source FROM {table}) d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source,
    range(greatest(ceil(r.rate / {RATE_STEP}::DOUBLE), 1)::BIGINT) t(i)),
sums AS (
  SELECT d.doc_id, d.source, sum((SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source AND d.u >= s.below)) AS k
  FROM draws d GROUP BY d.doc_id, d.source)
SELECT d.doc_id, d.source, c::INT AS mix_copy, md5('{seed}/order/' || coalesce(d.doc_id::VARCHAR, 'null') || '/' || c) AS mix_key
FROM {table} d JOIN sums s ON d.doc_id IS NOT DISTINCT FROM s.doc_id AND d.source IS NOT DISTINCT FROM s.source, range(s.k::BIGINT) t(c)"""
