"""Alerts kept in step with events: each batch adds its hits and redoes the buckets of groups that these fall into.

Under one path:

* ``events/batch=N``: what came in batch N. Read again only for a rule that is new or has changed.
* ``hits/part=N/rule_version=V/bucket=B``: what each rule counts of batch N (or, from ``compact``, of all
  up to it), without any text. For a keyword rule this is its evidence so far, so old lines are not searched again.
* ``alerts`` and ``evidence``, by ``rule_version`` and ``bucket``: for each bucket what its hits give.
  Only buckets with new hits are written anew.
* ``changes/batch=N`` and ``state/of=N``.

A group's bucket is a hash of its key, and what a bucket's alerts are follows from its hits
alone; so a step that failed half-way is simply run again. More hits never take away
all alerts of a group, so a bucket that has had alerts is always written anew with some.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.alerts import reconcile, summarize_alerts
from palisade.operators.detect import EVIDENCE, HITS, RULE_COLUMNS, detect_hits, hits
from palisade.operators.rules import Rule, fingerprint

#: Buckets that the groups of each rule are dealt to.
BUCKETS = 64
PLACE = "rule_version string, bucket int"
STATE = "batch long, base long, rules array<string>"


def bucket_of(key, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class AlertTables:
    """The tables of a rule set under a path."""

    def __init__(self, spark: SparkSession, path: str, rules: list[Rule], buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.rules = [r for r in rules if r.enabled]
        self.versions = {f"{r.id}@{fingerprint([r])[:16]}": r for r in self.rules}

    def _table(self, name: str, schema: str) -> DataFrame:
        """A table that may not have been written yet: then without rows."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def state(self) -> tuple[int, int, list[str]] | None:
        """(last batch, batch up to which hits are compacted or -1, versions of its rules)."""
        last = self._table("state", STATE).orderBy(F.desc("batch")).first()
        return (last.batch, last.base, last.rules) if last else None

    def read_batch(self, batch_id: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/events/batch={batch_id}")

    def read(self, name: str, batch_id: int | None = None) -> DataFrame:
        """``alerts`` or ``evidence`` of the live rules as they are now, or the ``changes`` of a batch."""
        if name == "changes":
            return self.spark.read.parquet(f"{self.path}/changes/batch={batch_id}")
        schema = self.alert_schema() if name == "alerts" else EVIDENCE
        return self._table(name, f"{schema}, {PLACE}").where(F.col("rule_version").isin(*self.versions)).drop("rule_version", "bucket")

    def alert_schema(self) -> str:
        empty = summarize_alerts(self.spark.createDataFrame([], EVIDENCE), self.rules)
        return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in empty.schema.fields)

    def stored_hits(self, upto: int, base: int) -> DataFrame:
        """All hits up to a batch: what was compacted, and the batches since."""
        live = (F.col("part") > base) & (F.col("part") <= upto)
        live = live | (F.col("part") == -1 - base) if base >= 0 else live
        return self._table("hits", f"{HITS}, part long, {PLACE}").where(live).drop("part")

    def hits_of(self, events: DataFrame, versions: list[str]) -> DataFrame:
        """What rules count of events, with rule_version and bucket."""
        seen = events.select(*RULE_COLUMNS)
        found = [hits(seen, self.versions[v]).withColumn("rule_version", F.lit(v)) for v in versions]
        whole = reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], f"{HITS}, rule_version string")
        return whole.withColumn("bucket", bucket_of(F.col("key"), self.buckets))

    def store_hits(self, rows: DataFrame, part: int) -> None:
        """One file for each bucket."""
        dealt = rows.repartition("rule_version", "bucket")
        dealt.write.mode("overwrite").partitionBy("rule_version", "bucket").parquet(f"{self.path}/hits/part={part}")

    def evidence_from(self, rows: DataFrame, versions: Iterable[str] | None = None) -> DataFrame:
        """Evidence of stored hits, rule by rule (of some versions only, where these are named), with the bucket of each group."""
        named = [(v, r) for v, r in self.versions.items() if versions is None or v in versions]
        found = [detect_hits(rows.where(F.col("rule_version") == v).select("key", "t", "id", "port", "steps", "spans"), r).withColumn("rule_version", F.lit(v)) for v, r in named]
        whole = reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], f"{EVIDENCE}, rule_version string")
        return whole.withColumn("bucket", bucket_of(F.col("group_key"), self.buckets))

    def touched(self, part: int) -> dict[str, list[int]]:
        """The buckets with hits in a batch; ``buckets`` for each rule at most."""
        rows = self._table("hits", f"{HITS}, part long, {PLACE}").where(F.col("part") == part).select("rule_version", "bucket").distinct().collect()
        return {v: sorted(r.bucket for r in rows if r.rule_version == v) for v in {r.rule_version for r in rows}}

    def step(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Take in a batch; returns (alert_key, status) of the alerts of the buckets that it touches.

        Running a batch again replaces what it wrote. A rule that is new or has changed
        is looked for in all events so far, and what other versions of it gave is not read any more.
        """
        batch.write.mode("overwrite").parquet(f"{self.path}/events/batch={batch_id}")
        before = self.state()
        base, known = (before[1], set(before[2])) if before else (-1, set())
        new = [v for v in self.versions if v not in known]
        fresh = self.hits_of(self.read_batch(batch_id), [v for v in self.versions if v in known])
        if new:
            everything = self.spark.read.parquet(f"{self.path}/events").where(F.col("batch") <= batch_id)
            fresh = fresh.unionByName(self.hits_of(everything, new))
        self.store_hits(fresh, batch_id)
        touched = self.touched(batch_id)
        if touched:
            place = reduce(lambda a, b: a | b, ((F.col("rule_version") == v) & F.col("bucket").isin(*b) for v, b in sorted(touched.items())))
            # Buckets of evidence are written at once in their place, and alerts made from what stands there.
            self.write_buckets("evidence", self.evidence_from(self.stored_hits(batch_id, base).where(place), touched))
            evidence = self._table("evidence", f"{EVIDENCE}, {PLACE}").where(place)
            version = F.element_at(F.create_map(*(F.lit(x) for v, r in self.versions.items() for x in (r.id, v))), F.col("rule_id"))
            placed = summarize_alerts(evidence, self.rules).withColumns({"rule_version": version, "bucket": bucket_of(F.col("group_key"), self.buckets)})
            alerts = self.stored(placed, f"redone/alerts-{batch_id}")
            old = self._table("alerts", f"{self.alert_schema()}, {PLACE}").where(place)
            self.stored(reconcile(old, alerts), f"changes/batch={batch_id}")
            self.write_buckets("alerts", alerts)
        else:
            self.stored(self.spark.createDataFrame([], "alert_key string, status string"), f"changes/batch={batch_id}")
        self.write_state(batch_id, base)
        return self.read("changes", batch_id)

    def write_buckets(self, name: str, rows: DataFrame) -> None:
        """One file for each bucket in rows; other buckets stay."""
        rows.repartition("rule_version", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("rule_version", "bucket").parquet(f"{self.path}/{name}")

    def write_state(self, batch_id: int, base: int) -> None:
        self.stored(self.spark.createDataFrame([(batch_id, base, list(self.versions))], STATE), f"state/of={batch_id}")

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def compact(self) -> None:
        """Fold the hits of all batches so far into one part, a file for each bucket; the next steps read that and what comes after."""
        state = self.state()
        if state is None or state[0] <= state[1]:
            return
        rows = self.stored_hits(state[0], state[1]).where(F.col("rule_version").isin(*self.versions))
        self.store_hits(rows, -1 - state[0])
        self.write_state(state[0], state[0])
