"""How well rules catch labelled subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judged_subjects(subjects: DataFrame, alerts: DataFrame) -> DataFrame:
    """Subjects (kind, variant, malicious, address) with the rules that alerted on the address."""
    hits = alerts.select(F.col("group_key").alias("address"), "rule_id").distinct()
    rules = hits.groupBy("address").agg(F.sort_array(F.collect_set("rule_id")).alias("rules"))
    return subjects.join(rules, "address", "left").withColumn("alerted", F.col("rules").isNotNull())


def score_detection(subjects: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: caught, missed, false, quiet, recall and precision (of subjects that alerted)."""
    j = judged_subjects(subjects, alerts)
    bad, loud = F.col("malicious"), F.col("alerted")
    n = {"caught": F.count_if(bad & loud), "missed": F.count_if(bad & ~loud), "false_alarms": F.count_if(~bad & loud), "quiet": F.count_if(~bad & ~loud)}
    counts = j.agg(*[c.alias(k) for k, c in n.items()])
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 4))
    return counts.select("*", ratio(F.col("caught"), F.col("caught") + F.col("missed")).alias("recall"), ratio(F.col("caught"), F.col("caught") + F.col("false_alarms")).alias("precision"))


def score_by_variant(subjects: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per (kind, variant): subjects, alerted, and the rules that alerted."""
    j = judged_subjects(subjects, alerts)
    rules = F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("rules")))), ",")
    return j.groupBy("kind", "variant").agg(F.count("*").alias("subjects"), F.count_if("alerted").alias("alerted"), rules.alias("rules"))
