"""Places in a global order: rows in ranges of the order, totals of each range, sums of the totals before it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from palisade.llm.common import Tables


def with_starts(rows: DataFrame, size: str) -> DataFrame:
    """rows with ``start``: the sum of ``size`` over the rows before in the same partition, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            sizes = batch.column(batch.schema.get_field_index(size)).to_numpy(zero_copy_only=False)
            ends = before + np.cumsum(sizes, dtype=np.int64)
            before = int(ends[-1]) if len(ends) else before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - sizes, pa.int64())], [*batch.schema.names, "start"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("start", LongType())]))


def placed(rows: DataFrame, order: list[str], tables: Tables, group: str | None = None, size: str | None = None) -> DataFrame:
    """rows with ``place``, from 0 in the order of ``order`` inside each group, and ``among``, the rows of the group.

    ``size`` adds ``start``, the sum of that column over all rows of the group before. Rows
    are dealt by ranges of (group, order), so a group of any size is spread over tasks, and
    so are equal rows: what is left of ties is told apart by where a row was read. Only a
    row for each range and group meets by group. Groups must not be null; both tables are
    written, so numbers stay what they are when an executor is lost.
    """
    of = [group] if group else []
    read = tables.written(rows, "unordered").withColumn("tie", F.monotonically_increasing_id())
    dealt = read.repartitionByRange(*of, *order, "tie").sortWithinPartitions(*of, *order, "tie").drop("tie")
    dealt = with_starts(dealt, size) if size else dealt
    ranged = tables.written(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ordered")
    sums = [F.sum(size).alias("bytes"), F.min("start").alias("first_start")] if size else []
    totals = ranged.groupBy("part", *of).agg(F.min("at").alias("first_at"), F.count("*").alias("rows"), *sums)
    whole = Window.partitionBy(*of)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    more = [(base("bytes") - F.col("first_start")).alias("start_base")] if size else []
    totals = tables.written(totals.select("part", *of, (base("rows") - F.col("first_at")).alias("base"), F.sum("rows").over(whole).alias("among"), *more), "ranges")
    found = ranged.join(totals, ["part", *of]).withColumn("place", F.col("base") + F.col("at"))
    return (found.withColumn("start", F.col("start") + F.col("start_base")).drop("start_base") if size else found).drop("part", "at", "base")
