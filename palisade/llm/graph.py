"""Connected components by repeated contraction, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import Tables, written

#: Edges for each task of a round; rounds only shrink the graph, so late ones get few tasks.
EDGES_A_TASK = 200_000


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs to (node, root): one root per component, for every node of an edge.

    Each round every node points to the neighbour (or itself) that comes first: the one
    with most neighbours, ties by a hash drawn anew, and the graph is contracted along
    these pointers: a star goes in one round, a path loses about two thirds. The pointers
    of all rounds are followed once, at the end. Hubs meet only map-side combined counts
    and minima, and joins whose large side can be split. Nulls and self-links are
    ignored; no edges give no rows.
    """
    tables = Tables()
    edges = tables.written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    moves: list[DataFrame] = []
    while n := edges.count():
        tasks = -(-n // EDGES_A_TASK)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = tables.written(both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree")).coalesce(tasks), "cc-degrees")

        def rank(node: str, turn: int = len(moves)) -> Column:
            return F.struct((-F.col("degree")).alias("degree"), F.xxhash64(node, F.lit(turn)).alias("rank"), F.col(node).alias("node"))

        ranked = both.join(degree.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), rank("b").alias("best"))
        first = ranked.unionByName(degree.select("node", rank("node").alias("best"))).groupBy("node").agg(F.min("best")["node"].alias("up"))
        parent = tables.written(first.coalesce(tasks), "cc-parents")
        moves.append(parent)
        left, right = parent.toDF("a", "ua"), parent.toDF("b", "ub")
        moved = edges.join(left, "a").join(right, "b").where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        edges = tables.written(moved.coalesce(tasks), "cc-edges")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves.pop().withColumnRenamed("up", "root")
    while moves:
        # Nodes of a round whose pointer has no edge left keep it as their root.
        further = roots.withColumnRenamed("node", "up")
        roots = moves.pop().join(further, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    out = written(roots, "cc-roots")
    tables.drop()
    return out
