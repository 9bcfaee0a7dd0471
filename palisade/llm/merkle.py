"""Merkle manifest of a table: one root over groups of rows, and for each row what proves that it is under the root.

Levels are windows: nodes are dealt by (group, block) and each run of nodes with one
parent is a window; its ordered list, over the full frame, gives the parent's preimage
and each child's siblings, and the run's first row becomes the parent. A block is
LEVELS levels high, so a block's levels share one shuffle, and all that is passed on is
a row for each block; a group of any size is as many blocks as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import Tables
from palisade.llm.order import placed

ARITY = 2
#: Levels that one block of nodes is high.
LEVELS = 5
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<before:string,after:string>>"
NO_STEPS = f"CAST(array() AS {STEPS})"
#: What the whole table is one group by.
ALL = "all"


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts one after the other, in lowercase hexadecimal digits."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value that cannot run into its neighbours: its length in UTF-8 bytes, a colon, itself; null is a dash."""
    said = value.cast("string")
    return F.when(said.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, start, lambda below, step: digest(step["before"], below, step["after"]))


def proof(steps: Column) -> Column:
    """SHA-256 of all siblings, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def block_of(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (grp, place, n, hash, item) to the nodes LEVELS levels up, with ``below``: (item, steps) of the nodes under each."""
    rows = nodes.withColumn("block", F.expr(f"place DIV {arity**LEVELS}"))
    # Dealt by block once: the windows of all its levels lie inside.
    rows = rows.repartition("grp", "block").select("grp", "block", "place", "n", "hash", F.array(F.struct("item", F.expr(NO_STEPS).alias("steps"))).alias("below"))
    for _ in range(LEVELS):
        rows = rows.withColumn("parent", F.expr(f"place DIV {arity}"))
        run = Window.partitionBy("grp", "block", "parent").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn("run", F.collect_list(F.struct("hash", "below")).over(run)).where(F.col("place") == F.col("parent") * arity)
        # Under a name of its own: inside a lambda "n" would be the new column.
        rows = rows.withColumn("many", F.col("n") > 1)

        def under(child: Column, i: Column) -> Column:
            before = F.array_join(F.slice(F.col("run.hash"), F.lit(1), i), "")
            after = F.array_join(F.slice(F.col("run.hash"), i + 2, F.lit(arity)), "")
            step = F.when(F.col("many"), F.array(F.struct(before.alias("before"), after.alias("after")))).otherwise(F.expr(NO_STEPS))
            return F.transform(child["below"], lambda b: F.struct(b["item"].alias("item"), F.concat(b["steps"], step).alias("steps")))

        rows = rows.select(
            "grp",
            "block",
            F.col("parent").alias("place"),
            F.when(F.col("many"), F.ceil(F.col("n") / F.lit(arity))).otherwise(F.col("n")).cast("long").alias("n"),
            F.when(F.col("many"), F.sha2(F.array_join("run.hash", ""), 256)).otherwise(F.col("hash")).alias("hash"),
            F.flatten(F.transform("run", under)).alias("below"),
        )
    return rows.drop("block")


def levels(nodes: DataFrame, most: int, tables: Tables, arity: int) -> list[DataFrame]:
    """Written tables of blocks from the leaves to one node of each group; ``most`` is the largest group."""
    out = []
    while not out or most > 1:
        below = nodes if not out else out[-1].select("grp", "place", "n", "hash", F.col("place").alias("item"))
        out.append(tables.written(block_of(below, arity), "merkle"))
        most = -(-most // arity**LEVELS)
    return out


def down(blocks: list[DataFrame], tails: DataFrame) -> DataFrame:
    """(grp, item, steps, ...) of the lowest nodes; tails (grp, steps, ...) lead from each group's last node to the root."""
    above = tails.withColumn("place", F.lit(0).cast("long")).withColumnRenamed("steps", "tail")
    carried = [c for c in tails.columns if c not in ("grp", "steps")]
    for depth, table in reversed(list(enumerate(blocks))):
        met = table.select("grp", "place", "below").join(above, ["grp", "place"])
        each = met.select("grp", *carried, "tail", F.explode("below").alias("b")).select("grp", *carried, F.col("b.item").alias("item"), F.concat("b.steps", "tail").alias("steps"))
        above = each.withColumnRenamed("item", "place").withColumnRenamed("steps", "tail")
        if depth == 0:
            return each
    raise ValueError("no levels")


def under_root(leaves: DataFrame, order: list[str], tables: Tables, arity: int = ARITY) -> DataFrame:
    """leaves (grp, leaf, ...) with ``subroot`` of their group, ``root`` of all, and ``steps`` from the leaf to the root.

    Leaves of a group stand in the order given, equal ones in any (they are interchangeable);
    groups stand in the order of grp, which must not be null.
    """
    own = [c for c in leaves.columns if c != "grp"]
    rows = tables.written(placed(leaves, order, tables, group="grp"), "merkle-leaves")
    nodes = rows.select("grp", "place", F.col("among").alias("n"), F.col("leaf").alias("hash"), F.struct(*own).alias("item"))
    blocks = levels(nodes, rows.agg(F.max("among")).first()[0] or 0, tables, arity)
    groups = tables.written(placed(blocks[-1].select("grp", "hash"), ["grp"], tables), "merkle-groups")
    tops = groups.select(F.lit(ALL).alias("grp"), "place", F.col("among").alias("n"), F.col("hash"), F.struct("grp", "hash").alias("item"))
    upper = levels(tops, groups.agg(F.max("among")).first()[0] or 0, tables, arity)
    tails = down(upper, upper[-1].select("grp", F.expr(NO_STEPS).alias("steps"), F.col("hash").alias("root")))
    tails = tails.select(F.col("item.grp").alias("grp"), "steps", F.col("item.hash").alias("subroot"), "root")
    return down(blocks, tails).select("grp", "item.*", "subroot", "root", "steps")


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id", group: str = "lang", arity: int = ARITY, probe: Column | None = None) -> DataFrame:
    """(key, group, leaf, subroot, root, steps) of every row; ``probe``, a leaf of the caller's own, travels along where given.

    A leaf is the digest of the columns, null being told from any text. Groups stand in the
    order of their UTF-8 bytes, null (a group like any other) first, and rows of a group by
    key, null first, then by leaf, so rows that repeat a key have a defined place; wholly
    equal rows have neighbouring places and may swap them. Empty texts are texts; of a
    text of any length only its digest leaves the scan. Columns that are not named stay out,
    whatever they are called. An empty table gives no rows.
    """
    tables = Tables()
    named = F.col(group).cast("string")
    carried = [probe.alias("probe")] if probe is not None else []
    leaves = docs.select(F.coalesce(F.concat(F.lit("+"), named), F.lit("")).alias("grp"), F.col(key).alias("key"), leaf(*map(F.col, columns)).alias("leaf"), *carried)
    found = under_root(leaves, ["key", "leaf"], tables, arity)
    told = F.when(F.col("grp") != "", F.substring("grp", 2, 2**31 - 1))
    return found.select(F.col("key").alias(key), told.alias(group), "leaf", *(["probe"] if carried else []), "subroot", "root", "steps")


def differences(docs: DataFrame, known: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id") -> DataFrame:
    """(key, leaf, in_docs, in_manifest): how often rows occur where documents and a manifest of them disagree.

    A changed row is two of these, its former leaf and its new one. Nothing is left where
    both agree, repeated rows, null keys and empty tables included.
    """
    now = docs.select(F.col(key).alias("key"), leaf(*map(F.col, columns)).alias("leaf"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    was = known.select(F.col(key).alias("key"), "leaf", F.lit(0).alias("a"), F.lit(1).alias("b"))
    counts = now.unionByName(was).groupBy("key", "leaf").agg(F.sum("a").alias("in_docs"), F.sum("b").alias("in_manifest"))
    return counts.where("in_docs <> in_manifest").select(F.col("key").alias(key), "leaf", "in_docs", "in_manifest")


def tampered(docs: DataFrame) -> Column:
    """The leaf of a row after n_chars grew by one where 7 divides the CRC-32 of doc_id; all others stay what they are."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    grown = F.when(hit, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    return leaf(*[grown.cast("decimal(20,0)") if c == "n_chars" else F.col(c) for c in COLUMNS])


def checked(docs: DataFrame) -> DataFrame:
    """The manifest of documents with each row's proof, and what becomes of the root where rows are tampered with.

    (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified); edges as in ``manifest``.
    A null doc_id is never tampered with, and a null n_chars stays null.
    """
    found = manifest(docs, probe=tampered(docs)).withColumn("folded_root", folded(F.col("probe"), F.col("steps")))
    return found.select("doc_id", "leaf", "subroot", "root", proof(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle(table: str = "documents") -> str:
    """SQL for ``checked``: every level by one grouping of the level below, every proof by a walk upwards."""
    said = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR END"
    of = lambda columns: "sha256(" + " || ".join(map(said, columns)) + ")"
    grown = [f"n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END" if c == "n_chars" else c for c in COLUMNS]
    nodes = lambda name, start: f"""{name} AS (
  SELECT grp, 0 AS level, place, n, hash FROM {start}
  UNION ALL
  SELECT grp, any_value(level) + 1, place // {ARITY}, (any_value(n) + {ARITY - 1}) // {ARITY}, sha256(string_agg(hash, '' ORDER BY place)) FROM {name} WHERE n > 1 GROUP BY grp, place // {ARITY})"""  # noqa: E731
    walk = lambda name, start, tree: f"""{name} AS (
  SELECT k, grp, 0 AS level, place, n, proof, folded FROM {start}
  UNION ALL
  SELECT k, f.grp, f.level + 1, f.place // 2, (f.n + 1) // 2, proof || coalesce(s.hash, ''),
    sha256(CASE WHEN f.place % 2 = 1 THEN s.hash ELSE '' END || folded || CASE WHEN f.place % 2 = 0 THEN coalesce(s.hash, '') ELSE '' END)
  FROM {name} f LEFT JOIN {tree} s ON s.grp = f.grp AND s.level = f.level AND s.place = xor(f.place, 1) WHERE f.n > 1)"""  # noqa: E731
    return rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, x: xor(a >> 1, (a & 1) * 3988292384))) AS t),
docs AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM {table}, crc),
leaves AS (SELECT doc_id, coalesce('+' || lang, '') AS grp, {of(COLUMNS)} AS hash, {of(grown)} AS folded FROM docs),
places AS (SELECT *, row_number() OVER () AS k, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, hash) - 1 AS place, count(*) OVER (PARTITION BY grp) AS n, '' AS proof FROM leaves),
{nodes("tree", "places")},
subroots AS (SELECT grp AS lang, 'all' AS grp, hash, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1),
{nodes("top", "subroots")},
{walk("low", "places", "tree")},
met AS (SELECT k, s.grp, s.place, s.n, proof, folded FROM low l JOIN subroots s ON s.lang = l.grp WHERE l.n = 1),
{walk("high", "met", "top")}
SELECT p.doc_id, p.hash AS leaf, s.hash AS subroot, r.hash AS root, sha256(h.proof) AS proof_sha256, h.folded AS folded_root, h.folded = r.hash AS verified
FROM places p JOIN subroots s ON s.lang = p.grp JOIN high h ON h.k = p.k AND h.n = 1, (SELECT hash FROM top WHERE n = 1) r"""
