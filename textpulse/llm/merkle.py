"""Merkle manifest of a table: a tree per group over the digests of its rows, and a tree over the groups.

Every level is one equijoin of its nodes with themselves: a node looks up the indices of its siblings, which are
computed from its own (its index XOR 1 for runs of two, offsets of its slot otherwise), and the nodes of slot zero
then emit the parents. Digests of siblings stay with the level's rows, so that proofs are put together on the way
down, from the root's empty proof, by one join a level.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.llm.common import read, register, small, written
from textpulse.operators.positions import with_position

#: Hexadecimal digits of a digest.
DIGITS = 64
#: Most nodes of a level, and most proofs, that are broadcast: about 8 MB each. Their numbers are computed, not counted.
SMALL_LEVEL, SMALL_PROOFS = 50_000, 4_000
_PROOF = "array<struct<slot: int, others: string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def row_digest(columns: list[Column]) -> Column:
    """Digest of a row: of every value ``-`` if null, else its number of UTF-8 bytes, a colon and the value as text."""
    parts: list[Column] = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return digest(*parts)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof, whose steps hold the slot of the own digest and those of the others."""
    return F.aggregate(
        proof,
        leaf,
        lambda own, step: F.sha2(
            F.concat(
                F.substring(step["others"], F.lit(1), step["slot"] * DIGITS),
                own,
                F.substring(step["others"], step["slot"] * DIGITS + 1, F.length(step["others"])),
            ).cast("binary"),
            256,
        ),
    )


def with_siblings(nodes: DataFrame, arity: int, broadcast: bool) -> DataFrame:
    """``nodes`` (``_tree, _index, _digest``, ...) with ``_slot`` in their run and ``_others``, the siblings' digests in order.

    A tree's root (``_size`` 1) has no siblings and joins nothing. A last run may have fewer nodes, even one.
    """
    nodes = nodes.withColumn("_slot", (F.col("_index") % arity).cast("int"))
    begin = F.col("_index") - F.col("_slot")
    found = []
    for offset in range(1, arity):
        at = F.col("_index").bitwiseXOR(F.lit(1)) if arity == 2 else begin + (F.col("_slot") + offset) % arity
        theirs = nodes.select(
            F.col("_tree").alias("_their_tree"), F.col("_index").alias("_their_index"), F.col("_digest").alias(f"_digest{offset}")
        )
        theirs = F.broadcast(theirs) if broadcast else theirs
        wanted = nodes.withColumn("_at", F.when(F.col("_size") > 1, at))
        match = (F.col("_tree") == F.col("_their_tree")) & (F.col("_at") == F.col("_their_index"))
        nodes = wanted.join(theirs, match, "left").drop("_at", "_their_tree", "_their_index")
        found.append(F.struct((F.col("_slot") + offset) % arity, F.coalesce(f"_digest{offset}", F.lit(""))))
    ordered = F.array_join(F.transform(F.sort_array(F.array(*found)), lambda x: x["col2"]), "")
    return nodes.withColumn("_others", ordered).drop(*[f"_digest{o}" for o in range(1, arity)])


def parents(level: DataFrame, arity: int) -> DataFrame:
    """The nodes above a level, emitted by the nodes of slot zero."""
    return level.filter((F.col("_slot") == 0) & (F.col("_size") > 1)).select(
        "_tree",
        F.expr(f"_index div {arity}").alias("_index"),
        F.expr(f"(_size + {arity - 1}) div {arity}").alias("_size"),
        digest(F.col("_digest"), F.col("_others")).alias("_digest"),
    )


def climbed(nodes: DataFrame, arity: int, largest: int, total: int, trees: int) -> list[DataFrame]:
    """All levels of the trees, from ``nodes`` up, each a stored table with siblings.

    ``largest`` is the size of the largest tree; ``total`` nodes and ``trees`` bound the rows of every level.
    """
    levels = []
    while True:
        broadcast = total <= SMALL_LEVEL
        level = with_siblings(nodes, arity, broadcast)
        levels.append(written(level.coalesce(1) if broadcast else level, "merkle-level"))
        if largest <= 1:
            return levels
        largest, total = -(-largest // arity), total // arity + trees
        nodes = parents(levels[-1], arity)


def roots(levels: list[DataFrame]) -> DataFrame:
    """``_tree, _root``: the node that remains of every tree."""
    found = [x.filter("_size = 1").select("_tree", F.col("_digest").alias("_root")) for x in levels]
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def with_proofs(levels: list[DataFrame], above: DataFrame, arity: int, total: int, trees: int) -> DataFrame:
    """The lowest level with ``_proof``; ``above`` (``_tree, _proof``) has what stands above every tree's root."""
    sizes = [total]
    for _ in levels[1:]:
        sizes.append(sizes[-1] // arity + trees)
    below: DataFrame | None = None
    for size, level in reversed(list(zip(sizes, levels, strict=True))):
        top = level.filter("_size = 1").join(above, "_tree", "left")
        top = top.withColumn("_proof", F.coalesce("_proof", F.array().cast(_PROOF)))
        if below is None:
            out = top
        else:
            over = below.select(F.col("_tree").alias("_over_tree"), F.col("_index").alias("_over_index"), "_proof")
            over = F.broadcast(over) if size // arity + trees <= SMALL_PROOFS else over
            rest = level.filter("_size > 1").withColumn("_over", F.expr(f"_index div {arity}"))
            rest = rest.join(over, (F.col("_tree") == F.col("_over_tree")) & (F.col("_over") == F.col("_over_index")))
            step = F.array(F.struct(F.col("_slot").alias("slot"), F.col("_others").alias("others")))
            rest = rest.withColumn("_proof", F.concat(step.cast(_PROOF), F.col("_proof")))
            out = rest.drop("_over", "_over_tree", "_over_index").unionByName(top)
        below = out
    return below


@dataclass
class Manifest:
    """``rows``: the rows with ``leaf``, ``subroot``, ``root`` and ``proof`` (steps of ``slot, others``, leaf to root);
    ``levels``: stored nodes of the groups' trees; ``top``: those of the tree over the groups."""

    rows: DataFrame
    levels: list[DataFrame]
    top: list[DataFrame]


def manifest(leaves: DataFrame, group: str, order: list[str], arity: int = 2) -> Manifest:
    """Trees over ``leaves``, which have a ``leaf`` digest: one for every ``group`` (null is a group), its leaves
    ascending by ``order`` and then by digest (null first), in runs of ``arity``; and one over the groups' roots,
    ascending by group.

    Rows that are equal in ``order`` and digest are leaves of their own, in any order. One group may hold any share of
    the rows: leaves are numbered by one range-partitioned order over all groups, and levels are joined by index. An
    empty table has no roots and gives no rows.
    """
    if arity < 2:
        raise ValueError("a run has at least two nodes")
    kept = leaves.columns
    placed = with_position(leaves, [group, *order, "leaf"], "_place")
    groups = placed.groupBy(group).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_size"))
    groups = written(groups, "merkle-groups")
    groups = written(with_position(groups, [group], "_tree").withColumn("_tree", F.col("_tree") - 1), "merkle-groups")
    largest, total, trees = groups.agg(F.max("_size"), F.sum("_size"), F.count(F.lit(1))).first()
    named = groups.withColumnRenamed(group, "_group")
    nodes = placed.join(small(named), F.col(group).eqNullSafe(F.col("_group"))).select(
        *kept, "_tree", (F.col("_place") - F.col("_first")).alias("_index"), "_size", F.col("leaf").alias("_digest")
    )
    largest, total = largest or 0, total or 0
    levels = climbed(nodes, arity, largest, total, trees)
    subroots = written(roots(levels), "merkle-subroots")
    over = subroots.select(
        F.lit(0).cast("long").alias("_tree"), F.col("_tree").alias("_index"), F.lit(trees).cast("long").alias("_size"), F.col("_root").alias("_digest")
    )
    top = climbed(over, arity, trees, trees, 1)
    none = subroots.limit(0).select(F.lit(0).cast("long").alias("_tree"), F.array().cast(_PROOF).alias("_proof"))
    above = with_proofs(top, none, arity, trees, 1).select(
        F.col("_index").alias("_tree"), "_proof", F.col("_digest").alias("subroot")
    )
    above = written(above.crossJoin(F.broadcast(roots(top).select(F.col("_root").alias("root")))), "merkle-above")
    proofs = with_proofs(levels, small(above.select("_tree", "_proof")), arity, total, trees)
    rows = proofs.join(small(above.select("_tree", "subroot", "root")), "_tree")
    return Manifest(rows.select(*kept, "subroot", "root", F.col("_proof").alias("proof")), levels, top)


_CRC = """WITH RECURSIVE crc16 AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(4)::BIGINT[]), lambda c, k:
      CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(16))::BIGINT AS i)))"""
_FIELD = "coalesce(CAST(strlen({0}) AS VARCHAR) || ':' || {0}, '-')"


def _sql_leaf(n_chars: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text"]
    return "sha256(" + " || ".join(_FIELD.format(x) for x in fields) + ")"


_SQL = f"""{_CRC},
d AS (
  SELECT doc_id, lang, {_sql_leaf('n_chars')} AS leaf,
         coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(
           string_split(regexp_replace(hex(encode(CAST(doc_id AS VARCHAR))), '(.)(.)', '\\2\\1', 'g'), ''),
           lambda x: CAST(strpos('0123456789ABCDEF', x) - 1 AS BIGINT))), lambda c, x:
           xor(c >> 4, t[xor(c & 15, x) + 1])), 4294967295) % 7 = 0, false) AS chosen,
         {_sql_leaf('(n_chars + 1)')} AS changed
  FROM documents, crc16),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
up AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY i) AS nodes FROM placed GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda j: sha256(nodes[j] || coalesce(nodes[j + 1], '')))
  FROM up WHERE len(nodes) > 1),
sub AS (
  SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM up WHERE len(nodes) = 1),
above AS (
  SELECT 0 AS level, list(subroot ORDER BY i) AS nodes FROM sub
  UNION ALL
  SELECT level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda j: sha256(nodes[j] || coalesce(nodes[j + 1], '')))
  FROM above WHERE len(nodes) > 1),
steps AS (
  SELECT p.doc_id, p.lang, p.leaf, p.i AS leaf_i, 0 AS part, u.level, (p.i >> u.level) AS i, u.nodes
  FROM placed p JOIN up u ON p.lang IS NOT DISTINCT FROM u.lang AND len(u.nodes) > 1
  UNION ALL
  SELECT p.doc_id, p.lang, p.leaf, p.i, 1, a.level, (s.i >> a.level), a.nodes
  FROM placed p JOIN sub s ON p.lang IS NOT DISTINCT FROM s.lang JOIN above a ON len(a.nodes) > 1),
proof AS (
  SELECT lang, leaf_i, list(CAST(i & 1 AS VARCHAR) || coalesce(nodes[xor(i, 1) + 1], '') ORDER BY part, level) AS steps
  FROM steps GROUP BY lang, leaf_i),
whole AS (
  SELECT p.doc_id, p.leaf, s.subroot, r.nodes[1] AS root, CASE WHEN p.chosen THEN p.changed ELSE p.leaf END AS begin,
         coalesce(f.steps, CAST([] AS VARCHAR[])) AS steps
  FROM placed p JOIN sub s ON p.lang IS NOT DISTINCT FROM s.lang JOIN above r ON len(r.nodes) = 1
  LEFT JOIN proof f ON p.lang IS NOT DISTINCT FROM f.lang AND p.i = f.leaf_i),
done AS (
  SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda e: substr(e, 2)), '')) AS proof_sha256,
         list_reduce(list_prepend(begin, steps), lambda own, e:
           sha256(CASE WHEN e[1] = '1' THEN substr(e, 2) || own ELSE own || substr(e, 2) END)) AS folded_root
  FROM whole)
SELECT *, folded_root = root AS verified FROM done"""


@register("op13_merkle_manifest", _SQL)
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether the root follows from its leaf, after changing some leaves.

    Only digests are moved: texts are hashed where they are read, and the leaves are stored before they are ordered.
    """
    docs = read(spark, folder, "documents")

    def leaf(n_chars: Column) -> Column:
        return row_digest([F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")])

    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.col("n_chars").cast("decimal(20,0)") + 1  # cannot overflow
    leaves = docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), F.when(chosen, leaf(more)).alias("_changed"))
    rows = manifest(written(leaves, "merkle-leaves"), "lang", ["doc_id"]).rows
    out = rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join(F.transform("proof", lambda x: x["others"]), "").cast("binary"), 256).alias("proof_sha256"),
        folded(F.coalesce("_changed", "leaf"), F.col("proof")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
