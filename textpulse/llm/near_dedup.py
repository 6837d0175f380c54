"""Near-duplicate documents by a chosen-path set similarity join over minwise tokens.

A document is the set of its word shingles. Documents with equal sets are one node. Every tree starts by dealing
the nodes out by one minwise token. Nodes that share a bucket with few others are compared with all of them by
their signatures. A large bucket branches by further chosen tokens, each node following two of them, so that its
unrelated members part and similar ones stay together on some path; members close to the middle of a large bucket
(the commonest token at each place) would not part and leave as one cluster. Independent trees are repeated until a
pair at the threshold meets with the wanted probability.

The buckets give candidate links, whose components are candidate clusters. Inside a cluster the links are confirmed
on the full sets: every node is compared with every other, in blocks of bounded size, except that nodes found
linked to a large cluster's middle need no comparison among themselves, as they are in one component already.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.llm.common import located, read, register, small, small_batches, written
from textpulse.llm.components import components
from textpulse.llm.shingles import shingle_set, signature
from textpulse.llm.words import runs

#: Minwise tokens of a signature, of which the first few are the trees' roots.
TOKENS = 128
#: A bucket with more nodes branches instead of comparing them.
BUCKET = 128
#: Places of the signature by which the middle of a large bucket is described.
_PLACES = 32
#: Agreement with the middle from which a node joins its cluster, and up to which it goes on branching as well.
_NEAR, _APART = 0.4, 0.7
_DEPTH = 12
#: Shingles, and documents, of a block of a cluster that is compared at once; a longer document is a block of its own.
BLOCK, MEMBERS = 400_000, 2000


def trees_for(similarity: float, recall: float) -> int:
    """Independent trees after which a pair of this similarity shares a root bucket with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity))


def shingled(docs: DataFrame, key: str, text: str, trees: int) -> DataFrame:
    """``uid, key, _tp_file, _tp_row, n, digest, roots, sig`` of every document, stored. ``n`` is 0 without words."""
    rows = located(docs).select(F.col(key).alias("key"), F.col(text).alias("text"), "_tp_file", "_tp_row")
    schema = f"key {docs.schema[key].dataType.simpleString()}, _tp_file string, _tp_row bigint, n bigint, digest binary, roots array<bigint>, sig binary"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in runs(batches, "text"):
            size, digest, roots, sig = [], [], [], []
            for t in texts:
                s = shingle_set(t)
                values = signature(s, TOKENS)
                size.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                roots.append(values[:trees].tolist())
                sig.append(values.astype(np.uint8).tobytes())
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("key", "_tp_file", "_tp_row")]
            added = [pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(roots, pa.list_(pa.int64())), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays([*kept, *added], names=["key", "_tp_file", "_tp_row", "n", "digest", "roots", "sig"])

    return written(rows.mapInArrow(build, schema).withColumn("uid", F.monotonically_increasing_id()), "shingled")


def _stars(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Edges from the first member of each component of a boolean adjacency matrix to its others."""
    out, left = [], np.ones(len(adjacent), dtype=bool)
    for i in range(len(adjacent)):
        if not left[i]:
            continue
        group = adjacent[i].copy()
        group[i] = True
        reached = group.copy()
        while reached.any():
            grown = adjacent[reached].any(axis=0) & ~group
            group |= grown
            reached = grown
        left &= ~group
        out.extend((i, int(j)) for j in np.flatnonzero(group) if j != i)
    return out


def _small_buckets(members: DataFrame, similarity: float) -> DataFrame:
    """Candidate edges ``a, b`` of buckets (``bucket, node, n, sig``) that have 2 to BUCKET members each.

    Members are compared by signatures, with a margin of five standard errors, and by sizes.
    """
    least = similarity - 5 * math.sqrt(similarity * (1 - similarity) / TOKENS)
    groups = members.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("node", "n", "sig"))).alias("m"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, offsets = lists.values, lists.offsets.to_numpy()
            node, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            sig = np.frombuffer(b"".join(flat.field(2).to_pylist()), dtype=np.uint8).reshape(-1, TOKENS)
            a, b = [], []
            for i, j in zip(offsets, offsets[1:]):
                s, z = sig[i:j], n[i:j]
                same = (s[:, None, :] == s[None, :, :]).mean(axis=2) >= least
                same &= np.minimum.outer(z, z) >= similarity * np.maximum.outer(z, z)
                for x, y in _stars(same):
                    a.append(node[i + x])
                    b.append(node[i + y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return groups.select("m").mapInArrow(compare, "a bigint, b bigint")


_PLACED = sorted(int(i) for i in np.random.default_rng(5).permutation(TOKENS)[:_PLACES])


def _at(place: int) -> Column:
    return F.hex(F.substring("sig", place + 1, 1))


def with_nearness(members: DataFrame, group: str) -> DataFrame:
    """Add ``near``: the share of chosen signature places at which a row has its group's commonest token."""
    commonest = [F.mode(_at(p), deterministic=True).alias(f"_m{p}") for p in _PLACED]
    middle = members.groupBy(group).agg(*commonest)  # counts of at most 256 tokens a place
    same = [F.when(_at(p) == F.col(f"_m{p}"), 1).otherwise(0) for p in _PLACED]
    joined = members.join(middle, group).withColumn("near", sum(same[1:], same[0]) / _PLACES)
    return joined.drop(*(f"_m{p}" for p in _PLACED))


def candidates(nodes: DataFrame, similarity: float, trees: int) -> DataFrame:
    """Candidate edges ``a, b`` between nodes (``node, n, roots, sig``), so that similar nodes are connected."""
    roots = nodes.select("node", F.posexplode("roots").alias("tree", "token"))
    entries = roots.select(F.xxhash64("tree", "token").alias("bucket"), "tree", "node")
    few, stars = [], []
    for depth in range(_DEPTH + 1):
        sizes = written(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "bucket-sizes")
        members = entries.join(sizes, "bucket")
        if not depth:
            members = members.join(nodes.select("node", "n", "sig"), "node")
        members = written(members, "buckets")
        few.append(members.filter(F.col("c") <= BUCKET).select("bucket", "node", "n", "sig"))
        large = members.filter(F.col("c") > BUCKET).drop("c")
        if large.isEmpty():
            break
        placed = written(with_nearness(large, "bucket"), "large-buckets")
        cluster = placed if depth == _DEPTH else placed.filter(F.col("near") >= _NEAR)
        heads = cluster.groupBy("bucket").agg(F.min("node").alias("a"))
        stars.append(cluster.join(heads, "bucket").filter("a <> node").select("a", F.col("node").alias("b")))
        # Branch: each remaining node follows two tokens, chosen anew for each tree and depth.
        pick = lambda i: (F.pmod(F.xxhash64("tree", F.lit(depth), F.lit(i)), F.lit(TOKENS - trees)) + F.lit(trees + 1)).cast("int")
        steps = placed.filter(F.col("near") < _APART).withColumn("place", F.explode(F.array(pick(0), pick(1))))
        token = F.expr("substring(sig, place, 1)")
        entries = steps.select(F.xxhash64("bucket", "place", token).alias("bucket"), "tree", "node", "n", "sig")
    out = _small_buckets(reduce(DataFrame.unionByName, few), similarity)
    return reduce(DataFrame.unionByName, [out, *stars])


def _sets(docs: DataFrame, members: DataFrame, text: str) -> DataFrame:
    """``members`` (with ``_tp_file, _tp_row``) with ``shingles``, the full set of each, made from its whole text again."""
    rows = located(docs).select(F.col(text).alias("text"), "_tp_file", "_tp_row").join(small(members, 300_000), ["_tp_file", "_tp_row"])
    rows = rows.drop("_tp_file", "_tp_row")
    names = [c for c in rows.columns if c != "text"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in runs(batches, "text"):
            sets = [shingle_set(t).view(np.int64) for t in texts]
            ends = np.cumsum([0] + [len(s) for s in sets])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), lists], names=[*names, "shingles"])

    return rows.mapInArrow(build, f"{fields}, shingles array<bigint>")


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray], similarity_percent: int) -> np.ndarray:
    """Boolean matrix: 100 * intersection >= percent * union, for all pairs of two lists of sets. Exact.

    Only shingles that occur on both sides count; their columns are multiplied in strips of bounded size.
    """
    def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    (lv, li), (rv, ri) = flat(left), flat(right)
    common = np.intersect1d(lv, rv)
    inner = np.zeros((len(left), len(right)), dtype=np.float32)

    def columns(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(common, values), max(0, len(common) - 1))
        held = common[at] == values if len(common) else np.zeros(len(values), bool)
        order = np.argsort(at[held], kind="stable")
        return at[held][order], rows[held][order]

    (lc, lr), (rc, rr) = columns(lv, li), columns(rv, ri)
    step = max(1, 4_000_000 // max(1, len(left) + len(right)))
    for c in range(0, len(common), step):
        strips = []
        for cols, rows, n in ((lc, lr, len(left)), (rc, rr, len(right))):
            i, j = np.searchsorted(cols, [c, c + step])
            strip = np.zeros((n, min(step, len(common) - c)), dtype=np.float32)
            strip[rows[i:j], cols[i:j] - c] = 1
            strips.append(strip)
        inner += strips[0] @ strips[1].T
    inner = np.rint(inner).astype(np.int64)
    sizes = np.add.outer([len(s) for s in left], [len(s) for s in right])
    return 100 * inner >= similarity_percent * (sizes - inner)


def _block_links(blocks: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` of blocks: rows ``m`` (list of node, side, shingles). Side 0 is compared with sides 0 and 1."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, offsets = lists.values, lists.offsets.to_numpy()
            node, side, sets = flat.field(0).to_numpy(), flat.field(1).to_numpy(), flat.field(2)
            values, ends = sets.values.to_numpy(), sets.offsets.to_numpy()
            a, b = [], []
            for i, j in zip(offsets, offsets[1:]):
                every = [values[ends[k] : ends[k + 1]] for k in range(i, j)]
                own = int((side[i:j] == 0).sum())
                same = linked_pairs(every[:own], every, percent)
                full = np.zeros((j - i, j - i), dtype=bool)
                full[:own] = same
                full |= full.T
                for x, y in _stars(full):
                    a.append(node[i + x])
                    b.append(node[i + y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return blocks.select("m").mapInArrow(compare, "a bigint, b bigint")


def confirmed(docs: DataFrame, clusters: DataFrame, text: str, percent: int) -> DataFrame:
    """Links ``a, b`` confirmed on full sets, enough to connect all that are linked. ``clusters``: cluster, node, n, sig, _tp_file, _tp_row."""
    weights = clusters.groupBy("cluster").agg(F.sum("n").alias("w"), F.count(F.lit(1)).alias("members"))
    parts = F.greatest(F.ceil(F.col("w") / BLOCK), F.ceil(F.col("members") / MEMBERS))
    weights = written(weights.select("cluster", parts.alias("parts")), "cluster-sizes")
    placed = clusters.join(weights, "cluster")
    sets = written(_sets(docs, placed, text), "sets")
    listed = F.sort_array(F.collect_list(F.struct("side", "node", "shingles")))
    listed = F.transform(listed, lambda x: F.struct(x["node"], x["side"], x["shingles"]))  # bounded by the block size
    one = sets.filter("parts = 1").withColumn("side", F.lit(0))
    links = [_block_links(one.groupBy("cluster").agg(listed.alias("m")), percent)]

    many = sets.filter("parts > 1")
    if not many.isEmpty():
        # The member nearest to the middle is compared with all first.
        near = with_nearness(many, "cluster")
        heads = near.groupBy("cluster").agg(F.max(F.struct("near", -F.col("node"))).alias("h"))
        heads = heads.select("cluster", (-F.col("h.col2")).alias("head"))
        head_sets = many.join(heads, "cluster").filter("node = head").select("cluster", "head", F.col("shingles").alias("theirs"))
        inner = F.size(F.array_intersect("shingles", "theirs"))
        checked = many.join(small(written(head_sets, "heads"), 1000), "cluster").withColumn("inner", inner)
        is_linked = 100 * F.col("inner") >= percent * (F.size("shingles") + F.size("theirs") - F.col("inner"))
        checked = written(checked.select("cluster", "head", "node", "parts", "shingles", is_linked.alias("linked")), "heads-checked")
        links.append(checked.filter("linked and node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")))
        # All others meet everything in pairs of blocks: their own among themselves, and against the linked ones.
        part = F.pmod(F.xxhash64("node"), F.col("parts"))
        dealt = checked.withColumn("part", part)
        free = dealt.filter("not linked")
        as_own = free.withColumn("other", F.explode(F.sequence(F.lit(0), 2 * F.col("parts") - 1)))
        as_own = as_own.filter("other >= part").select(
            "cluster", "part", "other", F.lit(0).alias("side"), "node", "shingles"
        )
        with_free = free.withColumn("mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("part")))).filter("mine < part")
        with_linked = dealt.filter("linked").withColumn("mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        as_other = with_free.select("cluster", F.col("mine").alias("part"), F.col("part").alias("other"), F.lit(1).alias("side"), "node", "shingles")
        as_other = as_other.unionByName(
            with_linked.select("cluster", F.col("mine").alias("part"), (F.col("part") + F.col("parts")).alias("other"), F.lit(1).alias("side"), "node", "shingles")
        )
        pairs = as_own.unionByName(as_other).groupBy("cluster", "part", "other").agg(listed.alias("m"))
        pairs = pairs.filter(F.exists("m", lambda x: x["side"] == 0))
        links.append(_block_links(pairs, percent))
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def near_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, recall: float = 0.999999
) -> DataFrame:
    """One row per document: ``_tp_file, _tp_row, key, n_shingles, component, kept``.

    Documents are linked when 100 * intersection >= ``percent`` * union of their shingle sets; ``component`` is the
    least key reachable over links. Null and empty texts, and texts of white space, have no shingles and are linked
    with nothing: their component is their own key. Exactly one row of a component is ``kept``: the first with the
    least key. Null keys come last. Repeated rows have equal sets and are one component. Other columns are not read;
    an empty table gives no rows.
    """
    similarity = percent / 100
    trees = trees_for(similarity, recall)
    docs = located(small_batches(docs)).drop("_tp_file", "_tp_row")  # stored rows, which are found again by their places
    table = shingled(docs, key, text, trees)
    some = table.filter("n > 0")
    firsts = written(some.groupBy("digest").agg(F.min("uid").alias("node")), "distinct-sets")
    nodes = written(
        some.join(firsts.select(F.col("node").alias("uid")), "uid").select(F.col("uid").alias("node"), "n", "roots", "sig", "_tp_file", "_tp_row"), "nodes"
    )
    near = components(candidates(nodes, similarity, trees))
    clusters = written(nodes.join(near, "node").select(F.col("root").alias("cluster"), "node", "n", "sig", "_tp_file", "_tp_row"), "clusters")
    linked = components(confirmed(docs, clusters, text, percent))

    narrow = table.select("uid", "key", "_tp_file", "_tp_row", "n", "digest")
    whole = narrow.join(firsts.withColumnRenamed("node", "first"), "digest", "left")
    node = F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("uid"))
    whole = whole.withColumn("node", node).join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = written(whole.select("uid", "key", "_tp_file", "_tp_row", "n", "root"), "labelled")
    rank = F.struct(F.col("key").isNull().alias("absent"), "key", "uid")
    least = whole.groupBy("root").agg(F.min(rank).alias("least"))
    return whole.join(least, "root").select(
        "_tp_file", "_tp_row", "key", F.col("n").alias("n_shingles"), F.col("least.key").alias("component"), (F.col("uid") == F.col("least.uid")).alias("kept")
    )


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: the first of every component."""
    rows = located(docs)
    groups = near_groups(rows.drop("_tp_file", "_tp_row"), key, text, percent)
    drops = written(groups.filter(~F.col("kept")).select("_tp_file", "_tp_row"), "near-drops")
    return rows.join(small(drops, 300_000), ["_tp_file", "_tp_row"], "left_anti").drop("_tp_file", "_tp_row")


@register("op10_chosen_path_minhash")
def op10_chosen_path_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document at 85 in 100 of five-word shingles."""
    groups = near_groups(read(spark, folder, "documents"))
    doc, first = F.col("key"), F.col("component")
    return groups.select(doc.alias("doc_id"), "n_shingles", first.alias("component_id"), (doc == first).alias("kept"))
