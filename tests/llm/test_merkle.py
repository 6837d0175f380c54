"""The Merkle manifest against a plain construction, for several run lengths and awkward tables."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from textpulse.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + arity])) for i in range(0, len(now), arity)])
    return levels


def proof(levels, i, arity):
    out = []
    for now in levels[:-1]:
        begin = i - i % arity
        out.append((i - begin, "".join(x for j, x in enumerate(now[begin : begin + arity], begin) if j != i)))
        i //= arity
    return out


def fold(own, steps):
    for slot, others in steps:
        own = sha(others[: 64 * slot] + own + others[64 * slot :])
    return own


def plain(leaves, arity):
    """(group, order, leaf) -> rows of (order, leaf, subroot, root, proof)."""
    groups = sorted({g for g, _, _ in leaves}, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in groups:
        own = sorted((x for x in leaves if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        trees.append((own, climb([x[2] for x in own], arity)))
    top = climb([levels[-1][0] for _, levels in trees], arity)
    rows = []
    for k, (own, levels) in enumerate(trees):
        above = proof(top, k, arity)
        for i, (_, key, leaf) in enumerate(own):
            rows.append((key, leaf, levels[-1][0], top[-1][0], proof(levels, i, arity) + above))
    return rows


TABLES = {
    "many": [("en" if i % 3 else "fr", i) for i in range(37)] + [(None, 4), ("de", 9), ("é", 2), ("z", 1)],
    "hot": [("en", i) for i in range(100)] + [("de", 1)],
    "ties": [("en", 5), ("en", 5), ("en", None), ("en", None), ("", 1), (None, None)],
    "one": [("en", 1)],
    "none": [],
}


@pytest.mark.parametrize(("name", "arity"), [("many", 2), ("hot", 3), ("ties", 2), ("one", 2), ("none", 3)])
def test_manifest(spark, name, arity):
    rows = [(g, i, sha(f"{g}{i}"), "x", "y") for g, i in TABLES[name]]
    table = spark.createDataFrame(rows, "lang string, doc_id bigint, leaf string, slot string, digest string").repartition(3)
    out = merkle.manifest(table, "lang", ["doc_id"], arity).rows
    assert out.columns == [*table.columns, "subroot", "root", "proof"]
    out = out.withColumn("back", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    found = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["proof"]]) for r in out]
    wanted = plain([r[:3] for r in rows], arity)
    assert sorted(map(repr, found)) == sorted(map(repr, wanted))
    for r in out:
        assert r["back"] == r["root"] == fold(r["leaf"], [tuple(s) for s in r["proof"]])


def test_query_detects_changed_rows(spark, tmp_path):
    rows = [(i, "t é" * (i % 4) if i % 5 else None, ["en", "de", None][i % 3], "s", i if i % 6 else None) for i in range(40)]
    rows += [(None, "x", "en", None, 2**63 - 1), (-7, "", "", "", 2**63 - 1), (3, "again", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    def leaf(doc_id, text, lang, source, n_chars):
        values = ["-" if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
        given = (doc_id, source, lang, n_chars, text)
        return sha("".join("-" if g is None else f"{len(v.encode())}:{v}" for g, v in zip(given, values, strict=True)))

    changed = {}
    for i, text, lang, source, n in rows:
        own = leaf(i, text, lang, source, n)
        hit = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
        changed[own] = leaf(i, text, lang, source, n + 1) if hit else own
    want = []
    for key, own, subroot, root, steps in plain([(r[2], r[0], leaf(*r)) for r in rows], 2):
        back = fold(changed[own], steps)
        want.append((key, own, subroot, root, sha("".join(s[1] for s in steps)), back, back == root))
    got = [tuple(r) for r in merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and {True, False} == {r[-1] for r in got}
