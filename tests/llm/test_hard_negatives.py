"""Hard negatives and their box tree against plain sorting of all scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textpulse.llm import box_tree, hard_negatives


def plain(rows, anchors, positives=5, negatives=5, low=80, high=100):
    """rows: (id, label, vector) without repeats."""
    out = []
    for a, label, v in (r for r in rows if anchors(r[0])):
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in rows if i != a)
        for minus, p, _ in [s for s in scored if s[2] == label][:positives]:
            near = [(i, -m) for m, i, other in scored if other != label and low * -minus <= 100 * -m <= high * -minus]
            out += [(a, p, n + 1, i, -minus, m) for n, (i, m) in enumerate(near[:negatives])]
    return sorted(out)


def vectors(n, width, seed, spread=20):
    """Clusters of near copies, equal vectors, ties and a hot label."""
    r = np.random.default_rng(seed)
    centre = r.integers(-90, 90, (7, width))
    out = []
    for i in range(n):
        v = centre[i % 7] + r.integers(-spread, spread, width) if i % 3 else centre[0]
        out.append((i * 5, int(r.integers(0, 4)) if i % 2 else 1, [int(x) for x in v]))
    return out


@pytest.mark.parametrize("width", [1, 6])
def test_search_over_blocks(width):
    rows = vectors(700, width, 3)
    ids, labels, values = (np.array(x, dtype=np.int64) for x in zip(*rows))
    values = values.reshape(len(ids), width)
    asked = np.flatnonzero(ids % 100 == 0)
    least = np.tile(np.array([[-50, box_tree.NONE + 1, 9]], dtype=np.int64), (len(asked), 1))
    most = np.tile(np.array([[2000, 5000, 8]], dtype=np.int64), (len(asked), 1))  # the last one is empty
    for same in (True, False):
        search = box_tree.Search(ids[asked], labels[asked], values[asked], (least, most), same, 3)
        for a in range(0, len(ids), 256):
            search.add(ids[a : a + 256], labels[a : a + 256], values[a : a + 256], list(range(width)))
        got = sorted(zip(*[x.tolist() for x in search.results()]))
        want = []
        for q, a in enumerate(asked):
            for w in range(3):
                s = [(-int(values[a] @ values[j]), int(ids[j])) for j in range(len(ids)) if j != a and (labels[j] == labels[a]) == same]
                s = sorted(x for x in s if least[q, w] <= -x[0] <= most[q, w])[:3]
                want += [(q, w, i, -m) for m, i in s]
        assert got == sorted(want)


def test_boxes_bound_scores_and_prune():
    r = np.random.default_rng(1)
    centre = r.integers(-200, 200, (16, 8))
    values = np.concatenate([c + r.integers(-5, 5, (64, 8)) for c in centre]).astype(np.int64)
    queries = values[::64]
    low, high = bounds = box_tree.bounds(queries, values.min(axis=0, keepdims=True), values.max(axis=0, keepdims=True))
    scores = queries @ values.T
    assert (low <= scores.min(axis=1, keepdims=True)).all() and (high >= scores.max(axis=1, keepdims=True)).all() and len(bounds) == 2
    ids = np.arange(len(values), dtype=np.int64)
    ends = (np.full((16, 1), box_tree.NONE + 1), np.full((16, 1), 2**62))
    search = box_tree.Search(ids[::64], np.zeros(16, dtype=np.int64), queries, ends, True, 5)
    search.add(ids, np.zeros(len(ids), dtype=np.int64), values, [0, 1, 2])
    assert search.leaves < 16 * 16 / 2  # of sixteen leaves for each of sixteen queries
    big = np.array([[2**29, 2**29]], dtype=np.int64)
    assert box_tree.product(big, big)[0, 0] == 2**59  # beyond what floating point holds exactly


def test_packing_is_a_permutation_into_narrow_leaves():
    r = np.random.default_rng(5)
    values, ids = r.integers(0, 1000, (1000, 3)).astype(np.int64), np.arange(1000)
    order = box_tree.packed_order(values, ids, [0, 1, 2])
    assert sorted(order.tolist()) == list(range(1000))
    first = [np.ptp(values[order[a : a + 64], 0]) for a in range(0, 1000, 64)]
    assert np.median(first) < 500


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, label int, vector array<bigint>, rank string, _id string")


def test_operator(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 128)
    monkeypatch.setattr(hard_negatives, "PART", 7)
    monkeypatch.setattr(hard_negatives, "GROUPS", 3)
    rows = vectors(600, 6, 8)
    given = [(*r, "x", "y") for r in rows]
    given += [given[5], (25, 9, [0] * 6, "x", "y")]  # a repeated row; a repeated key with a greater label
    given += [(None, 1, [1] * 6, "", ""), (3, None, [1] * 6, "", ""), (4, 1, None, "", ""), (6, 1, [1, None, 1, 1, 1, 1], "", "")]
    given += [(7, 1, [2**40] + [0] * 5, "", ""), (9, 1, [3, 2], "", ""), (11, 2, [], "", "")]
    rows += [(9, 1, [3, 2]), (11, 2, [])]
    found = hard_negatives.hard_negatives(table(spark, given).repartition(5), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, found.collect())) == plain(rows, lambda i: i % 100 == 0)
    few = hard_negatives.hard_negatives(table(spark, given), F.col("vec_id") % 100 == 0, positives=2, negatives=9, window=(10, 60))
    assert sorted(map(tuple, few.collect())) == plain(rows, lambda i: i % 100 == 0, 2, 9, 10, 60)


def test_tables_without_pairs(spark):
    none = hard_negatives.hard_negatives(table(spark, []), F.col("vec_id") % 100 == 0)
    assert none.count() == 0 and none.columns[0] == "anchor_id"
    assert hard_negatives.hard_negatives(table(spark, [(0, 1, [5], "", "")]), F.lit(True)).count() == 0
    assert hard_negatives.hard_negatives(table(spark, [(1, 1, [5], "", ""), (2, 1, [5], "", "")]), F.lit(None).cast("boolean")).count() == 0


def test_quantised(spark):
    rows = [([0.5, -0.001, 1.0],), ([math.nan],), ([math.inf],), ([None, 1.0],), (None,), ([],)]
    df = spark.createDataFrame(rows, "e array<float>")
    got = [r[0] for r in df.select(hard_negatives.quantised(F.col("e"), 256)).collect()]
    assert got == [[128, -1, 256], None, None, None, None, []]
