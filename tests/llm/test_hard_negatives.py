"""Hard negatives against all inner products, bounds of boxes, ties, and rows that take no part."""

import random

import numpy as np
import pytest

from epochlake.llm import hard_negatives
from epochlake.llm.hard_negatives import Tree, tiles


def plain(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    own = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        w = [int(np.floor(256 * float(x))) for x in v]
        own[i] = min(own.get(i, (label, w)), (label, w))
    out = []
    for a, (label, v) in own.items():
        if not is_anchor(a):
            continue
        scores = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, other == label) for i, (other, w) in own.items() if i != a and len(w) == len(v)]
        for p, i, _ in sorted(s for s in scores if s[2])[:positives]:
            fit = [(s, j) for s, j, same in sorted(scores) if not same and low * -p <= 100 * -s <= high * -p]
            out += [(a, i, k + 1, j, -p, -s) for k, (s, j) in enumerate(fit[:negatives])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, label int, embedding array<double>, tree string")


def made(rng, n, dim, values):
    centers = [[rng.choice(values) for _ in range(dim)] for _ in range(4)]
    rows = [(i, rng.randrange(3), [x + rng.choice([0.0, 0.0, 0.01, -0.004]) for x in rng.choice(centers)]) for i in range(n)]
    odd = [(n, None, [0.5] * dim), (n + 1, 1, None), (n + 2, 1, [None, *[0.1] * (dim - 1)]), (n + 3, 1, [float("nan")] * dim), (None, 1, [0.2] * dim), (n + 4, 0, [float("inf")] * dim)]
    other = [(n + 5, 1, [0.5]), (n + 6, 1, [0.6]), (n + 7, 2, [0.45]), (n + 8, 7, []), (n + 9, 9, [0.0] * dim), (0, 1, [9.0] * dim), (5, *rows[5][1:])]
    return rows + odd + other


@pytest.mark.parametrize(("tree_rows", "slice_rows"), [(16_384, 4_096), (40, 10)])
def test_equals_all_products(spark, tree_rows, slice_rows):
    rows = made(random.Random(tree_rows), 300, 6, [0.5, -0.3, 0.9, 0.0])
    got = hard_negatives.hard_negatives(frame(spark, rows), hard_negatives.F.col("id") % 5 == 0, tree_rows=tree_rows, slice_rows=slice_rows).collect()
    want = plain(rows, lambda i: i % 5 == 0)
    assert sorted(tuple(r) for r in got) == want
    assert len(want) > 100


def test_other_counts_and_windows(spark):
    rows = made(random.Random(1), 120, 3, [0.5, -0.3])
    got = hard_negatives.hard_negatives(frame(spark, rows), hard_negatives.F.col("id") % 3 == 0, positives=2, negatives=7, low=-20, high=130, tree_rows=50).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, lambda i: i % 3 == 0, 2, 7, -20, 130)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    vectors = np.concatenate([rng.integers(-5, 5, (400, 4)) + c for c in ([300, 0, 0, 0], [0, 300, 0, 0], [0, 0, 300, 0])])
    order = np.concatenate(list(tiles(vectors, [0, 1, 2], np.arange(len(vectors)))))
    assert sorted(order.tolist()) == list(range(len(vectors)))
    tree = Tree(order.astype(np.int64), np.arange(len(vectors)) % 2, vectors[order])
    anchor = np.array([250, 1, -3, 2])
    scores = tree.vectors @ anchor
    for (least, greatest), size in zip(tree.bounds(tree.exact(anchor)), (128, 1024, 8192), strict=True):
        for b, (lo, hi) in enumerate(zip(least, greatest, strict=True)):
            part = scores[b * size : (b + 1) * size]
            assert lo <= part.min() and part.max() <= hi
    whole = sorted(((int(s), -int(i)) for s, i, l in zip(scores, tree.ids, tree.labels, strict=True) if l == 1), reverse=True)
    assert tree.search(anchor, 1, True, [(None, None), (0, 900), (10**6, None)], 6) == [[(s, -i) for s, i in whole[:6]], [(s, -i) for s, i in whole if 0 <= s <= 900][:6], []]


def test_ties_prefer_small_ids(spark):
    rows = [(i, i % 2, [0.5, 0.5]) for i in range(200)] + [(i, 1, [0.4, 0.4]) for i in range(200, 240)]
    got = hard_negatives.hard_negatives(frame(spark, rows), hard_negatives.F.col("id") == 100, tree_rows=60).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, lambda i: i == 100)
    assert {r["positive_id"] for r in got} == {0, 2, 4, 6, 8} and {r["negative_id"] for r in got} == {200, 201, 202}


def test_large_numbers(spark):
    rows = [(0, 0, [1e5, 3.0]), (1, 0, [1e5, 2.0]), (2, 1, [8e4, 1.0]), (3, 1, [7e4, 5.0])]
    got = hard_negatives.hard_negatives(frame(spark, rows), hard_negatives.F.col("id") == 0).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, lambda i: i == 0)
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(frame(spark, [(0, 0, [1e18]), (1, 0, [1e18])]), hard_negatives.F.col("id") == 0)


def test_empty(spark):
    assert hard_negatives.hard_negatives(frame(spark, [(0, 1, [1.0])]).filter("vec_id = 5"), hard_negatives.F.col("id") % 50 == 0).count() == 0
    assert hard_negatives.hard_negatives(frame(spark, [(0, 1, [1.0])]), hard_negatives.F.col("id") % 50 == 0).count() == 0
