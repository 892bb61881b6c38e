"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.llm import hard_negatives
from kinloom.llm.hard_negatives import Tree, mine


def plain(rows):
    """Every anchor against every row, in Python numbers; equal anchors answer once."""

    def sound(r):
        return r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])

    known = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in filter(sound, rows)]
    out = []
    for i, label, v in {(i, label, tuple(v)) for i, label, v in known if i % 100 == 0}:
        scored = [(max(-(2**62), min(2**62, sum(map(int.__mul__, v, w)))), j, other) for j, other, w in known if j != i and len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, j, _ in [s for s in scored if s[2] == label][:5]:
            fit = [s for s in scored if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p][:10]
            out += [(i, j, k, n, p, s) for k, (s, n, _) in enumerate(fit, 1)]
    return sorted(out)


def vectors():
    draw = np.random.default_rng(8)
    centers = draw.standard_normal((12, 8))
    rows = [(100 * i if i % 3 == 0 else 100 * i + 1, (centers[i % 12] * draw.uniform(0.5, 2) + 0.4 * draw.standard_normal(8)).tolist(), int(draw.integers(0, 4))) for i in range(300)]
    rows += [(rows[0][0] + k, rows[0][1], k % 3) for k in range(1, 60)]  # copies, equal scores
    odd = [(None, [1.0] * 8, 1), (700, None, 1), (800, [1.0] * 8, None), (1000, [float("nan")] + [1.0] * 7, 1), (1100, [None] + [1.0] * 7, 1), (1400, [float("inf")] * 8, 2)]
    other = [(40_000 + k, [0.5, k / 10], k % 2) for k in range(0, 400, 50)] + [(50_000, [], 1), (50_001, [], 1), (50_002, [], 2)]
    large = [(60_000, [1e9] * 8, 0), (60_001, [2e9] * 8, 0), (60_002, [7e8] * 8, 1), (60_100, [1e14] * 8, 0)]
    zero = [(70_000, [0.0] * 8, 3), (70_001, [-0.1] * 8, 3)]
    return rows + [rows[0], rows[0]] + odd + other + large + zero


@pytest.mark.parametrize(("leaf_rows", "block"), [(4096, 1024), (24, 16)])
def test_hard_negatives_equal_brute_force(spark, leaf_rows, block):
    rows = vectors()
    frame = spark.createDataFrame([(*r, 5, 5) for r in rows], "vec_id long, embedding array<double>, label int, rank int, leaf int").repartition(5)
    got = mine(frame, F.col("id") % 100 == 0, leaf_rows=leaf_rows, block_anchors=block, fan=4).collect()
    want = plain(rows)
    assert len(want) > 1000
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(tuple(r[c] for c in names) for r in got) == want
    assert mine(frame.where(F.lit(False)), F.col("id") % 100 == 0).count() == 0


def test_single_precision_vectors_are_read_as_doubles(spark):
    draw = np.random.default_rng(2)
    rows = [(50 * k, draw.standard_normal(6).astype(np.float32).tolist(), k % 3) for k in range(120)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = mine(frame, F.col("id") % 100 == 0, leaf_rows=16, fan=3).collect()
    assert sorted(map(tuple, got)) == plain(rows)


def test_ranges_eliminate_leaves_and_lose_no_row():
    draw = np.random.default_rng(6)
    centers = draw.standard_normal((40, 16)) * 256
    x = np.floor(centers[draw.integers(0, 40, 4000)] + 12 * draw.standard_normal((4000, 16)))
    tree = Tree({16: x[:800]}, len(x), fan=6, leaf_rows=200)
    leaf = tree.place(x, 16, learn=True)
    asking, scores = x[:200], x[:200] @ x.T
    low, high = np.quantile(scores, 0.995, axis=1), np.quantile(scores, 0.999, axis=1)
    who, leaves = tree.reached(asking, 16, low[:, None], high[:, None])
    visited = set(zip(who.tolist(), leaves.tolist()))
    for a, s in enumerate(scores):
        inside = np.flatnonzero((s >= low[a]) & (s <= high[a]))
        assert {(a, int(leaf[k])) for k in inside} <= visited
    assert tree.n_leaves > 20 and len(visited) < 0.5 * 200 * tree.n_leaves, "windows on clustered rows leave most leaves out"
    none = tree.reached(asking[:1], 16, np.array([[5.0]]), np.array([[4.0]]))[0]
    assert not len(none)


def test_parts_of_the_ranges_add_up():
    draw = np.random.default_rng(1)
    x = np.floor(256 * draw.standard_normal((500, 4)))
    whole = Tree({4: x[:100]}, 500, fan=3, leaf_rows=50)
    whole.place(x, 4, learn=True)
    again = Tree({4: x[:100]}, 500, fan=3, leaf_rows=50)
    again.learn(whole.ranges().to_pylist())
    for a, b in zip(whole.nodes, again.nodes):
        assert (a.nearest == b.nearest).all() and (a.farthest == b.farthest).all() and (a.longest == b.longest).all()


def test_products_are_exact():
    a, b = np.array([[3.0, 5.0], [2.0**30, -1.0]]), np.array([[2.0**31 - 1, 7.0], [1.0, 2.0]])
    want = [[int(p) * int(r) + int(q) * int(s) for r, s in b] for p, q in a]
    assert hard_negatives.products(a, b).tolist() == want
    assert hard_negatives.products(np.array([[2.0**40]]), np.array([[2.0**40]])).tolist() == [[1 << 62]]
