"""Hard negatives against all pairs in plain Python, and the bounds of the anchor trees."""

import math
from collections import Counter

import numpy as np
import pytest

from tapeloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row int, tree string, x string"


def brute(rows, every=50, positives=5, taken=3, shares=(50, 95)):
    sound = []
    for vec_id, x, label, *_ in rows:
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        sound.append((vec_id, [math.floor(256 * v) for v in x], (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label))
    order = lambda t: (-t[0], t[1] is None, t[1] or 0, t[2])
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))  # noqa: B905, E731
    out = Counter()
    for i, (anchor, x, label) in enumerate(sound):
        if anchor is None or anchor % every:
            continue
        all_ = [(dot(x, y), other, j, m) for j, (other, y, m) in enumerate(sound) if j != i]
        for s, p, _, _ in sorted((t for t in all_ if t[3] == label), key=order)[:positives]:
            fit = sorted((t for t in all_ if t[3] != label and shares[0] * s <= 100 * t[0] <= shares[1] * s), key=order)
            for k, t in enumerate(fit[:taken]):
                out[(anchor, p, k + 1, t[1], s, t[0])] += 1
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", None) for r in rows], SCHEMA)


def found(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(tuple(r) for r in df.collect())


def vectors(n, dims=6, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    return [[round(float(v), 2) for v in centres[rng.integers(5)] + rng.normal(size=dims) * 0.4] for _ in range(n)]


@pytest.mark.parametrize("tree, block", [(512, 4096), (3, 40)])
def test_every_case(spark, tree, block):
    """Ties, repeated rows and ids, nulls in each column, odd lengths, non-finite parts; small trees and blocks as well."""
    rng = np.random.default_rng(5)
    rows = [(i * 5, x, int(rng.integers(4))) for i, x in enumerate(vectors(220))]
    rows += rows[10:16] + rows[10:13]
    rows += [(50, [1.0, 1.0], 2), (None, rows[20][1], 1), (None, rows[20][1], 2), (100, [], 1), (150, None, 1), (200, rows[3][1], None)]
    rows += [(250, [1.0, None], 1), (300, [float("nan")], 1), (350, [float("inf")], 1), (-50, rows[30][1], 3), (-350, rows[31][1], 9)]
    assert found(negatives.hard_negatives(table(spark, rows), tree=tree, block=block)) == brute(rows)


def test_components_beyond_doubles_stay_exact(spark):
    rows = [(i, [float(2**30 + i * 128), 1.0, -float(i)], i % 3) for i in range(0, 60, 5)]
    rows += [(i, [float(i % 9), 0.5, 0.25], i % 3) for i in range(60, 160, 5)]
    assert found(negatives.hard_negatives(table(spark, rows), tree=2, block=8)) == brute(rows)


def test_scores_outside_a_long_are_the_nearest(spark):
    rows = [(0, [3e38], 1), (50, [3e38], 1), (3, [1.6e38], 2), (6, [2.0], 2)]
    got = found(negatives.hard_negatives(table(spark, rows)))
    assert all(k[4] == 2**63 - 1 for k in got)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(empty).count() == 0
    assert negatives.hard_negatives(table(spark, [(50, None, 1), (1, [1.0], 1)])).count() == 0


def test_tree_spans_and_bounds_hold():
    x = negatives.matrix(vectors(80, 12, 9)) * 256
    order, parent, edge = negatives.spanning_tree(x)
    assert sorted(order) == list(range(80)) and parent[0] == -1 and all(parent[p] < p for p in range(80))
    tree = x[order]
    assert np.allclose(edge[1:], np.linalg.norm(tree[1:] - tree[parent[1:]], axis=1))
    # No other edge between the two sides of a cut is shorter: Kruskal over all pairs gives the same length.
    far = np.linalg.norm(x[:, None] - x[None], axis=2)
    group, length = list(range(80)), 0.0
    for d, i, j in sorted((far[i, j], i, j) for i in range(80) for j in range(i)):
        if group[i] != group[j]:
            length += d
            old, new = group[i], group[j]
            group = [new if g == old else g for g in group]
    assert math.isclose(length, edge.sum())


def test_close_anchors_score_few_candidates():
    """Anchors near each other hand down tight bounds: most candidates are never scored again, and none is missed."""
    rng = np.random.default_rng(2)
    candidates = np.floor(256 * rng.normal(size=(3000, 16)))
    anchors = np.floor(256 * (rng.normal(size=16) + 0.01 * rng.normal(size=(40, 16))))
    order, parent, edge = negatives.spanning_tree(anchors)
    tree, counted = anchors[order], []
    window = negatives.positive_window(lambda p: np.ones(3000, dtype=bool), 5)
    for place, rows, scores in negatives.scored(tree, parent, edge, candidates, window, counted):
        best = np.sort(candidates @ tree[place])[-5:]
        assert np.array_equal(np.sort(scores)[-5:], best) and len(rows) >= 5
    assert sum(counted[1:]) < 0.1 * 3000 * 39
