"""Operator 11 against sorting all scores, on plain, clustered and awkward vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotlens.llm import rtree

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, chosen, positives=5, negatives=3, share=(50, 95), scale=256.0):
    fine = [(i, [int(np.floor(scale * x)) for x in np.array(v, np.float32).astype(float)], y) for i, v, y in rows
            if i is not None and v and y is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    anchors = {(i, tuple(v), y) for i, v, y in fine if chosen(i)}
    for a, v, y in anchors:
        scored = [(-sum(p * q for p, q in zip(v, w, strict=True)), i, z) for i, w, z in fine if i != a and len(w) == len(v)]
        for s, p, _ in sorted(r for r in scored if r[2] == y)[:positives]:
            fit = sorted(r for r in scored if r[2] != y and share[0] * -s <= 100 * -r[0] <= share[1] * -s)
            out += [(a, p, k, n, -s, -t) for k, (t, n, _) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, chosen="vec_id % 5 = 0", schema=SCHEMA, **more):
    df = rtree.hard_negatives(spark.createDataFrame(rows, schema), F.expr(chosen), **more)
    return sorted(tuple(r)[:6] for r in df.collect())


def vectors(n, dims=8, labels=3, centres=0, seed=1):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, dims)) * (0.02 if centres else 1)
    if centres:
        x += g.normal(size=(centres, dims))[g.integers(0, centres, n)]
    return [(i, x[i].tolist(), int(g.integers(0, labels))) for i in range(n)]


@pytest.mark.parametrize("centres", [0, 6])
def test_equals_sorting(spark, centres):
    rows = vectors(400, centres=centres)
    got = mined(spark, rows)
    assert got == by_hand(rows, lambda i: i % 5 == 0) and got


def test_ties_repeats_and_small_values(spark):
    g = np.random.default_rng(3)
    rows = [(i, (g.integers(-1, 2, 4) / 256).tolist(), int(i % 2)) for i in range(300)]
    rows += rows[:40] + [(7, [0.5, 0.5, 0.5, 0.5], 1), (5, [0.25] * 4, 0)]
    assert mined(spark, rows) == by_hand(rows, lambda i: i % 5 == 0)


def test_hot_label_and_copies_of_one_vector(spark):
    rows = [(i, [1.0, 0.5, 0.25], 0) for i in range(200)] + [(1000 + i, [0.5, 0.5, 0.01 * i], 1 + i % 3) for i in range(60)]
    assert mined(spark, rows) == by_hand(rows, lambda i: i % 5 == 0)


def test_nulls_lengths_and_extra_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(60, dims=3) + [(None, [1.0, 1.0, 1.0], 0), (100, None, 0), (105, [], 0), (110, [1.0, None, 1.0], 1), (115, [1.0, nan, 1.0], 1),
                                  (120, [1.0, inf, 1.0], 1), (125, [1.0, 1.0, 1.0], None), (130, [1.0, 2.0], 1), (135, [2.0, 1.0], 1), (136, [1.5, 1.0], 0),
                                  (140, [1e30, 0.0, 0.0], 0)]
    held = [(i, [min(max(x, -2.0 ** 18), 2.0 ** 18) for x in v] if v and None not in v and nan not in v and inf not in v else v, y) for i, v, y in rows]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "'x' as v", "2 as dim", "3 as score", "4 as rank", "5 as part", "6 as place")
    got = rtree.hard_negatives(df, F.col("vec_id") % 5 == 0).collect()
    assert sorted(tuple(r)[:6] for r in got) == by_hand(held, lambda i: i % 5 == 0)


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []          # no anchor
    assert mined(spark, [(5, [1.0], 0), (2, [1.0], 1)]) == []          # no positive


def test_boxes_prune_clustered_vectors():
    g = np.random.default_rng(5)
    centres = g.normal(size=(40, 16)) * 200
    which = np.repeat(np.arange(40), 100)
    v = np.floor(centres[which] + g.normal(size=(4000, 16))).astype(np.int64)
    labels = which % 2
    tree = rtree.Tree.pack(np.arange(4000), labels, v, leaf=32, fan=4)
    again = rtree.Tree.read(dict(zip(("part", "dim", "ids", "labels", "data", "boxes", "nodes"), tree.row(1), strict=True)))
    assert sorted(again.ids.tolist()) == list(range(4000)) and (again.lo <= again.hi).all()
    for node in range(again.leaves):
        _, _, a, b = again.nodes[node]
        assert (again.v[a:b].min(axis=0) == again.lo[node]).all() and (again.v[a:b].max(axis=0) == again.hi[node]).all()
    low, high = np.full((1, 1), rtree._ANY), np.full((1, 1), -rtree._ANY)
    block = rtree.Block({"keys": np.array([1], "<i8").tobytes(), "ids": np.array([17], "<i8").tobytes(), "labels": labels[17:18].astype("<i8").tobytes(),
                         "data": v[17].astype("<i4").tobytes(), "dim": 16, "windows": np.stack([low, high]).astype("<i8").tobytes()}, 5, True)
    block.search(again)
    s = v @ v[17]
    rest = np.flatnonzero((labels == labels[17]) & (np.arange(4000) != 17))
    assert [(t, i) for _, _, t, i in block.found()] == [(int(s[i]), int(i)) for i in rest[np.lexsort((rest, -s[rest]))][:5]]
    assert block.visited < len(again.nodes) / 5


def test_window_bounds_are_exact():
    scores = np.array([-7, -1, 0, 1, 2, 3, 19, 20, 21, 10 ** 15 + 7])
    low, high = rtree._windows(scores, (50, 95))
    for s, a, b in zip(scores.tolist(), low.tolist(), high.tolist(), strict=True):
        assert 50 * s <= 100 * a and not 50 * s <= 100 * (a - 1)
        assert 100 * b <= 95 * s and not 100 * (b + 1) <= 95 * s
