"""Operator 1 against sorting all scores."""

import brute
import numpy as np
import pytest

from lotlens.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score int, part int"


def search(spark, rows, k):
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in topk.search(df.where("vec_id % 20 = 0"), df, k).collect())


@pytest.mark.parametrize("k", [1, 3, 20])
def test_same_as_sorting(spark, k, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 64)
    r = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=6)]) for i in range(300)]
    rows += [(i, [0.25] * 6) for i in range(300, 420)]      # a third ties with itself
    rows += [(500, None), (520, []), (540, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (560, [float("nan")] * 6), (580, [float("inf")] * 6)]
    rows += [(600, [0.5, 0.25]), (601, [1.0, 1.0]), (None, [1.0] * 6), (-20, [3.0] * 6)]
    assert search(spark, rows, k) == brute.top(rows, k)


def test_large_components_and_ranges(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=3) * 10.0 ** r.integers(0, 6)]) for i in range(200)]
    assert search(spark, rows, 7) == brute.top(rows, 7)


def test_repeated_rows_are_candidates_each(spark):
    rows = [(0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [1.0]), (0, [1.0])]
    got = search(spark, rows, 3)
    assert {(q, v, s) for q, _, v, s in got} <= {(0, 1, 8192), (0, 2, 4096)} and all(q == 0 for q, *_ in got)


def test_too_few_and_none(spark):
    assert search(spark, [(0, [1.0]), (7, [-1.0])], 20) == [(0, 1, 7, -4096)]
    assert search(spark, [(0, [1.0])], 20) == []
    assert search(spark, [], 20) == []
    with pytest.raises(ValueError):
        search(spark, [(0, [1.0])], 0)
