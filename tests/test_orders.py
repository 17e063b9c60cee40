"""Rules that run through a whole order - chunk cuts, run starts, later values - on inputs dealt over many ranges."""

import random
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotlens.operators import chunks, scrapes
from lotlens.operators.common import successors
from test_operators import _chunks_by_hand

PRODUCTS = "auction_id long, category string, title string, rep_lot string"


def _items(rng, n, words, cats=3):
    return sorted({(f"c{rng.randrange(cats)}", f"{rng.choice(['Ab', 'AB', 'ab'])} w{rng.randrange(words)} x{rng.randrange(9)}", f"L{i:05d}") for i in range(n)})


@pytest.mark.parametrize("target, drift, words, ranges", [(20, 1, 2, 7), (7, 3, 30, 20), (500, 50, 5, 3), (5, 4, 40, 9), (1, 1, 40, 6), (30, 3, 1, 11)])
def test_chunks_cut_through_many_blocks(spark, target, drift, words, ranges):
    rng = random.Random(target)
    lists = {1: _items(rng, 300, words), 2: _items(rng, 40, words), 3: [("c", "only one", "L1")]}
    want = sorted((a, lot, n) for a, items in lists.items()
                  for n, part in enumerate(_chunks_by_hand(items, target, drift), 1) for _, _, lot in part)
    df = spark.createDataFrame([(a, *i) for a, items in lists.items() for i in items], PRODUCTS).repartition(5)
    got = chunks.chunk_products(df, target, drift, ranges=ranges)
    assert sorted((r.auction_id, r.rep_lot, r.chunk) for r in got.collect()) == want


def test_one_auction_of_many_openings_is_many_blocks(spark):
    rng = random.Random(9)
    items = _items(rng, 6000, 4000)
    df = spark.createDataFrame([(1, *i) for i in items], PRODUCTS)
    order = chunks._Order(df, ["auction_id"], 110, 16)
    sizes = [r.n for r in order.blocks.collect()]
    assert len(sizes) == 16 and max(sizes) < len(items) / 8 and sum(sizes) == len(items)
    plan = chunks.chunk_plan(df, 100, 10, ranges=16).orderBy("chunk").collect()
    want = _chunks_by_hand(items, 100, 10)
    assert [(r.start_row, r.end_row) for r in plan] == [(a, a + len(p)) for a, p in zip(np.cumsum([0, *map(len, want)]).tolist(), want)]


def test_a_hot_title_is_cut_by_force(spark):
    items = sorted([("c", "same words", f"L{i:04d}") for i in range(700)] + [("c", f"z{i} other", f"M{i:04d}") for i in range(50)])
    df = spark.createDataFrame([(1, *i) for i in items], PRODUCTS)
    plan = chunks.chunk_plan(df, 100, 10, ranges=9).orderBy("chunk").collect()
    want = _chunks_by_hand(items, 100, 10)
    assert [r.end_row - r.start_row for r in plan] == [len(p) for p in want]
    assert [r.ends_forced for r in plan[:6]] == [True] * 6


def test_empty_product_lists(spark):
    assert chunks.chunk_products(spark.createDataFrame([], PRODUCTS), 10, 1).collect() == []


def _fold(stamps):
    out = []
    for t in sorted(set(stamps)):
        if not out or t - out[-1] > 3 * 3600:
            out.append(t)
    return out


@pytest.mark.parametrize("ranges", [None, 13])
def test_runs_of_stamps_a_minute_apart(spark, ranges):
    rng, base = random.Random(1), 1_789_000_000
    data = [(1, base + 60 * i) for i in range(7 * 24 * 60)] + [(2, base + rng.randrange(10 ** 6)) for _ in range(400)] + [(3, base)] * 5
    data += [(4, base + 10800 * i) for i in range(20)] + [(5, base + 10801 * i) for i in range(20)] + [(6, None), (7, -5), (7, 10796)]
    lots = spark.createDataFrame(data, "auction_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = scrapes.run_stamps(lots, F.col("ts"), ["auction_id"], ranges)
    found = defaultdict(list)
    for r in got.select("auction_id", F.unix_timestamp("_ts").alias("t"), "scrape", F.unix_timestamp("started_at").alias("s")).collect():
        found[r.auction_id].append((r.t, r.scrape, r.s))
    for a in (1, 2, 3, 4, 5, 7):
        stamps = {t for x, t in data if x == a}
        starts = _fold(stamps)
        assert sorted(found[a]) == [(t, bisect_right(starts, t), starts[bisect_right(starts, t) - 1]) for t in sorted(stamps)]
    assert 6 not in found
    begun = scrapes.cluster_starts(lots, F.col("ts"), ["auction_id"], ranges).where("auction_id = 1")
    assert sorted(r[0] for r in begun.select(F.unix_timestamp("started_at")).collect()) == _fold(t for a, t in data if a == 1)


@pytest.mark.parametrize("ranges", [None, 5])
def test_successors(spark, ranges):
    rng = random.Random(3)
    known, asked = [(rng.randrange(3), rng.randrange(50)) for _ in range(60)], [(rng.randrange(4), rng.randrange(60), i) for i in range(200)]
    got = successors(spark.createDataFrame(asked, "a long, at long, i long"), spark.createDataFrame(known, "a long, at long"), "at", ["a"], ranges)
    want = {i: min((v for x, v in known if x == a and v > at), default=None) for a, at, i in asked}
    assert {r.i: r.next_at for r in got.collect()} == want and got.count() == 200
