"""Medians by selection, and grades of titles with very many of them."""

import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lotlens.functions import vocab
from lotlens.operators import sales

CLOSED = "_ord long, title string, condition string, bids array<double>"


@pytest.mark.parametrize("long_list, bands", [(1 << 16, 1024), (20, 4), (0, 2)])
def test_medians_of_a_hot_product(spark, long_list, bands):
    rng, data = random.Random(1), []
    for i in range(8000):
        title = rng.choice(["hot", "hot", "hot", f"t{rng.randrange(40)}", "pair", "same", "unsold"])
        price = {"pair": rng.choice([1.0, 1.0, 1e9, 1e-7]), "same": 5.0, "unsold": None}.get(title, rng.choice([rng.lognormvariate(3, 2), None]))
        data.append((i, title, "Good", [price + 1, price + 2] if price is not None else [1.0]))
    closed = spark.createDataFrame(data, CLOSED)
    prices, unsold = defaultdict(list), defaultdict(int)
    for r in sales.price_histogram(closed).collect():
        if r.price is None:
            unsold[r.key_title] += r.copies
        else:
            prices[r.key_title] += [r.price] * r.copies
    want = {t: (len(p), unsold[t], statistics.median(p) if p else None, min(p, default=None), max(p, default=None))
            for t in {*prices, *unsold} for p in [prices[t]]}
    got = {r.key_title: (r.sold, r.unsold, r.median, r.low, r.high) for r in sales.sale_aggregate(closed, (), long_list, bands).collect()}
    assert got == want


def test_no_window_by_product(spark):
    closed = spark.createDataFrame([(1, "a", "Good", [3.0, 4.0])], CLOSED)
    assert "Window" not in sales.sale_aggregate(closed)._jdf.queryExecution().optimizedPlan().toString()
    assert sales.sale_aggregate(spark.createDataFrame([], CLOSED)).collect() == []


def _order(own, grade):
    ladder = list(vocab.PRICE_LADDER)
    if grade not in ladder:
        return (1, 0, 0, grade)
    steps = ladder.index(grade) + 1 - (ladder.index(own) + 1 if own in ladder else 0)
    return (0, abs(steps), int(own in ladder and steps < 0), grade)


def test_nearest_grade_of_titles_with_many(spark):
    rng = random.Random(2)
    grades = list(vocab.PRICE_LADDER) + ["ZETA", "ALPHA", ""]
    index_rows = {(t, g) for t in range(12) for g in rng.sample(grades, rng.randrange(len(grades)))} | {(99, f"G{i:06d}") for i in range(30_000)}
    index = spark.createDataFrame([(f"T{t}", g) for t, g in index_rows], "key_title string, key_condition string").withColumn(
        "weeks", F.array(F.col("key_condition")))
    lots_rows = [(str(i), f" t{rng.randrange(14)}", rng.choice([*grades, None, "odd"])) for i in range(400)]
    lots_rows += [(f"h{i}", "T99", f"g{i:06d}" if i % 2 else "unheard of") for i in range(300)] + [("n", None, None)]
    lots = spark.createDataFrame(lots_rows, "lot_number string, title string, condition string")
    shown = {r.lot_number: r for r in sales.sale_history_for_lot(lots, index).collect()}
    assert len(shown) == len(lots_rows)
    held = defaultdict(set)
    for t, g in index_rows:
        held[f"T{t}"].add(g)
    own_n = alt_n = 0
    for lot, title, condition in lots_rows:
        title, own, r = (title or "").strip().upper(), (condition or "").strip().upper(), shown[lot]
        others = sorted((g for g in held[title] if g and g != own), key=lambda g: _order(own, g))
        if own in held[title]:
            own_n += 1
            assert (r.sale_key, r.source_grade, r.weeks) == (f"{title}|{own}", None, [own])
        elif others:
            alt_n += 1
            assert (r.sale_key, r.source_grade, r.weeks) == (None, others[0], [others[0]])
        else:
            assert (r.sale_key, r.source_grade, r.weeks) == (None, None, None)
    few = lots.where("title <> 'T99'")
    for r in sales.join_sale_history(few, index).collect():
        others = sorted((g for g in held[r.key_title] if g and g != r.key_condition), key=lambda g: _order(r.key_condition, g))
        assert r.alt_keys == ([f"{r.key_title}|{g}" for g in others] or None)
    c = sales.sale_coverage(lots, index).first()
    assert (c.lots, c.own, c.alt_only) == (len(lots_rows), own_n, alt_n)
    asked = {((t or "").strip().upper(), (c or "").strip().upper()) for _, t, c in lots_rows}
    titles = {t for t, _ in asked}
    used = {(r.key_title, r.key_condition) for r in sales.sale_index_used(lots, index).collect()}
    assert used == {(f"T{t}", g) for t, g in index_rows if (f"T{t}" in titles and g) or (f"T{t}", g) in asked}
