"""Shortlists of real size: the join through words against the patterns of the scan, and lists beyond any pattern."""

import random

import pytest
from pyspark.sql import functions as F

from lotlens.operators import search, shortlist
from lotlens.sources.config import Bucket, Interest, check

WORDS = ["kettle", "steel-pot", "tea", "ring", "rings", "bolt", "old", "a/c", "usb", "c++", "é-bike", "lamp", "lamps", "x", "hot", "cold"]


def _rules(rng, n_buckets=73, n_seeds=1919, n_interests=23):
    seeds = set()
    while len(seeds) < n_seeds:
        words = [rng.choice(WORDS)[: rng.randint(1, 9)] + rng.choice(["", "", str(rng.randrange(40))]) for _ in range(rng.randint(1, 3))]
        seeds.add(" ".join(words) + rng.choice(["", " "]))
    seeds = sorted(seeds)
    rng.shuffle(seeds)
    pick = lambda k: tuple(seeds.pop() for _ in range(min(k, len(seeds))))
    conditions = ["Good", "Excellent", "For Parts Only"]
    buckets = [Bucket(f"B{i}", seeds=pick(n_seeds // n_buckets), exclude=tuple(rng.sample(["hot bolt", "cold", "old lamp ", "x"], rng.randrange(3))),
                      categories=tuple(rng.sample(["Home", "Home - Tea", "Shop - Old & New", "Home - tea - Pots"], rng.randrange(3))),
                      condition_in=tuple(rng.sample(conditions, rng.choice([0, 0, 1, 2])))) for i in range(n_buckets)]
    names = [b.name for b in buckets]
    interests = [Interest(f"I{i}", buckets=tuple(names[i::n_interests]), seeds=tuple(rng.sample(WORDS, 2)), exclude=("cold",) if i % 5 == 0 else ())
                 for i in range(n_interests)]
    return buckets, interests


def _lots(spark, rng, n=250):
    words = lambda k: " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", str(rng.randrange(40))]) for _ in range(rng.randint(0, k)))
    rows = [(f"L{i % 200}", rng.choice([words(7).title(), None]), rng.choice([words(2), None]), rng.choice(["Good", "Excellent", None, "Fair"]),
             rng.choice(["Home - Tea - pots", "Shop - Old & New - x", "Home", "Homeware", None, ""])) for i in range(n)]
    return spark.createDataFrame(rows, "lot_number string, title string, model string, condition string, category string")


@pytest.mark.parametrize("gate", [True, False])
def test_seeds_by_words_equal_patterns(spark, gate):
    rng = random.Random(11)
    buckets, interests = _rules(rng)
    check(buckets, interests)
    lots = _lots(spark, rng)
    got, want = (sorted(map(str, f(lots, buckets, interests, gate).collect())) for f in (shortlist.shortlist_by_words, shortlist.shortlist_scanned))
    assert got == want and len(got) == 250
    assert sum(len(r.cand) for r in shortlist.shortlist_by_words(lots, buckets, interests, gate).select("cand").collect()) > 100


def test_more_seeds_than_any_pattern(spark):
    rng = random.Random(12)
    lots = _lots(spark, rng, 60)
    many = [Bucket(f"N{i}", seeds=tuple(f"nothing{i} {j}" for j in range(500))) for i in range(50)]
    buckets = [Bucket("Pots", seeds=("steel-pot", "kettle ")), *many]
    check(buckets)
    got = shortlist.shortlist_lots(lots, buckets).select("lot_number", "title", "cand")
    want = shortlist.shortlist_scanned(lots, buckets[:1]).select("lot_number", "title", "cand")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_rules_and_no_lots(spark):
    lots = _lots(spark, random.Random(1), 5)
    empty = F.array().cast(shortlist.HITS)
    assert shortlist.shortlist_by_words(lots, [Bucket("C", categories=("Home",))]).count() == 5
    assert shortlist.shortlist_by_words(lots.limit(0), [Bucket("C", seeds=("x",))]).collect() == []
    assert shortlist.shortlist_by_words(lots, [Bucket("C", seeds=("zz",))]).where(F.col("cand") != empty).count() == 0


def test_references_resolve_within_their_auction(spark):
    lots = spark.createDataFrame([(1, "S-7"), (1, "M-7"), (2, "M-7"), (2, "9"), (3, "S-8")], "auction_id long, lot_number string")
    refs = spark.createDataFrame([(1, "7"), (2, "7"), (3, "7"), (2, " s7"), (2, "9"), (1, "9"), (3, "s 8"), (1, "m7")], "auction_id long, ref string")
    view = lots.where("auction_id = 1 and lot_number = 'M-7'")
    got = {(r.auction_id, r.ref): r.lot_number for r in search.resolve_lot_refs(refs, lots, view, ("auction_id",)).collect()}
    assert got == {(1, "7"): "M-7", (2, "7"): "M-7", (3, "7"): None, (2, " s7"): None, (2, "9"): "9", (1, "9"): None, (3, "s 8"): "S-8", (1, "m7"): "M-7"}
    plain = {(r.auction_id, r.ref): r.lot_number for r in search.resolve_lot_refs(refs, lots, scope=("auction_id",)).collect()}
    assert plain[1, "7"] == "S-7" and plain[2, "7"] == "M-7"
