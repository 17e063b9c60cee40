"""Snapshots that arrive in any order, in pieces, several in one trigger."""

import random

import pytest
from pyspark.sql import functions as F

from lotlens.operators import ingest
from lotlens.session import shared_dir
from lotlens.streaming import ingest as stream

PAGE = "auction_id long, scraped_at string, items array<struct<id:long>>"


def in_order(pages):
    """What one pass over the snapshots in their order gives."""
    out, auctions = {}, {}
    for auction, at, ids in pages:
        auctions.setdefault(auction, {}).setdefault(at, set()).update(ids)
    for auction, shots in auctions.items():
        before = {}
        for at in sorted(shots):
            before = {i: before.get(i, at) for i in shots[at]}
            for i, first in before.items():
                out[auction, at, i] = (first, first == at)
    return out


@pytest.mark.parametrize("seed", [1])
def test_any_order_gives_the_state_of_the_sorted_order(spark, seed):
    rng = random.Random(seed)
    pages = [(a, f"t{n}", rng.sample(range(6), 4)) for a in (7, 8) for n in range(4) for _ in range(rng.choice([1, 2]))]
    rng.shuffle(pages)
    arrivals, state = shared_dir(spark, "arrivals"), shared_dir(spark, "state")
    for n in range(0, len(pages), 4):
        rows = [(a, at, [(i,) for i in ids]) for a, at, ids in pages[n:n + 4]]
        spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").json(arrivals)
        stream.start(spark, arrivals, state).awaitTermination()
        got = {(r.auction_id, r.scraped_at, r.id): (r.first_seen, r.is_new) for r in spark.read.parquet(f"{state}/snapshots").collect()}
        assert got == in_order(pages[:n + 4])


def test_runs_of_presence(spark):
    """Repeated rows, a carried stamp, a blank one, a gap."""
    shown = spark.createDataFrame(
        [("a", 0, "t0", "old"), ("a", 1, "t1", None), ("a", 1, "t1", None), ("a", 3, "t3", None), ("b", 0, "t0", ""), ("b", 1, "t1", None),
         ("c", 2, "t2", None)], "id string, place int, scraped_at string, first_seen string")
    got = {(r.id, r.place): (r.first_seen, r.is_new) for r in ingest.first_seen_runs(shown).where(F.col("place") > 0).collect()}
    assert got == {("a", 1): ("old", False), ("a", 3): ("t3", True), ("b", 1): ("t0", False), ("c", 2): ("t2", True)}
    assert ingest.first_seen_runs(shown.where("false")).isEmpty()


def test_a_batch_is_read_once(spark):
    """Pages are parsed for what is kept of them, not again for the rejects, the stamps and the lots."""
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    state = shared_dir(spark, "state")
    batch = spark.createDataFrame([(7, "t0", "f", i, None, i) for i in range(50)],
                                  "auction_id long, scraped_at string, _file string, _ord int, _corrupt string, id long")
    missing = [f for f in stream.landing_item().fields if f.name != "id"]
    whole = batch.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
    stream.process_batch(whole.mapInPandas(count, whole.schema), 0, state)
    assert seen.value == 50
    assert spark.read.parquet(f"{state}/snapshots").count() == 50
