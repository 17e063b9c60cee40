"""What a stream of snapshots leaves on disk, and how much of its state it writes anew."""

import datetime
import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from lotlens.plans import ingest as plans
from lotlens.plans.registry import Tables
from lotlens.session import shared_dir
from lotlens.streaming import ingest as stream
from test_late import in_order

LAYERS = "auction_id long, lot_number string, layer_no int, _ord long, is_flagged boolean, buckets array<string>"


def pages(spark, rows):
    """A batch of (auction, stamp, id) as ``read_arrivals`` gives it."""
    batch = spark.createDataFrame([(a, at, "f", n, None, i, f"S-{i}") for n, (a, at, i) in enumerate(rows)],
                                  "auction_id long, scraped_at string, _file string, _ord int, _corrupt string, id long, lotNumber string")
    return batch.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in stream.landing_item().fields if f.name not in batch.columns])


def stamps(spark, state):
    return {(r.auction_id, r.scraped_at, r.id): (r.first_seen, r.is_new) for r in spark.read.parquet(f"{state}/snapshots").collect()}


def folder(spark, tmp_path, orders):
    """The driver's tables that lots are made of; two orders share an id."""
    day = lambda n: datetime.datetime(1995 + n % 2, 3, 1 + n % 28)
    tables = {
        "region": ([(0, "ASIA")], "r_regionkey long, r_name string"),
        "nation": ([(0, "NATION_2", 0)], "n_nationkey long, n_name string, n_regionkey long"),
        "customer": ([(0, "Customer#0", 0, "FURNITURE")], "c_custkey long, c_name string, c_nationkey long, c_mktsegment string"),
        "part": ([(n, "old ring", "Brand#7", "ECONOMY", 3, 9.5) for n in range(3)],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": ([(n % (orders - 1), 0, "OFP"[n % 3], 10.0 + n, day(n), ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")[n % 5])
                    for n in range(orders)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_arrivals_are_compressed_and_whole(spark, tmp_path):
    """The sets hold what a join of the landing rows with the lots by id gives, a repeated id with every partner."""
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{shared}/arrivals-*"))
    t = Tables(spark, folder(spark, tmp_path, 1201))
    rows = plans.ingest_stream(t)
    (arrivals,) = set(glob.glob(f"{shared}/arrivals-*")) - before
    files = [f for f in os.listdir(arrivals) if f.startswith("part-")]
    assert len(files) > 2 and all(f.endswith(".json.gz") for f in files)
    lots = Tables(spark, str(tmp_path))["lots"]
    pairs = lots.select("id", "auction_id").join(lots.select("id", "priority", "date"), "id")
    stamp = F.when(F.col("late"), "-02-02T00:00:00+00:00").otherwise("-01-01T00:00:00+00:00")
    both = pairs.withColumn("late", F.explode(F.array(F.lit(False), F.lit(True)))).where(
        "(late and priority <> '5-LOW') or (not late and priority <> '3-MEDIUM')")
    asked = sorted(tuple(r) for r in both.select("auction_id", F.concat("date", stamp), "id").collect())
    read = spark.read.json(arrivals).select("auction_id", "scraped_at", F.explode("items.id"))
    assert sorted(tuple(r) for r in read.collect()) == asked
    assert rows.count() > 0


def test_a_batch_leaves_only_the_state(spark):
    """Intermediate tables and shuffle files go with the batch."""
    shared = spark.conf.get("spark.checkpoint.dir")
    state, layers = shared_dir(spark, "state"), spark.createDataFrame([(7, "S-1", 1, 1, True, ["First"])], LAYERS)
    listed = set(os.listdir(shared))
    held = set(_blocks(spark))
    stream.process_batch(pages(spark, [(7, "t0", n) for n in range(40)]), 0, state, lambda _: layers)
    for _ in range(20):
        left = set(_blocks(spark)) - held
        if not left:
            break
        time.sleep(0.5)
    assert not left
    assert set(os.listdir(shared)) - listed == {os.path.basename(state)}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def _blocks(spark):
    root = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return [f for d in root for f in glob.glob(f"{d}/**/shuffle_*", recursive=True)]


def test_lots_that_keep_their_stamp_are_not_written_again(spark):
    """What an earlier batch brought of the same snapshot stays as it is; later snapshots are stamped anew."""
    state = shared_dir(spark, "state")
    files = lambda at, n: set(glob.glob(f"{state}/snapshots/auction_id=7/scraped_at={at}/batch_id={n}/part-*"))
    stream.process_batch(pages(spark, [(7, "t1", 1), (7, "t1", 2)]), 0, state)
    first = files("t1", 0)
    stream.process_batch(pages(spark, [(7, "t1", 2), (7, "t1", 3)]), 1, state)
    assert files("t1", 0) == first and files("t1", 1)
    stream.process_batch(pages(spark, [(7, "t0", 1)]), 2, state)
    assert files("t1", 0) != first
    assert stamps(spark, state) == in_order([(7, "t1", [1, 2, 3]), (7, "t0", [1])])


@pytest.mark.parametrize("at_once", [1, 3])
def test_shares_of_any_size_give_the_same_state(spark, monkeypatch, at_once):
    monkeypatch.setattr(stream, "ROWS_AT_ONCE", at_once)
    state, layers = shared_dir(spark, "state"), spark.createDataFrame([(7, "S-1", 1, 1, True, ["First"]), (8, "S-4", 2, 1, True, ["Next"])], LAYERS)
    arriving = [[(7, "t2", [1, 2, 3]), (8, "t1", [4, 5])], [(7, "t2", [6]), (None, "t3", [1])], [(7, "t1", [1, 6]), (7, "t3", [1, 6, 7])],
                [(None, "t1", [1, 2]), (None, "t2", [1]), (8, "t0", [5])]]
    seen = []
    for n, batch in enumerate(arriving):
        seen += batch
        stream.process_batch(pages(spark, [(a, at, i) for a, at, ids in batch for i in ids]), n, state, lambda _: layers)
        assert stamps(spark, state) == in_order(seen)
    new = {(r.auction_id, r.scraped_at, r.id) for r in spark.read.parquet(f"{state}/new_lots").collect()}
    assert new == {(a, at, i) for a, at, ids in seen for i in ids if (a, i) not in ((7, 1), (8, 4))}
    assert set(spark.read.parquet(f"{state}/new_lots").columns) == set(spark.read.parquet(f"{state}/snapshots").columns) - {"batch_id"}


def test_a_batch_without_a_usable_stamp(spark):
    state = shared_dir(spark, "state")
    stream.process_batch(pages(spark, [(7, "", 1)]), 0, state)
    stream.process_batch(pages(spark, [(7, "t0", 1), (7, "", 2)]), 1, state)
    assert stamps(spark, state) == {(7, "t0", 1): ("t0", True)}
