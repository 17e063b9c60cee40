"""The bundle: its lots are derived and written once, and small tables are met without dealing the lots anew."""

import os

import pytest
from pyspark.sql import functions as F

from lotlens.functions.values import parse_instant
from lotlens.operators import bundle, scrapes, skew
from lotlens.plans.registry import Tables
from lotlens.session import shared_dir
from lotlens.sources import sinks

FOLDER = os.environ.get("LOTLENS_TEST_DATA", "/root/testdata/sf0.001")
SCOPE = ("auction_id",)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    """Shuffles of a plan; broadcasts are not."""
    return plan(df).count("Exchange hashpartitioning")


def same(a, b) -> bool:
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_views_read_a_written_view(spark):
    wanted = Tables(spark, FOLDER)["valuations"].collect()
    t = Tables(spark, FOLDER)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # on again with the next tables
    t.write("lots", ["id", "lot_number", "status", "priority", "condition", "retail"], ["id"])
    assert len(t["lots"].inputFiles()) > 1  # though the orders are one row group
    assert "orders.parquet" not in plan(t["valuations"])
    assert sorted(map(str, t["valuations"].collect())) == sorted(map(str, wanted))
    assert "seller" in Tables(spark, FOLDER)["lots"].columns  # the next query makes its own


def test_join_without_hot_keys_keeps_the_right_side_in_place(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(1000).select("id", F.when(F.col("id") % 4 > 0, F.col("id") % 7).alias("k"))
        right = left.where("k < 5").groupBy("k").agg(F.min("id").alias("low"))
        plain, dealt = skew.attach(left, right, ["k"], look=True), skew.attach(left, right, ["k"])
        assert exchanges(plain) == 2 and exchanges(dealt) > 2 and plain.columns == dealt.columns
        assert same(plain, dealt)
        assert same(skew.attach(left, right, ["k"], "inner", look=True), skew.attach(left, right, ["k"], "inner"))
        split = skew.attach(left, right, ["k"], rows_per_part=10, look=True)
        assert "_part" in plan(split) and same(split, plain)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lots_meet_few_stamps_without_a_shuffle(spark, monkeypatch):
    lots = spark.createDataFrame([(1, str(i), f"2026-09-13T{i % 24:02d}:00:00Z" if i % 3 else None) for i in range(90)],
                                 "auction_id long, lot_number string, first_seen string")
    stamp = parse_instant(F.col("first_seen"))
    runs = scrapes.run_stamps(lots, stamp, SCOPE)
    few = scrapes.assign_scrapes(lots, runs, stamp, SCOPE)
    assert exchanges(few) == 0
    monkeypatch.setattr(scrapes, "FEW_STAMPS", 3)
    many = scrapes.assign_scrapes(lots, runs, stamp, SCOPE)
    assert exchanges(many) > 0 and many.columns == few.columns and same(many, few)
    assert few.where("scrape is null").count() == 30


def test_tables_may_be_made_of_those_written_before(spark):
    path, made = shared_dir(spark, "derived"), []

    def tens(written):
        made.append(written["lots"].inputFiles())
        return written["lots"].groupBy((F.col("id") % 10).alias("ten")).agg(F.count("*").alias("n"))

    sinks.write_tables({"lots": spark.range(35), "tens": tens}, path)
    assert len(made) == 1 and all("/runs/" in f for f in made[0])
    assert sinks.read_table(spark, path, "tens").agg(F.sum("n")).head()[0] == 35


@pytest.mark.parametrize("rows_per_part", [1, skew.ROWS_PER_PART])
def test_bundle_of_odd_rows(spark, monkeypatch, rows_per_part):
    """Two labels of one lot, an orphan, a lot without title, stamp or value, and an id that is another lot's number."""
    monkeypatch.setattr(skew, "ROWS_PER_PART", rows_per_part)
    raw = spark.createDataFrame([
        (1, 10, "A", 1, "ring", "Good", "x - y", "2026-09-13T10:00:00Z"), (1, 11, "10", 2, "ring", "Fair", "x", "2026-09-13T20:00:00Z"),
        (1, 12, "B", 3, None, None, None, None), (2, 10, "A", 4, "rod", "Good", "x", "2026-09-14T10:00:00Z")],
        "auction_id long, id long, lot_number string, _ord long, title string, condition string, category string, first_seen string")
    raw = raw.withColumn("image_url", F.lit("f")).withColumn("thumb_url", F.lit("")).withColumn("close_at", F.lit("2026-09-13T10:00:00Z"))
    given = spark.createDataFrame([(1, "10", 1, ["Rings"]), (1, "A", 2, ["Gone"]), (1, "B", 3, []), (1, "Z", 4, ["Rings"]), (2, "A", 5, [])],
                                  "auction_id long, lot_number string, _ord long, buckets array<string>")
    for name, value in (("title", "label"), ("subtype", None), ("match_strength", "none"), ("personal_reasoning", None), ("confidence", "low")):
        given = given.withColumn(name, F.lit(value).cast("string"))
    given = given.withColumn("is_flagged", F.size("buckets") > 0).withColumn("personal_match", F.lit(None).cast("boolean")).withColumn(
        "personal_tags", F.array().cast("array<string>"))
    values = spark.createDataFrame([(1, "10", 1, 5.0), (1, "A", 2, 7.0), (2, "10", 3, 9.0)], "auction_id long, lot_number string, _ord long, est_low double")
    values = values.withColumn("est_high", F.col("est_low")).withColumn("confidence", F.lit("low")).withColumn(
        "outlook", F.lit("good")).withColumn("reasoning", F.lit(""))
    index = spark.createDataFrame([("RING", "GOOD"), ("RING", "NEW")], "key_title string, key_condition string").withColumn("weeks", F.lit(1))
    dim = spark.createDataFrame([("Rings", "Jewellery", 0)], "bucket string, bucket_group string, group_pos int")
    path = shared_dir(spark, "bundle")
    sinks.write_tables(bundle.bundle_tables(raw, given, values, index, dim, parse_instant(F.col("first_seen")), SCOPE), path,
                       partition_by={"lots": ["auction_id"]})
    read = lambda n: sinks.read_table(spark, path, n)
    lots = read("lots").select(F.col("auction_id").cast("long"), "lot_number", "title", "buckets", "est_low", "sale_key", "alt_keys", "scrape")
    assert sorted((tuple(r) for r in lots.collect()), key=str) == sorted([
        (1, "A", "ring", ["Rings"], 7.0, "RING|GOOD", ["RING|NEW"], 1), (1, "A", "ring", ["Gone"], 7.0, "RING|GOOD", ["RING|NEW"], 1),
        (1, "B", "label", [], None, None, None, None), (2, "A", "rod", [], 9.0, None, None, 1)], key=str)
    assert sorted((r.bucket, r.bucket_group, r.uses) for r in read("bucket_groups").collect()) == [("Gone", "Other", 1), ("Rings", "Jewellery", 1)]
    assert sorted((r.bucket_group, r.uses) for r in read("groups").collect()) == [("Jewellery", 1), ("Other", 1)]
    assert sorted((r.auction_id, r.scrape, r.lots) for r in read("scrapes").collect()) == [(1, 1, 2), (2, 1, 1)]
    assert read("sale_history").count() == 2
