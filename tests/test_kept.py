"""Tables kept in buckets: what a change set reads and writes, and that the outcome is that of a whole pass."""

import random

import pytest
from pyspark.sql import functions as F

from lotlens.operators import facets, kept, labels
from lotlens.sources import layered, sinks, versions

LABEL = "auction_id bigint, lot_number string, _ord bigint, mark string"
LAYER = f"{LABEL}, layer_no int"
SCOPE = ("auction_id",)


def rows_of(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def random_labels(rng, n, first=0):
    numbers = [None, "", *(str(k) for k in range(40))]
    return [(rng.choice([1, 1, 1, 2, 3]), rng.choice(numbers), first + i, f"m{first + i}") for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_upserts_as_in_one_pass(spark, tmp_path, seed):
    """Two change sets, with repeated lots, lots without a number and one auction that holds most rows."""
    rng, path = random.Random(seed), str(tmp_path / "labels")
    whole = spark.createDataFrame(random_labels(rng, 120), LABEL)
    kept.keep_labels(whole, path, SCOPE, groups=4, buckets=4)
    for turn in range(2):
        new = spark.createDataFrame(random_labels(rng, 25, 1000 * (turn + 1)), LABEL)
        merged = labels.upsert_labels(whole, new, SCOPE)
        kept.upsert(new, path)
        cols = ("auction_id", "lot_number", "mark", "change")
        assert rows_of(kept.upserted(spark, path), *cols) == rows_of(merged, *cols)
        whole = spark.createDataFrame([(r.auction_id, r.lot_number, r._ord.part * 10**6 + r._ord.ord, r.mark)
                                       for r in merged.collect()], LABEL)
    assert layered.version(spark, path) == 3


def test_a_change_touches_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "labels")
    every = spark.range(8000).selectExpr("id % 8 as auction_id", "cast(id as string) as lot_number", "id as _ord", "'old' as mark")
    kept.keep_labels(every, path, SCOPE, groups=8, buckets=8)
    before = {tuple(r) for r in layered.pieces(spark, path).collect()}
    new = every.where("auction_id = 3 and _ord < 640").withColumn("mark", F.lit("new"))
    kept.upsert(new, path)
    after = {tuple(r) for r in layered.pieces(spark, path).collect()}
    assert len({b for b, _, _ in after - before}) <= 8  # the buckets of one group of auctions
    assert len(before & after) >= len(before) - 8
    read = layered.read(spark, path, new).inputFiles()
    assert 0 < len(read) <= 8 < len(layered.read(spark, path).inputFiles())
    assert kept.upserted(spark, path).where("mark = 'new'").count() == new.count()
    assert layered.read(spark, path, at=1).where("mark = 'new'").isEmpty()


@pytest.mark.parametrize("seed", [1])
def test_layers_fold_alike_at_any_number_of_pieces(spark, tmp_path, seed):
    rng, path = random.Random(seed), str(tmp_path / "layers")
    lots = [(a, str(k), 0, "base", 0) for a in (1, 2) for k in range(30)]
    base = spark.createDataFrame(lots, LAYER)
    kept.keep_layers(base.drop("layer_no"), path, SCOPE, groups=2, buckets=3)
    every = base
    for n in (2, 1, 3, 4, 4):  # out of order, and one layer twice
        layer = spark.createDataFrame([(a, k, o, m, n) for a, k, o, m in random_labels(rng, 20, 100 * n)], LAYER)
        every = every.unionByName(layer)
        kept.add_layer(layer, path, most=2)
        cols = ("auction_id", "lot_number", "mark", "layer_no")
        assert rows_of(kept.folded(spark, path), *cols) == rows_of(labels.fold_layers(every, SCOPE), *cols)
    assert layered.pieces(spark, path).groupBy("bucket").count().agg(F.max("count")).first()[0] <= 2


def test_appending_reads_nothing_and_keeps_pieces(spark, tmp_path):
    path = str(tmp_path / "layers")
    base = spark.range(400).selectExpr("id % 4 as auction_id", "cast(id as string) as lot_number", "id as _ord", "'old' as mark")
    kept.keep_layers(base, path, SCOPE, groups=4, buckets=4)
    before = {tuple(r) for r in layered.pieces(spark, path).collect()}
    kept.add_layer(base.where("_ord = 7").withColumn("layer_no", F.lit(1)), path)
    after = {tuple(r) for r in layered.pieces(spark, path).collect()}
    assert before < after and len(after - before) == 1 and next(iter(after - before))[2] == 1


def test_empty_tables(spark, tmp_path):
    none, path = spark.createDataFrame([], LABEL), str(tmp_path / "labels")
    kept.keep_labels(none, path, SCOPE, groups=2, buckets=2)
    assert kept.upserted(spark, path).isEmpty()
    kept.upsert(none, path)
    kept.upsert(spark.createDataFrame([(1, "7", 0, "m")], LABEL), path)
    assert rows_of(kept.upserted(spark, path), "lot_number", "change") == [("7", "added")]


def test_of_two_writers_of_one_version_one_is_refused(spark, tmp_path):
    path = str(tmp_path / "labels")
    kept.keep_labels(spark.createDataFrame([(1, "7", 0, "m")], LABEL), path, SCOPE)
    new = spark.createDataFrame([(1, "7", 1, "x")], LABEL)

    def late(old, given):
        kept.upsert(new, path)  # somebody else is done first
        return old

    with pytest.raises(versions.Conflict):
        layered.rewrite(kept._ordered(new, 2), path, late)
    assert rows_of(kept.upserted(spark, path), "mark") == [("x",)]


def test_runs_take_numbers_once(spark, tmp_path):
    path, lots = str(tmp_path / "out"), spark.range(1)

    def other(written):
        if not seen:
            seen.append(1)
            sinks.write_tables({"lots": spark.range(5)}, path)
        return lots.selectExpr("'p' as problem", "id as n", "false as fatal").where("false")

    seen = []
    sinks.write_tables({"lots": lots}, path, {"meanwhile": other})
    assert sinks.read_table(spark, path, "lots").count() == 1
    assert {r[0] for r in spark.read.parquet(f"{path}/manifest").select("version").collect()} == {1, 2}


def test_counts_kept_up_by_changes(spark):
    """Random change sets against counting anew: lots that come, go and move, one path that holds most of them."""
    rng = random.Random(5)
    schema = "auction_id bigint, lot_number string, category_path array<string>"
    lots = {n: (1, str(n), rng.choice([["A"], ["A"], ["A", "B"], [], None])) for n in range(60)}
    table = lambda rows: facets.tree_nodes(spark.createDataFrame(list(rows), schema))
    counts = facets.counted(table(lots.values()))
    for turn in range(2):
        changed = rng.sample(range(80), 20)
        before = [lots.pop(n) for n in changed if n in lots]
        after = [(1, str(n), rng.choice([["A"], ["C", f"t{turn}"], ["A", "B", "D"]])) for n in changed if rng.random() < 0.7]
        lots |= {int(r[1]): r for r in after}
        counts = facets.recounted(counts, table(before), table(after))
        assert rows_of(counts, "path", "lots") == rows_of(facets.counted(table(lots.values())), "path", "lots")
