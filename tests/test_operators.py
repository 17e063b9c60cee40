"""Operators on small hand-written tables: the rules that are easy to get wrong."""

import json
import random
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lotlens.operators import browse, chunks, facets, gates, ingest, labels, products, recall, sales, scrapes, search, skew
from lotlens.operators import shortlist as short
from lotlens.operators.skew import attach
from lotlens.session import shared_dir
from lotlens.sources import config, landing, sinks
from lotlens.sources.config import Bucket, Interest
from lotlens.streaming import ingest as stream


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


# --- sale history -----------------------------------------------------------------------

def test_sale_aggregate_against_brute_force(spark):
    rng = random.Random(7)
    data, want = [], defaultdict(lambda: [[], 0])
    for i in range(3000):
        # One product holds a third of all rows.
        title = "Hot Item" if rng.random() < 0.34 else f"item {rng.randrange(40)}"
        price = rng.choice([None, float(rng.randrange(1, 60))])
        data.append((i, title, rng.choice(["Good", None]), [price + 1, price + 2] if price else [1.0, 2.0]))
        group = want[(title.upper(), (data[-1][2] or "").upper())]
        group[0].append(price) if price else group.__setitem__(1, group[1] + 1)
    closed = spark.createDataFrame(data, "_ord long, title string, condition string, bids array<double>").repartition(7)
    got = {(r.key_title, r.key_condition): r for r in sales.sale_aggregate(closed).collect()}
    assert set(got) == set(want)
    for key, (sold, unsold) in want.items():
        r = got[key]
        assert (r.sold, r.unsold) == (len(sold), unsold)
        assert r.median == (statistics.median(sold) if sold else None)
        assert (r.low, r.high) == ((min(sold), max(sold)) if sold else (None, None))
    copies = Counter()
    for r in sales.sale_prices(closed).collect():
        copies[(r.key_title, r.key_condition)] += r.copies
    assert all(copies[k] == len(v[0]) for k, v in want.items())


def _index(spark, entries):
    schema = "title string, condition string, close_date string, _file string, _ord int, sold string, unsold string, median string, low string, high string"
    return sales.sale_index(spark.createDataFrame(
        [(t, c, d, f, i, "2", "1", "5", "4", "6") for i, (t, c, d, f) in enumerate(entries)], schema))


def test_sale_index_keeps_the_newest_eight(spark):
    index = _index(spark, [("Lamp", "Good", f"2026-01-{d:02d}", f"f{d}") for d in range(1, 12)]
                   + [("Lamp", "Good", "2026-01-11", "a"), (None, " ", "2026-01-01", "x"), ("", "Good", "2026-01-01", "x")])
    got = {(r.key_title, r.key_condition): [w.close_date for w in r.weeks] for r in index.collect()}
    assert got[("LAMP", "GOOD")] == ["2026-01-11"] * 2 + [f"2026-01-{d:02d}" for d in range(10, 4, -1)]
    assert ("", "") not in got and ("", "GOOD") in got


def test_alternates_nearest_grade_first(spark):
    grades = ["Excellent", "Fair", "Brand New - Sealed", "Odd", "", "New With Defects", "For Parts Only"]
    index = _index(spark, [("Lamp", g, "2026-01-01", "f") for g in grades] + [("Bare", "", "2026-01-01", "f")])
    lots = spark.createDataFrame([("1", "lamp ", "Good"), ("2", "Lamp", None), ("3", "Bare", None), ("4", "None", "Good")],
                                 "lot_number string, title string, condition string")
    got = {r.lot_number: r for r in sales.join_sale_history(lots, index).collect()}
    tail = lambda r: [k.rpartition("|")[2] for k in r.alt_keys]
    assert got["1"].sale_key is None
    assert tail(got["1"]) == ["NEW WITH DEFECTS", "EXCELLENT", "FAIR", "FOR PARTS ONLY", "BRAND NEW - SEALED", "ODD"]
    assert got["2"].sale_key == "LAMP|" and tail(got["2"])[0] == "BRAND NEW - SEALED"
    assert got["3"].sale_key == "BARE|" and got["3"].alt_keys is None
    assert (got["4"].sale_key, got["4"].alt_keys) == (None, None)
    shown = {r.lot_number: r for r in sales.sale_history_for_lot(lots, index).collect()}
    assert shown["1"].source_grade == "NEW WITH DEFECTS" and len(shown["1"].weeks) == 1
    assert shown["2"].source_grade is None and shown["4"].weeks is None


# --- labels -----------------------------------------------------------------------------

def test_label_join_prefers_the_id_and_the_last_row(spark):
    lots = spark.createDataFrame([(10, "7", 0, "old"), (10, "7", 1, "new"), (7, "8", 2, "other")],
                                 "id long, lot_number string, _ord long, title string")
    lab = spark.createDataFrame([("10", 0, "a"), ("7", 1, "b"), ("8", 2, None), ("99", 3, "x"), (None, 4, "y")],
                                "lot_number string, _ord long, note string")
    out = labels.join_labels_raw(lab, lots)
    assert rows(out, "lot_number", "title", "note", "matched_by") == [
        ("7", "new", "a", "id"), ("8", "other", "b", "id"), ("8", "other", None, "lot_number")]
    assert rows(labels.label_orphans(lab, lots), "note") == [("x",), ("y",)]


def test_upsert_duplicates(spark):
    old = spark.createDataFrame([("1", 0, "a"), ("1", 1, "b"), ("2", 2, "c"), (None, 3, "d"), ("", 4, "e")], "lot_number string, _ord long, v string")
    new = spark.createDataFrame([("1", 0, "n1"), ("1", 1, "n2"), ("5", 2, "first"), ("5", 3, "second"), (None, 4, "k"), ("", 5, "m")],
                                "lot_number string, _ord long, v string")
    out = labels.upsert_labels(old, new)
    assert rows(out, "lot_number", "v", "change") == sorted([
        ("1", "n2", "updated"), ("1", "n2", "updated"), ("2", "c", "kept"), (None, "d", "kept"), ("", "e", "kept"),
        ("5", "first", "added"), (None, "k", "added"), ("", "m", "added")], key=repr)
    assert rows(labels.change_counts(out)) == [(3, 2, 8)]
    assert [r.v for r in out.orderBy("_ord").collect()][:5] == ["n2", "n2", "c", "d", "e"]


def test_folding_twice_changes_nothing(spark):
    layers = spark.createDataFrame(
        [("1", 0, 0, "-"), ("2", 0, 0, "-"), ("1", 1, 0, "a"), ("1", 2, 0, "b"), ("1", 2, 1, "c"), ("9", 1, 0, "gone")],
        "lot_number string, layer_no int, _ord long, v string")
    once = labels.fold_layers(layers)
    assert rows(once, "lot_number", "v") == [("1", "c"), ("2", "-")]
    again = layers.unionByName(once.withColumn("layer_no", F.lit(9)).withColumn("_ord", F.lit(0)))
    assert rows(labels.fold_layers(again), "lot_number", "v") == rows(once, "lot_number", "v")


def test_new_lots_need_both_keys_absent(spark):
    lots = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d"), (5, None)], "id long, lot_number string")
    known = spark.createDataFrame([("1",), ("b",), (None,), ("",)], "lot_number string")
    assert rows(labels.diff_new(lots, known)) == [(3, "c"), (5, None), (None, "d")]
    batch = spark.createDataFrame([(3, "zz")], "id long, lot_number string")
    assert rows(labels.delta_new(lots, known, [batch])) == [(5, None), (None, "d")]


def test_no_join_is_a_nested_loop(spark):
    lots = spark.range(10).select("id", F.col("id").cast("string").alias("lot_number"))
    plan = labels.diff_new(lots, lots.select("lot_number"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


# --- products and chunks -------------------------------------------------------------------

def test_products_cover_every_lot_once(spark):
    rng = random.Random(3)
    data = [(f"L{i}", "Hot" if rng.random() < 0.4 else f"t{rng.randrange(30)}", rng.choice(["Good", None, ""]), rng.choice(["s", " S ", None]))
            for i in range(500)]
    slim = spark.createDataFrame(data, "lot_number string, title string, condition string, size string")
    prods = products.dedupe_products(slim)
    want = defaultdict(list)
    for lot, title, cond, size in data:
        want[(title.upper(), cond, (size or "").strip().upper())].append(lot)
    assert rows(prods, "rep_lot", "qty") == sorted((min(v), len(v)) for v in want.values())
    members = products.product_members(slim, prods)
    assert rows(members, "lot_number", "rep_lot") == sorted((m, min(v)) for v in want.values() for m in v)
    assert rows(gates.gate_fanout(prods, slim)) == []


def _chunks_by_hand(items, target, drift):
    """Each cut tries every row: the run boundary nearest to the wanted place, the later of two, else the place itself."""
    family = [(c, tuple(t.upper().split()[:2])) for c, t, _ in items]
    edges = {n for n in range(1, len(items)) if family[n] != family[n - 1]}
    cuts = [0]
    while len(items) - cuts[-1] > target:
        wanted = cuts[-1] + target
        reach = [n for n in edges if n > cuts[-1] and -drift <= n - wanted <= drift]
        cuts.append(sorted(reach, key=lambda n: (abs(n - wanted), -n))[0] if reach else wanted)
    return [items[a:b] for a, b in zip(cuts, [*cuts[1:], len(items)])]


@pytest.mark.parametrize("target, drift, words", [(20, 2, 12), (20, 1, 2), (7, 3, 30), (500, 50, 5)])
def test_chunks_against_row_by_row_cuts(spark, target, drift, words):
    rng = random.Random(target)
    items = sorted({(f"c{rng.randrange(3)}", f"{rng.choice(['Ab', 'AB', 'ab'])} w{rng.randrange(words)} x{rng.randrange(9)}", f"L{i:03d}") for i in range(300)})
    want = sorted((lot, n) for n, part in enumerate(_chunks_by_hand(items, target, drift), 1) for _, _, lot in part)
    df = spark.createDataFrame([(1, *i) for i in items], "auction_id long, category string, title string, rep_lot string").repartition(5)
    assert rows(chunks.chunk_products(df, target, drift), "rep_lot", "chunk") == want


# --- runs -------------------------------------------------------------------------------------

def test_runs_are_measured_from_their_start(spark):
    stamps = ["2026-09-13T10:00:00Z", "2026-09-13T12:00:00+00:00", "2026-09-13T13:00:01Z", "2026-09-13T14:00:00Z", "2026-09-16T01:00:00Z",
              "2026-09-13T10:00:00", "soon", None]
    lots = spark.createDataFrame([(1, str(i), s) for i, s in enumerate(stamps)], "auction_id long, lot_number string, first_seen string")
    from lotlens.functions.values import parse_instant

    runs = scrapes.run_stamps(lots, parse_instant(F.col("first_seen")), ["auction_id"])
    assigned = scrapes.assign_scrapes(lots, runs, parse_instant(F.col("first_seen")), ["auction_id"])
    assert [r.scrape for r in assigned.orderBy("lot_number").collect()] == [1, 1, 2, 2, 3, None, None, None]
    assert rows(scrapes.scrape_clusters(assigned, runs, ["auction_id"]), "scrape", "label", "lots") == [
        (1, "Sun Sep 13 06:00", 2), (2, "Sun Sep 13 09:00", 2), (3, "Tue Sep 15", 1)]


def test_first_seen_comes_from_the_previous_snapshot(spark):
    prior = spark.createDataFrame([(1, "t1", "s"), (2, None, "s"), (3, "", None)], "id long, first_seen string, scraped_at string")
    now = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    out = ingest.first_seen_carry(now, prior, F.lit("now"))
    assert rows(out, "id", "first_seen", "is_new") == [(1, "t1", False), (2, "s", False), (3, "now", True), (4, "now", True)]


def test_slim_reads_lines_between_carriage_returns(spark):
    raw = "Model: A:1\rNotes:\rIs Item Damaged? Yes\rIs Item Damaged? Unknown\rIs Item Functional? Yes: no\rMissing Major Parts? No\nVerified Size: XL\rModel: B"
    df = spark.createDataFrame([("1", "t", "Good", "c", raw, " ")], "lot_number string, title string, condition string, category string, description_raw string, description string")
    r = ingest.slim_lots(df).head()
    assert (r.model, r.notes, r.damaged, r.functional, r.missing_major_parts, r["size"], r.description) == ("B", None, "Unknown", None, None, None, None)


# --- shortlist and recall -----------------------------------------------------------------------

BUCKETS = [Bucket("Keys", seeds=("key", "pla "), exclude=("keychain",), condition_in=("Good",)),
           Bucket("Desks", categories=("Office - Desks",)), Bucket("Empty", seeds=("nothing-like-it",))]


def test_shortlist_rules(spark):
    data = [("1", "KEYBOARD", "Good", "x"), ("2", "MONKEY", "Good", "x"), ("3", "keychain key", "Good", "x"), ("4", "key", "Fair", "x"),
            ("5", "key", None, "x"), ("6", "table", None, "Office - Desks - Oak"), ("7", "table", None, "Office - Desks & chairs"), ("8", "PLATED", None, None)]
    lots = spark.createDataFrame(data, "lot_number string, title string, condition string, category string")
    out = short.shortlist_lots(lots, BUCKETS, [Interest("Any", seeds=("table",))])
    got = {r.lot_number: ([(c.bucket, c.reason) for c in r.cand], [c.bucket for c in r.profile]) for r in out.collect()}
    assert got == {"1": ([("Keys", "key")], []), "2": ([], []), "3": ([], []), "4": ([], []), "5": ([("Keys", "key")], []),
                   "6": ([("Desks", "office - desks")], ["Any"]), "7": ([], ["Any"]), "8": ([], [])}
    open_gate = short.shortlist_lots(lots, BUCKETS, gate=False).where("lot_number = '4'").head()
    assert [c.bucket for c in open_gate.cand] == ["Keys"]
    sizes = short.bucket_sizes(out).select("bucket", "lots")
    order = short.candidate_order(short.with_primary(out, sizes))
    assert rows(order, "start_row", "primary_bucket", "rows") == [(0, "~profile only", 1), (1, "Desks", 1), (2, "Keys", 2)]


def test_each_pattern_is_evaluated_once(spark):
    lots = spark.createDataFrame([("1", "key", "Good", "x")], "lot_number string, title string, condition string, category string")
    plan = short.bucket_sizes(short.shortlist_lots(lots, BUCKETS))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("keychain") == 1


def test_recall_needs_a_clear_family(spark):
    data = [(f"f{i}", "LOGITECH MX KEYS", 1, "c", ["Boards"]) for i in range(3)] + [
        ("e", "LOGITECH MX DOCK", 2, "c", ["Electronics"]), ("q", "Logitech MX Anywhere", 1, "c", []), ("v", "LOGITECH MX cable", 1, "c", []),
        ("z", "PHILIPS AVENT CUP", 1, "c", [])]
    df = spark.createDataFrame(data, "rep_lot string, title string, qty long, category string, buckets array<string>")
    out = recall.recall_suspects(df, [Bucket("Boards", seeds=("keys",), exclude=("CABLE",))])
    assert [(r.rep_lot, [(s.bucket, s.kind, s.sibling) for s in r.suspect]) for r in out.collect()] == [
        ("q", [("Boards", 2, "LOGITECH MX KEYS")])]


# --- search and browse ---------------------------------------------------------------------------

def test_search_cases(spark):
    lots = spark.createDataFrame([("S-1", "Wüsthof knife", "", ["Kitchen"]), ("S-2", "KitchenAid MIXER", "red", ["Home", "Café"]), ("M-3", "Drill", "with case", [])],
                                 "lot_number string, title string, description string, category_path array<string>")
    hit = lambda q, fuzzy=False: [r.lot_number for r in search.search(lots, q, fuzzy).orderBy("lot_number").collect()]
    assert hit("wusthof") == ["S-1"] and hit("wustof") == [] and hit("wustof", True) == ["S-1"]
    assert hit("kitchenad", True) == ["S-2"] and hit("drll", True) == []
    assert hit("kitchen") == ["S-1", "S-2"] and hit("RED cafe") == ["S-2"] and hit("red cafe", True) == ["S-2"]
    assert hit("   ") == [] and search.search_in_view(lots, " ").count() == 3
    assert hit("m-3") == ["M-3"]


def test_lot_references(spark):
    lots = spark.createDataFrame([("S-1042",), ("M-1042",), ("77",)], "lot_number string")
    refs = spark.createDataFrame([(r,) for r in ("1042", "s1042", " m 1042", "77", "x9", "S#9")], "ref string")
    view = lots.where("lot_number like 'M%'")
    assert rows(search.resolve_lot_refs(refs, lots, view)) == [(" m 1042", "M-1042"), ("1042", "M-1042"), ("77", "77"), ("S#9", None), ("s1042", "S-1042"), ("x9", None)]


def test_hangul_is_found(spark):
    lots = spark.createDataFrame([("1", "한국 차"), ("2", "Ａｎ ñandú")], "lot_number string, title string")
    hit = lambda q: [r.lot_number for r in search.search(lots, q).collect()]
    assert hit("한국") == ["1"] and hit("nandu") == ["2"]


def test_flagged_tab_without_a_bucket_shows_nothing(spark):
    lots = spark.createDataFrame([("1", True, ["A"], None)], "lot_number string, is_flagged boolean, buckets array<string>, subtype string")
    assert browse.filter_tab(lots, "flagged").count() == 0
    assert browse.filter_tab(lots, "flagged", bucket="A").count() == 1
    assert browse.filter_tab(lots, "flagged", bucket="A", subtype="s").count() == 0


def test_category_tree_counts_every_level(spark):
    lots = spark.createDataFrame([(["a", "b"],), (["a"],), ([],), (["a", "c"],), (["a", "c"],)], "category_path array<string>")
    assert rows(facets.category_tree(lots), "path", "lots", "sibling_rank") == sorted(
        [([], 5, 1), (["a"], 4, 1), (["a", "b"], 1, 2), (["a", "c"], 2, 1)], key=repr)


# --- gates, sources, sinks, stream -----------------------------------------------------------------

def test_write_is_all_or_nothing(spark):
    path = shared_dir(spark, "sink")
    good = spark.createDataFrame([("1", "t", "c", "Good")], "lot_number string, title string, category string, condition string")
    slim = {"slim": lambda written: gates.gate_slim(written["lots"])}
    sinks.write_tables({"lots": good}, path, slim)
    bad = good.withColumn("title", F.lit(""))
    with pytest.raises(gates.GateError, match="title"):
        sinks.write_tables({"lots": bad}, path, slim)
    assert sinks.read_table(spark, path, "lots").head().title == "t"
    sinks.write_tables({"lots": good.withColumn("title", F.lit("later"))}, path, slim)
    assert sinks.read_table(spark, path, "lots").head().title == "later"


def test_sources_skip_what_they_cannot_read(spark, tmp_path):
    folder = tmp_path / "history"
    folder.mkdir()
    (folder / "b.json").write_text(json.dumps({"close_date": "2026-01-02", "products": [{"title": "x", "sold": "many"}]}))
    (folder / "c.json").write_text('{"close_date": "2026-')
    (folder / "d.json").write_text(json.dumps([{"title": "no envelope"}]))
    assert rows(landing.read_sale_history(spark, str(folder)), "title", "sold") == [("x", "many")]
    assert landing.read_sale_history(spark, str(tmp_path / "none")).count() == 0
    items = tmp_path / "items"
    items.mkdir()
    (items / "env.json").write_text(json.dumps({"auction_id": 4, "items": [{"id": 1}, {"id": 2}]}))
    (items / "bare.json").write_text(json.dumps([{"id": 3}]))
    (items / "broken.json").write_text('{"items": [')
    read = landing.read_snapshot(spark, str(items))
    assert rows(landing.usable(read, "id"), "id", "auction_id") == [(1, 4), (2, 4), (3, None)]
    assert [r._file.rsplit("/", 1)[1] for r in landing.rejects(read).collect()] == ["broken.json"]


def test_the_later_file_wins_whatever_its_size(spark, tmp_path):
    """Spark packs files by size; the order that rules need is the order of paths and places."""
    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"auction_id": 1, "items": [{"id": 1, "title": "old"}]}))
    (folder / "b.json").write_text(json.dumps({"auction_id": 1, "items": [{"id": 1, "title": "new"}] + [{"id": k, "title": "x" * 500} for k in range(2, 400)]}))
    read = landing.usable(landing.read_snapshot(spark, str(folder)), "id")
    from lotlens.operators.common import latest
    assert latest(read.select("id", "title", "_ord"), ["id"], "_ord").where("id = 1").head().title == "new"


def test_rules_come_from_a_checked_file(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"buckets": [{"name": "A", "group": "g", "seeds": ["x", "y"]}], "interests": [{"name": "I", "buckets": ["A"]}]}))
    buckets, interests, legend = config.load(spark, str(path))
    assert buckets == [Bucket("A", "g", seeds=("x", "y"))] and interests == [Interest("I", buckets=("A",))] and legend == []
    path.write_text(json.dumps({"buckets": [{"name": "A", "condition_in": ["Nearly New"]}]}))
    with pytest.raises(ValueError, match="unknown conditions"):
        config.load(spark, str(path))


def test_stale_configuration_is_refused():
    with pytest.raises(ValueError, match="unknown conditions"):
        config.check([Bucket("A", condition_in=("Nearly New",))])
    with pytest.raises(ValueError, match="claimed by no interest"):
        config.check([Bucket("A")], [Interest("I", buckets=())])


def test_a_lot_that_returns_is_new_again(spark):
    arrivals, state = shared_dir(spark, "arrivals"), shared_dir(spark, "state")
    seen = []
    for n, ids in enumerate(([1, 2], [1], [1, 2])):
        page = [(7, f"t{n}", [(i,) for i in ids])]
        spark.createDataFrame(page, "auction_id long, scraped_at string, items array<struct<id:long>>").coalesce(1).write.mode("append").json(arrivals)
        stream.start(spark, arrivals, state, files_per_batch=1000).awaitTermination()
        shot = spark.read.parquet(f"{state}/snapshots").where(F.col("scraped_at") == f"t{n}")
        seen.append(rows(shot, "id", "first_seen", "is_new"))
    assert seen == [[(1, "t0", True), (2, "t0", True)], [(1, "t0", False)], [(1, "t0", False), (2, "t2", True)]]
    # A batch that runs again leaves the same state.
    batch = (spark.read.schema("auction_id long, scraped_at string").json(arrivals).where("scraped_at = 't2'")
             .select("auction_id", "scraped_at", F.lit(0).alias("_ord"), F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("id")))
    nested = landing.landing_item()
    for f in nested.fields:
        if f.name != "id":
            batch = batch.withColumn(f.name, F.lit(None).cast(f.dataType))
    stream.process_batch(batch, 2, state)
    assert rows(spark.read.parquet(f"{state}/snapshots").where("scraped_at = 't2'"), "id", "first_seen", "is_new") == seen[2]


def test_a_snapshot_may_come_in_files_and_two_in_one_trigger(spark):
    def land(arrivals, stamp, ids):
        page = [(7, stamp, [(i,) for i in ids])]
        spark.createDataFrame(page, "auction_id long, scraped_at string, items array<struct<id:long>>").coalesce(1).write.mode("append").json(arrivals)

    want = [(1, "t0", False), (2, "t0", False), (3, "t1", True), (4, "t1", True)]
    for reader in ({"files_per_batch": 1}, {}):
        arrivals, state = shared_dir(spark, "arrivals"), shared_dir(spark, "state")
        for stamp, ids in (("t0", [1]), ("t0", [2]), ("t1", [1, 3]), ("t1", [2, 4])):
            land(arrivals, stamp, ids)
        spark.createDataFrame([('{"auction_id": 7, "items": [{"id"',)], "value string").coalesce(1).write.mode("append").text(arrivals)
        stream.start(spark, arrivals, state, **reader).awaitTermination()
        shot = spark.read.parquet(f"{state}/snapshots").where("scraped_at = 't1'")
        assert rows(shot, "id", "first_seen", "is_new") == want
        assert spark.read.parquet(f"{state}/rejects").count() == 1


# --- auctions that reuse lot numbers, keys that repeat --------------------------------------------------

AT = ("auction_id",)


def test_lots_of_two_auctions_are_not_mixed_up(spark):
    lots = spark.createDataFrame([(1, "7"), (2, "7"), (2, "8")], "auction_id long, lot_number string")
    flags = lots.withColumn("buckets", F.array(F.lit("A"))).withColumn("is_flagged", F.lit(True)).withColumn("subtype", F.lit(None).cast("string"))
    assert gates.gate_lot_sets(flags, lots, ["lot_number"], True, AT).count() == 0
    other = gates.gate_lot_sets(flags.where("auction_id = 1"), lots, ["lot_number"], True, AT)
    assert rows(other, "auction_id", "check", "n") == [(2, "absent", 2), (2, "fingerprint", 0)]
    dim = spark.createDataFrame([("A", "g", 0)], "bucket string, bucket_group string, group_pos int")
    assert {r.lots for r in facets.label_nav(flags, dim, AT).collect()} == {3}
    watched = spark.createDataFrame([(2, "7")], "auction_id long, lot_number string")
    assert rows(browse.filter_tab(lots, "watched", watched, scope=AT), "auction_id", "lot_number") == [(2, "7")]
    short = spark.createDataFrame([(1, "7", [("A", "x")], []), (2, "7", [], []), (2, "8", [], [])],
                                  "auction_id long, lot_number string, cand array<struct<bucket:string,reason:string>>, profile array<string>")
    from lotlens.operators.shortlist import bucket_sizes
    assert rows(bucket_sizes(short, scope=AT), "auction_id", "lots", "share") == [(1, 1, 1.0)]


def test_chunks_of_two_auctions_answer_for_themselves(spark):
    chunks_of = spark.createDataFrame([(a, 1, "7", True) for a in (1, 2)], "auction_id long, chunk int, lot_number string, is_last boolean")
    answer = [(a, 1, 0, "7", False, [], False, None, list(gates.REQUIRED_KEYS)) for a in (1, 2)]
    marker = [(a, 1, 9, None, None, [], None, "7", ["chunk_complete"]) for a in (1, 2)]
    responses = spark.createDataFrame(answer + marker, "auction_id long, chunk int, pos int, lot_number string, is_flagged boolean, "
                                      "buckets array<string>, personal_match boolean, chunk_complete string, keys array<string>")
    assert gates.gate_responses(chunks_of, responses, AT).count() == 0
    reps = spark.createDataFrame([(1, "7"), (2, "7"), (2, "9")], "auction_id long, rep_lot string")
    assert rows(gates.gate_coverage(chunks_of, reps, AT), "auction_id", "problem", "n") == [(2, "products in no chunk", 1)]


def test_suspects_follow_from_their_own_auction(spark):
    labelled = spark.createDataFrame(
        [(1, "1", "Acme steel rod", "Tools", 2, ["Rods"]), (1, "2", "Acme steel rod kit", "Tools", 1, []), (2, "2", "Acme steel rod kit", "Tools", 1, [])],
        "auction_id long, rep_lot string, title string, category string, qty long, buckets array<string>")
    assert rows(recall.recall_suspects(labelled, [Bucket("Rods")], AT), "auction_id", "rep_lot") == [(1, "2")]


def test_repeated_valuations_multiply_nothing(spark):
    lots = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b")], "lot_number string, title string")
    prods = products.dedupe_products(lots)
    twice = spark.createDataFrame([("1", 1.0, 1), ("1", 2.0, 2), ("3", 5.0, 1)], "lot_number string, est_low double, _ord int")
    out = products.fanout_valuations(products.product_members(lots, prods), twice)
    assert rows(out, "lot_number", "est_low") == [("1", 2.0), ("2", 2.0), ("3", 5.0)]
    old = spark.createDataFrame([("1", 1)], "lot_number string, _ord int")
    fixes = spark.createDataFrame([("3", 7.0, 1), ("3", 8.0, 2)], "lot_number string, est_low double, _ord int")
    out = products.regroup_apply(lots, old, twice.where("lot_number = '1'"), fixes)
    assert rows(out, "lot_number", "source", "est_low") == [("1", "kept", 2.0), ("3", "fixed", 8.0)]
    layers = spark.createDataFrame([("1", 0), ("1", 0), ("1", 1), ("9", 1)], "lot_number string, layer_no int")
    assert rows(labels.layer_report(layers), "layer_no", "applied", "dropped") == [(1, 1, 1)]


def test_whole_orders_have_a_place_for_every_row(spark):
    from lotlens.operators.common import positions
    data = [(i, i * 7919 % 100) for i in range(5000)]
    df = spark.createDataFrame(data, "id long, v long").repartition(7)
    want = sorted((n, i) for n, (_, i) in enumerate(sorted((-v, i) for i, v in data), 1))
    assert sorted(rows(positions(df, [F.col("v").desc(), F.col("id").asc()]), "position", "id")) == want


def test_a_bar_in_a_title_is_no_key(spark):
    index = spark.createDataFrame([("A|B", "C", []), ("A", "B|C", [])], "key_title string, key_condition string, weeks array<string>")
    lots = spark.createDataFrame([("1", "a|b", "c")], "lot_number string, title string, condition string")
    used = sales.sale_index_used(sales.join_sale_history(lots, index), index)
    assert rows(used, "key_title", "key_condition") == [("A|B", "C")]


def test_fingerprint_ignores_order_and_counts_repeats(spark):
    make = lambda *lots: spark.createDataFrame([(x,) for x in lots], "lot_number string")
    sha = lambda df: gates.lot_set_sha(df).head().lot_set_sha
    assert sha(make("a", "b", "c")) == sha(make("c", "a", "b").repartition(3))
    assert len({sha(make("a", "b")), sha(make("a", "b", "b")), sha(make("ab")), sha(make("a", "c"))}) == 4


def test_hot_key_is_split(spark):
    """Two thirds of the rows share a key, others have none: the join stays whole and spread."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(30000).select("id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"))
        right = left.where("k is not null").groupBy("k").agg(F.min("id").alias("low"))
        out = attach(left, right, ["k"], rows_per_part=300)
        placed = out.withColumn("p", F.spark_partition_id())
        assert placed.count() == 30000
        assert placed.where("k = 'hot'").agg(F.count("*"), F.min("low"), F.max("low"), F.count_distinct("p")).head()[:] == (20000, 1, 1, 8)
        biggest = placed.groupBy("p").count().agg(F.max("count")).head()[0]
        assert biggest < 30000 / 8 * 1.5
        assert out.where("k is null").count() == 5000 and out.where("k like 'k%' and low = id").count() == 5000
        assert attach(left, right, ["k"], "inner", rows_per_part=5000).count() == 25000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_every_hot_key_is_split(spark):
    """Two thousand keys over the limit, and one far over it: none is left whole."""
    left = spark.range(40000).select("id", F.when(F.col("id") < 20000, F.col("id") % 2000).otherwise(F.lit(-1)).alias("k"))
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    parts = {r.k: r._parts for r in skew.hot_keys(counts, ["k"], 5).collect()}
    assert len(parts) == 2001 and parts[-1] == 4000 and set(parts[k] for k in parts if k >= 0) == {2}
    out = attach(left, counts, ["k"], rows_per_part=5)
    assert out.count() == 40000 and out.where("k = -1 and n = 20000").count() == 20000


def test_products_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_PART", 50)
    test_products_cover_every_lot_once(spark)
    slim = spark.createDataFrame([(f"L{i:03d}", "Hot" if i % 3 else f"t{i}") for i in range(300)], "lot_number string, title string")
    prods = products.dedupe_products(slim)
    members = products.product_members(slim, prods)
    answers = prods.where("qty > 1").select(F.col("rep_lot").alias("lot_number"), F.lit(True).alias("is_flagged"), F.array(F.lit("B")).alias("buckets"))
    out = products.fanout_labels(members, answers)
    assert out.count() == 300 and out.where("is_flagged").count() == 200
