"""The written index against scans, and term matches by words against each term on each lot."""

import random

import pytest
from pyspark.sql import functions as F

from lotlens.operators import legend, postings, search

WORDS = ["kettle", "kettles", "kettel", "teapot", "café", "cafe", "x", "ab", "abc", "steel-pot", "pot", "spot", "longishword", "longishwordy", "longsword",
         "thermometers", "thermometre", "1042", "éé", "a1b2"]


def _lots(spark, n=300):
    rng = random.Random(5)
    pick = lambda k: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, k)))
    rows = [(i % 3, f"S-{i}", pick(6).title() or None, rng.choice(["pots", None, "kettle parts"]), rng.choice([pick(9) + "\n\t " + pick(2), None]),
             rng.choice([["Home", "Kettles & Pots"], [], None])) for i in range(n)]
    rows += [(1, "S-1", "repeated kettle", None, None, None)] * 2
    return spark.createDataFrame(rows, "auction_id long, lot_number string, title string, subcategory string, description string, category_path array<string>")


@pytest.fixture(scope="module")
def built(spark):
    lots = _lots(spark)
    return lots, postings.Index(spark, postings.build(lots, ("auction_id", "lot_number"), parts=8), 8)


def _keys(df):
    return sorted((r.auction_id, r.lot_number) for r in df.select("auction_id", "lot_number").distinct().collect())


@pytest.mark.parametrize("query", ["kettle", "ettl", "Café pot", "x", "ab 104", "s-1", "nothing here", "", "steel-pot é", "pots"])
def test_exact_equals_a_scan(built, query):
    lots, index = built
    assert _keys(index.exact(query)) == _keys(search.search(lots, query))


@pytest.mark.parametrize("query", ["kettle", "ketle", "thermometer", "longishwrd kettle", "cafe pot", "", "termometerss", "a1b3", "xyz"])
def test_fuzzy_equals_a_scan(built, query):
    lots, index = built
    assert _keys(index.fuzzy(query)) == _keys(search.search(lots, query, fuzzy=True))


def test_a_search_reads_the_parts_of_its_trigrams_only(built):
    _, index = built
    plan = index._holding("kettle")._jdf.queryExecution().executedPlan().toString()
    parts = sorted({postings.part_of("kettle"[i:i + 3], 8) for i in range(4)})
    assert len(parts) < 8
    assert "PartitionFilters: [gram_part" in plan and all(str(p) in plan.split("PartitionFilters: [gram_part")[1][:80] for p in parts)
    assert "cut_part" in index._near("kettle")._jdf.queryExecution().executedPlan().toString()


def test_deletions_agree_on_both_sides(spark):
    words = ["", "a", "aa", "abca", "éab"]
    got = {r.w: sorted(r.c) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", postings._cuts(F.col("w")).alias("c")).collect()}
    assert got == {w: postings.cuts_of(w) for w in words}


def test_lists_are_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 10)
    lots = spark.createDataFrame([(f"L{i}", f"common{i:04d}") for i in range(600)], "lot_number string, title string")
    path = postings.build(lots, parts=4)
    sizes = [r[0] for r in spark.read.parquet(f"{path}/grams").where("gram = 'com'").select(F.size("gaps")).collect()]
    assert sum(sizes) == 600 and max(sizes) < 30
    assert postings.Index(spark, path, 4).exact("common059").count() == 10


def test_a_word_brings_few_rows_and_its_lots_are_shuffled_once(spark):
    lots = spark.createDataFrame([(f"L{i}", f"kettl{i} verylongword{i} {'x' * 20}{i}") for i in range(10, 60)], "lot_number string, title string")
    path = postings.build(lots, parts=4)
    cuts = spark.read.parquet(f"{path}/cuts").join(spark.read.parquet(f"{path}/words"), "word_id")
    assert {r.word[:5] for r in cuts.select("word").distinct().collect()} == {"kettl", *(f"L{i}".lower() for i in range(10, 60))}
    assert cuts.groupBy("word").count().where(F.col("count") > F.length("word") + 1).count() == 0
    assert spark.read.parquet(f"{path}/lots").select("lot.lot_number", "word").where("word like 'kettl%'").count() == 50


@pytest.mark.parametrize("token", ["longishword", "thermometers", "termometerss", "steel-pots", "verymuchlonger thermometers".replace(" ", ""), "aaaaaaaaaa", "longswordlongsword"])
def test_words_of_more_edits_come_by_trigrams(spark, token):
    words = WORDS + ["longishwrds", "longsword", "thrmometres", "aaaaaaaab", "aaaaaaaaaabb", "longswordlongswrd", "lngswordlongswoord", "verymuchlongerthermomet"]
    index = postings.Index(spark, postings.build(spark.createDataFrame([(w, w) for w in words], "lot_number string, title string"), parts=8), 8)
    edits = int(search.TOLERANCE * len(token))
    want = sorted(w for w in {*words, "cafe", "ee"} if spark.range(1).select(F.levenshtein(F.lit(w), F.lit(token))).first()[0] <= edits)
    near = index._near(token)
    assert sorted(r.word for r in near.collect()) == want
    if len({token[i:i + 3] for i in range(len(token) - 2)}) > 3 * edits:
        assert "gram_part" in near._jdf.queryExecution().executedPlan().toString()


def test_an_edit_is_a_letter_of_any_length(spark):
    lots = spark.createDataFrame([("a", "schung\u00dfge"), ("b", "schungge"), ("c", "schung\u00df\u00dfge")], "lot_number string, title string")
    found = postings.Index(spark, postings.build(lots, parts=4), 4).fuzzy("schungge")
    assert sorted(r.lot_number for r in found.collect()) == ["a", "b"]


def test_an_index_of_nothing(spark):
    empty = spark.createDataFrame([], "lot_number string, title string")
    index = postings.Index(spark, postings.build(empty, parts=2), 2)
    assert index.exact("kettle").count() == 0 and index.fuzzy("kettle").count() == 0


def _terms(rng, n):
    found = {"kettle", "pot", "x", "steel-pot kettle", "café", "ab abc", "1042 s-", "  ", "zzz"}
    while len(found) < n:
        found.add(" ".join(rng.choice(WORDS)[: rng.randint(1, 9)] for _ in range(rng.randint(1, 3))))
    return sorted(found)


def test_terms_by_words_equal_each_term_on_each_lot(spark):
    lots = _lots(spark).withColumn("buckets", F.array(F.lit("b")))
    terms = _terms(random.Random(3), 150)
    key = ("auction_id",)
    rows = lambda df: sorted((r.auction_id, r.lot_number, r.term, r.whole) for r in df.collect())
    want = rows(legend.term_hits_scanned(lots, terms, key))
    assert rows(legend.term_hits_by_words(lots, terms, key)) == want and len({w[2] for w in want}) > 50


def test_many_terms_are_not_tried_one_by_one(spark):
    lots = _lots(spark)
    terms = [f"term{i} kettle" for i in range(25_000)] + ["kettle pot"]
    got = legend.term_hits(lots, terms, ("auction_id",))
    want = legend.term_hits_scanned(lots, ["kettle pot"], ("auction_id",))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
