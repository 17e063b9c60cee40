"""Column functions on hand-written cases."""

import pytest
from pyspark.sql import functions as F

from lotlens.functions import patterns, text, values


def one(spark, column, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return row.select(column.alias("x")).head()["x"]


@pytest.mark.parametrize("raw, grade, rest", [
    (None, None, ""),
    ("", None, ""),
    ("EXCELLENT", "Excellent", ""),
    ("  brand new - sealed \r", "Brand New - Sealed", ""),
    ("Condition: NEW (ADJUSTED QUANTITY)\rIn packaging? Yes\rA kettle.", "New (Adjusted Quantity)", "A kettle."),
    ("Condition: ON-SITE CAT'S PICK", "On-Site Cat's Pick", ""),
    ("Condition: SELECT CONDITION HERE\nplain words", None, "plain words"),
    ("MYSTERY", None, "MYSTERY"),
    ("Est. Retail Price: 249.00\r\nCondition: GOOD\r\n\r\nFirst line\nSecond line", "Good", "First line\nSecond line"),
])
def test_descriptions(spark, raw, grade, rest):
    got = one(spark, text.parse_description(F.col("d").cast("string")), d=raw)
    assert (got["condition"], got["rest"]) == (grade, rest)


@pytest.mark.parametrize("raw, iso, utc", [
    ("Internet Bidding closed at: 8/24/2026 1:00:02 PM EST", "2026-08-24T13:00:02-04:00", "2026-08-24 17:00:02"),
    ("12/1/2026  12:05:00 am EDT", "2026-12-01T00:05:00-05:00", "2026-12-01 05:05:00"),
    ("13/45/2026 1:00:00 PM EST", None, None),
    ("closing soon", None, None),
    (None, None, None),
])
def test_closing_time_reads_new_york(spark, raw, iso, utc):
    got = one(spark, values.closing(F.col("d").cast("string")), d=raw)
    assert got["iso"] == iso
    assert (str(got["ts"]) if got["ts"] else None) == utc


def test_instants_need_an_offset(spark):
    assert one(spark, values.parse_instant(F.col("d")), d="2026-09-13T10:00:00") is None
    assert str(one(spark, values.parse_instant(F.col("d")), d="2026-09-13T10:00:00-04:00")) == "2026-09-13 14:00:00"
    assert one(spark, values.weekday_name(F.col("d")), d="2026-09-13T23:30:00-04:00") == "Sunday"


@pytest.mark.parametrize("bids, price", [
    ([12.0, 14.0, 16.0], 10.0), ([1.0, 2.0], None), ([5.0], None), ([], None), ([5.0, 5.0], None),
    ([10.0, 11.0, 50.0], 9.0)])
def test_final_price(spark, bids, price):
    assert one(spark, values.final_price(F.array(*[F.lit(b) for b in bids]).cast("array<double>"))) == price


@pytest.mark.parametrize("score, band", [
    ("0.33", "low"), ("0.34", "medium"), ("0.67", "high"), ("NaN", "high"), ("x", "low"), (None, "low")])
def test_confidence_band(spark, score, band):
    assert one(spark, values.confidence_band(F.col("s").cast("string")), s=score) == band


def test_lenient_numbers_and_words(spark):
    assert one(spark, values.to_count(F.lit("-4"))) == 0
    assert one(spark, values.to_count(F.lit("many"))) == 0
    assert one(spark, values.to_price(F.lit("1.5"))) == 1.5
    assert one(spark, values.norm_enum(F.lit(" High "), ("low", "high"))) == "high"
    assert one(spark, values.norm_enum(F.lit("huge"), ("low", "high"))) is None
    assert one(spark, text.normalise_subtype(F.lit(" Scrub \t Brushes "))) == "scrub brushes"
    assert one(spark, text.normalise_subtype(F.lit("  "))) is None


@pytest.mark.parametrize("title, words, key", [
    ("45 J SOLE COWBOY BOOTS LARGE", 3, "SOLE COWBOY BOOTS"),
    ("PHYLOSAL A3 MONITOR", 2, "PHYLOSAL A3"), ("LA ROCHE POSAY", 2, None), ("LOGITECH MX KEYS", 2, "LOGITECH MX"), ("PHILIPS AVENT BOTTLE", 2, None),
    ("A1 B2 C3 D4", 3, None), ("TWO WORDS", 3, None), (None, 3, None)])
def test_sibling_key(spark, title, words, key):
    assert one(spark, text.sibling_key(F.col("t").cast("string"), words), t=title) == key


@pytest.mark.parametrize("title, brand", [
    ("SHARK WANDVAC HANDHELD", "shark"), ("NEW shoes", None), ("12 PACK", None), ("S'WELL bottle", "s'well"), ("", None)])
def test_title_brand(spark, title, brand):
    assert one(spark, text.title_brand(F.col("t")), t=title) == brand


def test_folding(spark):
    assert one(spark, text.fold_text(F.lit("Wüsthof CRÈME brûlée ế"))) == "wusthof creme brulee e"
    assert one(spark, text.fold_text(F.lit("école"))) == "ecole"
    assert text.tokens_of("  Crème  BRÛLÉE ") == ["creme", "brulee"]


def found(spark, pattern, body):
    return one(spark, F.regexp_substr(F.lit(body), F.lit(pattern)))


def test_shortlist_terms(spark):
    p = patterns.shortlist_pattern(["key", "pla ", "pull-up bar", "keyboard"])
    assert found(spark, p, "monkey") is None
    assert found(spark, p, "éкkey") is None
    assert found(spark, p, "a keyboard") == "keyboard"
    assert found(spark, p, "plated") is None
    assert found(spark, p, "pla filament") == "pla"
    assert found(spark, p, "pull up bar") == "pull up bar"
    assert patterns.shortlist_pattern(["", "  "]) is None
    assert found(spark, patterns.shortlist_pattern(["c++"]), "c++ book") == "c++"


def test_title_seeds_keep_their_spaces(spark):
    p = patterns.title_seed_pattern(["usb", "mop ", "hot-swap"], 4)
    assert found(spark, p, "USB hub") is None
    assert found(spark, p, "a MOP head") == "MOP "
    assert found(spark, p, "hot swap") is None


def test_phrases_allow_a_plural(spark):
    p = patterns.phrase_pattern(["alto", "keys"])
    assert found(spark, p, "alto  keyses x")
    assert found(spark, p, "salto keys") is None


def test_category_paths(spark):
    none = F.lit(None).cast("array<string>")
    assert one(spark, values.category_path_of(none, F.lit("A & B - C-D/E - F"))) == ["A & B", "C-D/E", "F"]
    got = one(spark, values.resolve_categories(none, F.lit("Home"), F.lit("Home")))
    assert (got["category_path"], got["category"], got["subcategory"]) == (["Home"], "Home", "Home")
