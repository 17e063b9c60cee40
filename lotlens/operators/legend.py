"""Search-term legend: what each term finds, and brands no term covers yet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns, text, vocab
from .common import written_once
from .search import all_text
from .words import texts_with


def found_terms(body: Column, terms: Sequence[str]) -> Column:
    """array<struct<term, whole>> of the terms whose every token the text contains."""
    out = []
    for term in terms:
        tokens = text.tokens_of(term)
        if not tokens:
            continue
        every = F.lit(True)
        for t in tokens:
            every = every & body.contains(t)
        out.append(F.when(every, F.struct(
            F.lit(term).alias("term"), body.rlike(patterns.phrase_pattern(tokens)).alias("whole"))))
    if not out:
        return F.array().cast("array<struct<term:string,whole:boolean>>")
    return F.array_compact(F.array(*out))


#: Up to so many terms are tried on every row; more are found through the words that hold their tokens.
SCANNED_TERMS = 64


def _scanned(rows: DataFrame, body: Column, terms: Sequence[str]) -> DataFrame:
    found = text.let(body, lambda b: found_terms(b, terms))
    return rows.select("*", F.explode(found).alias("_t")).select(*rows.columns, "_t.*")


def _by_words(rows: DataFrame, body: Column, terms: Sequence[str]) -> DataFrame:
    """The same through an equi-join, whose cost doesn't grow with the number of terms."""
    split = [(t, tokens, patterns.phrase_pattern(tokens)) for t in terms for tokens in [text.tokens_of(t)] if tokens]
    held = written_once(rows.select(F.struct(*rows.columns).alias("_r"), body.alias("_body"))
                        .withColumn("_row", F.monotonically_increasing_id()), "texts")
    found = texts_with(held.select("_row", "_body"), split).select("_row", "term", F.rlike("_body", F.col("pattern")).alias("whole"))
    return found.join(held.select("_row", "_r"), "_row").select("_r.*", "term", "whole")


def hits(rows: DataFrame, body: Column, terms: Sequence[str]) -> DataFrame:
    """Every row with each term it holds (``term``), and whether as a phrase of whole words (``whole``)."""
    terms = list(dict.fromkeys(terms))
    return (_scanned if len(terms) <= SCANNED_TERMS else _by_words)(rows, body, terms)


def _searched(lots: DataFrame, scope: Sequence[str]) -> tuple[DataFrame, Column]:
    keep = [c for c in ("buckets",) if c in lots.columns]
    return lots.select(*scope, "lot_number", *keep, all_text(lots.columns).alias("_text")), F.col("_text")


def term_hits(lots: DataFrame, terms: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """(lot, term, whole) for every match; ``whole`` marks a whole-word phrase."""
    return hits(*_searched(lots, scope), terms).drop("_text")


def term_hits_scanned(lots: DataFrame, terms: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    return _scanned(*_searched(lots, scope), terms).drop("_text")


def term_hits_by_words(lots: DataFrame, terms: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    return _by_words(*_searched(lots, scope), terms).drop("_text")


def legend_counts(lots: DataFrame, terms: DataFrame, names: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """Lots per legend term; terms that find nothing stay with zero. A lot is its number within ``scope``."""
    once = term_hits(lots, names, scope).select(*scope, "lot_number", F.col("term").alias("_t")).distinct()
    counted = once.groupBy("_t").agg(F.count("*").alias("lots"))
    return (terms.join(counted, F.lower("term") == F.col("_t"), "left")
            .select("term_group", "term", F.coalesce("lots", F.lit(0)).alias("lots")))


def term_stats(lots: DataFrame, history: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Per term: periods seen, lots now, lots unflagged, whole-word lots, and flags.

    ``history`` carries one (period, title) row per product sold or listed.
    """
    spark = lots.sparkSession
    now = (term_hits(lots, terms).groupBy("term").agg(
        F.count("*").alias("now"), F.count_if(F.size("buckets") == 0).alias("missed"),
        F.count_if("whole").alias("whole")))
    titles = history.select("period", "title").distinct()
    seen = (hits(titles, text.fold_text(F.col("title")), terms)
            .select("period", "term").distinct().groupBy("term").agg(F.count("*").alias("weeks")))
    names = spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = names.join(now, "term", "left").join(seen, "term", "left").select(
        "term", zero("weeks"), zero("now"), zero("missed"), zero("whole"))
    return (out.withColumn("never_seen", F.col("weeks") == 0)
            .withColumn("noisy", (F.col("now") >= vocab.NOISY_MIN) & (F.col("now") > vocab.NOISY_RATIO * F.col("whole"))))


def brand_signals(history: DataFrame) -> DataFrame:
    """Bids and watches per leading brand word."""
    rows = (history.withColumn("signal", F.lower(text.strip(F.col("signal"))))
            .where(F.col("signal").isin("bid", "watch"))
            .withColumn("brand", text.title_brand(F.col("title"))).where("brand is not null"))
    return rows.groupBy("brand").agg(F.count_if(F.col("signal") == "bid").alias("bid"),
                                     F.count_if(F.col("signal") == "watch").alias("watch"))


def uncovered_brands(signals: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Brands that neither contain a legend term nor are contained in one."""
    lowered = [t.lower() for t in terms if t]
    if not lowered:
        return signals
    brand = F.col("brand")
    contains_term = brand.rlike("|".join(patterns.quote(t) for t in lowered))
    inside_term = F.lit("\n".join(lowered)).contains(brand)  # a brand holds no line break
    return signals.where(~contains_term & ~inside_term)


def brand_suggest(signals: DataFrame, terms: Sequence[str], top: int = 60) -> DataFrame:
    score = 2 * F.col("bid") + F.col("watch")
    return (uncovered_brands(signals, terms).withColumn("score", score)
            .orderBy(F.desc("score"), "brand").limit(top))
