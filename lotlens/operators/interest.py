"""What was bid on and watched, measured against what was on offer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.config import Bucket, Interest
from .common import keep, share
from .sales import with_product_key
from .shortlist import admitted, bucket_rows, shortlist_lots
from .skew import attach

NOISY_SUPPLY = 50


def dedupe_history(history: DataFrame) -> DataFrame:
    """One row per (date, lot); a bid outranks a watch."""
    rest = [c for c in history.columns if c not in ("date", "lot")]
    strength = F.struct(F.when(F.col("signal") == "bid", 1).otherwise(0), F.struct(*rest))
    return (history.groupBy("date", "lot").agg(F.max_by(F.struct(*rest), strength).alias("_r"))
            .select("date", "lot", "_r.*"))


def history_to_supply(history: DataFrame, lots: DataFrame) -> DataFrame:
    """Signals with the lot they refer to; ``matched`` is false where the titles disagree
    (the sign of joining the wrong week)."""
    supply = lots.withColumnRenamed("lot_number", "lot").withColumnRenamed("title", "lot_title")
    return (history.join(supply, ["date", "lot"], "left")
            .withColumn("matched", F.coalesce(F.col("lot_title").startswith(F.col("title")), F.lit(False))))


def with_sale_history(tracked: DataFrame, index: DataFrame) -> DataFrame:
    """Add what the product of each tracked lot sold for."""
    keyed = with_product_key(tracked.withColumn("_t", F.col("title")).withColumn("title", F.col("lot_title")))
    weeks = index.select("key_title", "key_condition", "weeks")
    return (attach(keyed, weeks, ["key_title", "key_condition"])
            .withColumn("title", F.col("_t")).drop("_t", "key_title", "key_condition"))


def tracked_lots(history: DataFrame, lots: DataFrame, buckets: Sequence[Bucket], gate: bool,
                 interests: Sequence[Interest] = ()) -> DataFrame:
    """Signals on known lots with the buckets the shortlist gives the lot."""
    rows = history_to_supply(history, lots).where("matched").withColumn("title", F.col("lot_title"))
    return shortlist_lots(rows, buckets, interests, gate=gate)


def taxonomy_gap(tracked: DataFrame) -> DataFrame:
    """Tracked lots that match at least one rule and none, by signal."""
    none = (F.size("cand") == 0) & (F.size("profile") == 0)
    return tracked.groupBy("signal").agg(
        F.count("*").alias("lots"), F.count_if(~none).alias("matched_any"), F.count_if(none).alias("matched_none"),
        F.round(F.avg(none.cast("double")), 6).alias("gap_share"))


def interest_lift(tracked: DataFrame, supply: DataFrame, buckets: Sequence[Bucket]) -> DataFrame:
    """Share of tracked lots over share of supply, per bucket.

    Both tables come shortlisted without the condition gate. The denominator is
    what the shortlist would have shown: a bucket with a condition gate is divided
    by its gated supply. The ungated lift is kept beside it.
    """
    n_tracked = tracked.agg(F.count("*")).scalar()
    n_supply = supply.agg(F.count("*")).scalar()
    shown = F.transform(admitted("cand", F.col("condition"), buckets), lambda c: c["bucket"])
    both = F.transform("cand", lambda c: F.struct(c["bucket"].alias("bucket"), F.array_contains(F.col("_shown"), c["bucket"]).alias("shown")))
    on_offer = (supply.withColumn("_shown", shown).select(F.explode(both).alias("c")).select("c.*").groupBy("bucket")
                .agg(F.count_if("shown").alias("supply"), F.count("*").alias("supply_ungated")))
    followed = bucket_rows(tracked).groupBy("bucket").agg(F.count("*").alias("tracked"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    rate = lambda c: F.round(share(zero("tracked") / n_tracked, zero(c) / n_supply), 6)
    return on_offer.join(followed, "bucket", "full").select(
        "bucket", zero("tracked").alias("tracked"), zero("supply").alias("supply"),
        zero("supply_ungated").alias("supply_ungated"), rate("supply").alias("lift"),
        rate("supply_ungated").alias("lift_ungated"), (zero("supply") < NOISY_SUPPLY).alias("noisy"))


def bid_conversion(tracked: DataFrame) -> DataFrame:
    """Bids as a share of the tracked lots of each bucket."""
    bid = F.col("signal") == "bid"
    return bucket_rows(tracked, "signal").groupBy("bucket").agg(
        F.count("*").alias("tracked"), F.count_if(bid).alias("bids"),
        F.round(F.avg(bid.cast("double")), 6).alias("bid_share"))


def interest_gap(tracked: DataFrame, min_products: int = 5, min_auctions: int = 2) -> DataFrame:
    """Families of unmatched bids wide enough to be an interest of their own."""
    loose = keep(tracked.where(F.col("signal") == "bid"), F.size("cand") == 0)
    keyed = loose.withColumn("family", text.sibling_key(F.col("title"), 3)).where("family is not null")
    return (keyed.groupBy("family")
            .agg(F.countDistinct("title").alias("products"), F.countDistinct("date").alias("auctions"),
                 F.count("*").alias("bids"))
            .where((F.col("products") >= min_products) & (F.col("auctions") >= min_auctions)))


def repeat_engagement(history: DataFrame, lots: DataFrame) -> DataFrame:
    """Per product: copies listed against copies anyone engaged with."""
    engaged = history.select("date", F.col("lot").alias("lot_number"), F.lit(True).alias("_e")).distinct()
    joined = with_product_key(lots).join(engaged, ["date", "lot_number"], "left")
    return (joined.groupBy("key_title", "key_condition")
            .agg(F.count("*").alias("listed"), F.count("_e").alias("engaged")).where("engaged > 0")
            .withColumn("engaged_share", F.round(F.col("engaged") / F.col("listed"), 6)))


def gate_recall(history: DataFrame, lots: DataFrame, buckets: Sequence[Bucket],
                interests: Sequence[Interest] = ()) -> DataFrame:
    """Shortlist recall against real bids with the condition gate on and off."""
    bids = history.where(F.col("signal") == "bid")
    both = tracked_lots(bids, lots, buckets, False, interests)
    both = (both.withColumn("cand_on", admitted("cand", F.col("condition"), buckets))
            .withColumn("profile_on", admitted("profile", F.col("condition"), [i.as_rule() for i in interests])))
    hit = lambda c, p: (F.size(c) > 0) | (F.size(p) > 0)
    return both.agg(F.count("*").alias("bids"),
                    F.count_if(hit("cand_on", "profile_on")).alias("hit_gate_on"),
                    F.count_if(hit("cand", "profile")).alias("hit_gate_off"),
                    F.round(F.avg(hit("cand_on", "profile_on").cast("double")), 6).alias("recall_gate_on"),
                    F.round(F.avg(hit("cand", "profile").cast("double")), 6).alias("recall_gate_off"))


def engaged_vs_ignored(history: DataFrame, lots: DataFrame, buckets: Sequence[Bucket],
                       poor: Sequence[str] = ("Fair", "Heavily Used")) -> DataFrame:
    """Condition mix of engaged and ignored lots, per bucket."""
    engaged = history.select("date", F.col("lot").alias("lot_number"), F.lit(True).alias("_e")).distinct()
    rows = shortlist_lots(lots, buckets, gate=False).join(engaged, ["date", "lot_number"], "left")
    bad = F.coalesce(F.col("condition").isin(*poor), F.lit(False))
    return (bucket_rows(rows.withColumn("engaged", F.col("_e").isNotNull()), "condition", "engaged")
            .groupBy("bucket", "engaged")
            .agg(F.count("*").alias("lots"), F.count_if(bad).alias("poor"),
                 F.round(F.avg(bad.cast("double")), 6).alias("poor_share")))
