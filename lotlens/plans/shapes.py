"""The views as the operators expect them: text columns turned into arrays and structs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..operators.common import list_of, written_once
from ..operators.products import dedupe_products, product_members
from ..operators.sales import price_histogram, sale_aggregate, sale_index  # noqa: F401
from ..operators.shortlist import shortlist_lots
from ..sources.config import bucket_table
from .registry import Tables
from .views import BUCKETS, INTERESTS

SCOPE = ("auction_id",)


def lots(t: Tables) -> DataFrame:
    return t["lots"].withColumn("category_path", F.split("category", vocab.CRUMB))


def landing(t: Tables, *more: str) -> DataFrame:
    """Nested landing rows, as the listing service returns them, with more columns of the lots."""
    url = lambda kind: F.concat(F.lit(f"https://img.example/{kind}/"), F.col("id").cast("string"))
    shown = F.col("status") != "F"
    path = F.reverse(F.split("category", vocab.CRUMB))
    leaf = F.struct(F.get(path, F.lit(0)).alias("categoryName"), F.col("category").alias("fullCategory"))
    upper = F.transform(F.slice(path, F.lit(2), F.size(path)), lambda n: F.struct(n.alias("categoryName"), n.alias("fullCategory")))
    return t["landing_text"].select(
        "auction_id", "id", F.col("lot_number").alias("lotNumber"), F.col("title").alias("lead"),
        F.col("description_raw").alias("description"),
        F.struct(F.when(shown, url("small")).alias("thumbnailLocation"),
                 F.when(shown, url("full")).alias("fullSizeLocation")).alias("featuredPicture"),
        F.array(F.struct(url("full").alias("fullSizeLocation")), F.struct(url("back").alias("fullSizeLocation"))).alias("pictures"),
        F.struct(F.col("current_bid").cast("string").alias("highBid"), "status",
                 F.col("closing_text").alias("timeLeftTitle")).alias("lotState"),
        F.concat(F.array(leaf), upper).alias("category"), *more)


def labels(t: Tables) -> DataFrame:
    buckets = list_of(F.col("buckets_csv"))
    return t["lot_labels"].select(
        "auction_id", "lot_number", "_ord", "title",
        ((F.col("is_flagged_text") == "yes") | (F.size(buckets) > 0)).alias("is_flagged"),
        buckets.alias("buckets"), "subtype", "personal_match", list_of(F.col("tags_csv")).alias("personal_tags"),
        "match_strength", "personal_reasoning", "confidence")


def flags(t: Tables) -> DataFrame:
    return t["flags"].select(
        "auction_id", "lot_number", "_ord", "is_flagged", list_of(F.col("buckets_csv")).alias("buckets"), "subtype",
        "personal_match", list_of(F.col("tags_csv")).alias("personal_tags"), "match_strength", "personal_reasoning")


def layers(t: Tables) -> DataFrame:
    return t["label_layers"].withColumn("buckets", list_of(F.col("buckets_csv"))).drop("buckets_csv")


def closed(t: Tables) -> DataFrame:
    return t["sales"].select(
        "auction_id", "close_date", "title", "condition", F.array("bid_head", "bid_second").alias("bids"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_ord"))


def history(t: Tables) -> DataFrame:
    """Sale history: one row per (auction, product)."""
    per = sale_aggregate(closed(t), ("auction_id", "close_date"))
    return (per.drop("key_title", "key_condition").withColumn("_file", F.col("auction_id").cast("string"))
            .withColumn("_ord", F.lit(0)))


def index(t: Tables) -> DataFrame:
    """Written once: the joins onto lots read it several times."""
    return written_once(sale_index(history(t)), "index")


def slim(t: Tables) -> DataFrame:
    """Lots with the fields that decide product identity."""
    return t["lots"].select("auction_id", "lot_number", "title", "condition", "size", "model", "damaged",
                            "functional", "category")


def products(t: Tables) -> DataFrame:
    return dedupe_products(slim(t), SCOPE)


def members(t: Tables) -> DataFrame:
    return product_members(slim(t), products(t), SCOPE)


def shortlisted(t: Tables, gate: bool = True) -> DataFrame:
    keep = t["lots"].select("auction_id", "lot_number", "title", "model", "size", "condition", "category")
    return shortlist_lots(keep, BUCKETS, INTERESTS, gate)


def bucket_dim(t: Tables) -> DataFrame:
    return bucket_table(t.spark, BUCKETS)


def published(t: Tables) -> DataFrame:
    """Lots as a viewer queries them: labels and valuations attached."""
    from ..operators.labels import join_resale

    flagged = flags(t).select("lot_number", "auction_id", F.struct(
        "is_flagged", "buckets", "subtype", "personal_match", "match_strength").alias("_f"))
    base = lots(t).join(flagged, ["auction_id", "lot_number"], "left")
    none = F.array().cast("array<string>")
    base = base.select(
        "auction_id", "id", "lot_number", "title", "condition", "category", "category_path", "status", "close_ts", "first_seen",
        F.element_at("category_path", -1).alias("subcategory"), F.col("seller").alias("description"),
        F.coalesce("_f.is_flagged", F.lit(False)).alias("is_flagged"), F.coalesce("_f.buckets", none).alias("buckets"),
        F.lower(F.trim("_f.subtype")).alias("subtype"), F.col("_f.personal_match").alias("personal_match"),
        F.col("_f.match_strength").alias("match_strength"),
        F.when(F.col("status") == "F", "Sunday").when(F.col("status") == "O", "Monday").otherwise("").alias("day"),
        F.when(F.col("status") != "F", F.concat(F.lit("t/"), F.col("lot_number"))).otherwise("").alias("thumb_url"),
        F.concat(F.lit("f/"), F.col("lot_number")).alias("image_url"))
    return join_resale(base, t["valuations"])


def doc_lots(t: Tables) -> DataFrame:
    return (t["doc_lots"].withColumn("category_path", F.split("category", vocab.CRUMB))
            .withColumn("buckets", list_of(F.col("buckets_csv"))))


def joined(c: str):
    return F.array_join(c, "|").alias(c)
