"""Unflagged products that look like misses: flagged relatives and category habits.

The matcher here is deliberately not the shortlist's: titles only, no hyphen
folding, seeds of four characters or more, vetoes matched anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns, text, vocab
from ..sources.config import Bucket
from .common import written_once
from .skew import attach


def labelled_products(products: DataFrame, labels: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Products with the buckets of their representative's label, written once: every check reads them."""
    given = labels.select(*scope, F.col("lot_number").alias("rep_lot"), "buckets")
    out = (products.join(given, [*scope, "rep_lot"], "left")
           .withColumn("buckets", F.coalesce("buckets", F.array().cast("array<string>")))
           .withColumn("category", F.coalesce("category", F.lit(""))))
    return written_once(out, "labelled")


def category_dominance(labelled: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Categories of a scope where one bucket holds at least 60% of 15 lots or more."""
    at = [*scope, "category"]
    lots = labelled.groupBy(*at).agg(F.sum("qty").alias("lots"))
    per = (labelled.select(*at, "qty", F.explode("buckets").alias("bucket"))
           .groupBy(*at, "bucket").agg(F.sum("qty").alias("bucket_lots")))
    # Buckets are few, so the best one per category is a plain reduction.
    best = per.groupBy(*at).agg(
        F.min_by(F.struct("bucket", "bucket_lots"), F.struct(-F.col("bucket_lots"), "bucket")).alias("_b"))
    joined = best.join(lots, at).select(*at, "_b.bucket", "_b.bucket_lots", "lots")
    return (joined.where((F.col("lots") >= vocab.MIN_CATEGORY_LOTS)
                         & (F.col("bucket_lots") / F.col("lots") >= vocab.DOMINANCE))
            .withColumn("share", F.round(F.col("bucket_lots") / F.col("lots"), 6)))


def family_evidence(labelled: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope..., words, family, bucket): flagged products of each title family.

    A two-word family only speaks for buckets that took at least 60% of its
    flagged lots. ``sibling`` is the most-copied flagged title.
    """
    flagged = labelled.where(F.size("buckets") > 0)
    keyed = flagged.select(*scope, "title", "qty", "buckets", F.explode(F.array(
        F.struct(F.lit(3).alias("words"), text.sibling_key(F.col("title"), 3).alias("family")),
        F.struct(F.lit(2).alias("words"), text.sibling_key(F.col("title"), 2).alias("family")))).alias("_k")
    ).select(*scope, "title", "qty", "buckets", "_k.*").where("family is not null")
    at = [*scope, "words", "family"]
    totals = (keyed.where("words = 2").groupBy(*at).agg(F.sum("qty").alias("family_lots")))
    per = (keyed.withColumn("bucket", F.explode("buckets")).groupBy(*at, "bucket")
           .agg(F.sum("qty").alias("bucket_lots"),
                F.max(F.struct("qty", "title")).alias("_best")))
    out = per.join(totals, at, "left")
    ok = (F.col("words") == 3) | (F.col("bucket_lots") / F.col("family_lots") >= vocab.DOMINANCE)
    return out.where(ok).select(*at, "bucket", "bucket_lots",
                                F.col("_best.title").alias("sibling"), F.col("_best.qty").alias("sibling_lots"))


def _vetoed(title: Column, bucket: Column, buckets: Sequence[Bucket]) -> Column:
    vetoes = F.lit(False)
    for b in buckets:
        pattern = patterns.anywhere_pattern(list(b.exclude))
        if pattern:
            vetoes = vetoes | ((bucket == b.name) & title.rlike(pattern))
    return vetoes


def _seed_in(title: Column, bucket: Column, buckets: Sequence[Bucket]) -> Column:
    found = F.lit(None).cast("string")
    for b in buckets:
        pattern = patterns.title_seed_pattern(list(b.seeds), vocab.MIN_SEED_LEN)
        if pattern:
            found = F.when(bucket == b.name, text.non_empty(F.regexp_extract(title, pattern, 0))).otherwise(found)
    return found


def suspect_evidence(labelled: DataFrame, buckets: Sequence[Bucket], scope: Sequence[str] = ()) -> DataFrame:
    """(product, bucket, evidence) of unflagged products; the strongest kind per bucket.

    Family and category tables are folded to one row per key first, so both
    joins are many-to-one however large a family is. A scope's suspects follow from
    its own flags alone.
    """
    families = family_evidence(labelled, scope)
    by_family = families.groupBy(*scope, "words", "family").agg(
        F.collect_list(F.struct("bucket", "sibling", "sibling_lots")).alias("_rel"))
    dominant = category_dominance(labelled, scope).select(*scope, "category", F.col("bucket").alias("_dom"), F.col("share").alias("_share"))
    quiet = labelled.where(F.size("buckets") == 0).select(
        *scope, "rep_lot", "title", "category", "qty",
        text.sibling_key(F.col("title"), 3).alias("_f3"), text.sibling_key(F.col("title"), 2).alias("_f2"))
    rel = lambda n: by_family.where(F.col("words") == n).select(
        *scope, F.col("family").alias(f"_f{n}"), F.col("_rel").alias(f"_rel{n}"))
    joined = quiet
    for key, table in (("_f3", rel(3)), ("_f2", rel(2)), ("category", dominant)):
        # Counted on the narrow input, not on what the joins before produced.
        joined = attach(joined, table, [*scope, key], counts=quiet.groupBy(*scope, key).agg(F.count("*").alias("n")))
    empty = F.array().cast("array<struct<bucket:string,sibling:string,sibling_lots:bigint>>")
    entry = lambda kind, c: F.transform(F.coalesce(c, empty), lambda r: F.struct(
        F.lit(kind).alias("kind"), r["bucket"].alias("bucket"), r["sibling"].alias("sibling"),
        r["sibling_lots"].alias("sibling_lots"), F.lit(None).cast("string").alias("seed")))
    seed = _seed_in(F.col("title"), F.col("_dom"), buckets)
    habit = F.when(seed.isNotNull(), F.array(F.struct(
        F.lit(3).alias("kind"), F.col("_dom").alias("bucket"), F.lit(None).cast("string").alias("sibling"),
        F.lit(None).cast("bigint").alias("sibling_lots"), seed.alias("seed"))))
    every = F.concat(entry(1, F.col("_rel3")), entry(2, F.col("_rel2")),
                     F.coalesce(habit, entry(3, empty)))
    rows = joined.select(*scope, "rep_lot", "title", "category", "qty", F.explode(every).alias("_e")).select(
        *scope, "rep_lot", "title", "category", "qty", "_e.*")
    rows = rows.where(~_vetoed(F.col("title"), F.col("bucket"), buckets))
    detail = F.struct("kind", "sibling", "sibling_lots", "seed")
    return (rows.groupBy(*scope, "rep_lot", "bucket")
            .agg(F.min_by(F.struct("title", "category", "qty", detail.alias("d")), "kind").alias("_r"))
            .select(*scope, "rep_lot", "bucket", "_r.title", "_r.category", "_r.qty", "_r.d.*"))


def recall_suspects(labelled: DataFrame, buckets: Sequence[Bucket], scope: Sequence[str] = ()) -> DataFrame:
    """One row per suspect product with its evidence (at most one entry per bucket)."""
    entry = F.struct("kind", "bucket", "sibling", "sibling_lots", "seed")
    return (suspect_evidence(labelled, buckets, scope)
            .groupBy(*scope, "rep_lot", "title", "category", "qty")
            .agg(F.array_sort(F.collect_list(entry)).alias("suspect")))


def recall_summary(suspects: DataFrame) -> DataFrame:
    return (suspects.select("qty", F.explode("suspect").alias("_s"))
            .groupBy(F.col("_s.bucket").alias("bucket"))
            .agg(F.count("*").alias("products"), F.sum("qty").alias("lots")))
