"""Products: identical lots judged once, answers copied back to every lot.

A product may hold a large share of all lots, so members are rows
(lot_number, rep_lot), never an array per product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vocab
from .common import latest
from .skew import attach


def product_id(columns: Sequence[str]) -> Column:
    """Digest of the title and the value fields; NULL counts as a value."""
    parts = [text.key_text(F.col("title"))]
    for name in vocab.VALUE_FIELDS:
        c = F.col(name).cast("string") if name in columns else F.lit(None).cast("string")
        absent = F.lit("\x00") if name == "condition" else F.lit("")
        parts.append(F.coalesce(F.upper(text.strip(c)), absent))
    return F.md5(F.concat_ws("\x1f", *parts))


def with_product_id(slim: DataFrame) -> DataFrame:
    return slim.withColumn("product_id", product_id(slim.columns))


def dedupe_products(slim: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One row per product: the fields of the smallest lot number (as text), and the copy count."""
    df = slim if "product_id" in slim.columns else with_product_id(slim)
    rest = [c for c in df.columns if c not in (*scope, "product_id")]
    return (df.groupBy(*scope, "product_id")
            .agg(F.min_by(F.struct(*rest), F.col("lot_number")).alias("_rep"), F.count("*").alias("qty"))
            .select(*scope, "product_id", F.col("_rep.lot_number").alias("rep_lot"), "qty",
                    *[F.col(f"_rep.{c}").alias(c) for c in rest if c != "lot_number"]))


def product_members(slim: DataFrame, products: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(lot_number, rep_lot, qty) for every lot; many-to-one, so a hot product splits."""
    key = [*scope, "product_id"]
    lots = with_product_id(slim).select(*key, "lot_number")
    counts = products.select(*key, F.col("qty").alias("n"))
    return attach(lots, products.select(*key, "rep_lot", "qty"), key, "inner", counts)


def dedupe_stats(products: DataFrame) -> DataFrame:
    return products.agg(
        F.coalesce(F.sum("qty"), F.lit(0)).alias("lots"),
        F.count("*").alias("products"),
        F.coalesce(F.sum(F.col("qty") - 1), F.lit(0)).alias("saved"),
        F.count_if(F.col("qty") > 1).alias("groups_of_two"),
        F.max("qty").alias("largest_group"),
    )


def _copies(members: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(product, n), from the copy counts members carry."""
    return members.select(*scope, "rep_lot", F.col("qty").alias("n")).where(F.col("n") > 1).distinct()


def fanout_labels(members: DataFrame, answers: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Copy each product's answer to its lots; products without one get the base row."""
    fields = [f for f in vocab.LABEL_FIELDS if f in answers.columns]
    given = answers.select(*scope, F.col("lot_number").alias("rep_lot"), *fields)
    defaults = {"is_flagged": F.lit(False), "personal_match": F.lit(False),
                "buckets": F.array().cast("array<string>")}
    out = attach(members.select(*scope, "lot_number", "rep_lot"), given, [*scope, "rep_lot"], "left", _copies(members, scope))
    return out.select(*scope, "lot_number", "rep_lot", *[
        F.coalesce(f, defaults[f]).alias(f) if f in defaults else F.col(f) for f in fields])


def fanout_valuations(members: DataFrame, valuations: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Copy each product's last valuation (by ``_ord``) to its lots; valuations of unknown lots fall away."""
    fields = [f for f in vocab.VALUATION_FIELDS if f in valuations.columns]
    given = valuations.select(*scope, F.trim("lot_number").alias("rep_lot"), *fields, "_ord")
    given = latest(given, [*scope, "rep_lot"], "_ord").drop("_ord")
    return attach(members.select(*scope, "lot_number", "rep_lot"), given, [*scope, "rep_lot"], "inner", _copies(members, scope))


def unvalued_products(products: DataFrame, valuations: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Products no valuation covers (a non-empty result means the pass was cut short)."""
    valued = valuations.select(*scope, F.trim("lot_number").alias("rep_lot"))
    return products.join(valued, [*scope, "rep_lot"], "left_anti").select(*scope, "rep_lot", "qty")


def ignored_valuations(products: DataFrame, valuations: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Valuations whose lot represents no product."""
    given = valuations.withColumn("rep_lot", F.trim("lot_number"))
    return given.join(products.select(*scope, "rep_lot"), [*scope, "rep_lot"], "left_anti")


def _reusable(slim: DataFrame, old_reps: DataFrame, valuations: DataFrame,
              scope: Sequence[str]) -> DataFrame:
    """Corrected product -> the first old representative whose valuation still holds.

    ``old_reps`` lists the former representatives with their order in ``_ord``.
    """
    valued = valuations.select(*scope, F.trim("lot_number").alias("lot_number"))
    moved = (with_product_id(slim).select(*scope, "lot_number", "product_id")
             .join(old_reps.select(*scope, "lot_number", "_ord"), [*scope, "lot_number"])
             .join(valued, [*scope, "lot_number"], "left_semi"))
    return (moved.groupBy(*scope, "product_id")
            .agg(F.min_by("lot_number", "_ord").alias("old_rep")))


def regroup_plan(slim: DataFrame, old_reps: DataFrame, valuations: DataFrame,
                 scope: Sequence[str] = ()) -> DataFrame:
    """Products of the corrected data that no existing valuation covers."""
    products = dedupe_products(slim, scope)
    kept = _reusable(slim, old_reps, valuations, scope)
    return products.join(kept, [*scope, "product_id"], "left_anti")


def regroup_apply(slim: DataFrame, old_reps: DataFrame, valuations: DataFrame, fixes: DataFrame,
                  scope: Sequence[str] = ()) -> DataFrame:
    """One valuation per corrected product, re-keyed on its representative: the last of each key by ``_ord``.

    ``source`` is 'kept', 'fixed' or NULL; a NULL means the fix-up was cut short.
    """
    products = dedupe_products(slim, scope).select(*scope, "product_id", "rep_lot", "qty")
    kept = _reusable(slim, old_reps, valuations, scope)
    fields = [f for f in vocab.VALUATION_FIELDS if f in valuations.columns]
    old = latest(valuations.select(*scope, F.trim("lot_number").alias("old_rep"), F.struct(*fields).alias("_old"), "_ord"),
                 [*scope, "old_rep"], "_ord").drop("_ord")
    new = latest(fixes.select(*scope, F.trim("lot_number").alias("rep_lot"), F.struct(*fields).alias("_new"), "_ord"),
                 [*scope, "rep_lot"], "_ord").drop("_ord")
    joined = (products.join(kept, [*scope, "product_id"], "left")
              .join(old, [*scope, "old_rep"], "left")
              .join(new, [*scope, "rep_lot"], "left"))
    chosen = F.coalesce("_old", "_new")
    return joined.select(
        *scope, "product_id", F.col("rep_lot").alias("lot_number"), "qty",
        F.when(F.col("_old").isNotNull(), "kept").when(F.col("_new").isNotNull(), "fixed").alias("source"),
        *[chosen[f].alias(f) for f in fields])
