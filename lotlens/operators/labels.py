"""Labels against listings: the two-key join, differences, upserts and layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, values, vocab
from .common import as_key, latest
from .skew import attach


def listings_by_key(lots: DataFrame, columns: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """Every key a label may use for a lot, with the lot it means.

    The id wins over the display number, and the last row wins within either.
    Both key kinds are stacked and reduced once, so the label join that follows
    needs a single shuffle of the listings instead of two.
    """
    row = F.struct(*columns)
    ids = lots.select(*scope, as_key(F.col("id")).alias("_key"), F.lit(1).alias("_kind"), "_ord", row.alias("_lot"))
    numbers = lots.select(*scope, as_key(F.col("lot_number")).alias("_key"), F.lit(0).alias("_kind"), "_ord", row.alias("_lot"))
    return (ids.unionByName(numbers).where("_key is not null")
            .groupBy(*scope, "_key")
            .agg(F.max_by(F.struct("_lot", "_kind"), F.struct("_kind", "_ord")).alias("_hit"))
            .select(*scope, "_key", F.col("_hit._lot").alias("_lot"),
                    F.when(F.col("_hit._kind") == 1, "id").otherwise("lot_number").alias("matched_by")))


def match_labels(labels: DataFrame, lots: DataFrame, columns: Sequence[str],
                 scope: Sequence[str] = ()) -> DataFrame:
    """Labels with the lot they name in ``_lot`` (NULL for an orphan) and ``matched_by``."""
    keyed = labels.withColumn("_key", as_key(F.col("lot_number")))
    return attach(keyed, listings_by_key(lots, columns, scope), [*scope, "_key"], look=True).drop("_key")


def join_labels_raw(labels: DataFrame, lots: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One merged row per label; orphans are left out (see label_orphans)."""
    columns = [c for c in lots.columns if c not in (*scope, "_ord")]
    matched = match_labels(labels, lots, columns, scope).where("_lot is not null")
    return merge_precedence(matched, columns, [c for c in labels.columns if c not in (*scope, "_ord")], scope)


def merge_precedence(matched: DataFrame, lot_columns: Sequence[str], label_columns: Sequence[str],
                     scope: Sequence[str] = ()) -> DataFrame:
    """Listing fields win where they have a value; everything else comes from the label.

    Category fields of the label are dropped. A label column outside the listing
    fields replaces the listing's even when it is NULL.
    """
    lot = lambda c: F.col(f"_lot.{c}")
    out: dict[str, Column] = {}
    for c in lot_columns:
        out[c] = lot(c)
    for c in label_columns:
        if c in vocab.LABEL_CATEGORY_FIELDS or c == "lot_number":
            continue
        if c in vocab.LISTING_FIELDS:
            mine = lot(c) if c in lot_columns else F.lit(None).cast("string")
            out[c] = F.coalesce(text.non_empty(mine), text.non_empty(F.col(c)), mine)
        else:
            out[c] = F.col(c)
    out["lot_number"] = F.coalesce(text.non_empty(lot("lot_number")), F.col("lot_number"))
    for c in ("title", "description", "thumb_url", "image_url", "lot_url"):
        if c in out:
            out[c] = F.coalesce(out[c], F.lit(""))
    if "category_path" in out or "category" in out:
        path = lot("category_path") if "category_path" in lot_columns else F.lit(None).cast("array<string>")
        crumb = lot("category") if "category" in lot_columns else F.lit(None).cast("string")
        out["category_path"] = values.category_path_of(path, crumb)
    if "close_at" in out:
        given = F.col("day") if "day" in label_columns else F.lit(None).cast("string")
        out["day"] = F.coalesce(text.non_empty(given), values.weekday_name(out["close_at"]))
    return matched.select(*scope, *[c.alias(n) for n, c in out.items()],
                          *(["matched_by"] if "matched_by" in matched.columns else []))


def label_orphans(labels: DataFrame, lots: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Labels that name no lot, neither by id nor by display number."""
    keys = _keys(lots, scope)
    return (labels.withColumn("_key", _dealt_key("lot_number", labels.columns))
            .join(keys, [*scope, "_key"], "left_anti").drop("_key"))


def overlap_report(labels: DataFrame, lots: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    hit = match_labels(labels, lots, ["lot_number"], scope)
    counted = hit.agg(
        F.count("*").alias("labels"),
        F.count_if(F.col("matched_by") == "id").alias("matched_by_id"),
        F.count_if(F.col("matched_by") == "lot_number").alias("matched_by_number"),
        F.count_if(F.col("matched_by").isNull()).alias("unmatched"))
    return counted.select(lots.agg(F.count("*")).scalar().alias("listings"), "*")


def _keys(df: DataFrame, scope: Sequence[str], fields: Sequence[str] = ("id", "lot_number")) -> DataFrame:
    """Every id and display number of a table, once."""
    have = [f for f in fields if f in df.columns]
    keys = F.explode(F.array(*[as_key(F.col(f)) for f in have]))
    return df.select(*scope, keys.alias("_key")).where("_key is not null").distinct()


def diff_new(lots: DataFrame, labels: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Lots whose id and display number are both absent from the labels.

    Two equi anti joins: one join on either key would be a nested loop.
    """
    known = _keys(labels, scope, ("lot_number",))
    return _without(lots, known, scope)


def _dealt_key(column: str, columns: Sequence[str]) -> Column:
    """A key for an anti join: rows without one get keys that no table holds, so that they don't meet in one task."""
    part = F.pmod(F.xxhash64(*columns), F.lit(4096)).cast("string")
    return F.coalesce(as_key(F.col(column)), F.concat(F.lit("\x00"), part))


def _without(lots: DataFrame, known: DataFrame, scope: Sequence[str]) -> DataFrame:
    out = lots
    for column in ("id", "lot_number"):
        out = (out.withColumn("_key", _dealt_key(column, lots.columns))
               .join(known, [*scope, "_key"], "left_anti").drop("_key"))
    return out


def delta_new(lots: DataFrame, labels: DataFrame, earlier: Sequence[DataFrame],
              scope: Sequence[str] = ()) -> DataFrame:
    """As diff_new, also leaving out the lots of earlier batches not folded in yet."""
    known = _keys(labels, scope)
    for batch in earlier:
        known = known.unionByName(_keys(batch, scope))
    return _without(lots, known.distinct(), scope)


def restrict_lot_set(rows: DataFrame, lots: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Rows of the current lot set."""
    return rows.join(lots.select(*scope, "lot_number"), [*scope, "lot_number"], "left_semi")


def outside_lot_set(rows: DataFrame, lots: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Rows of lots that are not in the set: the dropped rows of a restriction, or
    the foreign rows of a batch that never contained them (which is fatal)."""
    return rows.join(lots.select(*scope, "lot_number"), [*scope, "lot_number"], "left_anti")


def upsert_labels(existing: DataFrame, new: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Replace existing rows by the last new row of their lot, then append new lots.

    Every duplicate of an existing lot is replaced. Of several new rows of an
    unknown lot the first is appended; rows without a lot are always appended.
    ``change`` is 'kept', 'updated' or 'added'; both inputs carry ``_ord``.
    """
    cols = [c for c in existing.columns if c not in (*scope, "lot_number", "_ord")]
    keys = [*scope, "lot_number"]
    row = F.struct(*cols)
    with_key = F.col("lot_number").isNotNull() & (F.col("lot_number") != "")
    picked = (new.where(with_key).groupBy(*keys)
              .agg(F.max_by(row, "_ord").alias("_last"), F.min_by(row, "_ord").alias("_first"),
                   F.min("_ord").alias("_first_ord")))
    # One full join decides all three outcomes.
    old = existing.select(*keys, F.col("_ord").alias("_old_ord"), row.alias("_old"), F.lit(True).alias("_known"))
    both = old.join(picked, keys, "full")
    source = (F.when(F.col("_known") & F.col("_last").isNotNull(), F.col("_last"))
              .when(F.col("_known"), F.col("_old")).otherwise(F.col("_first")))
    change = (F.when(F.col("_known") & F.col("_last").isNotNull(), "updated")
              .when(F.col("_known"), "kept").otherwise("added"))
    merged = both.select(
        *keys, source.alias("_src"), change.alias("change"),
        F.struct(F.when(F.col("_known"), 0).otherwise(1).alias("part"),
                 F.coalesce("_old_ord", "_first_ord").alias("ord")).alias("_ord"))
    keyless = new.where(~F.coalesce(with_key, F.lit(False))).select(
        *keys, row.alias("_src"), F.lit("added").alias("change"),
        F.struct(F.lit(1).alias("part"), F.col("_ord").alias("ord")).alias("_ord"))
    return (merged.unionByName(keyless)
            .select(*keys, *[F.col(f"_src.{c}").alias(c) for c in cols], "change", "_ord"))


def change_counts(upserted: DataFrame) -> DataFrame:
    return upserted.agg(F.count_if(F.col("change") == "added").alias("added"),
                        F.count_if(F.col("change") == "updated").alias("updated"),
                        F.count("*").alias("total"))


def fold_layers(layers: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Last layer that has a row for a lot wins; layer 0 is the lot set.

    All layers are reduced in one pass over (lot), whatever their number. Rows of
    lots outside layer 0 fall away, and folding the same layers again changes
    nothing.
    """
    keys = [*scope, "lot_number"]
    rest = [c for c in layers.columns if c not in (*keys, "layer_no", "_ord")]
    return (layers.groupBy(*keys)
            .agg(F.max_by(F.struct(*rest, "layer_no"), F.struct("layer_no", "_ord")).alias("_row"),
                 F.max(F.col("layer_no") == 0).alias("_base"))
            .where("_base").select(*keys, "_row.*"))


def layer_report(layers: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Per layer: rows applied, rows dropped because the lot is gone."""
    lots = layers.where("layer_no = 0").select(*scope, "lot_number").distinct()
    return (layers.where("layer_no > 0")
            .join(lots.withColumn("_in", F.lit(True)), [*scope, "lot_number"], "left")
            .groupBy("layer_no")
            .agg(F.count("_in").alias("applied"), F.count_if(F.col("_in").isNull()).alias("dropped")))


def fold_valuations(base: DataFrame, layers: DataFrame, lots: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Valuations of the current lots; later layers replace or add."""
    keys = [*scope, "lot_number"]
    rest = [c for c in base.columns if c not in (*keys, "_ord")]
    stacked = base.withColumn("layer_no", F.lit(0)).unionByName(layers)
    best = (stacked.groupBy(*keys)
            .agg(F.max_by(F.struct(*rest, "layer_no"), F.struct("layer_no", "_ord")).alias("_row"))
            .select(*keys, "_row.*"))
    return restrict_lot_set(best, lots, scope)


def apply_recall(flags: DataFrame, members: DataFrame, confirmed: DataFrame,
                 scope: Sequence[str] = ()) -> DataFrame:
    """Give every copy of a confirmed product its new label."""
    from .products import fanout_labels

    picked = members.join(confirmed.select(*scope, F.col("lot_number").alias("rep_lot")),
                          [*scope, "rep_lot"], "left_semi")
    new = fanout_labels(picked, confirmed, scope).drop("rep_lot")
    keys = [*scope, "lot_number"]
    fields = [c for c in flags.columns if c not in (*keys, "_ord")]
    given = new.select(*keys, F.struct(*[
        F.col(f) if f in new.columns else F.lit(None).alias(f) for f in fields]).alias("_new"))
    joined = flags.join(given, keys, "left")
    return joined.select(*keys, *[
        F.when(F.col("_new").isNotNull(), F.col(f"_new.{f}")).otherwise(F.col(f)).alias(f) for f in fields],
        F.col("_new").isNotNull().alias("newly_flagged"))


def already_flagged(flags: DataFrame, confirmed: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Confirmed lots that carry a bucket already: the repair ran twice."""
    return flags.where(F.size("buckets") > 0).join(
        confirmed.select(*scope, "lot_number"), [*scope, "lot_number"], "left_semi")


def attach_bucket_groups(labels: DataFrame, bucket_dim: DataFrame) -> DataFrame:
    """(bucket, group, position, lots) of every bucket in use; unknown ones go to 'Other', last."""
    used = (labels.select(F.explode("buckets").alias("bucket"))
            .groupBy("bucket").agg(F.count("*").alias("uses")))
    known = F.col("bucket_group").isNotNull()
    return used.join(bucket_dim, "bucket", "left").select(
        "bucket", F.coalesce("bucket_group", F.lit(vocab.UNGROUPED)).alias("bucket_group"),
        F.coalesce("group_pos", F.lit(2**31 - 1)).alias("group_pos"), known.alias("is_known"), "uses")


# --- valuations ---------------------------------------------------------------------

def valuation_index(valuations: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Usable valuations, last one per key, enumerations normalised."""
    low, high = values.to_price(F.col("est_low")), values.to_price(F.col("est_high"))
    clean = valuations.select(
        *scope, text.non_empty(text.strip(F.col("lot_number").cast("string"))).alias("_key"), "_ord",
        low.alias("est_low"), high.alias("est_high"),
        values.norm_enum(F.col("confidence"), vocab.CONFIDENCES).alias("resale_confidence"),
        values.norm_enum(F.col("outlook"), vocab.OUTLOOKS).alias("resale_outlook"),
        text.non_empty(F.col("reasoning")).alias("resale_reasoning"))
    clean = clean.where(F.col("_key").isNotNull()
                        & (F.col("est_low").isNotNull() | F.col("est_high").isNotNull()))
    return latest(clean, [*scope, "_key"], "_ord").drop("_ord")


def join_resale(lots: DataFrame, valuations: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Attach the valuation keyed by display number, else the one keyed by id."""
    fields = ["est_low", "est_high", "resale_confidence", "resale_outlook", "resale_reasoning"]
    index = valuation_index(valuations, scope).select(*scope, "_key", F.struct(*fields).alias("_v"))
    keyed = (lots.withColumn("_number", text.non_empty(text.strip(F.col("lot_number"))))
             .withColumn("_id", F.col("id").cast("string")))
    by_number = index.select(*scope, F.col("_key").alias("_number"), F.col("_v").alias("_v1"))
    by_id = index.select(*scope, F.col("_key").alias("_id"), F.col("_v").alias("_v2"))
    joined = keyed.join(by_number, [*scope, "_number"], "left").join(by_id, [*scope, "_id"], "left")
    chosen = F.coalesce("_v1", "_v2")
    return joined.select(*lots.columns, chosen.isNotNull().alias("is_valued"),
                         *[chosen[f].alias(f) for f in fields])


# --- output shape -------------------------------------------------------------------

def output_lots(merged: DataFrame) -> DataFrame:
    """The published lot row, from either label shape.

    ``has_label_category`` marks rows whose label used the older single-category
    shape; its buckets are the category and subcategory and its confidence a score.
    """
    c = F.col
    have = set(merged.columns)
    pick = lambda n, t="string": c(n) if n in have else F.lit(None).cast(t)
    blank = lambda n: F.coalesce(pick(n), F.lit(""))
    older = F.coalesce(pick("has_label_category", "boolean"), F.lit(False))
    cats = values.resolve_categories(
        pick("category_path", "array<string>"), pick("flat_category"),
        F.when(older, pick("label_subcategory")).otherwise(pick("flat_subcategory")))
    url, lot_url = blank("url"), blank("lot_url")
    buckets = F.when(older, text.dedup_ordered(F.array(blank("label_category"), blank("label_subcategory")))
                     ).otherwise(text.dedup_ordered(F.coalesce(pick("buckets", "array<string>"),
                                                               F.array().cast("array<string>"))))
    return merged.withColumn("_cats", cats).select(
        *[n for n in ("auction_id",) if n in have],
        F.coalesce(text.non_empty(pick("day")), values.weekday_name(pick("close_at"))).alias("day"),
        blank("lot_number").alias("lot_number"), blank("title").alias("title"),
        blank("description").alias("description"),
        text.non_empty(pick("condition")).alias("condition"),
        blank("thumb_url").alias("thumb_url"), blank("image_url").alias("image_url"),
        F.when(older & url.rlike("^https://[^/]+/lot/"), url)
        .when(older, F.coalesce(text.non_empty(lot_url), url)).otherwise(lot_url).alias("lot_url"),
        "_cats.category", "_cats.subcategory", "_cats.category_path",
        F.coalesce(pick("is_flagged", "boolean"), F.lit(False)).alias("is_flagged"),
        buckets.alias("buckets"), text.normalise_subtype(pick("subtype")).alias("subtype"),
        F.when(older, values.confidence_band(pick("predicted_confidence")))
        .otherwise(values.confidence_word(pick("confidence"))).alias("confidence"),
        text.non_empty(pick("close_at")).alias("close_at"),
        text.non_empty(pick("first_seen")).alias("first_seen"),
        *[pick(n, t).alias(n) for n, t in (
            ("est_low", "double"), ("est_high", "double"), ("resale_confidence", "string"),
            ("resale_outlook", "string"), ("resale_reasoning", "string"),
            ("sale_key", "string"), ("alt_keys", "array<string>"),
            ("personal_match", "boolean"), ("personal_tags", "array<string>"),
            ("match_strength", "string"), ("match_types", "array<string>"),
            ("personal_reasoning", "string"), ("scrape", "bigint"))],
    )
