"""Browsing filters and orders as column predicates, and their composition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values
from .search import search_in_view


# --- predicates -----------------------------------------------------------------------

def day_is(day: str) -> Column:
    """'Monday', 'Sunday' or 'Both', from the lot-number prefix first."""
    if day == "Both":
        return F.lit(True)
    return values.day_letter(F.col("lot_number"), F.col("day")) == ("M" if day == "Monday" else "S")


def category_under(prefix: Sequence[str]) -> Column:
    return values.path_starts_with(F.col("category_path"), list(prefix))


def condition_in(conditions: Sequence[str]) -> Column:
    return F.coalesce(F.col("condition").isin(*conditions), F.lit(False)) if conditions else F.lit(True)


def confidence_at_least(level: str) -> Column:
    allowed = {"all": None, "high": ["high"], "medium-plus": ["high", "medium"]}[level]
    return F.lit(True) if allowed is None else F.coalesce(F.col("resale_confidence").isin(*allowed), F.lit(False))


def outlook_is(outlook: str) -> Column:
    return F.lit(True) if outlook == "all" else F.coalesce(F.col("resale_outlook") == outlook, F.lit(False))


def potential_resale() -> Column:
    """Valued, good or fair market, medium or high confidence."""
    return ((F.col("est_low").isNotNull() | F.col("est_high").isNotNull())
            & F.coalesce(F.col("resale_outlook").isin("good", "fair"), F.lit(False))
            & F.coalesce(F.col("resale_confidence").isin("medium", "high"), F.lit(False)))


def personal_pick() -> Column:
    return F.col("personal_match").eqNullSafe(F.lit(True))


def scrape_not_in(scrapes: Sequence[int]) -> Column:
    return F.col("scrape").isNull() | ~F.col("scrape").isin(*scrapes) if scrapes else F.lit(True)


def still_open(now: Column) -> Column:
    """Not closed yet by an explicit clock; an unknown closing time stays."""
    return F.col("close_ts").isNull() | (F.col("close_ts") > now)


def in_bucket(bucket: str | None, subtype: str | None = None) -> Column:
    """The flagged tab; without a bucket it shows nothing."""
    if bucket is None:
        return F.lit(False)
    chosen = F.col("is_flagged") & F.array_contains("buckets", bucket)
    return chosen & F.col("subtype").eqNullSafe(F.lit(subtype)) if subtype else chosen


def filter_tab(lots: DataFrame, tab: str, watched: DataFrame | None = None,
               bucket: str | None = None, subtype: str | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """Lots of a tab. A watched lot is its number within ``scope``."""
    if tab == "watched":
        return lots.join(watched.select(*scope, "lot_number"), [*scope, "lot_number"], "left_semi")
    if tab == "flagged":
        return lots.where(in_bucket(bucket, subtype))
    return lots


# --- orders ---------------------------------------------------------------------------

def sort_columns(key: str) -> list[Column]:
    """Ordering of a view: 'lot', 'close-asc', 'resale-asc' or 'resale-desc'."""
    lot = F.col("lot_number").asc()
    if key == "close-asc":
        return [F.col("close_ts").asc_nulls_last(), lot]
    if key in ("resale-asc", "resale-desc"):
        mean = values.valuation_mean(F.col("est_low"), F.col("est_high"))
        return [mean.asc_nulls_last() if key == "resale-asc" else mean.desc_nulls_last(), lot]
    return [F.col("is_flagged").desc(), (F.col("day") == "Sunday").desc(), lot]


def browse(lots: DataFrame, *, tab: str = "all", watched: DataFrame | None = None,
           bucket: str | None = None, subtype: str | None = None, day: str = "Both",
           category: Sequence[str] = (), personal_only: bool = False, potential_only: bool = False,
           confidence: str = "all", outlook: str = "all", conditions: Sequence[str] = (),
           excluded_scrapes: Sequence[int] = (), hide_ended_at: Column | None = None,
           query: str = "", fuzzy: bool = False, sort: str | None = "lot", scope: Sequence[str] = ()) -> DataFrame:
    """All filters, then search inside them, then the order. One scan: Catalyst
    collapses the chain."""
    view = filter_tab(lots, tab, watched, bucket, subtype, scope)
    if tab != "watched":
        view = view.where(day_is(day))
    if tab == "all":
        view = view.where(category_under(category))
    if personal_only:
        view = view.where(personal_pick())
    if potential_only:
        view = view.where(potential_resale())
    view = (view.where(confidence_at_least(confidence)).where(outlook_is(outlook))
            .where(condition_in(conditions)))
    if excluded_scrapes:
        view = view.where(scrape_not_in(excluded_scrapes))
    if hide_ended_at is not None:
        view = view.where(still_open(hide_ended_at))
    view = search_in_view(view, query, fuzzy)
    return view if sort is None else view.orderBy(*sort_columns(sort))


def lot_view(lots: DataFrame) -> DataFrame:
    """Derived columns a listing shows."""
    low, high = F.col("est_low"), F.col("est_high")
    shown = values.has_figures(low, high)
    first_of = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in c])
    return lots.select(
        "lot_number", "title", F.get("buckets", F.lit(0)).alias("bucket"),
        F.when(shown, low).alias("low"), F.when(shown, high).alias("high"),
        F.when(shown, values.valuation_mean(low, high)).alias("mid"),
        values.day_letter(F.col("lot_number"), F.col("day")).alias("day"),
        F.nullif("match_strength", F.lit("none")).alias("strength"),
        personal_pick().alias("is_pick"),
        first_of("thumb_url", "image_url").alias("image"),
        first_of("image_url", "thumb_url").alias("image_full"))
