"""Numbers, enumerations, times and category paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import dedup_ordered, let, strip


# --- numbers and enumerations ------------------------------------------------

def to_price(c: Column) -> Column:
    return c.try_cast("double")


def to_count(c: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0), c.try_cast("bigint")), F.lit(0)).cast("bigint")


def norm_enum(c: Column, allowed: tuple[str, ...]) -> Column:
    value = F.lower(strip(c))
    return F.when(value.isin(*allowed), value)


def confidence_band(c: Column) -> Column:
    score = c.try_cast("double")
    return (F.when(score.isNull() | (score < 0.34), "low")
            .when(score < 0.67, "medium").otherwise("high"))


def confidence_word(c: Column) -> Column:
    """Label confidence given as a word or as a score in text form."""
    return F.when(c.isin(*vocab.CONFIDENCES), c).otherwise(confidence_band(c))


def valuation_mean(low: Column, high: Column) -> Column:
    return F.coalesce((low + high) / 2, low, high)


def has_figures(low: Column, high: Column) -> Column:
    """A view shows a valuation only when one bound is above zero."""
    return (F.coalesce(low, F.lit(0.0)) > 0) | (F.coalesce(high, F.lit(0.0)) > 0)


def final_price(bids: Column) -> Column:
    """Final price from a closed lot's ladder; NULL (never 0) when unsold.

    The head of the ladder is one increment above the final price and the
    second entry two above.
    """
    head = F.get(bids, F.lit(0)).try_cast("double")
    second = F.get(bids, F.lit(1)).try_cast("double")
    price = head - (second - head)
    return F.when((second > head) & (price > 0), price)


# --- times ----------------------------------------------------------------------

def _local_close(text: Column) -> Column:
    found = F.regexp_extract(
        text, r"(?i)(\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}:\d{2}\s+(?:AM|PM))\s+E[SD]T", 1)
    return let(F.upper(F.regexp_replace(found, r"\s+", " ")), lambda v: F.when(
        v != "", F.try_to_timestamp(v, F.lit("M/d/yyyy h:mm:ss a"))))


def closing(text: Column) -> Column:
    """struct(ts, iso) of the closing time named in a sentence.

    The zone label is ignored: the clock reading is New York time whatever the
    label says. ``iso`` is the reading with the New York offset of that date.
    """
    def both(local: Column) -> Column:
        return let(F.to_utc_timestamp(local, vocab.TIME_ZONE), lambda utc: F.struct(
            utc.alias("ts"), _iso(local, F.timestamp_diff("MINUTE", utc, local)).alias("iso")))

    return let(_local_close(text), both)


def _iso(local: Column, minutes: Column) -> Column:
    offset = F.format_string(
        "%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"),
        F.floor(F.abs(minutes) / 60).cast("int"), (F.abs(minutes) % 60).cast("int"))
    return F.when(local.isNotNull(), F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset))


def close_ts(text: Column) -> Column:
    return closing(text)["ts"]


def close_iso(text: Column) -> Column:
    return closing(text)["iso"]


def parse_instant(text: Column) -> Column:
    """ISO text with an offset; text without one is NULL."""
    return F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text.try_cast("timestamp"))


def weekday_name(iso_text: Column) -> Column:
    """Weekday of the written wall clock, not of the UTC instant."""
    wall = F.substring(iso_text, 1, 19).try_cast("timestamp")
    return F.coalesce(F.date_format(wall, "EEEE"), F.lit(""))


def eastern(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, vocab.TIME_ZONE)


# --- categories -------------------------------------------------------------------

def split_crumbs(breadcrumb: Column) -> Column:
    parts = F.transform(F.split(breadcrumb, vocab.CRUMB), strip)
    return F.filter(parts, lambda p: p != "")


def category_path_of(path: Column, breadcrumb: Column) -> Column:
    """Discrete path when there is one, else the split breadcrumb."""
    tidy = F.filter(F.transform(path, strip), lambda p: p.isNotNull() & (p != ""))
    return F.when(F.size(tidy) > 0, tidy).otherwise(
        F.coalesce(split_crumbs(breadcrumb), F.array().cast("array<string>")))


def resolve_categories(path: Column, category: Column, subcategory: Column) -> Column:
    """struct(path, category, subcategory); flat columns stand in for a missing path."""
    kept = F.filter(path, lambda p: p.isNotNull() & (p != ""))
    cat = F.coalesce(category, F.lit(""))
    sub = F.coalesce(subcategory, F.lit(""))
    flat = dedup_ordered(F.array(cat, sub))
    native = F.size(F.coalesce(kept, F.array().cast("array<string>"))) > 0
    return F.struct(
        F.when(native, kept).otherwise(flat).alias("category_path"),
        F.when(native, F.get(kept, F.lit(0))).otherwise(cat).alias("category"),
        F.when(native, F.try_element_at(kept, F.lit(-1))).otherwise(sub).alias("subcategory"),
    )


def path_starts_with(path: Column, prefix: list[str]) -> Column:
    if not prefix:
        return F.lit(True)
    return F.slice(path, 1, len(prefix)) == F.array(*[F.lit(p) for p in prefix])


def day_letter(lot_number: Column, day: Column) -> Column:
    return (F.when(lot_number.startswith("M-"), "M").when(lot_number.startswith("S-"), "S")
            .when(day == "Monday", "M").otherwise("S"))
