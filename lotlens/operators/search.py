"""Text search over lots: exact, typo-tolerant, and spoken lot references."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

TOLERANCE = 0.2


def _pick(columns: Sequence[str], name: str, kind: str = "string") -> Column:
    return F.col(name) if name in columns else F.lit(None).cast(kind)


def _path(columns: Sequence[str]) -> Column:
    return F.array_join(F.coalesce(_pick(columns, "category_path", "array<string>"),
                                   F.array().cast("array<string>")), " ")


def all_text(columns: Sequence[str]) -> Column:
    """Every searchable field, folded, fields kept apart by two spaces."""
    return F.concat_ws("  ", *[text.fold_text(_pick(columns, c)) for c in
                               ("title", "subcategory", "lot_number", "description")],
                       text.fold_text(_path(columns)))


def long_text(columns: Sequence[str]) -> Column:
    """Description and categories only: always matched exactly."""
    return F.concat_ws("  ", text.fold_text(_pick(columns, "description")), text.fold_text(_path(columns)))


def search_index(lots: DataFrame) -> DataFrame:
    """Lots with the folded columns searches read; persist or write it for many queries."""
    return (lots.withColumn("search_all", all_text(lots.columns))
            .withColumn("search_long", long_text(lots.columns)))


def _every_token(body: Column, tokens: Sequence[str]) -> Column:
    """All tokens occur in the text; the text is put together once."""
    if not tokens:
        return F.lit(False)
    return text.let(body, lambda b: reduce(and_, [b.contains(t) for t in tokens]))


def _near(token: str, field: Column) -> Column:
    """The field contains the token, or one of its words is within 20% edits of it."""
    edits = int(TOLERANCE * len(token))
    near = field.contains(token)
    if edits:
        near = near | F.exists(F.split(field, r"\s+"), lambda w: (
            F.abs(F.length(w) - len(token)) <= edits) & (F.levenshtein(w, F.lit(token), edits) >= 0))
    return near


def matches(columns: Sequence[str], query: str, fuzzy: bool = False) -> Column:
    """Whether a lot matches; a query without tokens matches nothing.

    Works on raw lots and on a search_index alike.
    """
    tokens = text.tokens_of(query)
    if not fuzzy:
        body = F.col("search_all") if "search_all" in columns else all_text(columns)
        return _every_token(body, tokens)
    if not tokens:
        return F.lit(False)
    short = F.array(*[text.fold_text(F.col(c)) for c in ("title", "subcategory", "lot_number") if c in columns])
    near = text.let(short, lambda fields: reduce(and_, [
        F.exists(fields, partial(_near, t)) for t in tokens]))
    body = F.col("search_long") if "search_long" in columns else long_text(columns)
    return near | _every_token(body, tokens)


def search(lots: DataFrame, query: str, fuzzy: bool = False) -> DataFrame:
    return lots.where(matches(lots.columns, query, fuzzy))


def search_in_view(view: DataFrame, query: str, fuzzy: bool = False) -> DataFrame:
    """Search inside a filtered view: it narrows, never widens. Blank means no search."""
    return search(view, query, fuzzy) if query.strip() else view


def resolve_lot_refs(refs: DataFrame, lots: DataFrame, in_view: DataFrame | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """Resolve spoken references ('1042', 's1042', 'm 1042') to one lot each.

    Without a letter the candidates are S-, M- and the bare number, in that order;
    a lot of the current view wins over one outside it. References that name no lot
    stay, without one. Lot numbers are reused, so a reference is to a lot of its own
    ``scope``: all three tables carry those columns.
    """
    spoken = F.upper(text.strip(F.col("ref")))
    pattern = r"^([SM])?[^A-Z0-9_]*(\d+)$"
    letter = F.regexp_extract(spoken, pattern, 1)
    digits = F.regexp_extract(spoken, pattern, 2)
    options = (F.when(digits == "", F.array().cast("array<string>"))
               .when(letter != "", F.array(F.concat_ws("-", letter, digits)))
               .otherwise(F.array(F.concat(F.lit("S-"), digits), F.concat(F.lit("M-"), digits), digits)))
    key = [*scope, "lot_number"]
    asked = refs.select(*scope, "ref").distinct()
    offered = asked.select(*scope, "ref", F.posexplode(options).alias("_pos", "lot_number"))
    found = offered.join(lots.select(*key).distinct(), key)
    if in_view is not None:
        seen = in_view.select(*key, F.lit(0).alias("_out")).distinct()
        found = found.join(seen, key, "left")
    else:
        found = found.withColumn("_out", F.lit(0))
    rank = F.struct(F.coalesce("_out", F.lit(1)), "_pos")
    best = found.groupBy(*scope, "ref").agg(F.min_by("lot_number", rank).alias("lot_number"))
    return asked.join(best, [*scope, "ref"], "left")
