"""Queries that join, compare, upsert and fan out labels and valuations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import kept
from ..operators import labels as lab
from ..operators import products as prod
from ..operators.common import latest
from ..session import shared_dir
from . import shapes
from .registry import Tables, query
from .shapes import SCOPE, joined

# --- the two-key join ------------------------------------------------------------------

_MATCH = """
with keyed as (
  select l.*, case when b.id is not null then 'id' when n.id is not null then 'lot_number' end as matched_by,
    coalesce(b.id, n.id) as lot_id
  from lot_labels l
  left join lots b on cast(b.id as string) = l.lot_number and b.auction_id = l.auction_id
  left join lots n on n.lot_number = l.lot_number and n.auction_id = l.auction_id)
"""


@query("join_labels_raw", _MATCH + """
select lots.lot_number, lots.id, lots.title, lots.condition, matched_by, replace(lots.category, ' - ', '|') as category_path,
  is_flagged_text = 'yes' or buckets_csv <> '' as is_flagged, replace(buckets_csv, ',', '|') as buckets, subtype, personal_match, confidence,
  strftime(cast(lots.close_ts as timestamp), '%A') as day
from keyed join lots on lots.id = lot_id""")
def join_labels_raw(t: Tables):
    lots = t["lots"].select("auction_id", "id", "lot_number", "_ord", "title", "condition", "category",
                            F.date_format("close_ts", "yyyy-MM-dd'T'HH:mm:ss'-05:00'").alias("close_at"))
    out = lab.join_labels_raw(shapes.labels(t), lots, SCOPE)
    return out.select("lot_number", "id", "title", "condition", "matched_by", joined("category_path"), "is_flagged",
                      joined("buckets"), "subtype", "personal_match", "confidence", "day")


@query("merge_precedence", _MATCH + """
select lots.lot_number, case when damaged is null then coalesce(l.title, '') else lots.title end as title,
  case when damaged = 'Yes' then 'from label' else status end as status
from keyed l join lots on lots.id = lot_id""")
def merge_precedence(t: Tables):
    """Listings without a title take the label's; a label column outside the listing fields always wins."""
    source = t["lots"]
    lots = source.select("auction_id", "id", "lot_number", "_ord",
                         F.when(F.col("damaged").isNotNull(), F.col("title")).otherwise("").alias("title"), "status")
    own = source.select("auction_id", F.col("_ord"), F.when(F.col("damaged") == "Yes", "from label").otherwise(F.col("status")).alias("status"))
    labels = shapes.labels(t).select("auction_id", "lot_number", "_ord", "title").join(own, ["auction_id", "_ord"], "left")
    return lab.join_labels_raw(labels, lots, SCOPE).select("lot_number", "title", "status")


@query("label_orphans", _MATCH + "select lot_number, subtype, replace(buckets_csv, ',', '|') as buckets from keyed where matched_by is null")
def label_orphans(t: Tables):
    return lab.label_orphans(shapes.labels(t), t["lots"], SCOPE).select("lot_number", "subtype", joined("buckets"))


@query("overlap_report", _MATCH + """
select (select count(*) from lots) as listings, count(*) as labels, count(*) filter (matched_by = 'id') as matched_by_id,
  count(*) filter (matched_by = 'lot_number') as matched_by_number, count(*) filter (matched_by is null) as unmatched from keyed""")
def overlap_report(t: Tables):
    return lab.overlap_report(shapes.labels(t), t["lots"], SCOPE)


@query("output_lots", _MATCH + """
select lots.lot_number, lots.title, lots.condition, split_part(lots.category, ' - ', 1) as category,
  split_part(lots.category, ' - ', 3) as subcategory, replace(lots.category, ' - ', '|') as category_path,
  is_flagged_text = 'yes' or buckets_csv <> '' as is_flagged,
  case when l.priority_is_older then case when buckets_csv = '' then 'Loose' else concat(buckets_csv, '|Loose') end
       else replace(buckets_csv, ',', '|') end as buckets,
  nullif(lower(trim(regexp_replace(subtype, '\\s+', ' ', 'g'))), '') as subtype,
  case when l.priority_is_older then 'medium' when confidence in ('low', 'medium', 'high') then confidence
    when confidence = '0.5' then 'medium' else 'low' end as confidence,
  strftime(cast(lots.close_ts as timestamp), '%A') as day
from (select *, match_strength = 'strong' as priority_is_older from keyed) l join lots on lots.id = lot_id""")
def output_lots(t: Tables):
    """Both label shapes in one table: strong matches come in the older shape."""
    older = F.col("match_strength") == "strong"
    labels = (shapes.labels(t).withColumn("has_label_category", older)
              .withColumn("label_category", F.when(older, F.array_join("buckets", ",")))
              .withColumn("label_subcategory", F.when(older, F.lit("Loose")))
              .withColumn("predicted_confidence", F.lit("0.66")))
    lots = t["lots"].select("auction_id", "id", "lot_number", "_ord", "title", "condition", "category",
                            F.date_format("close_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("close_at"))
    out = lab.output_lots(lab.join_labels_raw(labels, lots, SCOPE))
    return out.select("lot_number", "title", "condition", "category", "subcategory", joined("category_path"), "is_flagged",
                      joined("buckets"), "subtype", "confidence", "day")


@query("join_resale", """
select lot_number, is_valued, est_low, est_high, resale_confidence, resale_outlook, resale_reasoning from published""")
def join_resale(t: Tables):
    lots = t["lots"].select("auction_id", "id", "lot_number")
    return lab.join_resale(lots, t["valuations"]).select(
        "lot_number", "is_valued", "est_low", "est_high", "resale_confidence", "resale_outlook", "resale_reasoning")


# --- differences ---------------------------------------------------------------------------

@query("diff_new", """
select lot_number, title from lots where not exists (
  select 1 from lot_labels l where l.auction_id = lots.auction_id and (l.lot_number = lots.lot_number or l.lot_number = cast(lots.id as string)))""")
def diff_new(t: Tables):
    return lab.diff_new(t["lots"], shapes.labels(t), SCOPE).select("lot_number", "title")


@query("delta_new", """
select lot_number, first_seen from lots where status = 'O' and not exists (
  select 1 from lots e where e.status = 'O' and e.damaged = 'Yes' and e.id = lots.id)""")
def delta_new(t: Tables):
    earlier = t["lots"].where("status = 'O' and damaged = 'Yes'").select("auction_id", "id", "lot_number")
    return lab.delta_new(t["lots"], shapes.labels(t), [earlier], SCOPE).select("lot_number", "first_seen")


@query("restrict_lot_set", "select f.lot_number, f.subtype from flags f join lots l on l.lot_number = f.lot_number and l.functional = 'No'")
def restrict_lot_set(t: Tables):
    current = t["lots"].where("functional = 'No'")
    return lab.restrict_lot_set(shapes.flags(t), current, SCOPE).select("lot_number", "subtype")


@query("foreign_labels", "select y.lot_number, y.layer_no from label_layers y join lots l on l.lot_number = y.lot_number where l.status = 'P'")
def foreign_labels(t: Tables):
    judged = t["lots"].where("status <> 'P'")
    return lab.outside_lot_set(shapes.layers(t), judged, SCOPE).select("lot_number", "layer_no")


# --- upserts and layers ----------------------------------------------------------------------

@query("last_write_wins", """
select auction_id, lot_number, buckets_csv as buckets, layer_no from label_layers
qualify row_number() over (partition by auction_id, lot_number order by layer_no desc, _ord desc) = 1""")
def last_write_wins(t: Tables):
    rows = shapes.layers(t).select("auction_id", "lot_number", "layer_no", "_ord", joined("buckets"))
    out = latest(rows.withColumn("_at", F.struct("layer_no", "_ord")), [*SCOPE, "lot_number"], "_at")
    return out.select("auction_id", "lot_number", "buckets", "layer_no")


_UPSERT = """
with old_rows as (select lot_number, _ord, buckets_csv from flags where lot_number like 'S-%'),
new_rows as (select case when functional = 'No' and damaged is null and status = 'P' and condition = 'Good' then '' else lot_number end as lot_number, id + k * 1000000 as _ord,
    concat(status, '-', k) as buckets_csv
  from lots, (values (0), (1)) c(k) where damaged = 'Yes' or functional = 'No'),
upserted as (
  select o.lot_number, coalesce(n.b, o.buckets_csv) as buckets, case when n.lot_number is null then 'kept' else 'updated' end as change
  from old_rows o left join (select lot_number, arg_max(buckets_csv, _ord) as b from new_rows where lot_number <> '' group by 1) n on n.lot_number = o.lot_number
  union all
  select lot_number, arg_min(buckets_csv, _ord), 'added' from new_rows where lot_number <> '' and lot_number not in (select lot_number from old_rows) group by 1
  union all
  select lot_number, buckets_csv, 'added' from new_rows where lot_number = '')
"""


def _upsert_sides(t: Tables):
    old = t["flags"].where("lot_number like 'S-%'").select("lot_number", "_ord", F.col("buckets_csv").alias("buckets"))
    keyless = "functional = 'No' and damaged is null and status = 'P' and condition = 'Good'"
    new = (t["lots"].where("damaged = 'Yes' or functional = 'No'")
           .select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
           .select(F.when(F.expr(keyless), "").otherwise(F.col("lot_number")).alias("lot_number"),
                   (F.col("id") + F.col("k") * 1000000).alias("_ord"),
                   F.concat("status", F.lit("-"), F.col("k").cast("string")).alias("buckets")))
    return old, new


def _upserted(t: Tables):
    return lab.upsert_labels(*_upsert_sides(t))


@query("upsert_labels", _UPSERT + "select * from upserted")
def upsert_labels(t: Tables):
    return _upserted(t).select("lot_number", "buckets", "change")


@query("upsert_counts", _UPSERT + """
select count(*) filter (change = 'added') as added, count(*) filter (change = 'updated') as updated, count(*) as total from upserted""")
def upsert_counts(t: Tables):
    return lab.change_counts(_upserted(t))


@query("fold_layers", """
select auction_id, lot_number, buckets_csv as buckets, is_flagged, layer_no from label_layers
qualify row_number() over (partition by auction_id, lot_number order by layer_no desc, _ord desc) = 1
  and min(layer_no) over (partition by auction_id, lot_number) = 0""")
def fold_layers(t: Tables):
    out = lab.fold_layers(shapes.layers(t), SCOPE)
    return out.select("auction_id", "lot_number", joined("buckets"), "is_flagged", "layer_no")


@query("upsert_kept", _UPSERT + "select * from upserted")
def upsert_kept(t: Tables):
    """The same rows from a kept table, of which the upsert rewrites the buckets that it touches."""
    old, new = _upsert_sides(t)
    path = shared_dir(t.spark, "kept-labels")
    kept.keep_labels(old, path, buckets=8)
    kept.upsert(new, path)
    return kept.upserted(t.spark, path).select("lot_number", "buckets", "change")


@query("fold_kept", """
select auction_id, lot_number, buckets_csv as buckets, is_flagged, layer_no from label_layers
qualify row_number() over (partition by auction_id, lot_number order by layer_no desc, _ord desc) = 1
  and min(layer_no) over (partition by auction_id, lot_number) = 0""")
def fold_kept(t: Tables):
    """Layers added one after the other to a kept table, whose buckets are settled on the way."""
    rows, path = shapes.layers(t), shared_dir(t.spark, "kept-layers")
    kept.keep_layers(rows.where("layer_no = 0"), path, SCOPE, groups=4, buckets=2)
    kept.add_layer(rows.where("layer_no = 1"), path)
    kept.add_layer(rows.where("layer_no > 1"), path, most=2)
    return kept.folded(t.spark, path).select("auction_id", "lot_number", joined("buckets"), "is_flagged", "layer_no")


@query("layer_report", """
select y.layer_no, count(b.lot_number) as applied, count(*) - count(b.lot_number) as dropped
from label_layers y left join label_layers b on b.lot_number = y.lot_number and b.auction_id = y.auction_id and b.layer_no = 0
where y.layer_no > 0 group by 1""")
def layer_report(t: Tables):
    return lab.layer_report(shapes.layers(t), SCOPE)


_FOLD_VALUES = """
with stacked as (
  select lot_number, auction_id, 0 as layer_no, id as _ord, retail as est_low from lots where condition = 'Good'
  union all select lot_number, auction_id, 1, id, retail * 2 from lots where damaged = 'Yes'
  union all select lot_number, auction_id, 2, id, null from lots where damaged = 'Yes' and priority = '1-URGENT' and condition = 'Excellent')
select lot_number, est_low, layer_no from stacked where lot_number in (select lot_number from lots where status <> 'P')
qualify row_number() over (partition by auction_id, lot_number order by layer_no desc, _ord desc) = 1"""


def _valuation_layers(t: Tables):
    lots = t["lots"]
    row = lambda df, price: df.select("auction_id", "lot_number", F.col("id").alias("_ord"), price.alias("est_low"))
    base = row(lots.where("condition = 'Good'"), F.col("retail"))
    first = row(lots.where("damaged = 'Yes'"), F.col("retail") * 2).withColumn("layer_no", F.lit(1))
    second = row(lots.where("damaged = 'Yes' and priority = '1-URGENT' and condition = 'Excellent'"),
                 F.lit(None).cast("double")).withColumn("layer_no", F.lit(2))
    return base, first.unionByName(second), lots.where("status <> 'P'")


@query("fold_resale", _FOLD_VALUES)
def fold_resale(t: Tables):
    return lab.fold_valuations(*_valuation_layers(t), SCOPE).select("lot_number", "est_low", "layer_no")


@query("fold_resale_kept", _FOLD_VALUES)
def fold_resale_kept(t: Tables):
    """Valuations kept in buckets, to which the layers are appended."""
    base, layers, lots = _valuation_layers(t)
    path = shared_dir(t.spark, "kept-valuations")
    kept.keep_layers(base, path, SCOPE, groups=4, buckets=2)
    kept.add_layer(layers, path)
    return kept.folded_valuations(t.spark, path, lots).select("lot_number", "est_low", "layer_no")


# --- products -----------------------------------------------------------------------------------

_PRODUCTS = """
with grouped as (
  select auction_id, upper(trim(title)) as kt, upper(condition) as kc, upper(coalesce(size, '')) as ks, upper(coalesce(model, '')) as km,
    upper(coalesce(damaged, '')) as kd, upper(coalesce(functional, '')) as kf, min(lot_number) as rep_lot, count(*) as qty
  from lots group by all),
joined as (
  select lots.*, g.rep_lot, g.qty from lots join grouped g on g.auction_id = lots.auction_id and kt = upper(trim(title))
    and kc is not distinct from upper(condition) and ks = upper(coalesce(size, '')) and km = upper(coalesce(model, ''))
    and kd = upper(coalesce(damaged, '')) and kf = upper(coalesce(functional, '')))
"""


@query("dedupe_products", _PRODUCTS + """
select auction_id, rep_lot, qty, title, condition, size, category from joined where lot_number = rep_lot""")
def dedupe_products(t: Tables):
    return shapes.products(t).select("auction_id", "rep_lot", "qty", "title", "condition", "size", "category")


@query("product_members", _PRODUCTS + "select auction_id, lot_number, rep_lot, qty from joined")
def product_members(t: Tables):
    return shapes.members(t).select("auction_id", "lot_number", "rep_lot", "qty")


@query("dedupe_stats", _PRODUCTS + """
select cast(sum(qty) as bigint) as lots, count(*) as products, cast(sum(qty - 1) as bigint) as saved,
  count(*) filter (qty > 1) as groups_of_two, max(qty) as largest_group from grouped""")
def dedupe_stats(t: Tables):
    return prod.dedupe_stats(shapes.products(t))


@query("fanout_labels", _PRODUCTS + """
select j.auction_id, j.lot_number, j.rep_lot, coalesce(f.is_flagged, false) as is_flagged, replace(coalesce(f.buckets_csv, ''), ',', '|') as buckets,
  f.subtype, coalesce(f.personal_match, false) as personal_match
from joined j left join flags f on f.lot_number = j.rep_lot and f.auction_id = j.auction_id and f.is_flagged""")
def fanout_labels(t: Tables):
    answers = shapes.flags(t).where("is_flagged")
    out = prod.fanout_labels(shapes.members(t), answers, SCOPE)
    return out.select("auction_id", "lot_number", "rep_lot", "is_flagged", joined("buckets"), "subtype", "personal_match")


_BY_REP = _PRODUCTS.rstrip() + """,
given as (select trim(lot_number) as rep_lot, est_low, est_high, outlook from valuations qualify row_number() over (partition by trim(lot_number) order by _ord desc) = 1)
"""


@query("fanout_resale", _BY_REP + """
select j.lot_number, j.rep_lot, v.est_low, v.est_high, v.outlook from joined j join given v using (rep_lot)""")
def fanout_resale(t: Tables):
    out = prod.fanout_valuations(shapes.members(t).drop("auction_id"), t["valuations"])
    return out.select("lot_number", "rep_lot", "est_low", "est_high", "outlook")


@query("unvalued_products", _BY_REP + "select rep_lot, qty from grouped where rep_lot not in (select rep_lot from given)")
def unvalued_products(t: Tables):
    return prod.unvalued_products(shapes.products(t).drop("auction_id"), t["valuations"])


@query("ignored_valuations", _BY_REP + "select rep_lot, est_low from (select trim(lot_number) as rep_lot, est_low from valuations) v where rep_lot not in (select rep_lot from grouped)")
def ignored_valuations(t: Tables):
    return prod.ignored_valuations(shapes.products(t).drop("auction_id"), t["valuations"]).select("rep_lot", "est_low")


# The former grouping ignored the size, so its representatives are fewer.
_REGROUP = _PRODUCTS.rstrip() + """,
old_reps as (select auction_id, min(lot_number) as lot_number, min(id) as _ord from lots group by auction_id, upper(title), upper(condition)),
valued_old as (select o.* from old_reps o where lot_number in (select trim(lot_number) from valuations)),
reusable as (select g.rep_lot, arg_min(o.lot_number, o._ord) as old_rep
  from valued_old o join joined g on g.lot_number = o.lot_number and g.auction_id = o.auction_id group by 1),
fixes as (select rep_lot as lot_number, qty * 1.5 as est_low from grouped where auction_id <> 1998)
"""


def _old_reps(t: Tables):
    return (t["lots"].groupBy("auction_id", F.upper("title"), F.upper("condition"))
            .agg(F.min("lot_number").alias("lot_number"), F.min("id").alias("_ord"))
            .select("auction_id", "lot_number", "_ord"))


def _valued(t: Tables):
    """The current valuation of each display number, with its auction."""
    v = latest(t["valuations"].withColumn("lot_number", F.trim("lot_number")), ["lot_number"], "_ord")
    return v.join(t["lots"].select("auction_id", "lot_number"), "lot_number")


@query("regroup_plan", _REGROUP + """
select auction_id, rep_lot, qty from grouped where rep_lot not in (select rep_lot from reusable)""")
def regroup_plan(t: Tables):
    out = prod.regroup_plan(shapes.slim(t), _old_reps(t), _valued(t), SCOPE)
    return out.select("auction_id", "rep_lot", "qty")


@query("regroup_apply", _REGROUP + """
select g.auction_id, g.rep_lot as lot_number, case when r.old_rep is not null then 'kept' when f.lot_number is not null then 'fixed' end as source,
  case when r.old_rep is not null then v.est_low else f.est_low end as est_low
from grouped g left join reusable r on r.rep_lot = g.rep_lot
left join (select trim(lot_number) as k, est_low from valuations qualify row_number() over (partition by trim(lot_number) order by _ord desc) = 1) v on v.k = r.old_rep
left join fixes f on f.lot_number = g.rep_lot""")
def regroup_apply(t: Tables):
    fixes = (shapes.products(t).where("auction_id <> 1998")
             .select("auction_id", F.col("rep_lot").alias("lot_number"), (F.col("qty") * 1.5).alias("est_low"), F.lit(0).alias("_ord"))
             .select("*", *[F.lit(None).cast("string").alias(f) for f in vocab.VALUATION_FIELDS if f not in ("est_low", "est_high")],
                     F.lit(None).cast("double").alias("est_high")))
    out = prod.regroup_apply(shapes.slim(t), _old_reps(t), _valued(t), fixes, SCOPE)
    return out.select("auction_id", "lot_number", "source", "est_low")


# --- recall repair and groups ----------------------------------------------------------------------

_CONFIRMED = _PRODUCTS.rstrip() + """,
confirmed as (select g.rep_lot from grouped g join lots l on l.lot_number = g.rep_lot
  where l.title like '%rod%' and l.condition = 'Good')
"""


def _confirmed(t: Tables):
    picked = shapes.products(t).where("title like '%rod%' and condition = 'Good'")
    return picked.select("auction_id", F.col("rep_lot").alias("lot_number"), F.lit(True).alias("is_flagged"),
                         F.array(F.lit("Fasteners")).alias("buckets"), F.lit("rods").alias("subtype"),
                         F.lit(False).alias("personal_match"))


@query("apply_recall", _CONFIRMED + """
select f.lot_number, c.rep_lot is not null as newly_flagged, case when c.rep_lot is not null then 'Fasteners' else replace(f.buckets_csv, ',', '|') end as buckets,
  case when c.rep_lot is not null then 'rods' else f.subtype end as subtype
from flags f join joined j on j.lot_number = f.lot_number left join confirmed c on c.rep_lot = j.rep_lot""")
def apply_recall(t: Tables):
    out = lab.apply_recall(shapes.flags(t), shapes.members(t), _confirmed(t), SCOPE)
    return out.select("lot_number", "newly_flagged", joined("buckets"), "subtype")


@query("already_flagged", _PRODUCTS + """
select f.lot_number, replace(f.buckets_csv, ',', '|') as buckets from flags f join grouped g on g.rep_lot = f.lot_number where buckets_csv <> '' and kc = 'GOOD'""")
def already_flagged(t: Tables):
    confirmed = shapes.products(t).where("condition = 'Good'").select("auction_id", F.col("rep_lot").alias("lot_number"))
    return lab.already_flagged(shapes.flags(t), confirmed, SCOPE).select("lot_number", joined("buckets"))


@query("attach_bucket_groups", """
select u.bucket, coalesce(d.bucket_group, 'Other') as bucket_group, coalesce(d.group_pos, 2147483647) as group_pos,
  d.bucket is not null as is_known, count(*) as uses
from (select unnest(list_filter(split(buckets_csv, ','), lambda x: x <> '')) as bucket from flags) u
left join dim_buckets d on d.bucket = u.bucket group by all""")
def attach_bucket_groups(t: Tables):
    return lab.attach_bucket_groups(shapes.flags(t), shapes.bucket_dim(t))
