"""The bundle job: everything joined, written, checked and published."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..operators import bundle
from ..session import shared_dir
from ..sources import sinks
from . import shapes
from .browse import _RUNS
from .labels import _MATCH
from .registry import Tables, query
from .sales import _STAMPED
from .shapes import SCOPE, joined


#: What the views of the bundle take from the lots.
_OF_LOTS = ("auction_id", "id", "_ord", "lot_number", "title", "condition", "category", "status", "priority", "retail", "first_seen",
            "close_ts")


def _publish(t: Tables) -> str:
    path = shared_dir(t.spark, "bundle")
    # Listings, labels and valuations are all made of the lots, which are a join of five tables.
    t.write("lots", _OF_LOTS, SCOPE + ("id",))
    raw = t["lots"].select(
        "auction_id", "id", "lot_number", "_ord", "title", "condition", "category", "first_seen",
        F.concat(F.lit("f/"), F.col("lot_number")).alias("image_url"), F.lit("").alias("thumb_url"),
        F.date_format("close_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("close_at"))
    # Valuations name a lot of any auction; here they belong to the auction of that lot.
    ids = t["lots"].select("auction_id", F.explode(F.array(F.col("id").cast("string"), F.col("lot_number"))).alias("k"))
    valued = t["valuations"].withColumn("k", F.trim("lot_number")).join(ids, "k").drop("k")
    tables = bundle.bundle_tables(raw, shapes.labels(t), valued, shapes.index(t), shapes.bucket_dim(t),
                                  values.parse_instant(F.col("first_seen")), SCOPE)
    sinks.write_tables(tables, path, bundle.bundle_gates(SCOPE), {"lots": ["auction_id"]})
    return path


_ALL = ("with recursive " + _MATCH.strip()[len("with "):] + ",\n" + _STAMPED + ",\n"
        + _RUNS.strip()[len("with recursive "):].replace("stamped", "seen_rows")) + """,
merged as (select l.auction_id, l.id, k.buckets_csv, k.subtype, k.is_flagged_text, k.match_strength from keyed k join lots l on l.id = k.lot_id)
"""


@query("build_bundle", _ALL + """
select m.auction_id, s.lot_number, s.title, s.condition, replace(s.category, ' - ', '|') as category_path, replace(m.buckets_csv, ',', '|') as buckets,
  nullif(lower(trim(regexp_replace(m.subtype, '\\s+', ' ', 'g'))), '') as subtype, m.is_flagged_text = 'yes' or m.buckets_csv <> '' as is_flagged,
  case when a.lot_key is not null then a.est_low else b.est_low end as est_low,
  case when a.lot_key is not null then a.resale_outlook else b.resale_outlook end as resale_outlook, s.sale_key, s.alt_keys, r.scrape
from merged m join stamped s on s.id = m.id left join assigned r on r.auction_id = m.auction_id and r.lot_number = s.lot_number
left join valued a on a.lot_key = s.lot_number left join valued b on b.lot_key = cast(s.id as string)""")
def build_bundle(t: Tables):
    lots = sinks.read_table(t.spark, _publish(t), "lots")
    return lots.select(F.col("auction_id").cast("bigint").alias("auction_id"), "lot_number", "title", "condition", joined("category_path"),
                       joined("buckets"), "subtype", "is_flagged", "est_low", "resale_outlook", "sale_key",
                       F.array_join("alt_keys", ";").alias("alt_keys"), "scrape")


@query("bundle_sides", _ALL + """,
used as (select unnest(list_filter(split(buckets_csv, ','), lambda x: x <> '')) as bucket from merged),
refs as (select distinct w.key_title, w.key_condition from weeks w where exists (
    select 1 from merged m join stamped s on s.id = m.id where s.sale_key = concat(w.key_title, '|', w.key_condition))
  or exists (select 1 from merged m join offers o on o.id = m.id where o.key_title = w.key_title and o.alt_condition = w.key_condition))
select 'bucket_groups' as part, count(distinct bucket) as n from used
union all select 'groups', count(distinct coalesce(bucket_group, 'Other')) from used left join dim_buckets using (bucket)
union all select 'scrapes', count(distinct (r.auction_id, r.scrape)) from merged m join lots l on l.id = m.id join assigned r on r.auction_id = l.auction_id and r.lot_number = l.lot_number where r.scrape is not null
union all select 'sale_history', count(*) from refs""")
def bundle_sides(t: Tables):
    path = _publish(t)
    out = None
    for name in bundle.TABLES[1:]:
        one = sinks.read_table(t.spark, path, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out
