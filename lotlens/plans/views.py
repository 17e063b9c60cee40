"""Views that shape the driver's tables like listings, labels and sales.

The SQL is read by Spark and by the oracle database alike, so it keeps to what
both understand; arrays are made by splitting text.
"""

from __future__ import annotations

from ..sources.config import Bucket, Interest, TermGroup

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
        "events", "documents", "labels")

BUCKETS = [
    Bucket("Rings", "Jewellery", seeds=("ring",), subtypes=("plain rings",)),
    Bucket("Widgets", "Parts", seeds=("widget", "gizmo b"), subtypes=("widgets",)),
    Bucket("Fasteners", "Parts", seeds=("bolt ", "rod"), exclude=("hot bolt", "cold bolt"), aliases=("Bolts",),
           subtypes=("bolts", "rods")),
    Bucket("Plates", "Parts", seeds=("plate",), condition_in=("Brand New - Sealed", "Excellent")),
    Bucket("Machinery", "Industrial", seeds=("gear", "old anvil"), exclude=("red gear",), subtypes=("gears",)),
    Bucket("Heavy", "Industrial", seeds=("anvil",)),
    Bucket("Asian furniture", "Regions", categories=("ASIA - NATION_2 - FURNITURE", "ASIA - NATION_7")),
    Bucket("Nothing", "Regions", seeds=("zzyzx",)),
]
INTERESTS = [
    Interest("Collecting", buckets=("Rings", "Heavy"), tags=("rings", "vintage"), seeds=("old ",)),
    Interest("Workshop", buckets=("Widgets", "Fasteners", "Plates", "Machinery"), tags=("tools",), exclude=("new rod",),
             seeds=("rod brand2",)),
    Interest("Abroad", buckets=("Asian furniture", "Nothing"), tags=("import",),
             categories=("EUROPE - NATION_3",)),
]
TAGS = [t for i in INTERESTS for t in i.tags]
LEGEND = [
    TermGroup("Names", ("Brand7", "red widget", "B17 gizmo", "old anvil")),
    TermGroup("Types", ("ring", "rod", "l")),
    TermGroup("Gone", ("quencher", "plate brand25")),
]
TERMS = [t.strip().lower() for g in LEGEND for t in g.terms]

VIEWS: dict[str, str] = {}

VIEWS["catalog"] = """
select p_partkey, p_brand as brand, cast(p_size as string) as size, p_retailprice as retail,
  case when p_type = 'PROMO'
    then concat(split_part(p_name, ' ', 2), ' ', replace(p_brand, 'Brand#', 'B'), ' ', split_part(p_name, ' ', 1))
    else concat(p_name, ' ', replace(p_brand, '#', '')) end as title,
  case p_type when 'ECONOMY' then 'Good' when 'MEDIUM' then 'Excellent' when 'STANDARD' then 'Brand New - Sealed'
    when 'SMALL' then 'For Parts Only' when 'PROMO' then 'Mystery Grade' end as condition
from part
"""

VIEWS["lots"] = """
select o_orderkey as id, o_orderkey as _ord,
  concat(case when o_orderstatus = 'P' then 'M-' else 'S-' end, cast(o_orderkey as string)) as lot_number,
  cast(year(o_orderdate) as bigint) as auction_id, cast(year(o_orderdate) as string) as date,
  catalog.title as title, catalog.condition as condition, catalog.size as size,
  case when o_orderpriority = '2-HIGH' then catalog.brand end as model,
  case o_orderpriority when '1-URGENT' then 'Yes' when '2-HIGH' then 'Unknown' end as damaged,
  case o_orderpriority when '5-LOW' then 'No' end as functional,
  concat(r_name, ' - ', n_name, ' - ', c_mktsegment) as category,
  o_orderstatus as status, o_orderpriority as priority, o_totalprice as current_bid, o_orderdate as close_ts,
  retail, c_name as seller,
  concat(cast(cast(o_orderdate as date) as string), case o_orderpriority
    when '1-URGENT' then 'T00:00:00+00:00' when '2-HIGH' then 'T02:00:00Z' when '3-MEDIUM' then 'T04:00:00+00:00'
    when '4-NOT SPECIFIED' then 'T04:30:00+00:00' else 'T05:00:00' end) as first_seen
from (select *, o_orderkey % (select count(*) from part) as part_ref from orders) o
join catalog on p_partkey = part_ref
join customer on c_custkey = o_custkey
join nation on n_nationkey = c_nationkey
join region on r_regionkey = n_regionkey
"""

# Lots filed under what they are, so that categories lean towards one bucket.
VIEWS["shop_lots"] = """
select auction_id, lot_number, title, condition, size, model, damaged, functional,
  concat('Shop - ', split_part(title, ' ', case when condition = 'Mystery Grade' then 1 else 2 end), ' - ', status) as category
from lots
"""

# A landing description: bare grade, labelled lines, or a placeholder.
VIEWS["landing_text"] = """
select lots.*, case priority
  when '1-URGENT' then upper(condition)
  else concat('Est. Price: 9', chr(13), 'Condition: ', upper(coalesce(condition, 'Select condition here')), chr(13),
    case when model is not null then concat('Model: ', model, ' ') else 'Model:' end, chr(13),
    'Verified Size: ', size, chr(13),
    'Is Item Damaged? ', coalesce(damaged, 'No'), chr(13),
    'Is Item Functional? ', coalesce(functional, 'Yes'), chr(13),
    'Sold by ', seller, chr(13), 'Note: see photos')
  end as description_raw,
  case when status <> 'F' then concat('Internet Bidding closed at: ', cast(month(close_ts) as string), '/',
    cast(day(close_ts) as string), '/', cast(year(close_ts) as string), ' 1:30:05 PM EST') end as closing_text
from lots
"""

VIEWS["lot_labels"] = """
select case when priority in ('1-URGENT', '2-HIGH') then cast(id as string) else lot_number end as lot_number,
  lot_number as display_number, auction_id, id as _ord, is_flagged_text, buckets_csv,
  case when buckets_csv <> '' and priority <> '3-MEDIUM' then
    case when title like '%bolt%' then ' Bolts' when title like '%rod%' then 'rods' else concat(lower(buckets_csv), '  items') end end as subtype,
  case when title like '%old%' then true when title like '%new%' then false end as personal_match,
  case when title like '%old%' then case when title like '%ring%' then 'rings,vintage' else 'Vintage,antique' end else '' end as tags_csv,
  case when title like '%old%' then 'strong' else 'none' end as match_strength,
  case when title like '%old%' and priority <> '4-NOT SPECIFIED' then 'old things' end as personal_reasoning,
  case priority when '1-URGENT' then 'high' when '2-HIGH' then '0.5' when '3-MEDIUM' then 'sure' else 'low' end as confidence,
  case when priority = '4-NOT SPECIFIED' then 'label title' end as title
from (
  select *, case when condition = 'For Parts Only' then ''
      when title like '%anvil%' then 'Machinery,Heavy' when title like '%gear%' then 'Machinery'
      when title like '%bolt%' then case when priority = '2-HIGH' then 'Bolts' else 'Fasteners' end
      when title like '%ring%' then 'Rings' when title like '%widget%' then 'Widgets'
      when title like '%gizmo%' then 'Gadgets'
      when title like '%plate%' and priority <> '5-LOW' then 'Plates' else '' end as buckets_csv,
    case when title like '%rod%' and priority = '5-LOW' then 'yes' else 'auto' end as is_flagged_text
  from lots where status <> 'O') flagged
union all
select concat('X-', cast(s_suppkey as string)), concat('X-', cast(s_suppkey as string)), 1995, 900000000 + s_suppkey,
  'auto', 'Rings', null, null, '', 'none', null, 'low', null
from supplier
"""

# Labels keyed by display number for the lots they belong to.
VIEWS["flags"] = """
select display_number as lot_number, auction_id, _ord, buckets_csv <> '' or is_flagged_text = 'yes' as is_flagged,
  buckets_csv, subtype, personal_match, tags_csv, match_strength, personal_reasoning
from lot_labels where display_number not like 'X-%'
"""

VIEWS["label_layers"] = """
select lot_number, auction_id, 0 as layer_no, id as _ord, false as is_flagged, '' as buckets_csv from lots where status <> 'P'
union all
select lot_number, auction_id, 1, id, true, 'First' from lots where priority <> '5-LOW'
union all
select lot_number, auction_id, 2, id, true, 'Revised' from lots where damaged = 'Yes' or functional = 'No'
union all
select lot_number, auction_id, 2, id + 1000000000, true, 'Revised twice' from lots where damaged = 'Yes' and status = 'F'
union all
select lot_number, auction_id, 3, id, false, '' from lots where auction_id >= 2000
"""

VIEWS["valuations"] = """
select case when status = 'F' then cast(id as string) else concat(' ', lot_number) end as lot_number, id as _ord,
  case when priority <> '1-URGENT' then retail * 0.5 end as est_low,
  case when priority not in ('1-URGENT', '2-HIGH') or status = 'P' then retail end as est_high,
  case status when 'F' then ' High' when 'O' then 'medium ' else case when priority = '5-LOW' then 'sure' else 'LOW' end end as confidence,
  case when priority in ('1-URGENT', '3-MEDIUM') then 'Good' when priority = '2-HIGH' then 'FAIR' else 'poor' end as outlook,
  case when priority = '5-LOW' then '' else 'comparable units' end as reasoning
from lots where condition is not null
union all
select lot_number, id + 1000000000, retail * 2, retail * 3, 'low', 'good', 'second look' from lots
where condition = 'Good' and priority = '3-MEDIUM'
"""

# One row per listing of a closed auction (a quarter).
VIEWS["sales"] = """
select cast(year(l_shipdate) * 10 + quarter(l_shipdate) as bigint) as auction_id,
  concat(cast(year(l_shipdate) as string), '-', cast(quarter(l_shipdate) * 3 as string)) as close_date,
  case when l_linestatus = 'O' then concat(' ', upper(title)) else title end as title, condition,
  case when l_returnflag = 'R' then 1.0 else l_extendedprice + 1.0 end as bid_head,
  case when l_returnflag = 'R' then 2.0 else l_extendedprice + 2.0 end as bid_second,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_linestatus
from lineitem join catalog on p_partkey = l_partkey
"""

VIEWS["bid_history"] = """
select lots.date as date, lots.lot_number as lot,
  case when value > 60 then concat('other ', split_part(title, ' ', 1))
    else concat(split_part(title, ' ', 1), ' ', split_part(title, ' ', 2)) end as title,
  case when event_type = 'purchase' then 'bid' else 'watch' end as signal,
  case when event_type = 'purchase' then case when value > 20 then 'Outbid' else 'MayHaveWon' end else '' end as outcome
from (select *, (event_id * 7 + user_id) % (select count(*) from orders) as lot_ref
      from events where event_type in ('purchase', 'click')) e
join lots on lots.id = lot_ref
"""

VIEWS["doc_lots"] = """
select concat('D-', cast(d.doc_id as string)) as lot_number, d.doc_id as id, text as title, '' as description,
  source as subcategory, concat(lang, ' - ', source) as category,
  case when quality = 1 then 'Kept' else '' end as buckets_csv
from documents d left join labels q on q.doc_id = d.doc_id
"""


def _values(rows: list[tuple], columns: str) -> str:
    lit = lambda v: "null" if v is None else (
        str(v).lower() if isinstance(v, (bool, int)) else "'" + str(v).replace("'", "''") + "'")
    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"select * from (values {body}) t({columns})"


def _folded(rules, pick):
    import re

    return [(r.name, re.sub(r"[-/]+", " ", s.strip().lower()), s != s.rstrip(), len(s)) for r in rules for s in pick(r)]


_order = list(dict.fromkeys(b.group for b in BUCKETS))
VIEWS["dim_buckets"] = _values([(b.name, b.group, _order.index(b.group)) for b in BUCKETS], "bucket, bucket_group, group_pos")
VIEWS["dim_seeds"] = _values(_folded(BUCKETS, lambda b: b.seeds), "bucket, seed, closed, seed_len")
VIEWS["dim_excludes"] = _values(_folded(BUCKETS, lambda b: b.exclude), "bucket, seed, closed, seed_len")
VIEWS["dim_aliases"] = _values([(a, b.name) for b in BUCKETS for a in b.aliases], "old_name, bucket")
VIEWS["dim_terms"] = _values([(g.name, t, t.lower()) for g in LEGEND for t in g.terms], "term_group, term, folded")
VIEWS["dim_tags"] = _values([(t,) for t in TAGS], "tag")
VIEWS["dim_subtypes"] = _values([(s,) for b in BUCKETS for s in b.subtypes], "subtype")
VIEWS["dim_grades"] = _values(
    [(g, i + 1) for i, g in enumerate((
        "BRAND NEW - SEALED", "BRAND NEW - OPEN BOX", "NEW (ADJUSTED QUANTITY)", "EXCELLENT", "GOOD",
        "NEW WITH DEFECTS", "FAIR", "HEAVILY USED", "FOR PARTS ONLY"))], "grade, rung")

# Labels and valuations on every lot, for the browsing queries.
VIEWS["valued"] = """
select lot_key, est_low, est_high,
  case when lower(trim(confidence)) in ('low', 'medium', 'high') then lower(trim(confidence)) end as resale_confidence,
  case when lower(trim(outlook)) in ('good', 'fair', 'poor') then lower(trim(outlook)) end as resale_outlook,
  nullif(reasoning, '') as resale_reasoning
from (select *, trim(lot_number) as lot_key, row_number() over (partition by trim(lot_number) order by _ord desc) as rn
      from valuations where est_low is not null or est_high is not null) ranked
where rn = 1
"""

VIEWS["published"] = """
select lots.auction_id, lots.id, lots.lot_number, lots.title, lots.condition, lots.category, lots.status, lots.close_ts,
  lots.first_seen, lots.seller, coalesce(flags.is_flagged, false) as is_flagged, coalesce(buckets_csv, '') as buckets_csv,
  lower(trim(subtype)) as subtype, personal_match, match_strength,
  case when status = 'F' then 'Sunday' when status = 'O' then 'Monday' else '' end as day,
  case when status <> 'F' then concat('t/', lots.lot_number) else '' end as thumb_url,
  concat('f/', lots.lot_number) as image_url,
  case when a.lot_key is not null then a.est_low else b.est_low end as est_low,
  case when a.lot_key is not null then a.est_high else b.est_high end as est_high,
  case when a.lot_key is not null then a.resale_confidence else b.resale_confidence end as resale_confidence,
  case when a.lot_key is not null then a.resale_outlook else b.resale_outlook end as resale_outlook,
  case when a.lot_key is not null then a.resale_reasoning else b.resale_reasoning end as resale_reasoning,
  a.lot_key is not null or b.lot_key is not null as is_valued
from lots
left join flags on flags.lot_number = lots.lot_number and flags.auction_id = lots.auction_id
left join valued a on a.lot_key = lots.lot_number
left join valued b on b.lot_key = cast(lots.id as string)
"""
