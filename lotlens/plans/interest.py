"""Queries over bid and watch history, and over the search-term legend."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import interest, legend
from ..operators.shortlist import shortlist_lots
from ..sources.config import term_table
from . import shapes
from .registry import Tables, query
from .shapes import SCOPE
from .shortlist import BODIES, rules
from .views import BUCKETS, INTERESTS, LEGEND, TERMS

_DEDUPED = """
with deduped as (select date, lot, max((case when signal = 'bid' then 1 else 0 end, title, signal, outcome)) as r from bid_history group by 1, 2),
tracked as (select d.date, lot, r[2] as title, r[3] as signal, r[4] as outcome, l.title as lot_title, l.condition, l.lot_number,
    starts_with(l.title, r[2]) as matched
  from deduped d left join lots l on l.lot_number = d.lot and l.date = d.date),
"""


def _history(t: Tables):
    return interest.dedupe_history(t["bid_history"].select("date", "lot", "title", "signal", "outcome"))


def _supply(t: Tables):
    return t["lots"].select("date", "lot_number", "title", "condition", "category", "size", "model")


@query("dedupe_history", _DEDUPED + "one as (select 1) select date, lot, title, signal, outcome from tracked")
def dedupe_history(t: Tables):
    return _history(t)


@query("history_to_supply", _DEDUPED + "one as (select 1) select date, lot, signal, matched, lot_title, condition from tracked")
def history_to_supply(t: Tables):
    return interest.history_to_supply(_history(t), _supply(t)).select("date", "lot", "signal", "matched", "lot_title", "condition")


@query("tracked_sale_history", _DEDUPED + """
priced as (select upper(trim(title)) as kt, upper(trim(coalesce(condition, ''))) as kc, auction_id, close_date,
    case when bid_second > bid_head and bid_head - (bid_second - bid_head) > 0 then 1 end as sold from sales),
newest as (select kt, kc, close_date, count(sold) as sold from priced group by kt, kc, auction_id, close_date
  qualify row_number() over (partition by kt, kc order by close_date desc, cast(auction_id as string)) = 1)
select date, lot, signal, n.close_date, n.sold from tracked t left join newest n on kt = upper(t.lot_title) and kc = upper(coalesce(t.condition, ''))
where matched""")
def tracked_sale_history(t: Tables):
    rows = interest.history_to_supply(_history(t), _supply(t)).where("matched")
    newest = F.get("weeks", F.lit(0))
    return interest.with_sale_history(rows, shapes.index(t)).select(
        "date", "lot", "signal", newest["close_date"].alias("close_date"), newest["sold"].alias("sold"))


_TRACKED = (_DEDUPED.replace("with deduped", "with " + BODIES + "deduped", 1)
            + rules() + ",\n" + rules("bodies", False, "open_cand", "open_profile") + ",\n"
            + "good as (select * from tracked where matched)")


def _tracked(t: Tables, gate: bool):
    return interest.tracked_lots(_history(t), _supply(t), BUCKETS, gate, INTERESTS)


@query("taxonomy_gap", _TRACKED + """
select signal, count(*) as lots, count(*) filter (hit) as matched_any, count(*) filter (not hit) as matched_none,
  round(count(*) filter (not hit) / count(*), 6) as gap_share
from (select *, lot in (select lot_number from open_cand) or lot in (select lot_number from open_profile) as hit from good) g group by 1""")
def taxonomy_gap(t: Tables):
    return interest.taxonomy_gap(_tracked(t, False))


@query("interest_lift", _TRACKED + """,
n as (select (select count(*) from good) as tracked_all, (select count(*) from lots) as supply_all),
a as (select bucket, count(*) as supply from cand group by 1), b as (select bucket, count(*) as supply_ungated from open_cand group by 1),
c as (select bucket, count(*) as tracked from good join open_cand on lot = open_cand.lot_number group by 1)
select bucket, coalesce(tracked, 0) as tracked, coalesce(supply, 0) as supply, coalesce(supply_ungated, 0) as supply_ungated,
  round(case when coalesce(supply, 0) > 0 then (coalesce(tracked, 0) / tracked_all) / (supply / supply_all) end, 6) as lift,
  round(case when coalesce(supply_ungated, 0) > 0 then (coalesce(tracked, 0) / tracked_all) / (supply_ungated / supply_all) end, 6) as lift_ungated,
  coalesce(supply, 0) < 50 as noisy
from a full join b using (bucket) full join c using (bucket), n""")
def interest_lift(t: Tables):
    return interest.interest_lift(_tracked(t, False), shortlist_lots(_supply(t), BUCKETS, gate=False), BUCKETS)


@query("bid_conversion", _TRACKED + """
select bucket, count(*) as tracked, count(*) filter (signal = 'bid') as bids, round(count(*) filter (signal = 'bid') / count(*), 6) as bid_share
from good join open_cand on lot = open_cand.lot_number group by 1""")
def bid_conversion(t: Tables):
    return interest.bid_conversion(_tracked(t, False))


@query("interest_gap", _TRACKED + """,
words as (select g.*, list_filter(split(regexp_replace(upper(lot_title), '[^A-Z0-9 ]', ' ', 'g'), ' '), lambda x: length(x) > 1 and not regexp_full_match(x, '[0-9]+')) as w
  from good g where signal = 'bid' and lot not in (select lot_number from open_cand))
select array_to_string(w[1:3], ' ') as family, count(distinct lot_title) as products, count(distinct date) as auctions, count(*) as bids
from words where len(w) >= 3 and len(list_filter(w[1:3], lambda x: regexp_full_match(x, '[A-Z]+'))) >= 2
group by 1 having count(distinct lot_title) >= 1 and count(distinct date) >= 2""")
def interest_gap(t: Tables):
    """The generated titles are their own families, so one product is enough here."""
    return interest.interest_gap(_tracked(t, False), min_products=1)


@query("repeat_engagement", _DEDUPED + """
listed as (select upper(title) as key_title, upper(coalesce(condition, '')) as key_condition, count(*) as listed,
    count(d.lot) as engaged from lots l left join deduped d on d.lot = l.lot_number and d.date = l.date group by 1, 2)
select key_title, key_condition, listed, engaged, round(engaged / listed, 6) as engaged_share from listed where engaged > 0""")
def repeat_engagement(t: Tables):
    return interest.repeat_engagement(_history(t), _supply(t))


@query("gate_recall", _TRACKED + """,
bids as (select lot, lot in (select lot_number from cand) or lot in (select lot_number from profile) as on_hit,
    lot in (select lot_number from open_cand) or lot in (select lot_number from open_profile) as off_hit from good where signal = 'bid')
select count(*) as bids, count(*) filter (on_hit) as hit_gate_on, count(*) filter (off_hit) as hit_gate_off,
  round(count(*) filter (on_hit) / count(*), 6) as recall_gate_on, round(count(*) filter (off_hit) / count(*), 6) as recall_gate_off from bids""")
def gate_recall(t: Tables):
    return interest.gate_recall(_history(t), _supply(t), BUCKETS, INTERESTS)


@query("engaged_vs_ignored", _TRACKED + """
select bucket, d.lot is not null as engaged, count(*) as lots, count(*) filter (l.condition in ('Good', 'For Parts Only')) as poor,
  round(count(*) filter (l.condition in ('Good', 'For Parts Only')) / count(*), 6) as poor_share
from open_cand c join lots l on l.lot_number = c.lot_number left join deduped d on d.lot = l.lot_number and d.date = l.date group by 1, 2""")
def engaged_vs_ignored(t: Tables):
    return interest.engaged_vs_ignored(_history(t), _supply(t), BUCKETS, poor=("Good", "For Parts Only"))


# --- legend ---------------------------------------------------------------------------------------

_HITS = """
with texts as (select l.lot_number, coalesce(f.buckets_csv, '') as buckets_csv, concat(lower(l.title), '  ', lower(l.lot_number), '  ', lower(replace(l.category, ' - ', ' '))) as body,
    lower(l.title) as t from lots l left join flags f using (lot_number)),
hits as (select lot_number, buckets_csv, term, folded, regexp_matches(body, '(^|[^a-z0-9])' || replace(folded, ' ', '\\s+') || '(e?s)?($|[^a-z0-9])') as whole
  from texts join dim_terms on len(list_filter(split(folded, ' '), lambda k: not contains(body, k))) = 0)
"""


def _texts(t: Tables):
    flagged = shapes.flags(t).select("auction_id", "lot_number", "buckets")
    none = F.array().cast("array<string>")
    return (shapes.lots(t).select("auction_id", "lot_number", "title", "category_path").join(flagged, ["auction_id", "lot_number"], "left")
            .withColumn("buckets", F.coalesce("buckets", none)))


@query("term_hits", _HITS + "select lot_number, folded as term, whole from hits")
def term_hits(t: Tables):
    return legend.term_hits(_texts(t), TERMS).select("lot_number", "term", "whole")


@query("legend_counts", _HITS + """
select term_group, d.term, count(h.lot_number) as lots from dim_terms d left join hits h on h.term = d.term group by 1, 2""")
def legend_counts(t: Tables):
    return legend.legend_counts(_texts(t), term_table(t.spark, LEGEND), TERMS, SCOPE)


@query("term_stats", _HITS + """,
seen as (select folded, count(distinct auction_id) as weeks from (select distinct auction_id, lower(title) as t from sales) s
  join dim_terms on len(list_filter(split(folded, ' '), lambda k: not contains(t, k))) = 0 group by 1)
select d.folded as term, coalesce(max(weeks), 0) as weeks, count(h.lot_number) as now, count(*) filter (h.buckets_csv = '') as missed, count(*) filter (whole) as whole,
  coalesce(max(weeks), 0) = 0 as never_seen, count(h.lot_number) >= 5 and count(h.lot_number) > 2 * count(*) filter (whole) as noisy
from dim_terms d left join hits h on h.folded = d.folded left join seen on seen.folded = d.folded group by 1""")
def term_stats(t: Tables):
    periods = t["sales"].select(F.col("auction_id").alias("period"), "title")
    return legend.term_stats(_texts(t), periods, TERMS)


_BRANDS = """
with brands as (select brand, count(*) filter (signal = 'bid') as bid, count(*) filter (signal = 'watch') as watch from (
    select split_part(lower(title), ' ', 1) as brand, signal from bid_history) b
  where length(brand) > 2 and not regexp_matches(brand, '[0-9]') and brand not in ('new', 'red', 'blue', 'large', 'small', 'green', 'black', 'white') group by 1)
"""


@query("brand_signals", _BRANDS + "select * from brands")
def brand_signals(t: Tables):
    return legend.brand_signals(t["bid_history"])


_UNCOVERED = _BRANDS.rstrip() + """,
uncovered as (select * from brands where not exists (select 1 from dim_terms where contains(brand, folded) or contains(folded, brand)))
"""


@query("uncovered_brands", _UNCOVERED + "select * from uncovered")
def uncovered_brands(t: Tables):
    return legend.uncovered_brands(legend.brand_signals(t["bid_history"]), TERMS)


@query("brand_suggest", _UNCOVERED + "select *, 2 * bid + watch as score from uncovered order by score desc, brand limit 60")
def brand_suggest(t: Tables):
    return legend.brand_suggest(legend.brand_signals(t["bid_history"]), TERMS)


