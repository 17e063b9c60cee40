"""Queries over closed auctions and their use on current lots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sales
from . import shapes
from .registry import Tables, query

_PRICED = """
priced as (select *, upper(trim(title)) as key_title, upper(trim(coalesce(condition, ''))) as key_condition,
    case when bid_second > bid_head and bid_head - (bid_second - bid_head) > 0 then bid_head - (bid_second - bid_head) end as price
  from sales)"""
_HISTORY = _PRICED + """,
past as (select auction_id, close_date, key_title, key_condition, count(price) as sold, count(*) - count(price) as unsold,
    median(price) as median, min(price) as low, max(price) as high from priced group by all),
weeks as (select *, row_number() over (partition by key_title, key_condition order by close_date desc, cast(auction_id as string)) as period from past qualify period <= 8),
keys as (select distinct key_title, key_condition from weeks)"""
_STAMPED = _HISTORY + """,
own as (select l.*, upper(trim(l.title)) as key_title, upper(trim(coalesce(l.condition, ''))) as key_condition,
    coalesce(g.rung, 0) as rung from lots l left join dim_grades g on g.grade = upper(trim(l.condition))),
offers as (select o.id, k.key_title, k.key_condition as alt_condition,
    row_number() over (partition by o.id order by case when g.rung is not null then 0 else 1 end,
      case when g.rung >= o.rung then g.rung - o.rung else o.rung - g.rung end, g.rung desc, k.key_condition) as choice
  from own o join keys k on k.key_title = o.key_title and k.key_condition <> o.key_condition and k.key_condition <> ''
  left join dim_grades g on g.grade = k.key_condition),
alternates as (select id, string_agg(concat(key_title, '|', alt_condition), ';' order by choice) as alt_keys,
    arg_min(alt_condition, choice) as nearest from offers group by id),
stamped as (select o.*, case when k.key_title is not null then concat(o.key_title, '|', o.key_condition) end as sale_key, alt_keys, nearest
  from own o left join keys k on k.key_title = o.key_title and k.key_condition = o.key_condition left join alternates a on a.id = o.id)"""


@query("sale_price", "with " + _PRICED + " select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(price, 6) as price, price is null as unsold from priced")
def sale_price(t: Tables):
    from ..functions.values import final_price

    price = final_price(F.array("bid_head", "bid_second"))
    return t["sales"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(price, 6).alias("price"), price.isNull().alias("unsold"))


@query("sale_aggregate", "with " + _PRICED + """
select key_title, key_condition, arg_min(trim(title), (l_orderkey * 10 + l_linenumber, trim(title))) as title,
  count(price) as sold, count(*) - count(price) as unsold, round(median(price), 6) as median, round(min(price), 6) as low, round(max(price), 6) as high
from priced group by key_title, key_condition""")
def sale_aggregate(t: Tables):
    out = sales.sale_aggregate(shapes.closed(t))
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("key_title", "key_condition", "title", "sold", "unsold", r("median"), r("low"), r("high"))


@query("sale_prices", "with " + _PRICED + """
select key_title, key_condition, round(price, 6) as price, count(*) as copies from priced where price is not null group by all""")
def sale_prices(t: Tables):
    return sales.sale_prices(shapes.closed(t)).withColumn("price", F.round("price", 6))


@query("sale_close_date", """
select auction_id, coalesce(max(case when auction_id % 10 = 1 then cast(l_shipdate as date) end),
  cast(max(case when auction_id % 10 <> 4 then (cast(l_shipdate as timestamp) at time zone 'UTC') at time zone 'America/New_York' end) as date), date '2002-01-01') as close_date
from sales group by auction_id""")
def sale_close_date(t: Tables):
    """First quarters carry the auction's date, fourth quarters no date at all."""
    closed = t["sales"].select(
        "auction_id", F.when(F.col("auction_id") % 10 == 1, F.to_date("l_shipdate")).alias("auction_close"),
        F.when(F.col("auction_id") % 10 != 4, F.col("l_shipdate")).alias("close_ts"))
    return sales.sale_close_date(closed, F.lit("2002-01-01"))


@query("sale_summary", "with " + _HISTORY + """
select auction_id, count(*) as products, cast(sum(sold) as bigint) as sold, cast(sum(unsold) as bigint) as unsold from past group by 1""")
def sale_summary(t: Tables):
    return sales.sale_summary(shapes.history(t), shapes.SCOPE)


@query("top_sellers", "with " + _PRICED + """
select key_title, key_condition, count(price) as sold, round(median(price), 6) as median from priced group by all having count(price) > 0
order by sold desc, arg_min(trim(title), (l_orderkey * 10 + l_linenumber, trim(title))), key_condition limit 5""")
def top_sellers(t: Tables):
    top = sales.top_sellers(sales.sale_aggregate(shapes.closed(t)))
    return top.select("key_title", "key_condition", "sold", F.round("median", 6).alias("median"))


@query("sale_index", "with " + _HISTORY + """
select key_title, key_condition, count(*) as periods, string_agg(concat(close_date, ':', sold, '/', unsold), ';' order by period) as weeks,
  round(max(case when period = 1 then median end), 6) as latest_median from weeks group by all""")
def sale_index(t: Tables):
    entry = lambda w: F.concat(w["close_date"], F.lit(":"), w["sold"].cast("string"), F.lit("/"), w["unsold"].cast("string"))
    return shapes.index(t).select(
        "key_title", "key_condition", F.size("weeks").cast("bigint").alias("periods"),
        F.array_join(F.transform("weeks", entry), ";").alias("weeks"), F.round(F.get("weeks", F.lit(0))["median"], 6).alias("latest_median"))


def _stamped(t: Tables):
    return sales.join_sale_history(t["lots"], shapes.index(t))


@query("join_sale_exact", "with " + _STAMPED + " select lot_number, sale_key from stamped where sale_key is not null")
def join_sale_exact(t: Tables):
    return _stamped(t).where("sale_key is not null").select("lot_number", "sale_key")


@query("join_sale_alternates", "with " + _STAMPED + " select lot_number, alt_keys from stamped where alt_keys is not null")
def join_sale_alternates(t: Tables):
    return _stamped(t).where("alt_keys is not null").select("lot_number", F.array_join("alt_keys", ";").alias("alt_keys"))


@query("sale_history_for_lot", "with " + _STAMPED + """
select s.lot_number, s.sale_key, case when s.sale_key is null then nearest end as source_grade, count(w.period) as periods,
  max(case when period = 1 then w.close_date end) as close_date, max(case when period = 1 then sold end) as sold,
  max(case when period = 1 then unsold end) as unsold, round(max(case when period = 1 then w.median end), 6) as median
from stamped s left join weeks w on w.key_title = s.key_title
  and w.key_condition = case when s.sale_key is not null then s.key_condition else nearest end
group by all""")
def sale_history_for_lot(t: Tables):
    out = sales.sale_history_for_lot(t["lots"].select("lot_number", "title", "condition"), shapes.index(t))
    newest = F.get("weeks", F.lit(0))
    return out.select("lot_number", "sale_key", "source_grade", F.coalesce(F.size("weeks"), F.lit(0)).cast("bigint").alias("periods"),
                      newest["close_date"].alias("close_date"), newest["sold"].alias("sold"), newest["unsold"].alias("unsold"),
                      F.round(newest["median"], 6).alias("median"))


@query("sale_index_used", "with " + _STAMPED + """
select k.key_title, k.key_condition from keys k where exists (select 1 from stamped s where s.sale_key = concat(k.key_title, '|', k.key_condition))
  or exists (select 1 from offers o where o.key_title = k.key_title and o.alt_condition = k.key_condition)""")
def sale_index_used(t: Tables):
    return sales.sale_index_used(t["lots"], shapes.index(t)).select("key_title", "key_condition")


@query("sale_coverage", "with " + _STAMPED + """
select count(*) as lots, count(sale_key) as own, count(*) filter (sale_key is null and alt_keys is not null) as alt_only,
  round(count(sale_key) / count(*), 6) as own_share, round(count(*) filter (sale_key is null and alt_keys is not null) / count(*), 6) as alt_share from stamped""")
def sale_coverage(t: Tables):
    return sales.sale_coverage(t["lots"], shapes.index(t))
