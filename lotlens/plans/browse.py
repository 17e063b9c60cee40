"""Queries a viewer runs: filters, orders, search, facets, runs and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..operators import browse as view
from ..operators import chunks, facets, postings, scrapes, search
from ..operators.common import positions, written_once
from . import shapes
from .registry import Tables, query
from .shapes import SCOPE, joined

NOW = "1999-06-30 00:00:00"


def _filter(name: str, sql: str, predicate, columns=("lot_number",)):
    cols = ", ".join(columns)

    @query(name, f"select {cols} from published where {sql}")
    def run(t: Tables):
        return shapes.published(t).where(predicate()).select(*columns)

    return run


_filter("filter_day", "lot_number like 'M-%'", lambda: view.day_is("Monday"), ("lot_number", "day"))
_filter("filter_category_prefix", "category like 'ASIA - NATION_2 - %'", lambda: view.category_under(["ASIA", "NATION_2"]), ("lot_number", "category"))
_filter("filter_conditions", "condition in ('Good', 'Mystery Grade')", lambda: view.condition_in(["Good", "Mystery Grade"]), ("lot_number", "condition"))
_filter("filter_resale_confidence", "resale_confidence in ('high', 'medium')", lambda: view.confidence_at_least("medium-plus"), ("lot_number", "resale_confidence"))
_filter("filter_outlook", "resale_outlook = 'fair'", lambda: view.outlook_is("fair"), ("lot_number", "resale_outlook"))
_filter("filter_potential_resale", "is_valued and resale_outlook in ('good', 'fair') and resale_confidence in ('medium', 'high')", view.potential_resale)
_filter("filter_personal", "personal_match is true", view.personal_pick)
_filter("filter_hide_ended", f"close_ts is null or close_ts > timestamp '{NOW}'", lambda: view.still_open(F.lit(NOW).cast("timestamp")))


@query("filter_tab", """
select 'bucket' as tab, auction_id, lot_number from published where is_flagged and list_contains(split(buckets_csv, ','), 'Machinery') and subtype = 'machinery  items'
union all select 'watched', cast(date as bigint), lot from bid_history group by date, lot
union all select 'all', auction_id, lot_number from published""")
def filter_tab(t: Tables):
    lots = shapes.published(t).select("auction_id", "lot_number", "is_flagged", "buckets", "subtype")
    watched = t["bid_history"].select(F.col("date").cast("bigint").alias("auction_id"), F.col("lot").alias("lot_number"))
    parts = [view.filter_tab(lots, "flagged", bucket="Machinery", subtype="machinery  items").withColumn("tab", F.lit("bucket")),
             view.filter_tab(lots, "watched", watched, scope=SCOPE).withColumn("tab", F.lit("watched")),
             view.filter_tab(lots, "all").withColumn("tab", F.lit("all")),
             view.filter_tab(lots, "flagged").withColumn("tab", F.lit("no bucket"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("tab", "auction_id", "lot_number")


# --- orders ---------------------------------------------------------------------------------------

def _sorted(t: Tables, key: str):
    """Every lot with its place in an order."""
    rows = shapes.published(t).select("lot_number", "is_flagged", "day", "close_ts", "est_low", "est_high")
    return positions(rows, view.sort_columns(key)).select("lot_number", "position")


def _sort_query(name: str, key: str, order: str):
    @query(name, f"select lot_number, row_number() over (order by {order}) as position from published")
    def run(t: Tables):
        return _sorted(t, key)

    return run


_MEAN = "coalesce((est_low + est_high) / 2, est_low, est_high)"
_sort_query("sort_default", "lot", "is_flagged desc, day = 'Sunday' desc, lot_number")
_sort_query("sort_close", "close-asc", "close_ts asc nulls last, lot_number")
_sort_query("sort_resale", "resale-desc", f"{_MEAN} desc nulls last, lot_number")
_sort_query("sort_resale_asc", "resale-asc", f"{_MEAN} asc nulls last, lot_number")


# --- search ---------------------------------------------------------------------------------------

_INDEX = """
with folded as (select lot_number, id, strip_accents(lower(title)) as title, strip_accents(lower(subcategory)) as subcategory, lower(lot_number) as number,
  strip_accents(lower(replace(category, ' - ', ' '))) as cats from doc_lots)
"""


@query("search_index", _INDEX + """
select lot_number, md5(concat_ws('  ', title, subcategory, number, '', cats)) as all_digest, concat('  ', cats) as search_long from folded""")
def search_index(t: Tables):
    out = search.search_index(shapes.doc_lots(t))
    return out.select("lot_number", F.md5("search_all").alias("all_digest"), "search_long")


@query("search_exact", _INDEX + """
select lot_number from folded where contains(concat_ws('  ', title, subcategory, number, '', cats), 'ele') and contains(concat_ws('  ', title, subcategory, number, '', cats), 'src1')""")
def search_exact(t: Tables):
    return search.search(shapes.doc_lots(t), "Èle  SRC1").select("lot_number")


_WORDS = _INDEX.rstrip() + """,
words as (select *, string_split_regex(title, '\\s+') as tw from folded)
"""


@query("search_fuzzy", _WORDS + """
select lot_number from words where
  ((contains(title, 'enlich') or len(list_filter(tw, lambda w: levenshtein(w, 'enlich') <= 1)) > 0
    or contains(subcategory, 'enlich') or levenshtein(subcategory, 'enlich') <= 1 or contains(number, 'enlich') or levenshtein(number, 'enlich') <= 1)
   and (contains(title, 'src3') or contains(subcategory, 'src3') or contains(number, 'src3')))
  or (contains(concat('  ', cats), 'enlich') and contains(concat('  ', cats), 'src3'))
union all
select lot_number || '?' from words where
  contains(title, 'schungge') or len(list_filter(tw, lambda w: levenshtein(w, 'schungge') <= 1)) > 0
    or contains(subcategory, 'schungge') or levenshtein(subcategory, 'schungge') <= 1 or contains(number, 'schungge') or levenshtein(number, 'schungge') <= 1
  or contains(concat('  ', cats), 'schungge')""")
def search_fuzzy(t: Tables):
    docs = shapes.doc_lots(t)
    two = search.search(docs, "enlìch src3", fuzzy=True).select("lot_number")
    one = search.search(docs, "schungge", fuzzy=True).select(F.concat("lot_number", F.lit("?")).alias("lot_number"))
    return two.unionByName(one)


def _postings(t: Tables) -> postings.Index:
    return postings.Index(t.spark, postings.build(shapes.doc_lots(t)))


@query("search_postings_exact", _INDEX + """
select lot_number from folded where contains(concat_ws('  ', title, subcategory, number, '', cats), 'ele') and contains(concat_ws('  ', title, subcategory, number, '', cats), 'src1')""")
def search_postings_exact(t: Tables):
    return _postings(t).exact("Èle  SRC1")


@query("search_postings_fuzzy", _WORDS + """
select lot_number from words where
  ((contains(title, 'enlich') or len(list_filter(tw, lambda w: levenshtein(w, 'enlich') <= 1)) > 0
    or contains(subcategory, 'enlich') or levenshtein(subcategory, 'enlich') <= 1 or contains(number, 'enlich') or levenshtein(number, 'enlich') <= 1)
   and (contains(title, 'src3') or contains(subcategory, 'src3') or contains(number, 'src3')))
  or (contains(concat('  ', cats), 'enlich') and contains(concat('  ', cats), 'src3'))
union all
select lot_number || '?' from words where
  contains(title, 'schungge') or len(list_filter(tw, lambda w: levenshtein(w, 'schungge') <= 1)) > 0
    or contains(subcategory, 'schungge') or levenshtein(subcategory, 'schungge') <= 1 or contains(number, 'schungge') or levenshtein(number, 'schungge') <= 1
  or contains(concat('  ', cats), 'schungge')""")
def search_postings_fuzzy(t: Tables):
    index = _postings(t)
    two, one = index.fuzzy("enlìch src3"), index.fuzzy("schungge").select(F.concat("lot_number", F.lit("?")).alias("lot_number"))
    return two.unionByName(one)


@query("search_in_view", """
select lot_number, title from published where lot_number like 'S-%' and condition = 'Good' and contains(lower(title), 'anvil') and contains(lower(title), 'brand1')""")
def search_in_view(t: Tables):
    lots = shapes.published(t).where(view.day_is("Sunday")).where(view.condition_in(["Good"]))
    return search.search_in_view(lots, "Anvil BRAND1").select("lot_number", "title")


@query("browse", """
select lot_number, title, est_low from published where lot_number like 'S-%' and category like 'EUROPE - %' and resale_confidence in ('high', 'medium')
  and condition in ('Good', 'Excellent') and close_ts > timestamp '1999-06-30 00:00:00' and contains(lower(title), 'ring')""")
def browse(t: Tables):
    out = view.browse(shapes.published(t), day="Sunday", category=["EUROPE"], confidence="medium-plus",
                      conditions=["Good", "Excellent"], hide_ended_at=F.lit(NOW).cast("timestamp"), query="ring", sort="resale-desc")
    return out.select("lot_number", "title", "est_low")


@query("lot_view", """
select lot_number, title, nullif(split_part(buckets_csv, ',', 1), '') as bucket, est_low as low, est_high as high,
  case when coalesce(est_low, 0) > 0 or coalesce(est_high, 0) > 0 then coalesce((est_low + est_high) / 2, est_low, est_high) end as mid,
  left(lot_number, 1) as day, nullif(match_strength, 'none') as strength, personal_match is true as is_pick,
  coalesce(nullif(thumb_url, ''), image_url) as image, image_url as image_full from published""")
def lot_view(t: Tables):
    return view.lot_view(shapes.published(t))


@query("resolve_lot_refs", """
with asked as (select distinct case when user_id % 3 = 0 then cast(event_id as string) when user_id % 3 = 1 then 's ' || event_id else 'M-' || event_id || ' ' end as ref,
    cast(event_id as string) as n, user_id % 3 as kind from events),
options as (select ref, 0 as pos, 'S-' || n as lot_number from asked where kind = 0 union all select ref, 1, 'M-' || n from asked where kind = 0
  union all select ref, 2, n from asked where kind = 0 union all select ref, 0, case when kind = 1 then 'S-' else 'M-' end || n from asked where kind <> 0)
select ref, arg_min(l.lot_number, (case when l.status = 'P' then 0 else 1 end, pos)) as lot_number from options o left join lots l on l.lot_number = o.lot_number group by 1""")
def resolve_lot_refs(t: Tables):
    n = F.col("event_id").cast("string")
    kind = F.col("user_id") % 3
    refs = t["events"].select(F.when(kind == 0, n).when(kind == 1, F.concat(F.lit("s "), n))
                              .otherwise(F.concat(F.lit("M-"), n, F.lit(" "))).alias("ref"))
    return search.resolve_lot_refs(refs, t["lots"], t["lots"].where("status = 'P'"))


# --- facets ---------------------------------------------------------------------------------------

_TREE = """
with nodes as (select unnest(list_transform(range(0, 4), lambda i: split(category, ' - ')[1:i])) as path from lots),
counted as (select path, count(*) as lots from nodes group by 1)
select array_to_string(path, '|') as path, len(path) as depth, path[-1] as name, lots,
  row_number() over (partition by len(path), path[1:len(path) - 1] order by lots desc, path[-1]) as sibling_rank from counted"""


@query("category_tree", _TREE)
def category_tree(t: Tables):
    tree = facets.category_tree(shapes.lots(t))
    return tree.select(joined("path"), F.col("depth").cast("bigint").alias("depth"), "name", "lots", "sibling_rank")


_NAV = """
with rows as (select auction_id, lot_number, nullif(subtype, '') as subtype, unnest(split(buckets_csv, ',')) as bucket from published where is_flagged and buckets_csv <> ''),
grouped as (select r.*, coalesce(d.bucket_group, 'Other') as bucket_group, coalesce(d.group_pos, 2147483647) as group_pos from rows r left join dim_buckets d using (bucket))
select 1 as level, group_pos, bucket_group, null as bucket, null as subtype, count(distinct (auction_id, lot_number)) as lots from grouped group by all
union all select 2, group_pos, bucket_group, bucket, null, count(distinct (auction_id, lot_number)) from grouped group by all
union all select 3, group_pos, bucket_group, bucket, subtype, count(distinct (auction_id, lot_number)) from grouped where subtype is not null group by all"""


@query("label_nav", _NAV)
def label_nav(t: Tables):
    return facets.label_nav(shapes.published(t), shapes.bucket_dim(t), SCOPE)


_CONDITIONS = """
select condition, condition <> 'Mystery Grade' as is_known, row_number() over (order by case condition when 'Brand New - Sealed' then 1
  when 'Excellent' then 5 when 'Good' then 6 when 'For Parts Only' then 10 else 12 end, condition) as position
from (select distinct condition from lots where condition is not null) c"""


@query("available_conditions", _CONDITIONS)
def available_conditions(t: Tables):
    return facets.available_conditions(t["lots"])


def _changed(now: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lots as they were, and the changed ones before and after: of every ten lots one came, one went, one moved."""
    kind = F.pmod(F.xxhash64("auction_id", "lot_number"), F.lit(10))
    moved = now.where(kind == 2)
    for name, value in (("category_path", F.array(F.lit("OLD"), F.element_at("category_path", 1))), ("condition", F.lit("Unsorted")),
                        ("buckets", F.array(F.lit("Rings"), F.lit("Unheard of"))), ("subtype", F.lit("kept")), ("is_flagged", F.lit(True))):
        if name in now.columns:
            moved = moved.withColumn(name, value)
    lost = now.where(kind == 1).withColumn("lot_number", F.concat(F.lit("X-"), "lot_number"))
    before = moved.unionByName(lost)
    return now.where(kind > 2).unionByName(now.where(kind == 1)).unionByName(before), before, now.where(kind.isin(0, 2))


def _kept_counts(t: Tables, now: DataFrame, nodes) -> DataFrame:
    """Counts of the lots as they were, written as a viewer keeps them, then brought up to date from the changes."""
    then, before, after = _changed(now)
    counts = written_once(facets.counted(nodes(then)), "counts")
    return facets.recounted(counts, nodes(before), nodes(after))


@query("category_tree_kept", _TREE)
def category_tree_kept(t: Tables):
    tree = facets.ranked_tree(_kept_counts(t, shapes.lots(t), facets.tree_nodes))
    return tree.select(joined("path"), F.col("depth").cast("bigint").alias("depth"), "name", "lots", "sibling_rank")


@query("label_nav_kept", _NAV)
def label_nav_kept(t: Tables):
    dim = shapes.bucket_dim(t)
    now = shapes.published(t).select("auction_id", "lot_number", "is_flagged", "buckets", "subtype")
    return _kept_counts(t, now, lambda lots: facets.nav_nodes(lots, dim, SCOPE))


@query("available_conditions_kept", _CONDITIONS)
def available_conditions_kept(t: Tables):
    now = t["lots"].select("auction_id", "lot_number", "condition")
    return facets.listed_conditions(_kept_counts(t, now, facets.condition_nodes).select("condition"))


@query("fidelity_report", """
select count(*) as lots, count(*) filter (title <> '') as titled, count(*) filter (thumb_url <> '') as imaged, count(*) as categorised, count(condition) as conditioned from published""")
def fidelity_report(t: Tables):
    lots = shapes.published(t).withColumn("image_url", F.col("thumb_url"))
    return facets.fidelity_report(lots)


@query("unknown_conditions", "select condition, count(*) as lots from lots where condition = 'Mystery Grade' group by 1")
def unknown_conditions(t: Tables):
    return facets.unknown_conditions(t["lots"])


# --- runs and chunks ----------------------------------------------------------------------------------

_RUNS = """
with recursive stamped as (select auction_id, lot_number, case when priority <> '5-LOW' then
    cast(replace(replace(first_seen, 'Z', ''), '+00:00', '') as timestamp) end as ts from lots),
stamps as (select distinct auction_id, ts from stamped where ts is not null),
starts as (
  select auction_id, min(ts) as ts from stamps group by 1
  union all
  select s.auction_id, (select min(n.ts) from stamps n where n.auction_id = s.auction_id and n.ts > s.ts + interval '3 hours') as ts
  from starts s where exists (select 1 from stamps n where n.auction_id = s.auction_id and n.ts > s.ts + interval '3 hours')),
numbered as (select auction_id, ts, row_number() over (partition by auction_id order by ts) as scrape,
  lead(ts) over (partition by auction_id order by ts) as next_ts from starts),
labelled as (select *, strftime((ts at time zone 'UTC') at time zone 'America/New_York', '%a %b %-d') as day,
  strftime((ts at time zone 'UTC') at time zone 'America/New_York', '%H:%M') as hour from numbered),
assigned as (select s.auction_id, s.lot_number, n.scrape from stamped s left join numbered n on n.auction_id = s.auction_id and s.ts >= n.ts and (n.next_ts is null or s.ts < n.next_ts))
"""


def _stamp():
    return values.parse_instant(F.col("first_seen"))


def _runs(t: Tables):
    lots = t["lots"].select("auction_id", "lot_number", "first_seen")
    stamps = scrapes.run_stamps(lots, _stamp(), SCOPE)
    return scrapes.assign_scrapes(lots, stamps, _stamp(), SCOPE), stamps


@query("scrape_clusters", _RUNS + """
select l.auction_id, l.scrape, strftime(l.ts, '%Y-%m-%d %H:%M:%S') as started_at,
  case when count(*) over (partition by l.auction_id, day) > 1 then day || ' ' || hour else day end as label, c.lots
from labelled l join (select auction_id, scrape, count(*) as lots from assigned where scrape is not null group by 1, 2) c on c.auction_id = l.auction_id and c.scrape = l.scrape""")
def scrape_clusters(t: Tables):
    assigned, stamps = _runs(t)
    out = scrapes.scrape_clusters(assigned, stamps, SCOPE)
    return out.withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"))


@query("assign_scrapes", _RUNS + "select auction_id, lot_number, scrape from assigned")
def assign_scrapes(t: Tables):
    return _runs(t)[0].select("auction_id", "lot_number", "scrape")


@query("filter_exclude_scrapes", _RUNS + "select auction_id, lot_number from assigned where scrape is null or scrape not in (1, 2, 3, 5, 8)")
def filter_exclude_scrapes(t: Tables):
    return _runs(t)[0].where(view.scrape_not_in([1, 2, 3, 5, 8])).select("auction_id", "lot_number")


@query("first_seen_histogram", _RUNS + """
select coalesce(strftime((ts at time zone 'UTC') at time zone 'America/New_York', '%a %b %d %H:%M'), '(no first_seen)') as first_seen, count(*) as lots from stamped group by 1""")
def first_seen_histogram(t: Tables):
    return scrapes.first_seen_histogram(t["lots"], _stamp())


_CHUNKS = """
with recursive reps as (select auction_id, min(lot_number) as rep_lot from lots
    group by auction_id, upper(title), upper(condition), upper(coalesce(size, '')), upper(coalesce(model, '')), damaged, functional),
placed as (select r.auction_id, r.rep_lot, l.category, l.title, array_to_string(split(upper(l.title), ' ')[1:2], ' ') as words,
    row_number() over (partition by r.auction_id order by l.category, l.title, r.rep_lot) - 1 as pos, count(*) over (partition by r.auction_id) as n
  from reps r join lots l on l.lot_number = r.rep_lot),
bounds as (select auction_id, pos from placed p qualify lag(category || '#' || words) over (partition by auction_id order by pos) <> category || '#' || words),
sizes as (select distinct auction_id, n from placed),
cuts as (
  select auction_id, n, 0 as cut, 0 as k from sizes
  union all
  select c.auction_id, c.n, coalesce((select arg_min(b.pos, (abs(b.pos - (c.cut + {target})), case when b.pos >= c.cut + {target} then 0 else 1 end)) from bounds b
      where b.auction_id = c.auction_id and b.pos > c.cut and abs(b.pos - (c.cut + {target})) <= {drift}), c.cut + {target}), k + 1
  from cuts c where c.cut + {target} < c.n),
chunked as (select p.*, (select count(*) from cuts c where c.auction_id = p.auction_id and c.k > 0 and c.cut <= p.pos) + 1 as chunk from placed p)
"""


def _chunked(t: Tables, target: int, drift: int):
    return chunks.chunk_products(shapes.products(t), target, drift, SCOPE)


@query("chunk_products", _CHUNKS.format(target=200, drift=20) + "select auction_id, rep_lot, chunk from chunked")
def chunk_products(t: Tables):
    return _chunked(t, 200, 20).select("auction_id", "rep_lot", "chunk")


@query("chunk_forced", _CHUNKS.format(target=37, drift=1) + "select auction_id, rep_lot, chunk from chunked")
def chunk_forced(t: Tables):
    """Hardly any room to move a cut, so many fall inside a run."""
    return _chunked(t, 37, 1).select("auction_id", "rep_lot", "chunk")


@query("chunk_summary", _CHUNKS.format(target=200, drift=20) + """
select auction_id, chunk, count(*) as rows, arg_max(rep_lot, pos) as last_lot from chunked group by 1, 2""")
def chunk_summary(t: Tables):
    return chunks.chunk_summary(_chunked(t, 200, 20), SCOPE)


