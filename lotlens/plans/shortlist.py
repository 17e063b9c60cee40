"""Queries around the lexical shortlist and the recall check."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest, recall
from ..operators import shortlist as short
from ..operators.products import dedupe_products
from . import shapes
from .registry import Tables, query
from .shapes import SCOPE
from .views import BUCKETS, INTERESTS

EDGE = r"[^\p{L}\p{N}_]"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _seed_sql(seed: str) -> str:
    closed = seed != seed.rstrip()
    return seed.strip().lower() + (f"({EDGE}|$)" if closed else "")


def _rule(name: str, entries, gate: bool, source: str) -> str:
    """CTEs giving (lot_number, bucket, reason) of one family of rules, a branch per term."""
    seen, vetoed = [], ["select null as lot_number, null as bucket where false"]
    for e in entries:
        for s in e.seeds:
            at = f"length(regexp_extract(body, {_lit(f'(?s)^(.*?(?:^|{EDGE})){_seed_sql(s)}')}, 1))"
            seen.append(f"select lot_number, condition, {_lit(e.name)} as bucket, {_lit(s.strip().lower())} as reason, 1 as pri, {at} as found_at "
                        f"from {source} where regexp_matches(body, {_lit(f'(^|{EDGE}){_seed_sql(s)}')})")
        for c in e.categories:
            p = c.lower()
            seen.append(f"select lot_number, condition, {_lit(e.name)}, {_lit(p)}, 2, 0 from {source} "
                        f"where lower(category) = {_lit(p)} or starts_with(lower(category), {_lit(p + ' - ')})")
        for x in e.exclude:
            vetoed.append(f"select lot_number, {_lit(e.name)} from {source} where regexp_matches(body, {_lit(f'(^|{EDGE}){_seed_sql(x)}')})")
        if gate and e.condition_in:
            allowed = ", ".join(map(_lit, e.condition_in))
            vetoed.append(f"select lot_number, {_lit(e.name)} from {source} where condition not in ({allowed})")
    return (f"{name}_seen as ({' union all '.join(seen)}),\n{name}_vetoed as ({' union all '.join(vetoed)}),\n"
            f"{name} as (select lot_number, bucket, arg_min(reason, (pri, found_at, -length(reason))) as reason from {name}_seen s "
            f"where not exists (select 1 from {name}_vetoed v where v.lot_number = s.lot_number and v.bucket = s.bucket) group by 1, 2)")


def rules(source: str = "bodies", gate: bool = True, name: str = "cand", pseudo: str = "profile") -> str:
    return _rule(name, BUCKETS, gate, source) + ",\n" + _rule(pseudo, INTERESTS, gate, source)


BODIES = r"""
bodies as (select lot_number, auction_id, title, condition, category, regexp_replace(lower(concat_ws(' ', title, coalesce(model, ''),
    coalesce(size, ''), category)), '[-/]+', ' ', 'g') as body from lots),"""
_SHORT = "with " + BODIES + rules()


@query("shortlist_lots", _SHORT + """,
c as (select lot_number, string_agg(concat(bucket, '=', reason), ';' order by bucket) as cand from cand group by 1),
p as (select lot_number, string_agg(concat(bucket, '=', reason), ';' order by bucket) as profile from profile group by 1)
select l.lot_number, coalesce(cand, '') as cand, coalesce(profile, '') as profile from lots l
left join c on c.lot_number = l.lot_number left join p on p.lot_number = l.lot_number""")
def shortlist_lots(t: Tables):
    text = lambda c: F.array_join(F.array_sort(F.transform(c, lambda h: F.concat_ws("=", h["bucket"], h["reason"]))), ";").alias(c)
    return shapes.shortlisted(t).select("lot_number", text("cand"), text("profile"))


@query("candidate_projection", _SHORT + """
select l.lot_number, l.title, l.model, l.size, l.condition, l.category, c.names as cand, p.names as profile from lots l
left join (select lot_number, string_agg(bucket, ';' order by bucket) as names from cand group by 1) c on c.lot_number = l.lot_number
left join (select lot_number, string_agg(bucket, ';' order by bucket) as names from profile group by 1) p on p.lot_number = l.lot_number
where c.names is not null or p.names is not null""")
def candidate_projection(t: Tables):
    out = ingest.candidate_projection(shapes.shortlisted(t))
    text = lambda c: F.array_join(F.array_sort(c), ";").alias(c)
    return out.select("lot_number", "title", "model", "size", "condition", "category", text("cand"), text("profile"))


_SIZES = _SHORT + """,
sizes as (select bucket, count(*) as lots from cand group by 1)"""


@query("bucket_sizes", _SIZES + " select bucket, lots, round(lots / (select count(*) from lots), 6) as share from sizes")
def bucket_sizes(t: Tables):
    return short.bucket_sizes(shapes.shortlisted(t)).select("bucket", "lots", "share")


@query("top_seeds", _SHORT + """
select bucket, reason as seed, count(*) as lots, row_number() over (partition by bucket order by count(*) desc, reason) as rank
from cand group by bucket, reason qualify rank <= 3""")
def top_seeds(t: Tables):
    return short.top_seeds(shapes.shortlisted(t))


_PRIMARY = _SIZES + """,
primaries as (select l.lot_number, coalesce(min((s.lots, c.bucket))[1], 0) as primary_size, coalesce(min((s.lots, c.bucket))[2], '~profile only') as primary_bucket
  from lots l left join cand c on c.lot_number = l.lot_number left join sizes s on s.bucket = c.bucket
  where c.lot_number is not null or l.lot_number in (select lot_number from profile) group by 1)"""


def _primary(t: Tables):
    rows = shapes.shortlisted(t)
    return short.with_primary(rows, short.bucket_sizes(rows).select("bucket", "lots"))


@query("primary_bucket", _PRIMARY + " select * from primaries")
def primary_bucket(t: Tables):
    return _primary(t).select("lot_number", "primary_size", "primary_bucket")


@query("candidate_order", _PRIMARY + """,
numbered as (select *, row_number() over (order by primary_size, primary_bucket, lot_number) - 1 as pos from primaries)
select primary_bucket, primary_size, min(pos) as start_row, count(*) as rows from numbered group by 1, 2""")
def candidate_order(t: Tables):
    return short.candidate_order(_primary(t))


@query("sweep_sample", _SHORT + """
select lot_number, title from lots where lot_number not in (select lot_number from cand) and lot_number not in (select lot_number from profile)
order by md5(concat('20260815', lot_number)), lot_number limit 500""")
def sweep_sample(t: Tables):
    return short.sweep_sample(shapes.shortlisted(t)).select("lot_number", "title")


# --- backtest and audits ------------------------------------------------------------------------

_SCORED = _SHORT + """,
wanted as (select f.lot_number, unnest(list_filter(split(buckets_csv, ','), lambda x: x <> '')) as named from flags f),
pairs as (select w.lot_number, coalesce(a.bucket, w.named) as bucket, c.bucket is not null as hit
  from wanted w left join dim_aliases a on a.old_name = w.named left join cand c on c.lot_number = w.lot_number and c.bucket = coalesce(a.bucket, w.named))"""


def _scored(t: Tables):
    lots = t["lots"].select("auction_id", "lot_number", "title", "model", "size", "condition", "category")
    return short.scored_labels(shapes.flags(t).select("auction_id", "lot_number", "buckets"), lots, BUCKETS, scope=SCOPE)


@query("backtest_recall", _SCORED + """
select bucket, count(*) filter (hit) as hit, count(*) as total, round(count(*) filter (hit) / count(*), 6) as recall,
  count(*) >= 10 and count(*) filter (hit) / count(*) < 0.9 as weak from pairs group by 1""")
def backtest_recall(t: Tables):
    return short.backtest_buckets(_scored(t), BUCKETS)


@query("backtest_summary", _SCORED + """
select count(*) as labels, 0 as unmatched, (select count(*) from pairs) as pairs, (select count(*) from pairs where hit) as pair_hits,
  count(*) filter (buckets_csv <> '') as flagged_lots, count(*) filter (buckets_csv <> '' and lot_number in (select lot_number from cand)) as reached_lots,
  round((select count(*) from pairs where hit) / (select count(*) from pairs), 6) as pair_recall,
  round(count(*) filter (buckets_csv <> '' and lot_number in (select lot_number from cand)) / count(*) filter (buckets_csv <> ''), 6) as lot_recall,
  0.0::double as unmatched_share from flags""")
def backtest_summary(t: Tables):
    return short.backtest_summary(_scored(t), BUCKETS)


@query("audit_shown_kept", _SCORED + """,
shown as (select bucket, count(*) as shown from cand group by 1),
kept as (select w.named as bucket, count(*) as kept, count(*) filter (c.bucket is null) as outside
  from wanted w left join cand c on c.lot_number = w.lot_number and c.bucket = w.named group by 1)
select bucket, coalesce(shown, 0) as shown, coalesce(kept, 0) as kept, coalesce(outside, 0) as outside,
  round(case when shown > 0 then coalesce(kept, 0) / shown end, 6) as rate,
  case when shown >= 20 and kept is null then 'refused' when shown > 0 and coalesce(kept, 0) / shown > 0.95 then 'shortlist decides' end as note
from shown full join kept using (bucket)""")
def audit_shown_kept(t: Tables):
    return short.audit_shown_kept(shapes.shortlisted(t), shapes.flags(t), SCOPE)


@query("audit_picks_no_bucket", """
select tag, count(*) as picks from (select unnest(list_filter(split(tags_csv, ','), lambda x: x <> '')) as tag from flags where personal_match and buckets_csv = '') p
group by 1 order by picks desc, tag limit 15""")
def audit_picks_no_bucket(t: Tables):
    return short.audit_picks_no_bucket(shapes.flags(t))


_TERMS = """
with words as (select lot_number, buckets_csv <> '' as kept, regexp_extract_all(lower(title), '[a-z0-9]+') as w from {source}),
terms as (select distinct lot_number, kept, unnest(w) as term from words
  union
  select lot_number, kept, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from words),
lifted as (select term, count(*) filter (kept) as kept, count(*) as total from terms where length(term) >= 4 and term not in (select seed from dim_seeds) group by 1)
select term, kept, round(kept / total, 6) as lift from lifted where kept >= 8 and kept / total > 0.75
"""


@query("audit_seed_lift", _TERMS.format(source="doc_lots"))
def audit_seed_lift(t: Tables):
    """Whole documents as titles; the full list of terms, before the report's cut."""
    docs = shapes.doc_lots(t)
    return short.audit_seed_lift(docs.select("lot_number", "title"), docs.select("lot_number", "buckets"), BUCKETS, top=None)


@query("top_terms", _TERMS.format(source="(select l.lot_number, l.title, coalesce(f.buckets_csv, '') as buckets_csv from lots l left join flags f using (lot_number)) q")
       + " order by kept / total desc, kept desc, term desc limit 25")
def top_terms(t: Tables):
    return short.audit_seed_lift(t["lots"], shapes.flags(t), BUCKETS, SCOPE)


# --- recall check ----------------------------------------------------------------------------------

_GROUPED = """
grouped as (select auction_id, upper(title) as kt, upper(condition) as kc, upper(coalesce(size, '')) as ks, upper(coalesce(model, '')) as km,
    coalesce(damaged, '') as kd, coalesce(functional, '') as kf, min(lot_number) as rep_lot, count(*) as qty from shop_lots group by all),
labelled as (select g.rep_lot, g.auction_id, g.qty, l.title, l.category, coalesce(f.buckets_csv, '') as buckets_csv,
    list_filter(split(regexp_replace(upper(l.title), '[^A-Z0-9 ]', ' ', 'g'), ' '), lambda x: length(x) > 1 and not regexp_full_match(x, '[0-9]+')) as w
  from grouped g join shop_lots l on l.lot_number = g.rep_lot left join flags f on f.lot_number = g.rep_lot),
keyed as (select *, case when len(w) >= 3 and len(list_filter(w[1:3], lambda x: regexp_full_match(x, '[A-Z]+'))) >= 2 then array_to_string(w[1:3], ' ') end as f3,
    case when len(w) >= 2 and regexp_full_match(w[1], '[A-Z]+') and (length(w[2]) <= 2 or regexp_matches(w[2], '[0-9]')) then array_to_string(w[1:2], ' ') end as f2
  from labelled),
flagged as (select *, unnest(split(buckets_csv, ',')) as bucket from keyed where buckets_csv <> ''),
dominance as (select auction_id, category, bucket, bucket_lots, lots from (
    select auction_id, category, bucket, cast(sum(qty) as bigint) as bucket_lots from flagged group by 1, 2, 3) b
  join (select auction_id, category, cast(sum(qty) as bigint) as lots from labelled group by 1, 2) c using (auction_id, category)
  qualify row_number() over (partition by auction_id, category order by bucket_lots desc, bucket) = 1),
dominant as (select *, round(bucket_lots / lots, 6) as share from dominance where lots >= 15 and bucket_lots / lots >= 0.6),
totals as (select auction_id, f2, sum(qty) as family_lots from keyed where buckets_csv <> '' group by 1, 2),
families as (
  select auction_id, 3 as words, f3 as family, bucket, cast(sum(qty) as bigint) as bucket_lots, arg_max(title, (qty, title)) as sibling, max(qty) as sibling_lots
  from flagged where f3 is not null group by all
  union all
  select auction_id, 2, f2, bucket, cast(sum(qty) as bigint), arg_max(title, (qty, title)), max(qty) from flagged join totals using (auction_id, f2) group by auction_id, f2, bucket, family_lots
  having sum(qty) / family_lots >= 0.6)"""


def _labelled(t: Tables):
    return recall.labelled_products(dedupe_products(t["shop_lots"], SCOPE), shapes.flags(t), SCOPE)


@query("category_dominance", "with " + _GROUPED + " select auction_id, category, bucket, bucket_lots, lots, share from dominant")
def category_dominance(t: Tables):
    return recall.category_dominance(_labelled(t), SCOPE)


@query("family_evidence", "with " + _GROUPED + " select * from families")
def family_evidence(t: Tables):
    return recall.family_evidence(_labelled(t), SCOPE)


_SUSPECTS = "with " + _GROUPED + """,
quiet as (select * from keyed where buckets_csv = ''),
evidence as (
  select rep_lot, title, qty, category, 1 as kind, bucket, sibling, sibling_lots, null as seed from quiet join families on words = 3 and family = f3 and families.auction_id = quiet.auction_id
  union all
  select rep_lot, title, qty, category, 2, bucket, sibling, sibling_lots, null from quiet join families on words = 2 and family = f2 and families.auction_id = quiet.auction_id
  union all
  select q.rep_lot, q.title, q.qty, q.category, 3, d.bucket, null, null, s.seed from quiet q join dominant d on d.category = q.category and d.auction_id = q.auction_id
    join (select bucket, string_agg(concat(seed, case when closed then ' ' else '' end), '|') as pattern from dim_seeds where seed_len >= 4 group by 1) p on p.bucket = d.bucket,
    lateral (select regexp_extract(q.title, '(?i)(?:^|[^\\p{L}\\p{N}_])(' || p.pattern || ')', 1) as seed) s where s.seed <> ''),
suspects as (select * from evidence e where not exists (
    select 1 from dim_excludes x where x.bucket = e.bucket and contains(lower(e.title), x.seed))
  qualify row_number() over (partition by rep_lot, bucket order by kind) = 1)
"""


@query("recall_suspects", _SUSPECTS + """
select rep_lot, title, qty, string_agg(concat(kind, ':', bucket, ':', coalesce(sibling, ''), ':', coalesce(seed, '')), ';' order by kind, bucket) as suspect
from suspects group by all""")
def recall_suspects(t: Tables):
    entry = lambda s: F.concat_ws(":", s["kind"].cast("string"), s["bucket"], F.coalesce(s["sibling"], F.lit("")), F.coalesce(s["seed"], F.lit("")))
    out = recall.recall_suspects(_labelled(t), BUCKETS, SCOPE)
    return out.select("rep_lot", "title", "qty", F.array_join(F.transform("suspect", entry), ";").alias("suspect"))


@query("recall_summary", _SUSPECTS + "select bucket, count(*) as products, cast(sum(qty) as bigint) as lots from suspects group by 1")
def recall_summary(t: Tables):
    return recall.recall_summary(recall.recall_suspects(_labelled(t), BUCKETS, SCOPE))


