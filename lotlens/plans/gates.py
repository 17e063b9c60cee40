"""Queries that report violations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facets, gates, ingest
from ..operators import shortlist as short
from . import shapes
from .registry import Tables, query
from .shapes import SCOPE
from .shortlist import _SHORT
from .views import BUCKETS, TAGS


def _plain(df):
    return df.select(*[c for c in ("auction_id", "chunk") if c in df.columns], "check", "problem", "n", "fatal")


@query("gate_closed", """
select 'closed' as check, upper(status) as problem, count(*) as n, true as fatal from (
  select case status when 'F' then ' closed ' when 'P' then '' else status end as status from lots) l
where upper(trim(status)) <> 'CLOSED' group by all""")
def gate_closed(t: Tables):
    lots = t["lots"].select(F.when(F.col("status") == "F", " closed ").when(F.col("status") == "P", "").otherwise(F.col("status")).alias("status"))
    return gates.gate_closed(lots)


@query("gate_lot_schema", """
select auction_id, 'lot schema' as check, problem, count(*) as n, true as fatal from (
  select auction_id, 'thumb_url' as problem from published where status = 'F' union all
  select auction_id, 'buckets' from published where buckets_csv = 'Rings' union all
  select auction_id, 'confidence' from published where coalesce(resale_confidence, 'unknown') = 'unknown' union all
  select auction_id, 'resale_outlook' from published where resale_outlook = 'fair') p group by 1, 3""")
def gate_lot_schema(t: Tables):
    return gates.gate_lot_schema(_spoilt(t), SCOPE)


@query("lot_schema_rows", """
select auction_id, lot_number, concat_ws(',', case when status = 'F' then 'thumb_url' end, case when buckets_csv = 'Rings' then 'buckets' end,
  case when coalesce(resale_confidence, 'unknown') = 'unknown' then 'confidence' end, case when resale_outlook = 'fair' then 'resale_outlook' end) as fields
from published where status = 'F' or buckets_csv = 'Rings' or coalesce(resale_confidence, 'unknown') = 'unknown' or resale_outlook = 'fair'""")
def lot_schema_rows(t: Tables):
    return gates.lot_schema_rows(_spoilt(t), SCOPE).withColumn("fields", shapes.joined("fields")).withColumn(
        "fields", F.replace(F.col("fields"), F.lit("|"), F.lit(",")))


def _spoilt(t: Tables):
    """Published lots with a few columns spoilt."""
    lots = shapes.published(t)
    return (lots.withColumn("thumb_url", F.when(F.col("status") != "F", F.col("thumb_url")))
              .withColumn("buckets", F.when(F.array_join("buckets", ",") == "Rings", F.array(F.lit(None).cast("string"))).otherwise(F.col("buckets")))
              .withColumn("confidence", F.coalesce("resale_confidence", F.lit("unknown")))
              .withColumn("resale_outlook", F.when(F.col("resale_outlook") == "fair", "so-so").otherwise(F.col("resale_outlook"))))


@query("gate_slim", """
select auction_id, 'required field' as check, 'category' as problem, count(*) filter (status = 'F') as n, true as fatal from lots group by 1 having n > 0
union all select auction_id, 'condition coverage', 'condition', count(*) filter (condition is null or condition <> 'Good'), true from lots
group by 1 having count(*) filter (condition = 'Good') < 0.5 * count(*)""")
def gate_slim(t: Tables):
    """Categories of closed lots are lost, and only one grade was recognised."""
    slim = ingest.slim_lots(t["landing_text"].withColumn("description", F.lit(None).cast("string"))
                            .withColumn("condition", F.when(F.col("condition") == "Good", "Good"))
                            .withColumn("category", F.when(F.col("status") != "F", F.col("category"))))
    return gates.gate_slim(slim, SCOPE)


@query("gate_prefilter", _SHORT + """,
sizes as (select l.auction_id, bucket, count(*) as lots from cand c join lots l on l.lot_number = c.lot_number group by 1, 2),
totals as (select auction_id, count(*) as total from lots group by 1),
rows as (select auction_id, count(*) as n from lots where lot_number in (select lot_number from cand) or lot_number in (select lot_number from profile) group by 1)
select auction_id, 'bucket share' as check, bucket as problem, lots as n, true as fatal from sizes join totals using (auction_id) where round(lots / total, 6) > 0.08
union all select auction_id, 'rows', 'shortlist', n, true from rows where n > 100
union all select auction_id, 'empty bucket', bucket, 0, false from totals, dim_buckets d
  where not exists (select 1 from sizes s where s.auction_id = totals.auction_id and s.bucket = d.bucket)""")
def gate_prefilter(t: Tables):
    rows = shapes.shortlisted(t)
    return gates.gate_prefilter(short.bucket_sizes(rows, scope=SCOPE), rows, BUCKETS, max_rows=100, scope=SCOPE)


#: More than any lot's number: repeats stand behind all first answers of a chunk, however many lots there are.
_ANSWERS = 1 << 60

# Auctions stand in for chunks; each answers with spoilt rows of a different kind.
_RESPONSES = """
with chunk_rows as (select auction_id as chunk, lot_number, lot_number = max(lot_number) over (partition by auction_id) as is_last from lots),
last_lots as (select chunk, lot_number as last_lot from chunk_rows where is_last),
answers as (
  select auction_id as chunk, id as pos, lot_number, title like '%ring%' as is_flagged, title like '%ring%' and not (auction_id = 1996 and condition = 'Good') as has_bucket,
    auction_id = 1997 and condition = 'Good' as forbidden, auction_id = 1997 and condition = 'Excellent' as lacking from lots where auction_id <> 2001
  union all select auction_id, id + 1000000, lot_number, false, false, false, false from lots where auction_id = 1998 and condition = 'Good'
  union all select auction_id, id + 2000000, concat('Z', lot_number), false, false, false, false from lots where auction_id = 1999 and condition = 'Good'),
markers as (select chunk, 0 as pos, case when chunk = 1996 then 'other' else last_lot end as marker, chunk = 1998 as early from last_lots where chunk not in (1995, 2001))
"""


@query("gate_responses", _RESPONSES + """
select chunk, 'responses' as check, problem, count(*) as n, true as fatal from (
  select 2001 as chunk, 'empty' as problem union all select 1995, 'no end marker' union all select 1996, 'wrong end marker' union all select 1998, 'end marker not last'
  union all select chunk, case when forbidden then 'forbidden key' else 'missing key' end from answers where forbidden or lacking
  union all select chunk, 'foreign lot' from answers where lot_number like 'Z%'
  union all select chunk, 'flag without bucket' from answers where is_flagged <> has_bucket and not forbidden and not lacking
  union all select chunk, 'returned twice' from answers where pos >= 1000000 and pos < 2000000) p group by 1, 3""")
def gate_responses(t: Tables):
    lots = t["lots"]
    rows = lots.select(F.col("auction_id").alias("chunk"), "id", "lot_number", "title", "condition")
    last = rows.groupBy("chunk").agg(F.max("lot_number").alias("last_lot"))
    chunk_rows = rows.join(last, "chunk").select("chunk", "lot_number", (F.col("lot_number") == F.col("last_lot")).alias("is_last"))
    ring = F.col("title").contains("ring")
    full = ["lot_number", "is_flagged", "buckets", "personal_match"]
    keys = lambda *names: F.array(*[F.lit(n) for n in names])
    none = F.array().cast("array<string>")
    later = lambda turn: F.col("id") + F.lit(turn * _ANSWERS)

    def answers(df, pos, lot, flagged, buckets, present):
        return df.select("chunk", pos.alias("pos"), lot.alias("lot_number"), flagged.alias("is_flagged"), buckets.alias("buckets"),
                         F.lit(False).alias("personal_match"), F.lit(None).cast("string").alias("chunk_complete"), present.alias("keys"))

    bare = (F.col("chunk") == 1996) & (F.coalesce("condition", F.lit("")) == "Good")
    present = (F.when((F.col("chunk") == 1997) & (F.col("condition") == "Good"), keys(*full, "reasoning"))
               .when((F.col("chunk") == 1997) & (F.col("condition") == "Excellent"), keys(*full[:3])).otherwise(keys(*full)))
    main = answers(rows.where("chunk <> 2001"), F.col("id"), F.col("lot_number"), ring,
                   F.when(ring & ~bare, keys("Rings")).otherwise(none), present)
    again = answers(rows.where("chunk = 1998 and condition = 'Good'"), later(1), F.col("lot_number"), F.lit(False), none, keys(*full))
    alien = answers(rows.where("chunk = 1999 and condition = 'Good'"), later(2), F.concat(F.lit("Z"), "lot_number"), F.lit(False), none, keys(*full))
    marker = last.where("chunk not in (1995, 2001)").select(
        "chunk", F.when(F.col("chunk") == 1998, -1).otherwise(3 * _ANSWERS).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("lot_number"),
        F.lit(None).cast("boolean").alias("is_flagged"), none.alias("buckets"), F.lit(None).cast("boolean").alias("personal_match"),
        F.when(F.col("chunk") == 1996, "other").otherwise(F.col("last_lot")).alias("chunk_complete"), keys("chunk_complete").alias("keys"))
    responses = main.unionByName(again).unionByName(alien).unionByName(marker)
    return _plain(gates.gate_responses(chunk_rows, responses))


@query("gate_coverage", """
with reps as (select auction_id, min(lot_number) as rep_lot from lots group by auction_id, upper(title), upper(condition), upper(coalesce(size, '')), upper(coalesce(model, '')), damaged, functional)
select auction_id, 'coverage' as check, 'products in no chunk' as problem, count(*) as n, true as fatal from reps join lots on lot_number = rep_lot where lots.priority = '5-LOW' group by lots.auction_id, reps.auction_id
union all select auction_id, 'coverage', 'products in two chunks', count(*), true from reps join lots on lot_number = rep_lot where lots.priority = '2-HIGH' group by lots.auction_id, reps.auction_id
union all select 1995, 'coverage', 'chunk rows of no product', 1, true""".replace("select auction_id, 'coverage'", "select reps.auction_id, 'coverage'"))
def gate_coverage(t: Tables):
    """Chunks that lost some products, hold some twice, and one row of nobody."""
    reps = shapes.products(t).select("auction_id", "rep_lot")
    listed = reps.join(t["lots"].select("auction_id", F.col("lot_number").alias("rep_lot"), "priority"), ["auction_id", "rep_lot"])
    kept = listed.where("priority <> '5-LOW'").select("auction_id", F.lit(1).alias("chunk"), F.col("rep_lot").alias("lot_number"))
    again = listed.where("priority = '2-HIGH'").select("auction_id", F.lit(2).alias("chunk"), F.col("rep_lot").alias("lot_number"))
    alien = t.spark.createDataFrame([(1995, 1, "Z-1")], "auction_id long, chunk int, lot_number string")
    return gates.gate_coverage(kept.unionByName(again).unionByName(alien), reps, SCOPE)


@query("gate_fanout", """
select auction_id, 'fan-out' as check, 'lots not covered once' as problem, count(*) filter (status = 'O') as n, true as fatal from lots group by 1 having n > 0""")
def gate_fanout(t: Tables):
    """Products of an older snapshot against all lots."""
    old = t["lots"].where("status <> 'O'")
    from ..operators.products import dedupe_products

    return gates.gate_fanout(dedupe_products(old.select("auction_id", "lot_number", "title", "condition", "size"), SCOPE), t["lots"], SCOPE)


_KNOWN = "(select bucket from dim_buckets)"


@query("gate_labels", f"""
with m as (select auction_id, count(*) filter (unknown > 0) as u0, cast(sum(unknown) as bigint) as unknown, count(*) filter (is_flagged <> (buckets_csv <> '')) as broken,
    count(*) filter (buckets_csv <> '') as flagged, count(*) filter (buckets_csv <> '' and coalesce(subtype, '') <> '') as with_subtype,
    count(*) filter (personal_match is true) as picks, count(*) filter (personal_match is true and coalesce(personal_reasoning, '') <> '') as explained
  from (select *, len(list_filter(split(buckets_csv, ','), lambda b: b <> '' and b not in ('Rings', 'Widgets', 'Fasteners', 'Plates', 'Machinery', 'Heavy', 'Asian furniture', 'Nothing'))) as unknown from flags) f group by 1)
select auction_id, 'buckets' as check, 'unknown buckets' as problem, unknown as n, true as fatal from m where unknown > 0
union all select auction_id, 'flag', 'flag without bucket', broken, true from m where broken > 0
union all select auction_id, 'subtypes', 'subtype missing', flagged - with_subtype, true from m where flagged > 0 and 100 * with_subtype / flagged < 90
union all select auction_id, 'reasons', 'reason missing', picks - explained, true from m where picks > 0 and 100 * explained / picks < 95""")
def gate_labels(t: Tables):
    return gates.gate_labels(shapes.flags(t), BUCKETS, SCOPE)


@query("vocabulary_strays", f"""
with used as (
  select 'bucket' as kind, unnest(list_filter(split(buckets_csv, ','), lambda x: x <> '')) as value from flags
  union all select 'subtype', nullif(lower(trim(regexp_replace(subtype, '\\s+', ' ', 'g'))), '') from flags where buckets_csv <> ''
  union all select 'tag', lower(unnest(list_filter(split(tags_csv, ','), lambda x: x <> ''))) from flags where personal_match is true)
select kind, value, count(*) as n from used where value is not null and not (
  (kind = 'bucket' and value in {_KNOWN}) or (kind = 'subtype' and value in (select subtype from dim_subtypes)) or (kind = 'tag' and value in (select tag from dim_tags)))
group by 1, 2""")
def vocabulary_strays(t: Tables):
    return gates.vocabulary_strays(shapes.flags(t), BUCKETS, TAGS)


@query("lot_set_sha", """
select auction_id, count(*) as lots, substr(sha256(concat_ws(':', cast(count(*) as varchar),
  cast(cast(sum(cast('0x' || substr(h, 1, 15) as bigint)) as hugeint) as varchar), cast(cast(sum(cast('0x' || substr(h, 16, 15) as bigint)) as hugeint) as varchar))), 1, 16) as lot_set_sha
from (select auction_id, sha256(lot_number) as h from lots) l group by 1""")
def lot_set_sha(t: Tables):
    return gates.lot_set_sha(t["lots"], SCOPE)


@query("lot_set_compare", """
with a as (select auction_id, lot_number, count(*) as n from label_layers where layer_no in (0, 2) group by 1, 2),
b as (select distinct auction_id, lot_number from lots where damaged is not null or status = 'F')
select coalesce(a.auction_id, b.auction_id) as auction_id, cast(coalesce(sum(n), 0) as bigint) as rows, count(n) as distinct_lots,
  cast(coalesce(sum(n - 1), 0) as bigint) as duplicates, count(*) filter (b.lot_number is null) as unknown, count(*) filter (n is null) as absent
from a full join b on a.auction_id = b.auction_id and a.lot_number = b.lot_number group by 1""")
def lot_set_compare(t: Tables):
    rows = shapes.layers(t).where("layer_no in (0, 2)")
    return gates.lot_set_compare(rows, t["lots"].where("damaged is not null or status = 'F'"), SCOPE)


@query("gate_lot_sets", """
select auction_id, 'required field' as check, 'personal_match' as problem, 1 as n, true as fatal from (select auction_id from flags union select auction_id from lots where damaged is not null) a
union all select f.auction_id, 'unknown', 'lots not in this set', count(*), true from flags f join lots l on l.lot_number = f.lot_number and l.auction_id = f.auction_id where l.damaged is null group by 1
union all select auction_id, 'absent', 'lots without a row', count(*), true from lots l where damaged is not null
  and not exists (select 1 from flags f where f.lot_number = l.lot_number and f.auction_id = l.auction_id) group by 1
union all select auction_id, 'fingerprint', 'another lot set', count(*), true from flags group by 1""")
def gate_lot_sets(t: Tables):
    rows = shapes.flags(t).drop("personal_match")
    return gates.gate_lot_sets(rows, t["lots"].where("damaged is not null"), ["lot_number", "buckets", "personal_match"], complete=True, scope=SCOPE)


@query("gate_stale_pairing", """
select auction_id, 'pairing' as check, 'labels of another lot set' as problem, count(*) filter (damaged is null) as n, true as fatal
from flags f join lots l using (auction_id, lot_number) group by 1 having round(count(*) filter (damaged is null) / count(*), 6) > 0.01""")
def gate_stale_pairing(t: Tables):
    lots = t["lots"].where("damaged is not null").select("auction_id", "lot_number", "title", "model", "size", "condition", "category")
    scored = short.scored_labels(shapes.flags(t).select("auction_id", "lot_number", "buckets"), lots, BUCKETS, scope=SCOPE)
    return gates.gate_stale_pairing(short.backtest_summary(scored, BUCKETS, SCOPE), scope=SCOPE)


@query("gate_bundle", """
select auction_id, 'title' as check, 'lots without a title' as problem, count(*) filter (condition = 'Good') as n, true as fatal from published group by 1 having n > 0
union all select auction_id, 'image', 'image coverage below 95%', count(*) filter (status = 'F') as n, false from published group by 1 having n > 0.05 * count(*)""")
def gate_bundle(t: Tables):
    lots = shapes.published(t)
    spoilt = (lots.withColumn("image_url", F.col("thumb_url"))
              .withColumn("title", F.when(F.coalesce("condition", F.lit("")) == "Good", "").otherwise(F.col("title"))))
    return gates.gate_bundle(facets.fidelity_report(spoilt, SCOPE), SCOPE)
