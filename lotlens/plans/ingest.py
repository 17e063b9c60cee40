"""Queries over landing data: sources, sinks, snapshots and their projections."""

from __future__ import annotations

import json
import math
from dataclasses import asdict

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import facets, ingest
from ..operators import gates as checks
from ..operators.common import written_once
from ..session import shared_dir, shuffles_dropped
from ..sources import landing as src
from ..sources import sinks
from ..sources.bigjson import read_large
from ..streaming import ingest as stream
from . import shapes
from .registry import Tables, query
from .views import BUCKETS, INTERESTS

_FLAT = """
select id, lot_number, title,
  case when priority = '1-URGENT' and condition = 'Mystery Grade' then null else condition end as condition,
  case when priority <> '1-URGENT' then concat('Sold by ', seller)
       when condition = 'Mystery Grade' then 'MYSTERY GRADE' else '' end as description,
  strftime(opened, '%Y-%m-%dT13:30:05') || case when date_diff('hour', opened, opened_utc) = 4 then '-04:00' else '-05:00' end as close_at,
  strftime(opened_utc, '%Y-%m-%d %H:%M:%S') as closes_utc,
  current_bid, category, split_part(category, ' - ', 3) as category_leaf,
  replace(category, ' - ', '|') as category_path,
  case when status = 'F' then '' else concat('https://img.example/small/', id) end as thumb_url,
  case when status = 'F' then concat('https://img.example/full/', id, '|https://img.example/back/', id)
       else concat('https://img.example/back/', id) end as additional_images,
  concat('https://lots.example/lot/', id, '/') as lot_url
from (select *, close_local as opened,
        (close_local at time zone 'America/New_York') at time zone 'UTC' as opened_utc
      from (select *, case when closing_text is not null then cast(close_ts as timestamp) + interval '13 hours 30 minutes 5 seconds' end as close_local
            from landing_text) l) m
"""


def _flat(df, *more):
    return ingest.normalise_lots(df).select(
        "id", "lot_number", "title", "condition", "description", "close_at",
        F.date_format("close_ts", "yyyy-MM-dd HH:mm:ss").alias("closes_utc"), "current_bid", "category",
        "category_leaf", shapes.joined("category_path"), "thumb_url", shapes.joined("additional_images"), "lot_url", *more)


@query("normalise_lots", _FLAT)
def normalise_lots(t: Tables):
    return _flat(shapes.landing(t))


def _land(t: Tables) -> str:
    """Landing pages of 500 lots as JSON lines in compressed files, with a broken line for each hundred or so."""
    path = shared_dir(t.spark, "landing")
    item = F.struct("id", "lotNumber", "lead", "description", "featuredPicture", "pictures", "lotState", "category")
    pages = (shapes.landing(t).groupBy("auction_id", F.floor(F.col("id") / 500).alias("page"))
             .agg(F.collect_list(item).alias("items")))
    good = F.to_json(F.struct("auction_id", "items"))
    bad = F.when(F.col("page") % 4 == 0, '{"auction_id": 1, "items": [{"id": ')
    lines = pages.select(F.explode(F.array(good, bad)).alias("value")).where("value is not null")
    lines.write.option("compression", "gzip").text(path)
    return path


@query("src_landing_json", _FLAT)
def src_landing_json(t: Tables):
    items = src.usable(src.read_landing(t.spark, _land(t), multi_line=False), "id")
    return _flat(items)


def _documents(t: Tables) -> str:
    """Landing items as JSON documents of several lines, up to 5,000 lots each, the envelope's number at their end."""
    path = shared_dir(t.spark, "documents")
    item = F.to_json(F.struct("id", "lotNumber", "lead", "description", "featuredPicture", "pictures", "lotState", "category"))
    items = shapes.landing(t).withColumn("a", F.col("auction_id")).withColumn("p", F.floor(F.col("id") / 5000))
    page = Window.partitionBy("a", "p").orderBy("id")
    head, tail = F.lit('{"note": "}{", "items": ['), F.concat(F.lit('], "auction_id": '), F.col("a"), F.lit("}"))
    lines = items.withColumn("value", F.concat(F.when(F.row_number().over(page) == 1, head).otherwise(","), item,
                                               F.when(F.lead("id").over(page).isNull(), tail).otherwise("")))
    lines.select("a", "p", "value").write.partitionBy("a", "p").text(path)
    return path


@query("src_landing_large", "select f.*, auction_id from (" + _FLAT.strip() + ") f join (select id, auction_id from landing_text) a using (id)")
def src_landing_large(t: Tables):
    """Documents that many tasks read, whatever their size."""
    read = read_large(t.spark, _documents(t), src.landing_item(), src.envelope_fields())
    return _flat(src.usable(read, "id").drop("auction_name", "scraped_at"), "auction_id")


@query("src_landing_rejects", """
select count(*) as broken from (select distinct auction_id, id // 500 as page from lots) p where page % 4 = 0""")
def src_landing_rejects(t: Tables):
    return src.rejects(src.read_landing(t.spark, _land(t), multi_line=False)).agg(F.count("*").alias("broken"))


_PER_AUCTION = """
select auction_id, close_date, upper(trim(title)) as key_title, upper(trim(coalesce(condition, ''))) as key_condition,
  count(price) as sold, count(*) - count(price) as unsold, round(median(price), 6) as median, min(price) as low, max(price) as high
from (select *, case when bid_second > bid_head and bid_head - (bid_second - bid_head) > 0 then bid_head - (bid_second - bid_head) end as price from sales) s
group by all
"""


@query("src_sale_history", _PER_AUCTION)
def src_sale_history(t: Tables):
    path = shared_dir(t.spark, "history")
    product = F.struct("title", "condition", "sold", "unsold", "median", "low", "high")
    # Pages of some five hundred products, however many an auction sold.
    history = shapes.history(t)
    sizes = history.groupBy("auction_id").agg(F.ceil(F.count("*") / 500).alias("pages"))
    pages = (history.join(sizes, "auction_id").withColumn("page", F.pmod(F.xxhash64("title", "condition"), F.col("pages")))
             .groupBy("auction_id", "close_date", "page").agg(F.collect_list(product).alias("products")))
    good = pages.select(F.to_json(F.struct("auction_id", "close_date", "products")).alias("value"))
    bad = (pages.select("auction_id").distinct().select(F.explode(F.array(
        F.lit("cut off mid-"), F.to_json(F.struct("auction_id")))).alias("value")))
    good.unionByName(bad).write.text(path)
    read = src.read_sale_history(t.spark, path + "/", multi_line=False)
    num = lambda c: values.to_price(F.col(c)).alias(c)
    return read.select(
        "auction_id", "close_date", text.key_text(F.col("title")).alias("key_title"),
        text.key_text(F.col("condition")).alias("key_condition"),
        values.to_count(F.col("sold")).alias("sold"), values.to_count(F.col("unsold")).alias("unsold"),
        F.round(values.to_price(F.col("median")), 6).alias("median"), num("low"), num("high"))


@query("src_bid_history", "select date, lot, title, signal, nullif(outcome, '') as outcome from bid_history")
def src_bid_history(t: Tables):
    path = shared_dir(t.spark, "bids")
    t["bid_history"].select("date", "lot", "title", "signal", "outcome").write.csv(path, sep="\t", header=True, emptyValue="")
    return src.read_bid_history(t.spark, path)


@query("src_config_dims", """
select d.bucket, d.bucket_group, d.group_pos, count(distinct seed) as seeds, count(distinct f.lot_number) as labelled
from dim_buckets d left join dim_seeds s on s.bucket = d.bucket
left join flags f on list_contains(split(f.buckets_csv, ','), d.bucket)
group by all""")
def src_config_dims(t: Tables):
    """Rules written to a file and read back as a user would keep them."""
    from ..sources.config import bucket_table, load, seed_table

    path = shared_dir(t.spark, "rules")
    text = json.dumps({"buckets": [asdict(b) for b in BUCKETS], "interests": [asdict(i) for i in INTERESTS]})
    t.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    buckets, _, _ = load(t.spark, path)
    seeds = seed_table(t.spark, buckets).groupBy("bucket").agg(F.countDistinct("seed").alias("seeds"))
    used = (shapes.flags(t).select("lot_number", F.explode("buckets").alias("bucket"))
            .groupBy("bucket").agg(F.countDistinct("lot_number").alias("labelled")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (bucket_table(t.spark, buckets).join(seeds, "bucket", "left").join(used, "bucket", "left")
            .select("bucket", "bucket_group", "group_pos", zero("seeds"), zero("labelled")))


@query("sink_tables", """
select auction_id, count(*) as lots, count(distinct title) as titles, round(sum(current_bid), 2) as bids
from lots group by auction_id""")
def sink_tables(t: Tables):
    path = shared_dir(t.spark, "published")
    lots = shapes.lots(t).select("auction_id", "id", "lot_number", "title", "condition", "category", "current_bid")
    sinks.write_tables(
        {"lots": lots, "conditions": facets.available_conditions(lots)}, path,
        gates={"slim": lambda written: checks.gate_slim(written["lots"], shapes.SCOPE)}, partition_by={"lots": ["auction_id"]})
    back = sinks.read_table(t.spark, path, "lots")
    return back.groupBy(F.col("auction_id").cast("bigint").alias("auction_id")).agg(
        F.count("*").alias("lots"), F.countDistinct("title").alias("titles"), F.round(F.sum("current_bid"), 2).alias("bids"))


@query("combine_auctions", "select id, lot_number, title from lots")
def combine_auctions(t: Tables):
    plain = t["lots"].withColumn("lot_number", F.col("id").cast("string")).select("id", "lot_number", "title", "status")
    return ingest.combine_auctions(plain.where("status <> 'P'"), plain.where("status = 'P'")).drop("status")


@query("first_seen_carry", """
select l.auction_id, l.lot_number,
  coalesce(case when p.id is null then null when p.priority = '4-NOT SPECIFIED' then concat(p.date, '-01-01T00:00:00+00:00') else p.first_seen end,
           concat(l.date, '-12-31T00:00:00+00:00')) as first_seen,
  p.id is null as is_new
from lots l left join lots p on p.id = l.id and p.auction_id = l.auction_id and p.priority <> '3-MEDIUM'""")
def first_seen_carry(t: Tables):
    prior = t["lots"].where("priority <> '3-MEDIUM'").select(
        "auction_id", "id", "_ord", F.when(F.col("priority") != "4-NOT SPECIFIED", F.col("first_seen")).alias("first_seen"),
        F.concat("date", F.lit("-01-01T00:00:00+00:00")).alias("scraped_at"))
    current = t["lots"].select("auction_id", "id", "lot_number", "date")
    out = ingest.first_seen_carry(current, prior, F.concat("date", F.lit("-12-31T00:00:00+00:00")), shapes.SCOPE)
    return out.select("auction_id", "lot_number", "first_seen", "is_new")


@query("first_seen_new", """
select auction_id, count(*) filter (priority = '3-MEDIUM') as new_lots, count(*) as lots from lots group by auction_id""")
def first_seen_new(t: Tables):
    return first_seen_carry(t).groupBy("auction_id").agg(F.count_if("is_new").alias("new_lots"), F.count("*").alias("lots"))


_SLIM = """
select lot_number, title, condition, category,
  case when priority <> '1-URGENT' then model end as model,
  case when priority <> '1-URGENT' then size end as size,
  case when priority <> '1-URGENT' then damaged end as damaged,
  case when priority <> '1-URGENT' then functional end as functional, seller as description
from landing_text"""


@query("slim_lots", _SLIM)
def slim_lots(t: Tables):
    out = ingest.slim_lots(t["landing_text"].withColumn("description", F.concat(F.col("seller"), F.lit(" "))))
    return out.select("lot_number", "title", "condition", "category", "model", "size", "damaged", "functional", "description")


@query("base_rows", "select auction_id, lot_number, false as is_flagged, '' as buckets, false as personal_match from lots")
def base_rows(t: Tables):
    return ingest.base_rows(t["lots"], shapes.SCOPE).withColumn("buckets", shapes.joined("buckets"))


@query("field_coverage", """
unpivot (select count(nullif(lot_number, '')) as lot_number, count(nullif(title, '')) as title, count(nullif(condition, '')) as condition,
  count(nullif(category, '')) as category, count(case when priority <> '1-URGENT' then model end) as model,
  count(case when priority <> '1-URGENT' then damaged end) as damaged from landing_text)
on lot_number, title, condition, category, model, damaged into name field value filled""")
def field_coverage(t: Tables):
    slim = ingest.slim_lots(t["landing_text"].withColumn("description", F.lit("")))
    return facets.field_coverage(slim, ["lot_number", "title", "condition", "category", "model", "damaged"]).select("field", "filled")


_STREAM = """
select auction_id, lot_number, case when priority = '3-MEDIUM' then concat(date, '-02-02T00:00:00+00:00') else concat(date, '-01-01T00:00:00+00:00') end as first_seen,
  priority = '3-MEDIUM' as is_new, coalesce(nullif(arg_max(b, (layer_no, o)), ''), '') as buckets
from (select lots.*, coalesce(y.layer_no, 0) as layer_no, coalesce(y._ord, 0) as o, coalesce(y.buckets_csv, '') as b
      from lots left join label_layers y on y.lot_number = lots.lot_number and y.auction_id = lots.auction_id and y.layer_no > 0
      where priority <> '5-LOW') s
group by all"""


#: What landing pages and label layers take from the lots.
_OF_LOTS = ("auction_id", "id", "lot_number", "title", "condition", "size", "model", "damaged", "functional", "category", "status",
            "priority", "current_bid", "close_ts", "seller", "date")
#: Pages of one file of arrivals, which one task reads.
_PAGES = 1000


def _arriving(t: Tables, layers: str):
    """Landing rows with the page they are on and, by their id, the ``set_priority`` and ``set_date`` that say which set has them.

    The lots, a join of five tables, are written once and label layers made of them; rows are dealt by page before
    they get their texts.
    """
    same = F.collect_list(F.struct(F.col("priority").alias("set_priority"), F.col("date").alias("set_date"))).over(Window.partitionBy("id"))
    t.put("lots", written_once(t["lots"].select(*_OF_LOTS, same.alias("_same")), "lots"))
    shapes.layers(t).where("layer_no > 0").write.parquet(layers)
    parts = max(2, int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    paged = t["lots"].select(*_OF_LOTS, F.explode("_same").alias("_set")).select(*_OF_LOTS, "_set.*", F.floor(F.col("id") / 500).alias("page"))
    t.put("lots", paged.repartition(parts, "auction_id", "page"))
    return shapes.landing(t, "page", "set_priority", "set_date")


def _streamed(t: Tables, late: bool):
    """Two snapshots of every auction arrive, each in files that grow in number with it and two triggers; with ``late`` the older one comes second."""
    arrivals, state = shared_dir(t.spark, "arrivals"), shared_dir(t.spark, "state")
    item = F.struct("id", "lotNumber", "lead", "description", "featuredPicture", "pictures", "lotState", "category")
    # Label layers are a table of their own; every trigger reads them.
    kept = shared_dir(t.spark, "layers")
    with shuffles_dropped(t.spark):
        rows = _arriving(t, kept)
    sets = ((rows.where("set_priority <> '3-MEDIUM'"), "-01-01T00:00:00+00:00"), (rows.where("set_priority <> '5-LOW'"), "-02-02T00:00:00+00:00"))

    def layers(session):
        return session.read.parquet(kept)

    before = 0
    for present, stamp in reversed(sets) if late else sets:
        pages = (present.groupBy("auction_id", F.concat("set_date", F.lit(stamp)).alias("scraped_at"), "page")
                 .agg(F.collect_list(item).alias("items")).drop("page"))
        with shuffles_dropped(t.spark):
            pages.write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", _PAGES).json(arrivals)
        files = len(t.spark.read.text(arrivals).inputFiles())
        half, before = max(1, math.ceil((files - before) / 2)), files
        stream.start(t.spark, arrivals, state, layers, files_per_batch=half).awaitTermination()
    second = F.col("scraped_at").contains("-02-02T")
    shot = t.spark.read.parquet(f"{state}/snapshots").where(second)
    labels = t.spark.read.parquet(f"{state}/labels").where(second)
    return (shot.select("auction_id", "lot_number", "first_seen", "is_new")
            .join(labels.select("auction_id", "lot_number", "buckets"), ["auction_id", "lot_number"])
            .select(F.col("auction_id").cast("bigint").alias("auction_id"), "lot_number", "first_seen", "is_new", shapes.joined("buckets")))


@query("ingest_stream", _STREAM)
def ingest_stream(t: Tables):
    return _streamed(t, late=False)


@query("ingest_stream_late", _STREAM)
def ingest_stream_late(t: Tables):
    return _streamed(t, late=True)
