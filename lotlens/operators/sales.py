"""Past sale prices per product, and their join onto current lots.

A product is (title, condition), upper-cased and stripped; lot numbers and ids
are reused every period and identify nothing across periods.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, values, vocab
from .common import written_once
from .skew import attach

#: Rows of a product's price list that one aggregation buffer may hold.
LONG_LIST = 1 << 16

KEY = ("key_title", "key_condition")


def with_product_key(df: DataFrame) -> DataFrame:
    return (df.withColumn("key_title", text.key_text(F.col("title")))
            .withColumn("key_condition", text.key_text(F.col("condition"))))


def key_string(title: str = "key_title", condition: str = "key_condition") -> Column:
    return F.concat_ws("|", F.col(title), F.col(condition))


def price_histogram(closed: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(product, price, spelling, copies): the whole price list, run-length encoded.

    ``price`` is NULL for unsold lots. Grouping on the price as well spreads a
    product that makes up much of the input over many tasks, and what is left of
    it afterwards is one row per distinct price. ``closed`` carries the reading
    order in a numeric ``_ord``.
    """
    priced = (with_product_key(closed).withColumn("title", text.strip(F.col("title")))
              .withColumn("price", values.final_price(F.col("bids"))))
    return (priced.groupBy(*scope, *KEY, "price", "title", "condition")
            .agg(F.count("*").alias("copies"), F.min("_ord").alias("_ord")))


def _middle(prices: DataFrame, totals: DataFrame, key: Sequence[str], bands: int) -> DataFrame:
    """Exact median of few products with very long price lists, by selection: (key, median).

    Each middle rank starts with the whole range of its product's prices. The range is cut into ``bands`` equal ones,
    copies are counted by band (combined before the shuffle), and the band that holds the rank is the next range, cut
    to the prices in it. A range of two prices or more always splits; it is done when it is one price.
    """
    ranks = F.explode(F.array_distinct(F.array(F.floor((F.col("sold") + 1) / 2), F.floor((F.col("sold") + 2) / 2))))
    sought = totals.select(*key, ranks.alias("rank"), F.col("low").alias("lo"), F.col("high").alias("hi")).withColumn("need", F.col("rank"))
    sought = written_once(sought, "sought")
    while not sought.where("lo < hi").isEmpty():
        live = F.broadcast(sought.where("lo < hi"))  # two rows at most for each product that is this long
        inside = prices.join(live, list(key)).where((F.col("price") >= F.col("lo")) & (F.col("price") <= F.col("hi")))
        band = F.least(F.floor((F.col("price") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bands), F.lit(bands - 1))
        counted = (inside.groupBy(*key, "rank", "need", band.alias("band"))
                   .agg(F.sum("copies").alias("n"), F.min("price").alias("lo"), F.max("price").alias("hi")))
        # At most ``bands`` entries for a rank.
        listed = counted.groupBy(*key, "rank", "need").agg(F.array_sort(F.collect_list(F.struct("band", "n", "lo", "hi"))).alias("_b"))
        kind = "struct<need:bigint,lo:double,hi:double,found:boolean>"
        start = F.struct(F.col("need").alias("need"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), F.lit(False).alias("found")).cast(kind)
        step = lambda acc, e: F.when(acc["found"], acc).when(
            acc["need"] > e["n"], F.struct((acc["need"] - e["n"]).alias("need"), acc["lo"].alias("lo"), acc["hi"].alias("hi"), F.lit(False).alias("found"))
        ).otherwise(F.struct(acc["need"].alias("need"), e["lo"].alias("lo"), e["hi"].alias("hi"), F.lit(True).alias("found"))).cast(kind)
        narrowed = listed.select(*key, "rank", F.aggregate("_b", start, step).alias("_r"))
        narrowed = narrowed.select(*key, "rank", F.col("_r.lo").alias("lo"), F.col("_r.hi").alias("hi"), F.col("_r.need").alias("need"))
        sought = written_once(narrowed.unionByName(sought.where("lo >= hi")), "sought")
    return sought.groupBy(*key).agg(F.avg("lo").alias("median"))


def sale_aggregate(closed: DataFrame, scope: Sequence[str] = (), long_list: int = LONG_LIST, bands: int = 1024) -> DataFrame:
    """Per product: sold, unsold, exact median, low and high. Products that sold
    nothing stay, with NULL figures; the first spelling seen is shown.

    Everything is combined before the shuffle. A price list of up to ``long_list``
    rows gives its median in the aggregation; a longer one is searched for it.
    """
    key = [*scope, *KEY]
    prices = written_once(price_histogram(closed, scope), "prices")
    long = prices.where("price is not null").groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > long_list).drop("_n")
    long = written_once(long, "long")
    some = not long.isEmpty()
    # At most one of these for each ``long_list`` rows.
    marked = prices.join(F.broadcast(long.withColumn("_long", F.lit(True))), key, "left") if some else prices.withColumn("_long", F.lit(None).cast("boolean"))
    short = F.when(F.col("_long").isNull(), F.col("price"))
    sold = F.when(F.col("price").isNotNull(), F.col("copies")).otherwise(0)
    out = marked.groupBy(*key).agg(
        F.min(F.struct("_ord", "title", "condition")).alias("_first"), F.sum(sold).alias("sold"),
        F.sum(F.col("copies") - sold).alias("unsold"), F.percentile(short, F.lit(0.5), F.col("copies")).alias("median"),
        F.min("price").alias("low"), F.max("price").alias("high"))
    if some:
        out = written_once(out, "totals")
        hot = F.broadcast(long)
        found = _middle(prices.where("price is not null").join(hot, key).select(*key, "price", "copies"), out.join(hot, key), key, bands)
        out = (out.join(F.broadcast(found.withColumnRenamed("median", "_median")), key, "left")
               .withColumn("median", F.coalesce("median", "_median")).drop("_median"))
    return out.select(*key, F.col("_first.title").alias("title"), F.col("_first.condition").alias("condition"),
                      "sold", "unsold", "median", "low", "high")


def sale_prices(closed: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Sold prices of each product with their number of copies."""
    return (price_histogram(closed, scope).where("price is not null")
            .groupBy(*scope, *KEY, "price").agg(F.sum("copies").alias("copies")))


def sale_close_date(closed: DataFrame, today: Column, scope: Sequence[str] = ("auction_id",)) -> DataFrame:
    """Date of each auction: the auction's own, else the latest close of a lot, else today."""
    return closed.groupBy(*scope).agg(
        F.coalesce(F.max("auction_close"), F.to_date(values.eastern(F.max("close_ts"))), F.to_date(F.first(today)))
        .alias("close_date"))


def sale_summary(products: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    return products.groupBy(*scope).agg(
        F.count("*").alias("products"), F.sum("sold").alias("sold"), F.sum("unsold").alias("unsold"))


def top_sellers(products: DataFrame, k: int = 5) -> DataFrame:
    return products.where("sold > 0").orderBy(F.desc("sold"), "title", "condition").limit(k)


def newest_periods(history: DataFrame) -> DataFrame:
    """History entries of each product, newest first, at most eight of them.

    Input rows are already one per (period, product), and the ranking is cut
    before the shuffle, so a product costs each task eight rows at most.
    """
    order = W.partitionBy(*KEY).orderBy(F.desc("close_date"), "_file", "_ord")
    return (with_product_key(history)
            .where((F.col("key_title") != "") | (F.col("key_condition") != ""))
            .select(*KEY, F.row_number().over(order).alias("period"), "close_date",
                    values.to_count(F.col("sold")).alias("sold"),
                    values.to_count(F.col("unsold")).alias("unsold"),
                    values.to_price(F.col("median")).alias("median"),
                    values.to_price(F.col("low")).alias("low"),
                    values.to_price(F.col("high")).alias("high"))
            .where(F.col("period") <= vocab.MAX_WEEKS))


def sale_index(history: DataFrame) -> DataFrame:
    """One row per product with its periods as an array of at most eight."""
    entry = F.struct("period", "close_date", "sold", "unsold", "median", "low", "high")
    return (newest_periods(history).groupBy(*KEY)
            .agg(F.array_sort(F.collect_list(entry)).alias("weeks")))


def _ladder_order(own: Column, candidate: Column) -> Column:
    """A struct that sorts grades as substitutes for ``own``.

    Grades off the ladder come after those on it, by name. Among the others the
    steps between the two grades count (from the top of the ladder, if ``own`` is
    off it), and of two as far away the worse grade goes first.
    """
    rungs = F.create_map(*[F.lit(x) for i, g in enumerate(vocab.PRICE_LADDER, 1) for x in (g, i)])
    mine, theirs = F.try_element_at(rungs, own), F.try_element_at(rungs, candidate)
    return F.struct(
        theirs.isNull().alias("off_ladder"),
        F.coalesce(F.abs(theirs - F.coalesce(mine, F.lit(0))), F.lit(0)).alias("steps"),
        F.coalesce(theirs < mine, F.lit(False)).alias("is_better"),
        candidate.alias("condition"))


def _grades(index: DataFrame) -> DataFrame:
    """Per title: its grades on the ladder (nine at most), the first name of the others, and how many grades have a name."""
    grade = F.col("key_condition")
    on = grade.isin(list(vocab.PRICE_LADDER))
    return index.where(grade != "").groupBy("key_title").agg(
        F.collect_set(F.when(on, grade)).alias("_rungs"), F.min(F.when(~on, grade)).alias("_other"), F.count("*").alias("_n"))


def _resolved(lots: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lots with their product key, and each distinct key with its copies, ``_own`` (has history), ``_nearest`` (the grade
    to show where it has none) and ``_alternates`` (how many other grades its title has)."""
    keyed = with_product_key(lots)
    keys = written_once(keyed.groupBy(*KEY).agg(F.count("*").alias("n")), "keys")
    own = index.select(*KEY, F.lit(True).alias("_own"))
    met = attach(keys, _grades(index), ["key_title"]).join(own, list(KEY), "left")
    # A key without history is none of its title's grades, so the first of all the others is its nearest.
    rung = F.array_min(F.transform("_rungs", lambda g: _ladder_order(F.col("key_condition"), g)))["condition"]
    mine = F.coalesce("_own", F.lit(False))
    named = (mine & (F.col("key_condition") != "")).cast("long")
    return keyed, written_once(met.select(
        *KEY, "n", mine.alias("_own"), F.when(~mine, F.coalesce(rung, "_other")).alias("_nearest"),
        (F.coalesce("_n", F.lit(0)) - named).alias("_alternates")), "resolved")


def sale_alternates(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(key, place, alternate) for every other grade of each key's title, nearest first."""
    own = F.col("key_condition")
    offers = index.where("key_condition <> ''").select("key_title", F.col("key_condition").alias("alternate"))
    met = keys.select(*KEY).join(offers, "key_title").where(F.col("alternate") != own)
    nearest = W.partitionBy(*KEY).orderBy(_ladder_order(own, F.col("alternate")))
    return met.select(*KEY, F.row_number().over(nearest).alias("place"), "alternate")


def join_sale_history(lots: DataFrame, index: DataFrame) -> DataFrame:
    """Stamp ``sale_key`` (own history) and ``alt_keys`` (same title, other grades,
    nearest first). The lists are made once for each distinct key of the lots."""
    keyed, keys = _resolved(lots, index)
    lists = (sale_alternates(keys.where("_alternates > 0"), index)
             .groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "alternate"))),
                                            lambda r: r["alternate"]).alias("_all")))
    stamps = written_once(keys.join(lists, list(KEY), "left").select(
        *KEY, F.when(F.col("_own"), key_string()).alias("sale_key"),
        F.transform("_all", lambda c: F.concat_ws("|", F.col("key_title"), c)).alias("alt_keys")), "stamps")
    return attach(keyed, stamps, KEY, counts=keys.select(*KEY, "n"), look=True).select(*lots.columns, *KEY, "sale_key", "alt_keys")


def sale_history_for_lot(lots: DataFrame, index: DataFrame) -> DataFrame:
    """Each lot with the periods of its own history, else of the nearest other
    grade, labelled with that grade. The two are never blended.

    The grade is chosen for distinct keys, from at most nine grades on the ladder and one name, and one history joined.
    """
    keyed, keys = _resolved(lots, index)
    grade = F.when(F.col("_own"), F.col("key_condition")).otherwise(F.col("_nearest"))
    shown = index.select("key_title", F.col("key_condition").alias("_grade"), "weeks")
    found = attach(keys.withColumn("_grade", grade), shown, ["key_title", "_grade"]).select(
        *KEY, F.when(F.col("_own"), key_string()).alias("sale_key"), F.col("_nearest").alias("source_grade"), "weeks")
    return (attach(keyed, found, KEY, counts=keys.select(*KEY, "n"))
            .select(*lots.columns, *KEY, "sale_key", "source_grade", "weeks"))


def sale_index_used(lots: DataFrame, index: DataFrame) -> DataFrame:
    """History entries some lot refers to, by its own key or as an alternate.

    A named grade is one or the other for every lot of its title; a blank one is never offered, so it takes a lot of its own.
    """
    keys = with_product_key(lots).select(*KEY).distinct()
    named = index.where("key_condition <> ''").join(keys.select("key_title").distinct(), "key_title", "left_semi")
    return named.unionByName(index.where("key_condition = ''").join(keys, list(KEY), "left_semi").select(*named.columns))


def sale_coverage(lots: DataFrame, index: DataFrame) -> DataFrame:
    """Lots with history of their own, and with other grades' only."""
    _, keys = _resolved(lots, index)
    copies = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lots"), copies(F.col("_own")).alias("own"),
                     copies(~F.col("_own") & (F.col("_alternates") > 0)).alias("alt_only"))
    part = lambda c: F.round(F.try_divide(F.col(c).cast("double"), F.col("lots")), 6)
    return total.select("lots", "own", "alt_only", part("own").alias("own_share"), part("alt_only").alias("alt_share"))
