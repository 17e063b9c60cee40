"""Cut an auction's product list into chunks that keep near-identical products together.

Products are ordered by category, title and lot, and a cut's place depends on the cut before it. The order is dealt out
in blocks (ranges of products); what a block does to the cuts is a function from the place of its first cut to the place
of the first cut after it. Places count from the block's edge and lie within one chunk's length of it, so the function is
a short list. Every block computes its list in its own task, the lists are composed by a prefix scan over blocks, and
each block then cuts from its known first place.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, vocab
from .common import dealt, written_once

_PLACE = ("_cat", "_title", "rep_lot")


def _with_family(products: DataFrame) -> DataFrame:
    """Category and title as they are ordered; products of one ``_family`` share a category and two opening words."""
    title = F.coalesce("title", F.lit(""))
    tidy = text.strip(F.regexp_replace(F.upper(title), r"\s+", " "))
    return (products.withColumn("_cat", F.coalesce("category", F.lit(""))).withColumn("_title", title)
            .withColumn("_family", F.struct("_cat", F.array_join(F.slice(F.split(tidy, " "), 1, 2), " ").alias("words"))))


def next_cut(at: np.ndarray, edges: np.ndarray, target: int, drift: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The cut after each of ``at`` (-1: none) and whether it is forced.

    It is the family edge nearest to ``target`` rows on, the later one on a tie; with none within ``drift`` the place
    itself, forced.
    """
    end, far = at + target, np.iinfo(np.int64).max
    k = np.searchsorted(edges, end, "left")
    padded = np.concatenate([[-1], edges, [far]])
    before, ahead = padded[k], padded[k + 1]
    later = np.where((ahead < total) & (ahead - end <= drift), ahead - end, far)
    earlier = np.where((before > at) & (end - before <= drift), end - before, far)
    forced = (later == far) & (earlier == far)
    out = np.where(forced, end, np.where(later <= earlier, ahead, before))
    return np.where(end < total, out, -1), forced & (end < total)


def _function(target: int, drift: int, keys: Sequence[str]):
    """A block's exits for all its entries: places of the first cut past the block, from its end, -1 for no more cuts."""
    def work(block: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        one, edges = block.iloc[0], np.sort(near["position"].to_numpy(np.int64))
        start, end, total = int(one["start"]), int(one["start"] + one["n"]), int(one["total"])
        at = start + np.arange(target + drift, dtype=np.int64)
        live = np.flatnonzero(at < end)
        while len(live):
            at[live] = next_cut(at[live], edges, target, drift, total)[0]
            live = live[(at[live] >= 0) & (at[live] < end)]
        out = block[[*keys]].copy()
        out["exits"] = [np.where(at < 0, -1, at - end).tolist()]
        return out

    return work


def _walk(target: int, drift: int, keys: Sequence[str]):
    """The chunks that begin in a block whose first cut is known."""
    def work(block: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        one, edges = block.iloc[0], np.sort(near["position"].to_numpy(np.int64))
        start, end, total = int(one["start"]), int(one["start"] + one["n"]), int(one["total"])
        at = start + int(one["entry"]) if one["entry"] >= 0 else -1
        found = []
        while 0 <= at < end:
            after, hard = next_cut(np.array([at]), edges, target, drift, total)
            found.append((at, int(after[0]) if after[0] >= 0 else total, bool(hard[0])))
            at = int(after[0])
        out = pd.DataFrame(found, columns=["start_row", "end_row", "is_forced"])
        for c in reversed(keys):
            out.insert(0, c, one[c])
        out["place"] = np.arange(len(out), dtype=np.int64)
        return out

    return work


def _entries(maps: DataFrame, scope: Sequence[str], most: int) -> DataFrame:
    """Where each block's first cut is: all blocks before it, composed by doubling how many a list stands for."""
    step, scan = 1, maps
    while step < most:
        ahead = scan.select(*scope, (F.col("no") + step).alias("no"), F.col("exits").alias("_earlier"))
        through = F.transform("_earlier", lambda x: F.when(x < 0, F.lit(-1).cast("long")).otherwise(F.get("exits", x.cast("int"))))
        scan = written_once(scan.join(ahead, [*scope, "no"], "left")
                            .select(*scope, "no", F.coalesce(through, "exits").alias("exits")), "scan")
        step *= 2
    return scan.select(*scope, (F.col("no") + 1).alias("no"), F.get("exits", F.lit(0)).alias("entry"))


class _Order:
    """Products in order: ``rows`` with their place, the blocks of that order, and the edges between families."""

    def __init__(self, products: DataFrame, scope: Sequence[str], reach: int, ranges: int | None):
        self.scope, self.reach = list(scope), reach
        table = dealt(_with_family(products), [*scope, *_PLACE], ranges)
        keys = [*scope, "_range"]
        place = F.struct(*_PLACE)
        blocks = table.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by("_family", place).alias("first"),
                                          F.max_by("_family", place).alias("last"))
        # One row for each range of the order.
        follow = W.partitionBy(*scope).orderBy("_range")
        upto = follow.rowsBetween(W.unboundedPreceding, -1)
        self.blocks = written_once(blocks.select(
            *keys, "n", (F.row_number().over(follow) - 1).alias("no"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("start"),
            F.sum("n").over(W.partitionBy(*scope)).alias("total"), F.lag("last").over(follow).alias("_before")), "blocks")
        inside = W.partitionBy(*keys).orderBy(*_PLACE)
        before = F.coalesce(F.lag("_family").over(inside), F.col("_before"))
        self.rows = (table.join(self.blocks.select(*keys, "start", "_before"), keys)
                     .withColumn("position", F.col("start") + F.row_number().over(inside) - 1)
                     .withColumn("_edge", before != F.col("_family")))
        self.edges = written_once(self.rows.where("_edge").select(*keys, "position"), "edges")

    def near(self) -> DataFrame:
        """A block's own edges and those up to one chunk's length past its end, by cells of that length."""
        cell = lambda c: F.floor(c / self.reach)
        ends = (self.blocks.select(*self.scope, "_range", (F.col("start") + F.col("n")).alias("_end"))
                .withColumn("_cell", F.explode(F.array(cell(F.col("_end")), cell(F.col("_end")) + 1))))
        past = (self.edges.drop("_range").withColumn("_cell", cell(F.col("position"))).join(ends, [*self.scope, "_cell"])
                .where((F.col("position") >= F.col("_end")) & (F.col("position") < F.col("_end") + self.reach)))
        return self.edges.unionByName(past.select(*self.scope, "_range", "position"))


def _starts(order: _Order, target: int, drift: int) -> DataFrame:
    scope, keys = order.scope, [*order.scope, "_range"]
    kinds = dict(order.blocks.dtypes)
    ddl = ", ".join(f"{c} {kinds[c]}" for c in keys)
    near = written_once(order.near(), "near")
    maps = (order.blocks.select(*keys, "start", "n", "total").groupBy(*keys).cogroup(near.groupBy(*keys))
            .applyInPandas(_function(target, drift, keys), f"{ddl}, exits array<bigint>"))
    numbers = order.blocks.select(*keys, "no")
    maps = written_once(maps.join(numbers, keys).select(*scope, "no", "exits"), "maps")
    most = order.blocks.agg(F.max("no")).first()[0] or 0
    known = order.blocks.join(_entries(maps, scope, most + 1), [*scope, "no"], "left")
    known = known.select(*keys, "no", "start", "n", "total", F.when(F.col("no") == 0, F.lit(0)).otherwise(F.col("entry")).cast("long").alias("entry"))
    begun = written_once(
        known.groupBy(*keys).cogroup(near.groupBy(*keys))
        .applyInPandas(_walk(target, drift, keys), f"{ddl}, start_row bigint, end_row bigint, is_forced boolean, place bigint"), "starts")
    counted = begun.groupBy(*keys).agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(*scope).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counted = counted.select(*keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_earlier"))
    return (begun.join(counted, keys).select(*scope, (F.col("_earlier") + F.col("place") + 1).alias("chunk"),
                                             "start_row", "end_row", F.col("is_forced").alias("ends_forced")))


def _room(target: int, drift: int | None) -> int:
    return max(1, int(target * vocab.CHUNK_DRIFT)) if drift is None else drift


def chunk_plan(products: DataFrame, target: int = vocab.CHUNK_ROWS, drift: int | None = None,
               scope: Sequence[str] = ("auction_id",), ranges: int | None = None) -> DataFrame:
    """Per chunk: first row, end row, and whether the cut at its end had no edge in reach."""
    drift = _room(target, drift)
    return _starts(_Order(products, scope, target + drift, ranges), target, drift)


def chunk_products(products: DataFrame, target: int = vocab.CHUNK_ROWS, drift: int | None = None,
                   scope: Sequence[str] = ("auction_id",), ranges: int | None = None) -> DataFrame:
    """Products with their chunk number, from 1.

    ``rep_lot`` is unique in its scope. ``ranges`` says into how many blocks the order is dealt (by default as many as
    a shuffle has). Places meet chunks by cells of ``target`` rows, so no task holds more than the rows of its cells.
    """
    drift = _room(target, drift)
    order = _Order(products, scope, target + drift, ranges)
    cell = lambda c: F.floor(c / target)
    begun = (_starts(order, target, drift)
             .withColumn("_cell", F.explode(F.sequence(cell(F.col("start_row")), cell(F.col("end_row") - 1))))
             .select(*scope, "_cell", "start_row", "end_row", "chunk"))
    placed = order.rows.select(*products.columns, "position").withColumn("_cell", cell(F.col("position")))
    return (placed.join(begun, [*scope, "_cell"])
            .where((F.col("position") >= F.col("start_row")) & (F.col("position") < F.col("end_row")))
            .select(*products.columns, "chunk"))


def chunk_summary(chunked: DataFrame, scope: Sequence[str] = ("auction_id",)) -> DataFrame:
    """Rows and last lot of each chunk, in reading order."""
    place = F.struct(F.coalesce("category", F.lit("")), F.coalesce("title", F.lit("")), "rep_lot")
    return chunked.groupBy(*scope, "chunk").agg(F.count("*").alias("rows"), F.max_by("rep_lot", place).alias("last_lot"))
