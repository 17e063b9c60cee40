"""Numbered runs from first-seen stamps.

A run takes every stamp within three hours of its first, and the stamp after those begins the next. So the start of the
next run is a function of a start alone: the first stamp more than three hours later. It is looked up for every stamp
by range; then the starts that follow from an auction's first stamp are found by doubling how many runs a jump skips.
Starts are more than three hours apart, so three hours of the clock hold one at most, and stamps meet their start by
such cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values, vocab
from .common import successors, written_once
from .skew import attach

_GAP = vocab.CLUSTER_SECONDS * 1_000_000
#: Stamps that every task may hold; lots meet more of them by key.
FEW_STAMPS = 1 << 17


def _stamps(lots: DataFrame, stamp: Column, scope: Sequence[str]) -> DataFrame:
    """The distinct stamps, with their microseconds as ``at``."""
    found = lots.select(*scope, stamp.alias("_ts")).where("_ts is not null").distinct()
    return written_once(found.withColumn("at", F.unix_micros("_ts")), "stamps")


def _starts(stamps: DataFrame, scope: Sequence[str], ranges: int | None) -> DataFrame:
    """First stamp of each run (``at``)."""
    asked = stamps.select(*scope, F.col("at").alias("start"), (F.col("at") + _GAP).alias("at"))
    jumps = written_once(successors(asked, stamps.select(*scope, "at"), "at", scope, ranges)
                         .where("next_at is not null").select(*scope, "start", "next_at"), "jumps")
    starts = stamps.groupBy(*scope).agg(F.min("at").alias("at"))
    while not jumps.isEmpty():
        reached = starts.withColumnRenamed("at", "start").join(jumps, [*scope, "start"]).select(*scope, F.col("next_at").alias("at"))
        starts = written_once(starts.unionByName(reached), "starts")
        onward = jumps.select(*scope, F.col("start").alias("next_at"), F.col("next_at").alias("_beyond"))
        jumps = written_once(jumps.join(onward, [*scope, "next_at"]).select(*scope, "start", F.col("_beyond").alias("next_at")), "jumps")
    return starts


def cluster_starts(lots: DataFrame, stamp: Column, scope: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """(scope, started_at) for each run.

    A stamp joins the run whose *start* is at most three hours back; measuring
    from the last stamp instead (as a session window does) would merge more.
    """
    return _starts(_stamps(lots, stamp, scope), scope, ranges).select(*scope, F.timestamp_micros("at").alias("started_at"))


def run_stamps(lots: DataFrame, stamp: Column, scope: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """(stamp, scrape, started_at) for every distinct stamp of an auction."""
    stamps = _stamps(lots, stamp, scope)
    # One row for each run, and these are three hours apart.
    numbered = _starts(stamps, scope, ranges).withColumn("scrape", F.row_number().over(W.partitionBy(*scope).orderBy("at")))
    cell = F.col("at") - F.pmod("at", F.lit(_GAP))
    spot = F.explode(F.array(F.struct(cell.alias("_cell"), F.lit(True).alias("_starts_here")),
                             F.struct((cell + _GAP).alias("_cell"), F.lit(False).alias("_starts_here")))).alias("_spot")
    run = F.struct("at", "scrape")
    cells = (numbered.select(*scope, "at", "scrape", spot).groupBy(*scope, F.col("_spot._cell").alias("_cell"))
             .agg(F.max(F.when(F.col("_spot._starts_here"), run)).alias("_own"),
                  F.max(F.when(~F.col("_spot._starts_here"), run)).alias("_before")))
    met = attach(stamps.withColumn("_cell", cell), cells, [*scope, "_cell"], "inner")
    mine = F.when(F.col("_own.at") <= F.col("at"), F.col("_own")).otherwise(F.col("_before"))
    found = (met.withColumn("_run", mine)
             .select(*scope, "_ts", F.col("_run.scrape").cast("long").alias("scrape"), F.timestamp_micros("_run.at").alias("started_at")))
    return written_once(found, "runs")


def assign_scrapes(lots: DataFrame, stamps: DataFrame, stamp: Column, scope: Sequence[str] = ()) -> DataFrame:
    """Lots with their 1-based run number; NULL without a usable stamp.

    Lots without a stamp would meet in one task for each scope, so lots are dealt by stamp only where there are many.
    """
    numbered, keyed, on = stamps.select(*scope, "_ts", "scrape"), lots.withColumn("_ts", stamp), [*scope, "_ts"]
    if numbered.limit(FEW_STAMPS + 1).count() <= FEW_STAMPS:
        return keyed.join(F.broadcast(numbered), on, "left").drop("_ts")
    return attach(keyed, numbered, on).drop("_ts")


def scrape_clusters(assigned: DataFrame, stamps: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One row per run: number, start, Eastern label and lots.

    Two runs of one day carry the time in their label.
    """
    counts = assigned.where("scrape is not null").groupBy(*scope, "scrape").agg(F.count("*").alias("lots"))
    local = values.eastern(F.col("started_at"))
    day = F.date_format(local, "EEE MMM d")
    runs = stamps.select(*scope, "scrape", "started_at").distinct()
    # One row per run by now, so counting the runs of a day is a small window.
    same_day = F.count("*").over(W.partitionBy(*scope, day))
    label = F.when(same_day > 1, F.concat_ws(" ", day, F.date_format(local, "HH:mm"))).otherwise(day)
    return (runs.select(*scope, "scrape", "started_at", label.alias("label"))
            .join(counts, [*scope, "scrape"]))


def first_seen_histogram(lots: DataFrame, stamp: Column) -> DataFrame:
    """Lots per Eastern minute they were first seen in."""
    minute = F.date_format(values.eastern(stamp), "EEE MMM dd HH:mm")
    return (lots.select(F.coalesce(minute, F.lit("(no first_seen)")).alias("first_seen"))
            .groupBy("first_seen").agg(F.count("*").alias("lots")))
