"""Many-to-one joins that survive a key with a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written_once

ROWS_PER_PART = 1_000_000   # rows one key may bring to a task
_UNMATCHED_PARTS = 4096     # rows with a null in the key meet nothing, but must not pile up


def hot_keys(counts: DataFrame, on: Sequence[str], rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Keys with more rows than a task should get, and how many parts to split them into, from (key..., n) counts."""
    return (counts.where(F.col("n") > rows_per_part)
            .select(*on, F.ceil(F.col("n") / rows_per_part).cast("int").alias("_parts")))


def attach(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left",
           counts: DataFrame | None = None, rows_per_part: int | None = None, look: bool = False) -> DataFrame:
    """Join a table with one row per key to a table that may repeat keys without limit.

    Rows of a hot key are spread over as many parts as its count asks for and its
    one right row is copied to each part, so no task gets the whole key. Adaptive
    skew handling alone would not do: it leaves joins alone whose right side comes
    out of an aggregation. There is at most one hot key for every
    ``rows_per_part`` left rows, which bounds the list that is broadcast;
    ``counts`` (key..., n) spares the counting pass where they are known already.
    With ``look`` the hot keys are sought at once; if there are none, the tables meet by a plain join, which deals
    neither side anew where it lies by key already and sends a small right table to all tasks.
    """
    on = list(on)
    if counts is None:
        counts = left.groupBy(*on).agg(F.count("*").alias("n"))
    found = hot_keys(counts, on, rows_per_part or ROWS_PER_PART)
    if look:
        found = written_once(found, "hot")
        if found.isEmpty():
            return left.join(right, on, how)
    hot = F.broadcast(found)
    unmatched = F.lit(False)
    for k in on:
        unmatched = unmatched | F.col(k).isNull()
    parts = F.when(unmatched, F.lit(_UNMATCHED_PARTS)).otherwise(F.coalesce("_parts", F.lit(1)))
    spread = (left.join(hot, on, "left")
              .withColumn("_part", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("_parts"))
    copied = (right.join(hot, on, "left")
              .withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
              .drop("_parts"))
    return spread.join(copied, [*on, "_part"], how).drop("_part")
