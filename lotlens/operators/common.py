"""Building blocks shared by the operators.

All of them reduce with partial aggregation, so a key that holds a large share
of the rows is combined before the shuffle and never sits in one window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_dir


def latest(df: DataFrame, keys: Sequence[str], order: Column | str, first: bool = False) -> DataFrame:
    """One row per key: the last by ``order`` (or the first). ``order`` must not tie."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if first else F.max_by
    return (df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_row"))
            .select(*keys, "_row.*"))


def as_key(c: Column) -> Column:
    """Text form of an identifier; empty means no key."""
    return F.nullif(c.cast("string"), F.lit(""))


def list_of(csv: Column) -> Column:
    return F.filter(F.split(F.coalesce(csv, F.lit("")), ","), lambda v: v != "")


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def keep(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that satisfy a condition on costly computed columns.

    A plain filter would be pushed below the projection that computes them and
    evaluate them a second time; a one-element explode stays where it is.
    """
    one = F.explode(F.when(condition, F.array(F.lit(True)))).alias("_kept")
    return df.select("*", one).drop("_kept")


def written_once(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back, where one plan would derive it many times."""
    return written_to(df, shared_dir(df.sparkSession, name))


def written_to(df: DataFrame, path: str, by: Sequence[str] = ()) -> DataFrame:
    """``written_once`` in a given folder, for tables that their maker removes."""
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, order: Sequence[Column | str], ranges: int | None = None) -> DataFrame:
    """The rows dealt out by range of an order and written once, so that later jobs agree on the ranges.

    ``_range`` numbers the ranges in the order; a range is what one task handles.
    """
    parts = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    return written_once(parts.withColumn("_range", F.spark_partition_id()), "order")


def positions(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Every row with its place (from 1) in an order that doesn't tie.

    Rows are dealt out by range and written once, so that the ranges which are
    counted are the ranges which are ranked; a row's place is its rank in its
    range after all rows of the ranges before. No task sees more than one range.
    """
    rows = dealt(df, order)
    # One row for each range.
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = (rows.groupBy("_range").agg(F.count("*").alias("_n"))
              .select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    rank = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return (rows.withColumn("_rank", rank).join(before, "_range")
            .withColumn(name, F.col("_before") + F.col("_rank")).drop("_range", "_rank", "_before"))


def successors(asked: DataFrame, known: DataFrame, at: str, scope: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Every row of ``asked`` with ``next_at``: the least ``at`` of ``known`` above its own in its scope, NULL if none.

    Both sides are dealt out together by value. A row looks on in its own range and else takes the first value of the
    next range of its scope that has one, so no task sees more than a range.
    """
    both = (known.select(*scope, at).distinct().withColumn("_known", F.col(at)).withColumn("_asks", F.lit(0))
            .unionByName(asked.withColumn("_asks", F.lit(1)), allowMissingColumns=True))
    rows = dealt(both, [*scope, at], ranges)
    keys = [*scope, "_range"]
    # One row for each range of the order.
    later = W.partitionBy(*scope).orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)
    beyond = (rows.groupBy(*keys).agg(F.min("_known").alias("_least"))
              .select(*keys, F.min("_least").over(later).alias("_beyond")))
    # Downwards, with askers before the known value they equal: the last value passed is the least above.
    passed = W.partitionBy(*keys).orderBy(F.desc(at), F.desc("_asks")).rowsBetween(W.unboundedPreceding, -1)
    found = rows.withColumn("_above", F.last("_known", ignorenulls=True).over(passed)).where("_asks = 1").join(beyond, keys)
    return found.select(*asked.columns, F.coalesce("_above", "_beyond").alias("next_at"))
