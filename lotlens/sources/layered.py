"""Tables kept in buckets, of which a change set reads and writes only those that it falls in.

A row's bucket is one of ``groups`` by the hash of its scope, times one of ``buckets`` by the hash of its key, so that a
change within one scope meets one group, and a scope with most of the rows is still spread. A bucket is a list of
pieces, folders written once and never changed; the manifest of a version names the pieces of every bucket. Rows without
a key are dealt out by ``_ord``.

There are three changes. ``append`` adds a piece to each bucket that it has rows for and reads nothing. ``rewrite`` puts
one new piece in place of those of the buckets touched. ``compact`` does so for buckets of too many pieces. Each ends in
one published manifest: a writer that dies leaves the version before, and of two that began on one version the second
gets ``Conflict`` (an append, which depends on no rows, tries again on top of the other).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions

ENTRY = "bucket int, run string, n bigint"
GROUPS, BUCKETS = 16, 16


@dataclass(frozen=True)
class Layout:
    keys: tuple[str, ...]
    scope: tuple[str, ...]
    groups: int
    buckets: int

    def bucket(self) -> Column:
        text = [F.nullif(F.col(k).cast("string"), F.lit("")) for k in self.keys]
        # With a null among its parts a key is none.
        of_key = F.coalesce(F.concat_ws("\x00", F.when(F.concat(*text).isNotNull(), F.array(*text))), F.lit(""))
        part = F.when(of_key != "", F.xxhash64(F.lit(2), of_key)).otherwise(F.xxhash64(F.lit(3), F.to_json(F.struct("_ord"))))
        group = F.xxhash64(F.lit(1), *(F.col(c).cast("string") for c in self.scope))
        return (F.pmod(group, F.lit(self.groups)) * self.buckets + F.pmod(part, F.lit(self.buckets))).cast("int")


def layout(spark: SparkSession, path: str) -> Layout:
    row = spark.read.parquet(f"{path}/layout").first()
    return Layout(tuple(row["keys"]), tuple(row["scope"]), row["groups"], row["buckets"])


def version(spark: SparkSession, path: str) -> int:
    return versions.last_version(spark, path, ENTRY)


def pieces(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """(bucket, run, n) of the last version or an earlier one: at most a few rows for each bucket."""
    at = version(spark, path) if at is None else at
    return versions.published(spark, path, ENTRY).where((F.col("version") == at) & F.col("bucket").isNotNull()).drop("version")


def _publish(entries: DataFrame, path: str, number: int) -> None:
    """The pieces of a version, and a row without a bucket, so that a table without rows has a version too."""
    mark = entries.sparkSession.range(1).select(F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("string").alias("run"), F.lit(0).cast("bigint").alias("n"))
    versions.publish(entries.unionByName(mark), path, number)


def _written(rows: DataFrame, path: str, how: Layout) -> DataFrame:
    """The rows as pieces of a run of their own: one for each bucket that they fall in."""
    spark, run = rows.sparkSession, f"r{uuid.uuid4().hex}"
    folder = f"{path}/data/run={run}"
    rows.withColumn("bucket", how.bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder)
    return (spark.read.schema("bucket int").parquet(folder).groupBy("bucket").agg(F.count("*").alias("n"))
            .select("bucket", F.lit(run).alias("run"), "n"))


def create(rows: DataFrame, path: str, keys: Sequence[str], scope: Sequence[str] = (), groups: int = GROUPS, buckets: int = BUCKETS) -> int:
    """Lay a table out as version 1. It needs an orderable ``_ord``, and no columns named ``bucket`` or ``run``."""
    spark = rows.sparkSession
    if taken := {"bucket", "run"} & set(rows.columns):
        raise ValueError(f"columns {sorted(taken)} are used by the layout")
    how = Layout(tuple(keys), tuple(scope), groups if scope else 1, buckets)
    one = spark.range(1)
    names = lambda of: F.array(*map(F.lit, of)).cast("array<string>")
    one.select(names(how.keys).alias("keys"), names(how.scope).alias("scope"), F.lit(how.groups).alias("groups"),
               F.lit(how.buckets).alias("buckets")).coalesce(1).write.parquet(f"{path}/layout")
    spark.createDataFrame([], rows.schema).write.parquet(f"{path}/schema")
    _publish(_written(rows, path, how), path, 1)
    return 1


def _opened(spark: SparkSession, path: str, entries: DataFrame) -> DataFrame:
    """The rows of some pieces; the driver sees their names, a bounded number for each bucket."""
    schema = spark.read.parquet(f"{path}/schema").schema
    found = [f"{path}/data/run={e.run}/bucket={e.bucket}" for e in entries.select("run", "bucket").collect()]
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*found).select(*schema.names)


def _touched(rows: DataFrame, how: Layout) -> DataFrame:
    return rows.select(how.bucket().alias("bucket")).distinct()


def read(spark: SparkSession, path: str, touching: DataFrame | None = None, at: int | None = None) -> DataFrame:
    """All rows as of a version (the last), or those of the buckets that the rows of ``touching`` fall in."""
    entries = pieces(spark, path, at)
    if touching is not None:
        entries = entries.join(_touched(touching, layout(spark, path)), "bucket", "left_semi")
    return _opened(spark, path, entries)


def append(rows: DataFrame, path: str) -> int:
    """Add rows as new pieces. What wins among rows of a key is for the reader's fold, so nothing is read."""
    spark = rows.sparkSession
    new = _written(rows.select(*spark.read.parquet(f"{path}/schema").columns), path, layout(spark, path))
    while True:
        now = version(spark, path)
        try:
            _publish(pieces(spark, path, now).unionByName(new), path, now + 1)
            return now + 1
        except versions.Conflict:
            continue  # the rows are written; only the list of pieces is made anew


def _replaced(spark: SparkSession, path: str, now: int, buckets: DataFrame, rows: DataFrame) -> int:
    new = _written(rows.select(*spark.read.parquet(f"{path}/schema").columns), path, layout(spark, path))
    _publish(pieces(spark, path, now).join(buckets, "bucket", "left_anti").unionByName(new), path, now + 1)
    return now + 1


def rewrite(changes: DataFrame, path: str, change: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """Replace the buckets that ``changes`` fall in by ``change(their rows, changes)``; the other pieces stay as they are."""
    spark, how = changes.sparkSession, layout(changes.sparkSession, path)
    now, buckets = version(spark, path), _touched(changes, how)
    rows = _opened(spark, path, pieces(spark, path, now).join(buckets, "bucket", "left_semi"))
    return _replaced(spark, path, now, buckets, change(rows, changes))


def compact(spark: SparkSession, path: str, fold: Callable[[DataFrame], DataFrame], most: int = 8) -> int:
    """Fold the buckets of more than ``most`` pieces into one piece each. ``fold`` reduces the rows of a key, and
    folding folded rows with later ones must give what folding all of them gives."""
    now = version(spark, path)
    many = pieces(spark, path, now).groupBy("bucket").agg(F.count("*").alias("pieces")).where(F.col("pieces") > most).select("bucket")
    if many.isEmpty():
        return now
    return _replaced(spark, path, now, many, fold(_opened(spark, path, pieces(spark, path, now).join(many, "bucket", "left_semi"))))
