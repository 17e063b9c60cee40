"""Label and valuation tables kept from run to run: a change set costs what its buckets hold, not what the table holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import layered
from .labels import fold_layers, fold_valuations, upsert_labels

# --- upserts ------------------------------------------------------------------------


def _ordered(rows: DataFrame, turn: int) -> DataFrame:
    """``_ord`` as (turn, ord), so that rows added later stand after all earlier ones."""
    return rows.withColumn("_ord", F.struct(F.lit(turn).alias("turn"), F.col("_ord").cast("long").alias("ord")))


def keep_labels(existing: DataFrame, path: str, scope: Sequence[str] = (), **sizes: int) -> int:
    """Lay label rows (lot_number, ``_ord``, label columns) out for ``upsert``."""
    rows = _ordered(existing, 1).withColumn("_turn", F.lit(1))
    return layered.create(rows, path, ["lot_number"], scope, **sizes)


def upsert(new: DataFrame, path: str) -> int:
    """``upsert_labels`` on the kept rows; only the buckets that hold a lot of ``new`` are read and written."""
    spark = new.sparkSession
    turn, scope = layered.version(spark, path) + 1, layered.layout(spark, path).scope

    def change(old: DataFrame, given: DataFrame) -> DataFrame:
        merged = upsert_labels(old, given.withColumn("_turn", F.lit(turn)), scope)
        return merged.withColumn("_ord", F.col("_ord.ord"))

    return layered.rewrite(_ordered(new, turn), path, change)


def upserted(spark: SparkSession, path: str) -> DataFrame:
    """The kept rows; ``change`` tells what the last upsert did to each: 'kept', 'updated' or 'added'."""
    turn = layered.version(spark, path)
    change = F.when(F.col("_turn") < turn, "kept").when(F.col("_ord.turn") < turn, "updated").otherwise("added")
    return layered.read(spark, path).withColumn("change", change).drop("_turn")


# --- layers -------------------------------------------------------------------------


def settled(layers: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """What later folds need of a lot: its last row of layer 0 and its last row of all, two rows at most."""
    keys = [*scope, "lot_number"]
    row = F.struct(*(c for c in layers.columns if c not in keys))
    at = F.struct("layer_no", "_ord")
    ends = F.array_distinct(F.array_compact(F.array(
        F.max_by(row, F.when(F.col("layer_no") == 0, at)), F.max_by(row, at))))
    return layers.groupBy(*keys).agg(ends.alias("_ends")).select(*keys, F.explode("_ends").alias("_row")).select(*keys, "_row.*").select(*layers.columns)


def keep_layers(base: DataFrame, path: str, scope: Sequence[str] = (), **sizes: int) -> int:
    """Lay the lot set's base rows out as layer 0."""
    return layered.create(base.withColumn("layer_no", F.lit(0)), path, ["lot_number"], scope, **sizes)


def add_layer(layer: DataFrame, path: str, most: int = 8) -> int:
    """Append the rows of one or more layers; buckets with more than ``most`` pieces are settled."""
    spark = layer.sparkSession
    layered.append(layer, path)
    scope = layered.layout(spark, path).scope
    return layered.compact(spark, path, lambda rows: settled(rows, scope), most)


def folded(spark: SparkSession, path: str, touching: DataFrame | None = None) -> DataFrame:
    """``fold_layers`` of what is kept, or of the buckets that some lots fall in."""
    return fold_layers(layered.read(spark, path, touching), layered.layout(spark, path).scope)


def folded_valuations(spark: SparkSession, path: str, lots: DataFrame) -> DataFrame:
    """``fold_valuations`` of kept valuations, whose first rows are layer 0, for the current lots."""
    rows = layered.read(spark, path)
    base = rows.where("layer_no = 0").drop("layer_no")
    return fold_valuations(base, rows.where("layer_no > 0"), lots, layered.layout(spark, path).scope)
