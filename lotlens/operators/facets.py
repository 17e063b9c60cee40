"""Facet counts over the published lots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import non_empty


def counted(nodes: DataFrame) -> DataFrame:
    """Rows per node."""
    return nodes.groupBy(*nodes.columns).agg(F.count("*").alias("lots"))


def recounted(counts: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """Counts of nodes after some rows went and others came: only those rows are counted, and counts of nodes are added.

    ``gone`` and ``come`` are the nodes of the changed lots as they were and as they are (a moved lot is in both). A node
    left by its last lot goes too. Where nodes are distinct by lot (``nav_nodes``), give all rows of a changed lot.
    """
    nodes = [c for c in counts.columns if c != "lots"]
    signed = lambda df, one: counted(df).withColumn("lots", F.col("lots") * one)
    return (counts.unionByName(signed(gone, -1)).unionByName(signed(come, 1))
            .groupBy(*nodes).agg(F.sum("lots").alias("lots")).where("lots <> 0"))


def tree_nodes(lots: DataFrame) -> DataFrame:
    """Every node that a lot is at or below, the root included."""
    path = F.coalesce("category_path", F.array().cast("array<string>"))
    nodes = F.transform(F.sequence(F.lit(0), F.size(path)), lambda i: F.slice(path, F.lit(1), i))
    return lots.select(F.explode(nodes).alias("path"))


def category_tree(lots: DataFrame) -> DataFrame:
    """Lots at or below every node of the category tree, the root included.

    ``sibling_rank`` orders children by count, then name.
    """
    return ranked_tree(counted(tree_nodes(lots)))


def ranked_tree(counts: DataFrame) -> DataFrame:
    """The category tree of counted nodes."""
    depth = F.size("path")
    parent = F.when(depth > 0, F.slice("path", F.lit(1), depth - 1))
    named = counts.select("path", depth.alias("depth"), parent.alias("_parent"),
                           F.try_element_at("path", F.lit(-1)).alias("name"), "lots")
    # One row per category by now, whatever the number of lots.
    order = W.partitionBy("depth", "_parent").orderBy(F.desc("lots"), "name")
    return named.withColumn("sibling_rank", F.row_number().over(order)).drop("_parent")


def label_nav(lots: DataFrame, bucket_dim: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Distinct flagged lots per group, bucket and subtype; a lot is its number within ``scope``."""
    return counted(nav_nodes(lots, bucket_dim, scope))


def nav_nodes(lots: DataFrame, bucket_dim: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One row for each flagged lot and node of the label navigation that it belongs to.

    Each lot is expanded to the nodes it belongs to and duplicates are removed on
    (node, lot), so a node with most of the lots is counted in many tasks.
    """
    dim = bucket_dim.select("bucket", "bucket_group", "group_pos")
    rows = (lots.where("is_flagged")
            .select(*scope, "lot_number", non_empty(F.col("subtype")).alias("subtype"), F.explode("buckets").alias("bucket"))
            .join(dim, "bucket", "left"))
    group = F.coalesce("bucket_group", F.lit(vocab.UNGROUPED))
    pos = F.coalesce("group_pos", F.lit(2**31 - 1))
    none = F.lit(None).cast("string")
    node = lambda level, b, s: F.struct(
        F.lit(level).alias("level"), pos.alias("group_pos"), group.alias("bucket_group"),
        b.alias("bucket"), s.alias("subtype"))
    nodes = F.array_compact(F.array(
        node(1, none, none), node(2, F.col("bucket"), none),
        F.when(F.col("subtype").isNotNull(), node(3, F.col("bucket"), F.col("subtype")))))
    return rows.select(*scope, "lot_number", F.explode(nodes).alias("n")).distinct().select("n.*")


def available_conditions(lots: DataFrame) -> DataFrame:
    """Conditions in use: known ones in vocabulary order, others after them by name."""
    return listed_conditions(condition_nodes(lots).distinct())


def condition_nodes(lots: DataFrame) -> DataFrame:
    return lots.where("condition is not null").select("condition")


def listed_conditions(present: DataFrame) -> DataFrame:
    """The conditions of ``present`` (one row each) in their order."""
    known = F.array(*[F.lit(c) for c in vocab.CONDITIONS])
    rank = F.array_position(known, F.col("condition")).cast("int")
    order = W.orderBy(F.when(rank == 0, len(vocab.CONDITIONS) + 1).otherwise(rank), "condition")
    return present.select("condition", (rank > 0).alias("is_known"), F.row_number().over(order).alias("position"))


def field_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, filled, total): non-empty values per column, all columns in one pass."""
    filled = [F.count_if(F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull()).alias(c) for c in columns]
    once = df.agg(*filled, F.count("*").alias("_total"))
    entry = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled"), F.col("_total").alias("total"))
                      for c in columns])
    return once.select(F.explode(entry).alias("e")).select("e.*")


def fidelity_report(lots: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Coverage of the fields a listing cannot do without."""
    has = lambda c: F.count_if(F.coalesce(F.col(c) != "", F.lit(False)))
    return lots.groupBy(*scope).agg(
        F.count("*").alias("lots"), has("title").alias("titled"), has("image_url").alias("imaged"),
        F.count_if(F.size("category_path") > 0).alias("categorised"), has("condition").alias("conditioned"))


def unknown_conditions(lots: DataFrame) -> DataFrame:
    """Conditions outside the vocabulary, with their lots."""
    return (lots.where(F.col("condition").isNotNull() & (F.col("condition") != "")
                       & ~F.col("condition").isin(*vocab.CONDITIONS))
            .groupBy("condition").agg(F.count("*").alias("lots")))
