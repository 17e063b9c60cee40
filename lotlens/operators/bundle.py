"""The published bundle: listings, labels, valuations, past sales and run numbers in one row per lot, and its side tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import facets, gates, labels, sales, scrapes
from .common import written_once

TABLES = ("lots", "bucket_groups", "groups", "scrapes", "sale_history")


def bundle_lots(raw: DataFrame, label_rows: DataFrame, valuations: DataFrame, index: DataFrame, stamp: Column,
                scope: Sequence[str] = (), runs: DataFrame | None = None) -> DataFrame:
    """One output row per labelled lot, with its valuation, sale keys and run number.

    ``stamp`` reads the first-seen column of ``raw``; ``runs`` spares numbering its runs where that was done already.
    Labels that name no lot are left out. The valued rows are written once: their products are counted before they are stamped.
    """
    merged = labels.join_labels_raw(label_rows, raw, scope)
    valued = written_once(labels.join_resale(merged, valuations, scope), "valued")
    keyed = sales.join_sale_history(valued, index)
    runs = scrapes.run_stamps(raw, stamp, scope) if runs is None else runs
    numbered = scrapes.assign_scrapes(keyed, runs, stamp, scope)
    return labels.output_lots(numbered)


def bundle_tables(raw: DataFrame, label_rows: DataFrame, valuations: DataFrame, index: DataFrame, bucket_dim: DataFrame,
                  stamp: Column, scope: Sequence[str] = ()) -> dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]]:
    """The five tables of a bundle, for ``sinks.write_tables``: the lots, and functions that make the side tables from the lots as written."""
    index = written_once(index, "index")
    runs = scrapes.run_stamps(raw, stamp, scope)
    group = lambda used: used.groupBy("bucket_group").agg(F.min("group_pos").alias("group_pos"), F.sum("uses").alias("uses"))
    numbered = lambda lots: lots.where("scrape is not null").select(*scope, "scrape")
    return {"lots": bundle_lots(raw, label_rows, valuations, index, stamp, scope, runs),
            "bucket_groups": lambda written: labels.attach_bucket_groups(written["lots"], bucket_dim),
            "groups": lambda written: group(written["bucket_groups"]),
            "scrapes": lambda written: scrapes.scrape_clusters(numbered(written["lots"]), runs, scope),
            "sale_history": lambda written: sales.sale_index_used(sales.with_product_key(written["lots"]), index)}


def bundle_gates(scope: Sequence[str] = ()):
    """Checks of a written bundle: conforming rows, titles everywhere, images nearly everywhere."""
    return {"schema": lambda written: gates.gate_lot_schema(written["lots"], scope),
            "fidelity": lambda written: gates.gate_bundle(facets.fidelity_report(written["lots"], scope), scope)}
