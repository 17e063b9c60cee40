"""Lot analytics on Spark: tables in, tables out."""
