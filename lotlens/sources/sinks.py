"""All-or-nothing writes of several tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gates import GateError, require
from . import versions

_MANIFEST = "run string, tables array<string>"


def write_tables(tables: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], path: str,
                 gates: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] | None = None,
                 partition_by: dict[str, list[str]] | None = None) -> str:
    """Write every table, check what was written, then publish all together; returns the run id.

    A table after the first may be a function of those before it as they were written, which spares deriving these again.
    Tables land in a folder of their own run. Gates are functions of the written
    tables, so what is checked is what is read later; one that fails leaves the
    run unpublished and readers with the one before. Readers follow the manifest,
    whose next number is taken by one rename; runs are counted, not timed.
    """
    spark = next(iter(tables.values())).sparkSession
    run = uuid.uuid4().hex
    written: dict[str, DataFrame] = {}
    for name, given in tables.items():
        df = given(written) if callable(given) else given
        writer = df.write.mode("overwrite")
        keys = (partition_by or {}).get(name)
        if keys:
            writer = writer.partitionBy(*keys)
        writer.parquet(f"{path}/runs/{run}/{name}")
        written[name] = spark.read.schema(df.schema).parquet(f"{path}/runs/{run}/{name}")
    for name, violations in (gates or {}).items():
        require(violations(written), name)
    entry = spark.range(1).select(F.lit(run).alias("run"), F.array(*[F.lit(n) for n in tables]).alias("tables"))
    while True:
        try:
            versions.publish(entry, path, versions.last_version(spark, path, _MANIFEST) + 1)
            break
        except versions.Conflict:
            continue  # another run took the number; this one comes after it
    return run


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The table as of the last published run."""
    last = versions.published(spark, path, _MANIFEST).orderBy(F.desc("version")).head()
    if last is None or name not in last["tables"]:
        raise GateError(f"{name} was never published under {path}")
    return spark.read.parquet(f"{path}/runs/{last['run']}/{name}")
