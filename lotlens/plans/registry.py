"""Registered queries, the views they read, and their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.common import written_once
from ..session import configure
from .views import BASE, VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _mentioned(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_]+", sql))
    return [n for n in (*BASE, *VIEWS) if n in words]


def _needed(names: list[str]) -> list[str]:
    """Names with everything they are built from, in build order."""
    out: list[str] = []
    for n in names:
        if n in VIEWS:
            out += [d for d in _needed([m for m in _mentioned(VIEWS[n]) if m != n]) if d not in out]
        if n not in out:
            out.append(n)
    return out


class Tables:
    """Driver tables and derived views of one data folder, looked up by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder
        self._ready: set[str] = set()

    def __getitem__(self, name: str) -> DataFrame:
        for n in _needed([name]):
            if n in self._ready:
                continue
            if n in VIEWS:
                df = self.spark.sql(VIEWS[n])
            else:
                df = self.spark.read.parquet(f"{self.folder}/{n}.parquet")
            df.createOrReplaceTempView(n)
            self._ready.add(n)
        return self.spark.table(name)

    def write(self, name: str, columns: Sequence[str], by: Sequence[str]) -> None:
        """Write columns of a view once; views not looked up before read what was written.

        Rows are dealt by ``by``, since a folder of few large row groups would have few tasks read them every time.
        """
        self.put(name, written_once(self[name].select(*columns).repartition(*by), name))

    def put(self, name: str, df: DataFrame) -> None:
        """Views not looked up before read this table under the name."""
        df.createOrReplaceTempView(name)
        self._ready.add(name)


def oracle(sql: str) -> str:
    """Prefix a statement with the views it mentions, as common table expressions."""
    body = sql.strip()
    views = [n for n in _needed(_mentioned(body)) if n in VIEWS]
    ctes = ",\n".join(f"{n} as ({VIEWS[n].strip()})" for n in views)
    match = re.match(r"with\s+(recursive\s+)?", body)
    recursive = "recursive " if match and match.group(1) else ""
    if match:
        rest = body[match.end():]
        return f"with {recursive}{ctes},\n{rest}" if ctes else body
    return f"with {ctes}\n{body}" if ctes else body


def query(name: str, sql: str | None = None):
    """Register a function from Tables to a DataFrame, with its SQL twin."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLES[name] = oracle(sql)
        return fn

    return register
