"""Gates over lots whose numbers are as high as in large tables."""

import os

import duckdb
import pytest

from __spark_entry__ import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    """The small tables with numbers of orders above nine million."""
    folder = tmp_path_factory.mktemp("shifted")
    for name in os.listdir(DATA):
        os.symlink(f"{DATA}/{name}", folder / name)
    os.remove(folder / "orders.parquet")
    parts = duckdb.sql(f"select count(*) from '{DATA}/part.parquet'").fetchall()[0][0]
    duckdb.sql(f"copy (select * replace (o_orderkey + 10000000 // {parts} * {parts} as o_orderkey) "
               f"from '{DATA}/orders.parquet') to '{folder}/orders.parquet' (format parquet)")
    return str(folder)


def test_end_markers_stay_last_behind_any_lot_number(spark, shifted):
    found = lambda folder: sorted((r["chunk"], r["problem"], r["n"]) for r in queries()["gate_responses"](spark, folder).collect())
    high = found(shifted)
    assert [r for r in high if r[1] == "end marker not last"] == [(1998, "end marker not last", 1)]
    assert high == found(DATA)
