"""Every registered query against its SQL on the smallest tables that give it rows."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tools.check import TABLES, compare

duckdb = pytest.importorskip("duckdb")
SMALLEST = "/root/testdata/sf0.001"
LARGER = dict.fromkeys(["cross_study_program_scores", "types_shared_by_all_donors"], "/root/testdata/sf0.01")


def connected(folder: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def test_flagship_runs(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "top_type" in df.columns


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_matches_sql(spark, name):
    folder = LARGER.get(name, SMALLEST)
    result, _ = compare(spark, connected(folder), name, folder)
    assert result.startswith(("ok", "rows-only")), result
