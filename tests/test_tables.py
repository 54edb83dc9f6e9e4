"""Queries on tables whose keys are repeated or missing, which those of the given tables never are."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract

duckdb = pytest.importorskip("duckdb")

EVENTS = [
    (1, 10, "view", 50.0),
    (1, 99, "view", 5.0),
    (2, 10, "click", 0.0),
    (3, 11, "click", 20.0),
    (4, None, "view", None),
]
CUSTOMERS = [(10, 5.0), (10, 7.0), (11, -1.0), (None, 3.0)]


@pytest.mark.parametrize("more", [[], [(None, 11, "view", 1.0)], [(None, 10, "view", 1.0)]])
@pytest.mark.parametrize("customers", [CUSTOMERS, CUSTOMERS[2:]])
def test_association_projection_on_repeated_and_missing_keys(spark, tmp_path, more, customers):
    events = spark.createDataFrame(EVENTS + more, "event_id long, user_id long, event_type string, value double")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(contract.oracle_sql()["association_projection"]).fetchall()
    found = [tuple(r) for r in contract.queries()["association_projection"](spark, str(tmp_path)).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
