"""Content-keyed reuse: what a change rebuilds, what is read again, and failed builds."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corrobora.operators.contracts import fingerprint
from corrobora.operators.reuse import Reuse, row_digests


def chain(spark, folder, source, builds, factor=2):
    store = Reuse(spark, folder)

    def noted(name, fn):
        def build(*rows, **params):
            builds.append(name)
            return fn(*rows, **params)

        return build

    a = store.source("a", source)
    keys = store.table("keys", [a], noted("keys", lambda x: x.select("k").distinct()))
    sums = store.table("sums", [a], noted("sums", lambda x, factor: x.groupBy("k").agg((F.sum("v") * factor).alias("s"))), {"factor": factor})
    below = store.table("below", [keys], noted("below", lambda x: x.agg(F.count(F.lit(1)).alias("n"))))
    return a, sums, below


def test_only_tables_below_a_change_are_built(spark, tmp_path):
    folder, source = str(tmp_path / "store"), str(tmp_path / "a")
    rows = [(i % 3, i) for i in range(50)] + [(None, None), (1, 1), (1, 1)]
    spark.createDataFrame(rows, "k int, v long").repartition(4).write.parquet(source)
    builds: list[str] = []
    first, sums, _ = chain(spark, folder, source, builds)
    assert builds == ["keys", "sums", "below"] and first.status == "read" and first.n_rows == 53
    again, same, below = chain(spark, folder, source, builds)
    assert len(builds) == 3 and again.status == "known" and again.digest == first.digest and below.rows.first()["n"] == 4
    assert same.rows.sort("k").collect() == sums.rows.sort("k").collect()
    chain(spark, folder, source, builds, factor=3)
    assert builds[3:] == ["sums"]
    # One more row: a new file is read, the old ones are not; the keys come out the same, so what is below them stays.
    spark.createDataFrame([(2, 7)], "k int, v long").coalesce(1).write.mode("append").parquet(source)
    before = spark.read.parquet(f"{folder}/files").count()
    more, sums, below = chain(spark, folder, source, builds)
    assert builds[4:] == ["keys", "sums"] and more.n_rows == 54 and below.status == "reused"
    assert spark.read.parquet(f"{folder}/files").count() == before + 1
    # The old state of the source finds the old tables.
    old = str(tmp_path / "old")
    spark.createDataFrame(rows, "k int, v long").repartition(2).write.parquet(old)
    chain(spark, folder, old, builds)
    assert len(builds) == 6


def test_failed_builds_leave_no_entry_and_empty_sources_work(spark, tmp_path):
    folder, source = str(tmp_path / "store"), str(tmp_path / "empty")
    spark.createDataFrame([], "k int").write.parquet(source)
    store = Reuse(spark, folder)
    empty = store.source("empty", source)
    assert empty.n_rows == 0
    fails = lambda x: spark.range(1).select(F.raise_error(F.lit("no")).alias("k"))
    with pytest.raises(Exception, match="no"):
        store.table("t", [empty], fails)
    made = store.table("t", [empty], lambda x: x)
    assert made.status == "built" and made.n_rows == 0 and made.rows.columns == ["k"]
    assert {(r["table_name"], r["status"]) for r in store.report().collect()} == {("empty", "read"), ("t", "built")}


def test_digests_of_parts_add_up_and_see_types_and_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "")], "x int, `odd.name` string")
    of = lambda f: tuple(f.agg(*row_digests(f)).first())
    whole, a, b = of(df), of(df.filter("x = 1")), of(df.filter("x <> 1"))
    assert whole == (a[0] + b[0], a[1] + b[1], a[2] ^ b[2])
    assert of(df.withColumn("x", F.col("x").cast("long"))) != whole and of(df.na.fill("")) != whole
    assert fingerprint(df.select("x")).first()["n_rows"] == 4
