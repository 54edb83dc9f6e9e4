"""Stored tables follow their source folder."""

from __future__ import annotations

import contextlib
import io
import shutil

from corrobora import session
from corrobora.plans import bindings
from corrobora.plans.contracts import count_alignment
from corrobora.session import folder_state, stored


def test_changed_source_makes_a_new_copy(spark, tmp_path):
    folder, built = str(tmp_path / "src"), []

    def build():
        built.append(1)
        return spark.read.parquet(f"{folder}/t.parquet").selectExpr("sum(id) AS n")

    def total() -> int:
        return stored(spark, folder, "total", build).first()["n"]

    spark.range(10).write.parquet(f"{folder}/t.parquet")
    assert (total(), total(), len(built)) == (45, 45, 1)
    spark.range(11).write.mode("overwrite").parquet(f"{folder}/t.parquet")
    assert (total(), len(built)) == (55, 2)
    spark.range(5).write.parquet(f"{folder}/u.parquet")
    assert (total(), len(built)) == (55, 3)
    assert folder_state(spark, str(tmp_path / "none")) == ()


def test_tasks_of_larger_tables_hold_no_more_rows(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "tables")
    shutil.copytree("/root/testdata/sf0.001", folder)
    monkeypatch.setattr(session, "PART_ROWS", 100)
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    parts = -(-lines.count() // 100)
    assert session.parts_for(spark, lines.count()) == parts > spark.sparkContext.defaultParallelism
    assert session.parts_for(spark, 1) == spark.sparkContext.defaultParallelism
    assert len(bindings.counts(spark, folder).inputFiles()) > parts // 2
    aligned = count_alignment(spark, folder)
    told = io.StringIO()
    with contextlib.redirect_stdout(told):
        aligned.explain()
    dealt = [x for x in told.getvalue().splitlines() if "hashpartitioning(library" in x and "cell_id" in x]
    assert len(dealt) == 2 and all(f", {parts}), REPARTITION_BY_NUM" in x for x in dealt)
    assert [r["n_unequal"] > 0 for r in aligned.orderBy("library").collect()] == [False, False, True]
