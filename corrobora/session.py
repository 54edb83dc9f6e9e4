"""Session helpers: lineage cuts, shared scratch space and joins with group statistics."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 16
"""Parts into which the rows of each group are dealt when they meet the group's statistics."""

PART_ROWS = 250_000
"""Rows of a partition whose tasks sort or hash all of them."""

_STORED: dict[tuple[str, str, str, tuple], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or one below the warehouse where that is unset."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and sc.getCheckpointDir() is not None:
        folder = sc.getCheckpointDir().rsplit("/", 1)[0]
    if folder is None:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from the written copy."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions for so many narrow rows: one for each core, or more, so that the memory of a task does not grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // PART_ROWS))


def join_statistics(rows: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows with the statistics of their group, of which ``stats`` has one row for each.

    The rows of a group are dealt to ``SALTS`` parts by a hash of the whole row, and the statistics are
    repeated for each part, so a group may hold any share of the rows.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(SALTS)))
    repeated = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def run_folder(spark: SparkSession) -> str:
    """Folder of everything that this application writes besides checkpoints."""
    return f"{shared_folder(spark).rstrip('/')}/run-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the run's folder for a derived text or Parquet table."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def folder_state(spark: SparkSession, source: str) -> tuple:
    """Name, length and time of change of every entry of a folder, one level deep; empty if there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return ()
    found = ((e.getPath().getName(), e.getLen(), e.getModificationTime()) for e in fs.listStatus(path))
    return tuple(sorted(found))


def _key(spark: SparkSession, source: str, name: str) -> tuple[str, str, str, tuple]:
    return (spark.sparkContext.applicationId, source, name, folder_state(spark, source))


def is_stored(spark: SparkSession, source: str, name: str) -> bool:
    """Whether :func:`stored` has a copy for the present state of the folder."""
    return _key(spark, source, name) in _STORED


def stored(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """A derived table that many jobs of a run read: written once for each state of the source folder, then read back.

    A table of the folder that was rewritten, added or removed since makes a new copy; so does a table folder
    whose files changed, where the file system keeps the time of that.
    """
    key = _key(spark, source, name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        build().write.partitionBy(*by).parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def clear_run(spark: SparkSession) -> None:
    """Delete what the application has stored; to be called at its end."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    for key in [k for k in _STORED if k[0] == spark.sparkContext.applicationId]:
        del _STORED[key]
