"""Reuse of derived tables by content: a table is rebuilt only if the rows of its inputs, or its parameters, changed."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

KNOWN = "path string, length long, modified timestamp, n_rows long, digest_sum decimal(38,0), digest_xor long"
ENTRY = "data string, n_rows long, digest_sum decimal(38,0), digest_xor long"


def row_digests(df: DataFrame) -> tuple[Column, Column, Column]:
    """Aggregates (n_rows, digest_sum, digest_xor) over all columns of ``df``; those of its parts add up to those of the whole."""
    names = sorted(df.columns)
    schema = ",".join(f"{n}:{df.schema[n].dataType.simpleString()}" for n in names)
    cols = [F.lit(schema), *[x for n in names for x in (F.col(f"`{n}`").isNull(), F.col(f"`{n}`"))]]
    return (
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(F.xxhash64(*cols).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias("digest_sum"),
        F.coalesce(F.bit_xor(F.xxhash64(F.lit(1), *cols)), F.lit(0)).alias("digest_xor"),
    )


@dataclass(frozen=True)
class Content:
    """A table with the digest of its rows, and whether it was there before."""

    name: str
    digest: str
    rows: DataFrame
    n_rows: int
    status: str


@dataclass
class Reuse:
    """Derived tables below ``folder``, which every executor must reach; another run that gives the same folder finds them.

    The digest of a source is kept for each of its files, by name, length and time of change: files that are
    as they were are not read again, and a source whose rows were only dealt to other files counts as unchanged. A derived table is known by the digests
    of its inputs, its parameters and ``version``, which stands for the code that builds it. Its own digest is observed in the pass that writes it, so
    a table that comes out with the rows it had leaves those below it as they are. A build that failed leaves no entry.
    """

    spark: SparkSession
    folder: str
    told: list[tuple[str, str, int]] = field(default_factory=list)

    def _at(self, path: str) -> tuple:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        store, p = self._at(path)
        return store.exists(p)

    def _known(self) -> DataFrame:
        path = f"{self.folder}/files"
        return self.spark.read.schema(KNOWN).parquet(path) if self._exists(path) else self.spark.createDataFrame([], KNOWN)

    def source(self, name: str, path: str) -> Content:
        """A Parquet table, of one file or a folder of them. Names of files come to the driver, as they do for any scan."""
        keys = ["path", "length", "modified"]
        listing = (
            self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
            .select("path", "length", F.col("modificationTime").alias("modified"))
        )
        fresh = [r["path"] for r in listing.join(self._known(), keys, "left_anti").collect()]
        whole = self.spark.read.parquet(path)
        if fresh:
            store, p = self._at(path)
            reader = self.spark.read.schema(whole.schema)
            changed = (reader.option("basePath", path) if store.getFileStatus(p).isDirectory() else reader).parquet(*fresh)
            decoded = F.url_decode(F.replace(F.col("_path"), F.lit("+"), F.lit("%2B")))
            parts = (
                changed.withColumn("_path", F.col("_metadata.file_path")).groupBy("_path").agg(*row_digests(changed))
                .withColumn("path", F.regexp_replace(decoded, "^file:///", "file:/"))
            )
            state = listing.filter(F.col("path").isin(fresh)) if len(fresh) <= 1000 else listing.join(self._known(), keys, "left_anti")
            zero = {"n_rows": F.lit(0).cast("long"), "digest_sum": F.lit(0).cast("decimal(38,0)"), "digest_xor": F.lit(0).cast("long")}
            found = state.join(parts, "path", "left").select(*keys, *[F.coalesce(c, z).alias(c) for c, z in zero.items()])
            # files without rows have a digest too, so that they are not read again
            found.write.mode("append").parquet(f"{self.folder}/files")
        known = self._known().dropDuplicates(keys)
        total = listing.join(known, keys).agg(F.sum("n_rows").alias("n"), F.sum("digest_sum").alias("s"), F.bit_xor("digest_xor").alias("x")).first()
        status = "read" if fresh else "known"
        self.told.append((name, status, total["n"] or 0))
        return Content(name, self._digest(whole, total["n"], total["s"], total["x"]), whole, total["n"] or 0, status)

    @staticmethod
    def _digest(df: DataFrame, *numbers: object) -> str:
        return hashlib.sha256(json.dumps([df.schema.simpleString(), *[str(n or 0) for n in numbers]]).encode()).hexdigest()

    def table(
        self, name: str, inputs: Sequence[Content], build: Callable[..., DataFrame], params: Mapping[str, object] | None = None, version: int = 1
    ) -> Content:
        """The table ``build`` makes from the inputs' rows and the parameters, read back if it was made from equal ones before."""
        made_of = json.dumps([name, [i.digest for i in inputs], dict(params or {}), version], sort_keys=True)
        entry = f"{self.folder}/entries/{name}-{hashlib.sha256(made_of.encode()).hexdigest()}"
        status = "reused"
        if not self._exists(f"{entry}/_SUCCESS"):
            status = "built"
            data = f"{self.folder}/data/{name}-{uuid.uuid4().hex}"
            rows = build(*[i.rows for i in inputs], **dict(params or {}))
            seen = Observation(f"{name}-{uuid.uuid4().hex}")
            rows.observe(seen, *row_digests(rows)).write.parquet(data)
            got = seen.get
            self.spark.createDataFrame([(data, got["n_rows"], got["digest_sum"], got["digest_xor"])], ENTRY).coalesce(1).write.mode("overwrite").parquet(entry)
        kept = self.spark.read.schema(ENTRY).parquet(entry).first()
        rows = self.spark.read.parquet(kept["data"])
        self.told.append((name, status, kept["n_rows"]))
        return Content(name, self._digest(rows, kept["n_rows"], kept["digest_sum"], kept["digest_xor"]), rows, kept["n_rows"], status)

    def report(self) -> DataFrame:
        """(table_name, status, n_rows) of everything asked for so far."""
        return self.spark.createDataFrame(self.told, "table_name string, status string, n_rows long")
