"""Text scans with declared schemas. A line that does not fit is returned as a violation row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CORRUPT = "_corrupt_record"


def _place() -> Column:
    """Where a line stands: blocks of a file in order, and lines in order inside a block."""
    return F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: str,
    sep: str = "\t",
    junk: str | None = None,
    header: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Rows of the declared schema, and the lines that did not parse.

    ``junk`` is a pattern for title or note lines to leave out; they then may stand above
    the header, which is the first line of a file that is made of the column names.
    """
    lines = spark.read.text(path)
    if junk:
        lines = lines.filter(~F.col("value").rlike(junk))
    if header:
        named = sep.join(StructType.fromDDL(schema).names)
        titles = lines.withColumn("_at", _place()).filter(F.col("value") == named)
        one = titles.groupBy("_metadata.file_path").agg(F.min("_at").alias("_title"))
        lines = (
            lines.withColumn("_at", _place())
            .withColumn("_file", F.col("_metadata.file_path"))
            .join(one.withColumnRenamed("file_path", "_file"), "_file", "left")
            .filter(F.coalesce(F.col("_at") != F.col("_title"), F.lit(True)))
            .select("value")
        )
    full = f"{schema}, {CORRUPT} string"
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    rows = lines.select(F.from_csv("value", F.lit(full), options).alias("_r")).select("_r.*")
    return rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), rows.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def read_wide_counts(
    spark: SparkSession, path: str, sep: str = ",", names: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Gene-by-cell text to sparse ``(cell_id, gene_id, umi)``, and violations ``(gene_id, problem)``.

    The header is the first line of the first file, or ``names`` if the text has none; its corner cell may be
    absent. Lines with a bad count or another width, and genes that stand in several lines, are violations
    and not counted; a cell that the header names twice is one too, and none of its columns counts.
    """
    at = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select("value", at.alias("_at"))
    if names is None:
        first = lines.agg(F.min("_at").alias("at"), F.min_by("value", "_at").alias("value")).first()
        names = (first["value"] or "").split(sep) if first["at"] else []
        names = names[1:] if names and names[0] == "" else names
        if first["at"]:
            path_at, *place = first["at"]
            lines = lines.filter(F.col("_at") > F.struct(F.lit(path_at), *[F.lit(x).cast("bigint") for x in place]))
    width = len(names)
    head = spark.createDataFrame([(i, n, names.count(n) == 1) for i, n in enumerate(names)], "ordinal int, cell_id string, once boolean")
    fields = F.split("value", sep, -1)
    rows = lines.select(
        F.regexp_replace(F.get(fields, F.lit(0)), '^"|"$', "").alias("gene_id"),
        F.transform(F.slice(fields, 2, F.size(fields)), lambda x: x.try_cast("int")).alias("values"),
    ).withColumn(
        "problem",
        F.when(F.size("values") != width, "width").when(F.exists("values", lambda v: v.isNull() | (v < 0)), "count"),
    )
    repeated = rows.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gene_id")
    counts = (
        rows.filter("problem IS NULL")
        .join(repeated, "gene_id", "left_anti")
        .select("gene_id", F.posexplode("values").alias("ordinal", "umi"))
        .filter("umi > 0")
        .join(F.broadcast(head.filter("once")), "ordinal")  # the header, one line
        .select("cell_id", "gene_id", "umi")
    )
    violations = (
        rows.filter("problem IS NOT NULL").select("gene_id", "problem")
        .unionByName(repeated.withColumn("problem", F.lit("repeated_gene")))
        .unionByName(head.filter("NOT once").select(F.col("cell_id").alias("gene_id")).distinct().withColumn("problem", F.lit("repeated_cell")))
    )
    return counts, violations


def read_triplets(
    spark: SparkSession, path: str, dims_path: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Coordinate-format counts ``(row, col, value)`` and a one-row check against the declared size.

    Entries that do not parse, have a place outside the declared size or a negative value are invalid;
    entries that share a place are repeated. Only a check without any is ``consistent``.

    The size line is the first line after the comments of a single file, or comes from its
    own file when the entries are spread over many.
    """
    lines = spark.read.text(path).select("value", _place().alias("_at")).filter(~F.col("value").startswith("%"))
    if dims_path:
        size_line = spark.read.text(dims_path).filter(~F.col("value").startswith("%")).first()["value"]
    else:
        first = lines.agg(F.min_by("value", "_at").alias("value"), F.min("_at").alias("at")).first()
        size_line = first["value"]
        start, row = first["at"]
        lines = lines.filter(F.col("_at") > F.struct(F.lit(start).cast("bigint"), F.lit(row).cast("bigint")))
    n_rows, n_cols, n_entries = (int(x) for x in size_line.split())
    t = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.try_cast("bigint"))
    entry = lines.select(t.alias("t")).select(
        F.col("t")[0].alias("row"), F.col("t")[1].alias("col"), F.col("t")[2].alias("value")
    )
    bad = F.coalesce(
        F.col("row").isNull() | F.col("col").isNull() | F.col("value").isNull()
        | (F.col("row") < 1) | (F.col("col") < 1) | (F.col("value") < 0) | (F.col("row") > n_rows) | (F.col("col") > n_cols),
        F.lit(True),
    )
    places = entry.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_bad"))
    n_all, n_bad = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_bad"), F.lit(0))
    n_repeated = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
    check = places.agg(
        n_all.alias("n_entries"),
        F.lit(n_rows).cast("bigint").alias("declared_rows"),
        F.lit(n_cols).cast("bigint").alias("declared_cols"),
        F.lit(n_entries).cast("bigint").alias("declared_entries"),
        n_bad.alias("n_invalid"),
        n_repeated.alias("n_repeated"),
        ((n_all == n_entries) & (n_bad == 0) & (n_repeated == 0)).alias("consistent"),
    )
    return entry, check


def label_triplets(entries: DataFrame, features: DataFrame, barcodes: DataFrame) -> DataFrame:
    """Replace 1-based ordinals by feature and barcode names."""
    return (
        entries.join(features.select(F.col("ordinal").alias("row"), "gene_id"), "row")
        .join(barcodes.select(F.col("ordinal").alias("col"), "cell_id"), "col")
        .select("cell_id", "gene_id", F.col("value").alias("umi"))
    )


def read_gene_sets(spark: SparkSession, path: str, drop_prefix: str = "MT-") -> DataFrame:
    """Tab-separated set lines to ``(program, ordinal, gene_id)``: first occurrences, prefix dropped."""
    f = F.split("value", "\t")
    genes = F.filter(F.array_distinct(F.slice(f, 3, F.size(f))), lambda g: ~g.startswith(drop_prefix) & (g != ""))
    return spark.read.text(path).select(F.get(f, F.lit(0)).alias("program"), F.posexplode(genes).alias("ordinal", "gene_id"))


def read_annotation(spark: SparkSession, path: str, feature: str = "gene", attribute: str = "gene_name") -> DataFrame:
    """Feature annotation rows of one kind as 0-based half-open intervals with a named attribute."""
    schema = (
        "chrom string, source string, feature string, first bigint, last bigint, "
        "score string, strand string, frame string, attributes string"
    )
    rows = spark.read.schema(schema).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)
    return rows.filter(F.col("feature") == feature).select(
        F.regexp_extract("attributes", f'{attribute} "([^"]+)"', 1).alias("gene"),
        "chrom",
        (F.col("first") - F.lit(1)).alias("start"),
        F.col("last").alias("end"),
        "strand",
    ).filter(F.col("gene") != "")


MAPPING_SCHEMA = (
    "map<string, struct<name: string, mappings: array<struct<assembly_name: string, "
    "seq_region_name: string, start: bigint, `end`: bigint>>>>"
)


def explode_mappings(df: DataFrame, text: str) -> DataFrame:
    """Nested JSON ``{id: {name, mappings: [...]}}`` to one row per id with its mapping array."""
    parsed = df.select(F.explode(F.from_json(text, F.lit(MAPPING_SCHEMA))).alias("variant_id", "record"))
    return parsed.select("variant_id", F.col("record.name").alias("name"), F.col("record.mappings").alias("mappings"))
