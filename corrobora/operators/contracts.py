"""Contract checks as jobs: every check yields rows, nothing is repaired or raised."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.functions.numeric import close_to


def column_contract(df: DataFrame, required: Sequence[str], exact: bool = False) -> DataFrame:
    """Missing (and, if exact, unexpected) columns as rows."""
    have = set(df.columns)
    rows = [(c, "missing") for c in required if c not in have]
    if exact:
        rows += [(c, "unexpected") for c in df.columns if c not in set(required)]
    return df.sparkSession.createDataFrame(rows, "column_name string, problem string")


def rule_report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows checked and rows failing for each rule, all rules in one pass.

    A rule that evaluates to NULL counts as failed.
    """
    counted = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[
            F.coalesce(F.sum((~F.coalesce(ok, F.lit(False))).cast("bigint")), F.lit(0)).alias(f"_r{i}")
            for i, ok in enumerate(rules.values())
        ],
    )
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("check"), F.col("_n").alias("n_rows"), F.col(f"_r{i}").alias("n_bad"))
            for i, name in enumerate(rules)
        ]
    )
    return counted.select(F.explode(pairs).alias("_x")).select("_x.*")


def null_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values per column, in one aggregate."""
    return rule_report(df, {c: F.col(c).isNotNull() for c in columns})


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def key_set_difference(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys present on one side only, labelled with the side that has them."""
    a = left.select(*key).distinct().withColumn("_l", F.lit(True))
    b = right.select(*key).distinct().withColumn("_r", F.lit(True))
    return (
        a.join(b, list(key), "full_outer")
        .filter(F.col("_l").isNull() | F.col("_r").isNull())
        .select(*key, F.when(F.col("_r").isNull(), "left_only").otherwise("right_only").alias("side"))
    )


def declared_counts(
    df: DataFrame, key: Sequence[str], declared: str, second: DataFrame, second_declared: str
) -> DataFrame:
    """Keys whose row count differs from its own declaration or from a second one."""
    actual = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(declared).alias("declared_min"),
        F.max(declared).alias("declared_max"),
    )
    both = actual.join(second.select(*key, F.col(second_declared).alias("second_declared")), list(key), "left")
    agrees = (
        (F.col("declared_min") == F.col("declared_max"))
        & (F.col("n_rows") == F.col("declared_min"))
        & (F.col("n_rows") == F.col("second_declared"))
    )
    return both.filter(~F.coalesce(agrees, F.lit(False)))


def minimum_coverage(scaffold: DataFrame, df: DataFrame, key: Sequence[str], minimum: int) -> DataFrame:
    """Row count of every frozen group against a minimum; an absent group counts zero and fails."""
    counted = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return scaffold.join(counted, list(key), "left").select(
        *scaffold.columns,
        F.coalesce("_n", F.lit(0)).alias("n_rows"),
        (F.coalesce("_n", F.lit(0)) >= minimum).alias("sufficient"),
    )


def label_audit(df: DataFrame, label: str, text_ok: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """Split rows into usable labels and an audit of excluded ones; labels are never repaired."""
    ok = F.coalesce(text_ok, F.lit(False))
    kept = df.filter(ok)
    audit = df.filter(~ok).withColumn("reason", F.lit(reason)).withColumn(label, F.col(label).cast("string"))
    return kept, audit


def recode(df: DataFrame, column: str, mapping: Mapping[str, str], name: str) -> tuple[DataFrame, DataFrame]:
    """Exact recode; labels outside the mapping are returned with their row counts."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    coded = df.withColumn(name, F.try_element_at(table, F.col(column)))
    unknown = coded.filter(F.col(name).isNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
    return coded.filter(F.col(name).isNotNull()), unknown


def mapping_audit(listed: DataFrame, matrix_keys: DataFrame, key: str, policy: str) -> DataFrame:
    """Every listed key with whether it occurs exactly; absent keys stay visible."""
    found = matrix_keys.select(key).distinct().withColumn("_found", F.lit(True))
    return (
        listed.join(found, key, "left")
        .withColumn("exact_match", F.col("_found").isNotNull())
        .withColumn("mapping_status", F.when(F.col("_found"), "exact_symbol").otherwise("missing_symbol"))
        .withColumn("mapping_policy", F.lit(policy))
        .drop("_found")
    )


def reconcile_counts(
    left: DataFrame, right: DataFrame, key: Sequence[str], count: str, group: Sequence[str]
) -> DataFrame:
    """Compare two sparse count tables cell by cell (absent = 0) and report per group."""
    a = left.select(*key, F.col(count).alias("_a"))
    b = right.select(*key, F.col(count).alias("_b"))
    x, y = F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0))
    return (
        a.join(b, list(key), "full_outer")
        .groupBy(*group)
        .agg(
            F.count(F.lit(1)).alias("n_compared"),
            F.sum((x != y).cast("bigint")).alias("n_unequal"),
            (F.sum((x != y).cast("bigint")) == 0).alias("exact_match"),
        )
    )


def reconcile_results(
    left: DataFrame, right: DataFrame, key: Sequence[str], values: Sequence[str], tolerance: float
) -> DataFrame:
    """Per value column: rows compared, one-sided rows and rows outside the tolerance (NULL = NULL)."""
    a = left.select(*key, *[F.col(v).alias(f"_a_{v}") for v in values], F.lit(1).alias("_in_a"))
    b = right.select(*key, *[F.col(v).alias(f"_b_{v}") for v in values], F.lit(1).alias("_in_b"))
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    joined = a.join(b, list(key), "full_outer")
    summed = joined.agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum((~both).cast("bigint")).alias("_one"),
        *[
            F.sum((both & ~close_to(F.col(f"_a_{v}"), F.col(f"_b_{v}"), tolerance)).cast("bigint")).alias(f"_x_{v}")
            for v in values
        ],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(v).alias("column_name"),
                F.col("_n").alias("n_keys"),
                F.coalesce("_one", F.lit(0)).alias("n_one_sided"),
                F.coalesce(f"_x_{v}", F.lit(0)).alias("n_outside_tolerance"),
            )
            for v in values
        ]
    )
    return summed.select(F.explode(rows).alias("_r")).select("_r.*")


def join_cardinality(left: DataFrame, right: DataFrame, keys: Sequence[str], expect: str) -> DataFrame:
    """Keys that break a declared join cardinality, as ``(side, *keys, n_rows)``; no row if it holds.

    ``expect`` is ``many_to_one`` (right keys are unique), ``one_to_many`` or ``one_to_one``. Rows without a
    key join nothing and are left out.
    """
    sides = {"many_to_one": ["right"], "one_to_many": ["left"], "one_to_one": ["left", "right"]}[expect]
    found = [
        df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1").select(F.lit(side).alias("side"), *keys, "n_rows")
        for side, df in (("left", left), ("right", right))
        if side in sides
    ]
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-free content digest and row count, for deciding whether a table changed.

    Two 64-bit row hashes are summed exactly and combined by XOR, so row order,
    partitioning and file layout do not matter but repeated rows do. Column names and types,
    and which values are missing, are part of the digest.
    """
    names = list(columns or sorted(df.columns))
    schema = ",".join(f"{n}:{df.schema[n].dataType.simpleString()}" for n in names)
    cols = [F.lit(schema), *[x for n in names for x in (F.col(n).isNull(), F.col(n))]]
    h = F.xxhash64(*cols)
    h2 = F.xxhash64(F.lit(1), *cols)
    return df.select(h.alias("_h"), h2.alias("_h2")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(F.col("_h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest_sum"),
        F.coalesce(F.bit_xor("_h2"), F.lit(0)).alias("digest_xor"),
    )


def canonical_line(texts: Mapping[str, Column]) -> Column:
    """One text of a row from texts of its columns: each with its name and length, so nothing can shift; ``-`` if missing."""
    parts = [
        F.coalesce(F.concat(F.lit(f"{name}="), F.length(text).cast("string"), F.lit(":"), text), F.lit(f"{name}-"))
        for name, text in texts.items()
    ]
    return F.concat_ws("|", *parts)


def text_fingerprint(df: DataFrame, line: Column) -> DataFrame:
    """Portable variant of :func:`fingerprint` over a canonical text of each row (MD5 based)."""
    word = F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("bigint")
    return df.select(word.alias("_h")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(F.col("_h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest_sum"),
        F.coalesce(F.bit_xor("_h"), F.lit(0)).alias("digest_xor"),
    )


def changed_tables(current: DataFrame, registered: DataFrame) -> DataFrame:
    """Compare fingerprints of two runs by table name: reuse, changed, new or gone."""
    b = registered.select(
        "table_name", *[F.col(c).alias(f"_r_{c}") for c in ("n_rows", "digest_sum", "digest_xor")]
    ).withColumn("_known", F.lit(True))
    same = (
        (F.col("n_rows") == F.col("_r_n_rows"))
        & (F.col("digest_sum") == F.col("_r_digest_sum"))
        & (F.col("digest_xor") == F.col("_r_digest_xor"))
    )
    status = (
        F.when(F.col("_known").isNull(), "new")
        .when(F.col("n_rows").isNull(), "gone")
        .when(same, "reuse")
        .otherwise("changed")
    )
    return current.join(b, "table_name", "full_outer").select("table_name", status.alias("status"))
