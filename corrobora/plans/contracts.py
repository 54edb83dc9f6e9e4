"""Contract, set and reconciliation queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.functions.numeric import checked_cast, finite, rounded
from corrobora.operators import contracts
from corrobora.operators import counts as ops
from corrobora.operators import reuse
from corrobora.plans import bindings as b
from corrobora.plans.bindings import r, with_ctes
from corrobora.plans.registry import query
from corrobora.session import parts_for, scratch_path
from corrobora.sources import digests, tables
from corrobora.sources.tables import load
from corrobora.sources.text import read_delimited


def report_sql(table: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS \"check\", count(*) AS n_rows, count(*) FILTER (WHERE NOT coalesce({ok}, false)) AS n_bad FROM {table}"
        for n, ok in rules.items()
    )


DOMAIN = {
    "quantity_positive": "l_quantity > 0",
    "quantity_whole": "l_quantity = floor(l_quantity)",
    "discount_in_unit_range": "l_discount BETWEEN 0 AND 1",
    "discount_open_interval": "l_discount > 0 AND l_discount < 1",
    "flag_known": "l_returnflag IN ('A', 'R')",
    "line_status_known": "l_linestatus IN ('O', 'F')",
}


@query("domain_contract", report_sql("lineitem", {**DOMAIN, "price_finite": "isfinite(l_extendedprice)"}))
def domain_contract(spark: SparkSession, d: str) -> DataFrame:
    rules = {n: F.expr(e) for n, e in DOMAIN.items()}
    return contracts.rule_report(load(spark, d, "lineitem"), {**rules, "price_finite": finite(F.col("l_extendedprice"))})


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("missing_value_contract", report_sql("orders", {c: f"{c} IS NOT NULL" for c in ORDER_COLUMNS}))
def missing_value_contract(spark: SparkSession, d: str) -> DataFrame:
    """Missing values of every column, in one aggregate."""
    orders = load(spark, d, "orders")
    return contracts.null_report(orders, orders.columns)


@query(
    "record_schema_contract",
    """SELECT count(*) AS n_rows, count(*) FILTER (WHERE length(p) - length(replace(p, '|', '')) <> 2) AS n_malformed
FROM (SELECT CASE WHEN c_acctbal < 0 THEN c_custkey || '|' || c_mktsegment ELSE c_custkey || '|' || c_mktsegment || '|' || c_nationkey END AS p FROM customer)""",
)
def record_schema_contract(spark: SparkSession, d: str) -> DataFrame:
    """Delimited text whose negative-balance rows lack a field; those must surface as violations."""
    short = F.concat_ws("|", "c_custkey", "c_mktsegment")
    line = F.when(F.col("c_acctbal") < 0, short).otherwise(F.concat_ws("|", short, F.col("c_nationkey")))
    path = scratch_path(spark, "customers")
    load(spark, d, "customer").select(line.alias("value")).write.text(path)
    good, bad = read_delimited(spark, path, "c_custkey bigint, c_mktsegment string, c_nationkey int", "|", header=False)
    both = good.select(F.lit(0).alias("bad")).unionByName(bad.select(F.lit(1).alias("bad")))
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("bad").alias("n_malformed"))


@query(
    "column_contract",
    """SELECT 'p_container' AS column_name, 'missing' AS problem, CAST(NULL AS BIGINT) AS n_present
UNION ALL SELECT 'p_brand', 'unexpected', count(p_brand) FROM part
UNION ALL SELECT 'p_retailprice', 'unexpected', count(p_retailprice) FROM part
UNION ALL SELECT 'p_size', 'unexpected', count(p_size) FROM part""",
)
def column_contract(spark: SparkSession, d: str) -> DataFrame:
    """Columns that break the exact set, with how many rows an unexpected one fills."""
    part = load(spark, d, "part")
    broken = contracts.column_contract(part, ["p_partkey", "p_name", "p_type", "p_container"], exact=True)
    filled = contracts.null_report(part, part.columns).select(
        F.col("check").alias("column_name"), (F.col("n_rows") - F.col("n_bad")).alias("n_present")
    )
    return broken.join(filled, "column_name", "left")


@query(
    "duplicate_line_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_line_keys(spark: SparkSession, d: str) -> DataFrame:
    return contracts.duplicate_keys(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "one_sided_order_keys",
    """SELECT k AS orderkey, 'left_only' AS side FROM (SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem)
UNION ALL SELECT k, 'right_only' FROM (SELECT l_orderkey AS k FROM lineitem EXCEPT SELECT o_orderkey FROM orders)""",
)
def one_sided_order_keys(spark: SparkSession, d: str) -> DataFrame:
    left = load(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"))
    right = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"))
    return contracts.key_set_difference(left, right, ["orderkey"])


@query(
    "declared_turn_counts",
    """SELECT conv_id, n_rows, declared_min, declared_max, second_declared FROM (
  SELECT conv_id, count(*) AS n_rows, min(m) AS declared_min, max(m) AS declared_max, max(length(text)) AS second_declared FROM (
    SELECT *, length(role) AS m FROM conversations) GROUP BY 1)
WHERE NOT coalesce(declared_min = declared_max AND n_rows = declared_min AND n_rows = second_declared, false)""",
)
def declared_turn_counts(spark: SparkSession, d: str) -> DataFrame:
    """Turns per conversation against two unrelated declarations, so that mismatches are plenty."""
    turns = load(spark, d, "conversations")
    second = turns.groupBy("conv_id").agg(F.max(F.length("text")).alias("declared_b"))
    return contracts.declared_counts(
        turns.withColumn("declared_a", F.length("role")), ["conv_id"], "declared_a", second, "declared_b"
    )


@query(
    "frozen_group_coverage",
    """SELECT o_orderpriority, o_orderstatus, coalesce(n, 0) AS n_rows, coalesce(n, 0) >= 1000 AS sufficient
FROM (SELECT cell_type AS o_orderpriority FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) v(cell_type))
CROSS JOIN (VALUES ('F'), ('O'), ('P'), ('X')) s(o_orderstatus)
LEFT JOIN (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) USING (o_orderpriority, o_orderstatus)""",
)
def frozen_group_coverage(spark: SparkSession, d: str) -> DataFrame:
    frozen = spark.createDataFrame([(t, s) for t in b.TYPES for s in "FOPX"], "o_orderpriority string, o_orderstatus string")
    return contracts.minimum_coverage(frozen, load(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], 1000)


@query(
    "label_audit",
    """SELECT doc_id, CAST(n_chars AS VARCHAR) AS label, 'label is a number' AS reason FROM documents WHERE n_chars % 2 = 0""",
)
def label_audit(spark: SparkSession, d: str) -> DataFrame:
    """Labels are a word of the text, or a bare number where the length is even; numbers are excluded."""
    docs = load(spark, d, "documents").select(
        "doc_id",
        F.when(F.col("n_chars") % 2 == 0, F.col("n_chars").cast("string")).otherwise(F.concat(F.lit("w"), F.col("lang"))).alias("label"),
    )
    _, audit = contracts.label_audit(docs, "label", ~F.col("label").rlike(r"^\d+$"), "label is a number")
    return audit


@query(
    "numeric_cast_audit",
    """SELECT count(*) AS n_rows, count(TRY_CAST(w AS BIGINT)) AS n_converted, count(*) FILTER (WHERE w IS NOT NULL AND TRY_CAST(w AS BIGINT) IS NULL) AS n_failed
FROM (SELECT CASE WHEN quality = 1 THEN 'good' ELSE CAST(doc_id AS VARCHAR) END AS w FROM labels)""",
)
def numeric_cast_audit(spark: SparkSession, d: str) -> DataFrame:
    word = F.when(F.col("quality") == 1, "good").otherwise(F.col("doc_id").cast("string"))
    value, failed = checked_cast(word, "bigint")
    return load(spark, d, "labels").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(value).alias("n_converted"), F.count_if(failed).alias("n_failed")
    )


@query(
    "count_alignment",
    with_ctes(
        """SELECT library, count(*) AS n_compared, count(*) FILTER (WHERE coalesce(a, 0) <> coalesce(c, 0)) AS n_unequal,
  count(*) FILTER (WHERE coalesce(a, 0) <> coalesce(c, 0)) = 0 AS exact_match
FROM (SELECT library, cell_id, gene_id, umi AS a FROM counts JOIN labels0 USING (cell_id)) FULL OUTER JOIN
  (SELECT o_orderstatus AS library, l_orderkey AS cell_id, l_partkey AS gene_id, CAST(sum(CASE WHEN o_orderstatus = 'P' AND l_returnflag = 'A' THEN 0 ELSE CAST(l_quantity AS INTEGER) END) AS BIGINT) AS c
   FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3) USING (library, cell_id, gene_id)
GROUP BY 1""",
        "counts", "labels0",
    ),
)
def count_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Two distributions of the same counts, of which the second loses some lines of one library."""
    lines = load(spark, d, "lineitem")
    parts = parts_for(spark, lines.count())
    key = ["library", "cell_id", "gene_id"]
    library = b.cell_labels(spark, d).select("cell_id", "library").repartition(parts, "cell_id")
    first = b.counts(spark, d).repartition(parts, "cell_id").join(library, "cell_id")
    lost = (F.col("library") == "P") & (F.col("l_returnflag") == "A")
    second = (
        lines.select(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene_id"), "l_returnflag", F.col("l_quantity").cast("int").alias("n"))
        .repartition(parts, "cell_id")
        .join(library, "cell_id")
        .repartition(parts, *key)  # hardly any lines share a key, so nothing is lost by adding them up only where they meet
        .groupBy(*key)
        .agg(F.sum(F.when(lost, F.lit(0)).otherwise(F.col("n"))).alias("umi"))
    )
    return contracts.reconcile_counts(first.repartition(parts, *key), second, key, "umi", ["library"])


@query(
    "metadata_count_agreement",
    with_ctes(
        """SELECT v.column_name, count(*) AS n_keys, CAST(0 AS BIGINT) AS n_one_sided,
  count(*) FILTER (WHERE CASE v.column_name WHEN 'total' THEN total <> t2 ELSE n_genes <> g2 END) AS n_outside_tolerance
FROM metrics JOIN (SELECT l_orderkey AS cell_id, CAST(sum(l_quantity) AS BIGINT) AS t2, count(*) AS g2 FROM lineitem GROUP BY 1) USING (cell_id)
CROSS JOIN (VALUES ('total'), ('n_genes')) v(column_name) GROUP BY 1""",
        "metrics",
    ),
)
def metadata_count_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Per-cell metrics against the same figures counted from raw lines (repeated lines differ)."""
    mine = ops.cell_metrics(b.counts(spark, d), b.genes(spark, d)).select("cell_id", "total", "n_genes")
    raw = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id")).agg(
        F.sum("l_quantity").cast("bigint").alias("total"), F.count(F.lit(1)).alias("n_genes")
    )
    return contracts.reconcile_results(mine, raw, ["cell_id"], ["total", "n_genes"], 1e-10)


SETS = {
    "union_all": "SELECT l_partkey FROM a UNION ALL SELECT l_partkey FROM z",
    "distinct": "SELECT DISTINCT l_partkey FROM (SELECT l_partkey FROM a UNION ALL SELECT l_partkey FROM z)",
    "intersection": "SELECT l_partkey FROM a INTERSECT SELECT l_partkey FROM z",
    "difference": "SELECT l_partkey FROM a EXCEPT SELECT l_partkey FROM z",
}


@query(
    "key_set_operations",
    "WITH a AS (SELECT l_partkey FROM lineitem WHERE l_quantity > 49), z AS (SELECT l_partkey FROM lineitem WHERE l_discount > 0.095) "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS operation, count(*) AS n_keys, CAST(sum(l_partkey) AS BIGINT) AS key_sum FROM ({q})" for n, q in SETS.items()
    ),
)
def key_set_operations(spark: SparkSession, d: str) -> DataFrame:
    line = load(spark, d, "lineitem")
    a = line.filter("l_quantity > 49").select("l_partkey")
    z = line.filter("l_discount > 0.095").select("l_partkey")
    results = {
        "union_all": a.unionByName(z),
        "distinct": a.unionByName(z).distinct(),
        "intersection": a.distinct().join(z, "l_partkey", "left_semi"),
        "difference": a.distinct().join(z, "l_partkey", "left_anti"),
    }
    counted = [
        df.agg(F.count(F.lit(1)).alias("n_keys"), F.sum("l_partkey").alias("key_sum")).withColumn("operation", F.lit(n))
        for n, df in results.items()
    ]
    return reduce(DataFrame.unionByName, counted).select("operation", "n_keys", "key_sum")


# Columns by how their values become text: as they are, as a number of billionths rounded down, or as microseconds.
TABLES: dict[str, str] = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal:number c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal:number",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice:number",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice:number o_orderdate:time o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity:number l_extendedprice:number l_discount:number "
    "l_tax:number l_returnflag l_linestatus l_shipdate:time",
    "events": "event_id ts:time user_id event_type value:number props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding:numbers label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}


def _kinds(table: str) -> dict[str, str]:
    return {name: kind for name, _, kind in (c.partition(":") for c in TABLES[table].split())}


def _value_text(name: str, kind: str) -> Column:
    billionths = lambda x: F.floor(x.cast("double") * F.lit(1e9)).cast("string")
    if kind == "number":
        return billionths(F.col(name))
    if kind == "numbers":
        return F.array_join(F.transform(name, billionths), ",", "-")
    return F.unix_micros(F.col(name).cast("timestamp")).cast("string") if kind == "time" else F.col(name).cast("string")


def _value_sql(name: str, kind: str) -> str:
    billionths = lambda x: f"CAST(CAST(floor({x}::DOUBLE * 1000000000.0::DOUBLE) AS BIGINT) AS VARCHAR)"
    text = {
        "number": billionths(name),
        "numbers": f"array_to_string(list_transform({name}, lambda x: coalesce({billionths('x')}, '-')), ',')",
        "time": f"CAST(epoch_us({name}) AS VARCHAR)",
    }.get(kind, f"CAST({name} AS VARCHAR)")
    return f"coalesce('{name}=' || length({text}) || ':' || {text}, '{name}-')"


@query(
    "table_fingerprints",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows, CAST(sum(h) AS VARCHAR) AS digest_sum, bit_xor(h) AS digest_xor "
        f"FROM (SELECT ('0x' || substr(md5(concat_ws('|', {', '.join(_value_sql(n, k) for n, k in _kinds(t).items())})), 1, 15))::BIGINT AS h FROM {t})"
        for t in TABLES
    ),
)
def table_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """All columns of all tables; a missing value differs from every text."""
    parts = [
        contracts.text_fingerprint(
            load(spark, d, t), contracts.canonical_line({n: _value_text(n, k) for n, k in _kinds(t).items()})
        ).withColumn("table_name", F.lit(t))
        for t in TABLES
    ]
    return reduce(DataFrame.unionByName, parts).select("table_name", "n_rows", "digest_sum", "digest_xor")


@query(
    "join_cardinality_violations",
    """SELECT 'right' AS side, c_custkey AS key, 2::BIGINT AS n_rows FROM customer WHERE c_custkey % 50 = 0
UNION ALL SELECT 'left', o_custkey, count(*) FROM orders GROUP BY 2 HAVING count(*) > 1""",
)
def join_cardinality_violations(spark: SparkSession, d: str) -> DataFrame:
    """Orders against customers of which some stand twice, declared one to one."""
    customer = load(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    twice = customer.unionByName(customer.filter("key % 50 = 0"))
    orders = load(spark, d, "orders").select(F.col("o_custkey").alias("key"))
    return contracts.join_cardinality(orders, twice, ["key"], "one_to_one")


def _digest_sql(name: str, source: str, columns: str) -> str:
    return f"SELECT '{name}' AS t, count(*) AS n, sum(hash({columns})::HUGEINT) AS h FROM {source}"


@query(
    "table_reuse_decision",
    "WITH now AS ("
    + " UNION ALL ".join(
        [
            _digest_sql("orders", "orders", "o_orderkey, o_custkey, o_totalprice"),
            _digest_sql("customer", "customer", "c_custkey, c_acctbal"),
            _digest_sql("part", "part", "p_partkey"),
        ]
    )
    + "), earlier AS ("
    + " UNION ALL ".join(
        [
            _digest_sql("orders", "orders", "o_orderkey, o_custkey, o_totalprice"),
            _digest_sql("customer", "customer WHERE c_acctbal > 0", "c_custkey, c_acctbal"),
            _digest_sql("nation", "nation", "n_nationkey"),
        ]
    )
    + """)
SELECT t AS table_name, CASE WHEN earlier.n IS NULL THEN 'new' WHEN now.n IS NULL THEN 'gone'
  WHEN now.n = earlier.n AND now.h = earlier.h THEN 'reuse' ELSE 'changed' END AS status
FROM now FULL OUTER JOIN earlier USING (t)""",
)
def table_reuse_decision(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of this run against those of a run that saw fewer customers and other tables."""

    def prints(frames: dict[str, DataFrame]) -> DataFrame:
        return reduce(
            DataFrame.unionByName, [contracts.fingerprint(f).withColumn("table_name", F.lit(n)) for n, f in frames.items()]
        )

    orders, customer = load(spark, d, "orders"), load(spark, d, "customer")
    now = prints({"orders": orders, "customer": customer, "part": load(spark, d, "part")})
    before = prints(
        {"orders": orders.orderBy(F.desc("o_totalprice")), "customer": customer.filter("c_acctbal > 0"), "nation": load(spark, d, "nation")}
    )
    return contracts.changed_tables(now, before)


@query(
    "saved_result_invariants",
    with_ctes(
        """SELECT 'gene_within_library' AS "check", count(*) AS n_rows, count(*) FILTER (WHERE sum_gene_umis > sum_all_umis) AS n_bad FROM cube WHERE sum_gene_umis IS NOT NULL
UNION ALL SELECT 'detected_fraction_in_range', count(*), count(*) FILTER (WHERE pct_detected < 0 OR pct_detected > 100) FROM cube WHERE sum_gene_umis IS NOT NULL
UNION ALL SELECT 'gene_counts_conserve_library', count(*), count(*) FILTER (WHERE s <> a) FROM (
  SELECT qc, donor, cell_type, sum(sum_gene_umis) AS s, max(sum_all_umis) AS a FROM cube WHERE n_cells > 0 GROUP BY 1, 2, 3)
UNION ALL SELECT 'groups_per_gene_fixed', count(*), count(*) FILTER (WHERE n <> 50) FROM (SELECT gene_id, count(*) AS n FROM cube GROUP BY 1)""",
        "cube",
    ),
)
def saved_result_invariants(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "cube")
    tables.write_new_parquet(b.cube(spark, d), path)
    cube = spark.read.parquet(path)
    known = cube.filter("sum_gene_umis IS NOT NULL")
    per_row = contracts.rule_report(
        known,
        {
            "gene_within_library": F.col("sum_gene_umis") <= F.col("sum_all_umis"),
            "detected_fraction_in_range": F.col("pct_detected").between(0, 100),
        },
    )
    groups = cube.filter("n_cells > 0").groupBy("qc", "donor", "cell_type").agg(
        F.sum("sum_gene_umis").alias("s"), F.max("sum_all_umis").alias("a")
    )
    sizes = cube.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_row.unionByName(contracts.rule_report(groups, {"gene_counts_conserve_library": F.col("s") == F.col("a")}))
        .unionByName(contracts.rule_report(sizes, {"groups_per_gene_fixed": F.col("n") == 50}))
    )


@query(
    "source_file_registry",
    """WITH found AS (SELECT CAST(page_id AS VARCHAR) AS file, strlen(html) AS bytes_found, sha256(html) AS sha256_found, md5(html) AS md5_found
  FROM pages WHERE page_id % 11 <> 0),
declared AS (SELECT CAST(page_id AS VARCHAR) AS file, strlen(html) + (page_id % 7 = 0)::INT AS bytes,
  CASE WHEN page_id % 5 = 0 THEN sha256(url) ELSE sha256(html) END AS sha256 FROM pages WHERE page_id % 13 <> 0)
SELECT file, bytes, bytes_found, sha256_found, md5_found, CASE WHEN bytes_found IS NULL THEN 'missing_file' WHEN bytes IS NULL THEN 'undeclared_file'
  WHEN bytes <> bytes_found THEN 'size_mismatch' WHEN sha256 <> sha256_found THEN 'digest_mismatch' ELSE 'verified' END AS status
FROM declared FULL OUTER JOIN found USING (file)""",
)
def source_file_registry(spark: SparkSession, d: str) -> DataFrame:
    """Downloaded pages against a registry; some are missing, undeclared, or declared with another size or digest."""
    pages = load(spark, d, "pages").withColumn("file", F.col("page_id").cast("string"))
    found = tables.content_digests(pages.filter("page_id % 11 <> 0"), "file", F.encode("html", "UTF-8"))
    declared = pages.filter("page_id % 13 <> 0").select(
        "file",
        (F.octet_length("html") + F.when(F.col("page_id") % 7 == 0, 1).otherwise(0)).cast("bigint").alias("bytes"),
        F.sha2(F.when(F.col("page_id") % 5 == 0, F.col("url")).otherwise(F.col("html")), 256).alias("sha256"),
    )
    return tables.compare_registry(declared, found).select("file", "bytes", "bytes_found", "sha256_found", "md5_found", "status")


def _reuse_run(spark: SparkSession, folder: str, orders: str, customer: str, run: str) -> DataFrame:
    """Five tables below orders and customers, as far as they are not there yet."""
    store = reuse.Reuse(spark, folder)
    o, c = store.source("orders", orders), store.source("customer", customer)
    number = store.table("orders_per_customer", [o], lambda x: x.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")))
    store.table("spend_per_customer", [o], lambda x: x.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,4)")).alias("spend")))
    store.table("customers_per_number", [number], lambda x: x.groupBy("n").agg(F.count(F.lit(1)).alias("customers")))
    store.table("active_customers", [number, c], lambda x, y, least: y.join(x.filter(F.col("n") >= least), y.c_custkey == x.o_custkey, "left_semi"), {"least": 2})
    store.table("customers_per_nation", [c], lambda x: x.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers")))
    return store.report().withColumn("run", F.lit(run))


@query(
    "content_keyed_reuse",
    """WITH number AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
sizes AS (SELECT 'orders' AS table_name, count(*) AS n_rows FROM orders UNION ALL SELECT 'customer', count(*) FROM customer
  UNION ALL SELECT 'orders_per_customer', count(*) FROM number UNION ALL SELECT 'spend_per_customer', count(*) FROM number
  UNION ALL SELECT 'customers_per_number', count(DISTINCT n) FROM number
  UNION ALL SELECT 'active_customers', count(*) FROM customer JOIN number ON c_custkey = o_custkey WHERE n >= 2
  UNION ALL SELECT 'customers_per_nation', count(DISTINCT c_nationkey) FROM customer)
SELECT run, table_name, n_rows, CASE
  WHEN table_name IN ('orders', 'customer') THEN CASE WHEN run = 'first' OR table_name = 'orders' THEN 'read' ELSE 'known' END
  WHEN run = 'first' OR run = 'changed' AND table_name IN ('orders_per_customer', 'spend_per_customer') THEN 'built' ELSE 'reused' END AS status
FROM sizes CROSS JOIN (VALUES ('first'), ('rewritten'), ('changed')) v(run)""",
)
def content_keyed_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Three runs over one store: as given, with the orders dealt to other files, and with one order's price changed.

    The change builds the two tables made of orders. The number of orders comes out as it was, so what is below stays.
    """
    folder, customer = scratch_path(spark, "reuse"), f"{d.rstrip('/')}/customer.parquet"
    orders = load(spark, d, "orders")
    rewritten, changed = scratch_path(spark, "orders"), scratch_path(spark, "orders")
    orders.repartition(5, "o_custkey").write.parquet(rewritten)
    least = orders.agg(F.min("o_orderkey")).first()[0]
    price = F.when(F.col("o_orderkey") == least, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).cast(orders.schema["o_totalprice"].dataType)
    orders.withColumn("o_totalprice", price).write.parquet(changed)
    paths = {"first": f"{d.rstrip('/')}/orders.parquet", "rewritten": rewritten, "changed": changed}
    return reduce(DataFrame.unionByName, [_reuse_run(spark, folder, p, customer, run) for run, p in paths.items()]).select("run", "table_name", "n_rows", "status")


PAGE_CHUNK = 256
LEAVES = f"""bytes AS (SELECT page_id, encode(html) AS b, octet_length(encode(html)) AS n FROM pages),
chunks AS (SELECT page_id, n, b, unnest(range(greatest(1, (n + {PAGE_CHUNK - 1}) // {PAGE_CHUNK}))) AS chunk FROM bytes)"""


@query(
    "chunk_digest_roots",
    f"""WITH {LEAVES},
hexa AS (SELECT page_id, n, chunk, sha256(unhex(substr(hex(b), chunk * {2 * PAGE_CHUNK} + 1, {2 * PAGE_CHUNK}))) AS digest FROM chunks)
SELECT CAST(page_id AS VARCHAR) AS file, CAST(n AS BIGINT) AS bytes_found, count(*) AS n_chunks,
  sha256(n || ':' || string_agg(digest, '' ORDER BY chunk)) AS root_found FROM hexa GROUP BY page_id, n""",
)
def chunk_digest_roots(spark: SparkSession, d: str) -> DataFrame:
    """Digest trees of all pages, in chunks of 256 bytes."""
    size = F.octet_length("html").cast("bigint")
    pages = load(spark, d, "pages").withColumn("_leaves", digests.leaf_digests(F.encode("html", "UTF-8"), PAGE_CHUNK))
    return pages.select(
        F.col("page_id").cast("string").alias("file"),
        size.alias("bytes_found"),
        F.size("_leaves").cast("bigint").alias("n_chunks"),
        digests.root_digest(F.col("_leaves"), size).alias("root_found"),
    )


@query(
    "changed_chunks",
    f"""WITH bytes AS (SELECT page_id, octet_length(encode(html)) AS n FROM pages), last AS (SELECT page_id, (n + {PAGE_CHUNK - 1}) // {PAGE_CHUNK} - 1 AS chunk, n FROM bytes WHERE n > 0)
SELECT CAST(page_id AS VARCHAR) AS file, CAST(chunk AS BIGINT) AS chunk, CAST(chunk * {PAGE_CHUNK} AS BIGINT) AS "offset", 'changed' AS status FROM last WHERE page_id % 2 = 0 AND n % {PAGE_CHUNK} <> 0
UNION ALL SELECT CAST(page_id AS VARCHAR), CAST(chunk + 1 AS BIGINT), CAST((chunk + 1) * {PAGE_CHUNK} AS BIGINT), 'gone' FROM last WHERE page_id % 2 = 0 AND n % {PAGE_CHUNK} = 0
UNION ALL SELECT CAST(page_id AS VARCHAR), 0, 0, 'changed' FROM last WHERE page_id % 3 = 0 AND NOT (page_id % 2 = 0 AND chunk = 0 AND n % {PAGE_CHUNK} <> 0)""",
)
def changed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Pages against declared chunks of a state in which even pages had one more byte and every third another first byte."""
    pages = load(spark, d, "pages").filter(F.octet_length("html") > 0)
    first = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("\x7f"), F.substring("html", 2, 2**31 - 1))).otherwise(F.col("html"))
    before = F.when(F.col("page_id") % 2 == 0, F.concat(first, F.lit("+"))).otherwise(first)

    def leaves(text):
        rows = pages.select(F.col("page_id").cast("string").alias("file"), F.posexplode(digests.leaf_digests(F.encode(text, "UTF-8"), PAGE_CHUNK)).alias("chunk", "digest"))
        return rows.withColumn("chunk", F.col("chunk").cast("bigint"))

    return digests.changed_chunks(leaves(F.col("html")), leaves(before), PAGE_CHUNK)


@query(
    "fixed_format_sink",
    f"SELECT c_custkey, {r('c_acctbal / 7.0', 6)} AS balance FROM customer",
)
def fixed_format_sink(spark: SparkSession, d: str) -> DataFrame:
    """Create-only text sink with 12 significant digits, read back."""
    path = scratch_path(spark, "balances")
    tables.write_new_text(load(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / F.lit(7.0)).alias("balance")), path)
    back = spark.read.schema("c_custkey bigint, balance double").option("header", True).csv(path)
    return back.withColumn("balance", rounded(F.col("balance")))


@query(
    "region_scan",
    "SELECT l_orderkey, l_suppkey, l_partkey AS pos FROM lineitem WHERE l_returnflag = 'R' AND l_partkey BETWEEN 100 AND 900",
)
def region_scan(spark: SparkSession, d: str) -> DataFrame:
    """Write the lines by flag and sorted by part, then read one region by partition and row group."""
    path = scratch_path(spark, "regions")
    line = load(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("chrom"), F.col("l_partkey").alias("pos"), "l_orderkey", "l_suppkey"
    )
    tables.write_by_region(line, path)
    return tables.scan_region(spark, path, "R", 100, 900).select("l_orderkey", "l_suppkey", "pos")


@query(
    "key_list_scan",
    "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 50)",
)
def key_list_scan(spark: SparkSession, d: str) -> DataFrame:
    keys = load(spark, d, "part").filter("p_size = 50").select(F.col("p_partkey").alias("l_partkey"))
    return tables.restrict_to_keys(load(spark, d, "lineitem"), keys, "l_partkey").select("l_orderkey", "l_partkey", "l_linenumber")


@query(
    "prefix_flag",
    "SELECT p_name LIKE 'red%' AS is_mt, count(*) AS n_genes FROM part GROUP BY 1",
)
def prefix_flag(spark: SparkSession, d: str) -> DataFrame:
    return ops.mark_prefix(load(spark, d, "part"), "p_name", "red").groupBy("is_mt").agg(F.count(F.lit(1)).alias("n_genes"))
