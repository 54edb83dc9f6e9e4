"""Cell-context queries: winners, leave-one-out stability and agreement between studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.functions.numeric import rounded
from corrobora.operators import counts as ops
from corrobora.operators import ranking
from corrobora.plans import bindings as b
from corrobora.plans.bindings import r, with_ctes
from corrobora.plans.registry import query
from corrobora.session import cut_lineage, stored
from corrobora.sources.tables import load

KEYS = ["gene_id", "gene_in_matrix"]


def with_missing(df: DataFrame, status: str = "status") -> DataFrame:
    """Keys without a matrix column are reported as such, whatever the comparison said."""
    return df.withColumn(status, F.when(F.col("gene_in_matrix"), F.col(status)).otherwise("missing_symbol"))


def primary(spark: SparkSession, d: str) -> DataFrame:
    return b.cube(spark, d).filter("qc = 'primary'")


def score() -> Column:
    return F.col("log1p_cpm")


def winner_sql(source: str, name: str, keys: str, n_types: int) -> str:
    """SQL fragment: unique positive maximum per key over (keys, cell_type, ord, s)."""
    return f"""{name} AS (SELECT {keys},
  CASE WHEN count(s) < {n_types} THEN 'insufficient_groups' WHEN any_value(mx) <= 0 THEN 'no_UMIs'
       WHEN count(*) FILTER (WHERE abs(s - mx) <= 1e-10) > 1 THEN 'tie' ELSE 'unique' END AS status,
  CASE WHEN count(s) = {n_types} AND any_value(mx) > 0 AND count(*) FILTER (WHERE abs(s - mx) <= 1e-10) = 1
       THEN max(cell_type) FILTER (WHERE abs(s - mx) <= 1e-10) END AS top_type,
  CASE WHEN count(s) = {n_types} THEN any_value(mx) END AS top_score
  FROM (SELECT *, max(s) OVER (PARTITION BY {keys}) AS mx FROM {source}) GROUP BY {keys})"""


BASE = (
    """base_scores AS (SELECT gene_id, gene_in_matrix, cell_type, avg(log1p_cpm) AS s FROM cube
  WHERE qc = 'primary' AND cell_type IN (SELECT cell_type FROM primary_types) GROUP BY 1, 2, 3),
"""
    + winner_sql("base_scores", "base", "gene_id, gene_in_matrix", 4)
)
FOLDS = (
    """fold_scores AS (SELECT gene_id, gene_in_matrix, o.donor AS omitted_donor, cell_type, avg(log1p_cpm) AS s
  FROM cube JOIN donors o ON o.donor <> cube.donor
  WHERE qc = 'primary' AND cell_type IN (SELECT cell_type FROM primary_types) GROUP BY 1, 2, 3, 4),
"""
    + winner_sql("fold_scores", "fold", "gene_id, gene_in_matrix, omitted_donor", 4)
)


@query(
    "top_context",
    with_ctes(
        f"SELECT gene_id, top_type, CASE WHEN gene_in_matrix THEN status ELSE 'missing_symbol' END AS status, {r('top_score')} AS top_score FROM base",
        "cube", "primary_types", extra=BASE,
    ),
)
def top_context(spark: SparkSession, d: str) -> DataFrame:
    scores = ranking.comparisons(primary(spark, d), KEYS, b.PRIMARY_TYPES, {ranking.ALL_DONORS: b.DONORS}, score())
    out = with_missing(ranking.unique_winner(scores, b.PRIMARY_TYPES))
    return out.select("gene_id", "top_type", "status", rounded(F.col("top_score")).alias("top_score"))


@query(
    "leave_one_donor_out",
    with_ctes(
        f"""SELECT gene_id, omitted_donor, b.top_type AS baseline_top_type, f.top_type AS fold_top_type, f.status AS fold_status,
  {r('f.top_score')} AS fold_score, b.status = 'unique' AND f.status = 'unique' AS evaluable,
  coalesce(b.status = 'unique' AND f.status = 'unique' AND b.top_type = f.top_type, false) AS agrees
FROM fold f JOIN base b USING (gene_id) WHERE b.gene_in_matrix""",
        "cube", "primary_types", "donors", extra=f"{BASE},\n{FOLDS}",
    ),
)
def leave_one_donor_out(spark: SparkSession, d: str) -> DataFrame:
    out = ranking.leave_one_out(
        primary(spark, d).filter("gene_in_matrix"), ["gene_id"], b.PRIMARY_TYPES, b.DONORS, score()
    )
    return out.select(
        "gene_id", "omitted_donor", "baseline_top_type", "fold_top_type", "fold_status",
        rounded(F.col("fold_score")).alias("fold_score"), "evaluable", "agrees",
    )


STABLE = """stable AS (SELECT b.gene_id, b.gene_in_matrix, any_value(b.top_type) AS top_type, any_value(b.status) AS status,
  any_value(b.top_score) AS top_score,
  count(*) FILTER (WHERE b.status = 'unique' AND f.status = 'unique' AND b.top_type = f.top_type) AS agreeing_folds,
  count(*) FILTER (WHERE b.status = 'unique' AND f.status = 'unique') AS evaluable_folds
  FROM base b JOIN fold f USING (gene_id) GROUP BY 1, 2)"""


def stability(spark: SparkSession, d: str) -> DataFrame:
    return with_missing(ranking.stability(primary(spark, d), KEYS, b.PRIMARY_TYPES, b.DONORS, score()))


@query(
    "context_stability",
    with_ctes(
        f"""SELECT gene_id, top_type, CASE WHEN gene_in_matrix THEN status ELSE 'missing_symbol' END AS status,
  {r('top_score')} AS top_score, agreeing_folds, evaluable_folds, agreeing_folds = 5 AND evaluable_folds = 5 AS all_folds_agree FROM stable""",
        "cube", "primary_types", "donors", extra=f"{BASE},\n{FOLDS},\n{STABLE}",
    ),
)
def context_stability(spark: SparkSession, d: str) -> DataFrame:
    out = stability(spark, d)
    return out.withColumn("top_score", rounded(F.col("top_score"))).drop("gene_in_matrix")


@query(
    "donor_top_context",
    with_ctes(
        f"""SELECT gene_id, donor,
  CASE WHEN count(s) < 4 THEN 'insufficient_groups' WHEN any_value(mx) = 0 THEN 'no_detected_UMIs'
       WHEN count(*) FILTER (WHERE abs(s - mx) <= 1e-10) > 1 THEN 'tie' ELSE 'unique' END AS status,
  CASE WHEN count(s) = 4 AND any_value(mx) <> 0
       THEN string_agg(cell_type, ';' ORDER BY ord) FILTER (WHERE abs(s - mx) <= 1e-10) END AS top_type,
  CASE WHEN count(s) = 4 THEN {r('any_value(mx)')} END AS top_score
FROM (SELECT gene_id, donor, cell_type, ord, log1p_cpm AS s, max(log1p_cpm) OVER (PARTITION BY gene_id, donor) AS mx
  FROM cube JOIN primary_types USING (cell_type) WHERE qc = 'primary' AND gene_in_matrix) GROUP BY 1, 2""",
        "cube", "primary_types",
    ),
)
def donor_top_context(spark: SparkSession, d: str) -> DataFrame:
    out = ranking.donor_winners(
        primary(spark, d).filter("gene_in_matrix"), ["gene_id"], b.PRIMARY_TYPES, b.DONORS, score()
    )
    return out.withColumn("top_score", rounded(F.col("top_score")))


@query(
    "quality_tier_agreement",
    with_ctes(
        """SELECT p.gene_id, p.top_type AS primary_top, s.top_type AS strict_top,
  coalesce(p.status = 'unique' AND s.status = 'unique' AND p.top_type = s.top_type, false) AS same_top
FROM base p JOIN strict s USING (gene_id) WHERE p.gene_in_matrix""",
        "cube", "primary_types",
        extra=BASE
        + """,
strict_scores AS (SELECT gene_id, cell_type, avg(log1p_cpm) AS s FROM cube
  WHERE qc = 'strict' AND cell_type IN (SELECT cell_type FROM primary_types) GROUP BY 1, 2),
"""
        + winner_sql("strict_scores", "strict", "gene_id", 4),
    ),
)
def quality_tier_agreement(spark: SparkSession, d: str) -> DataFrame:
    return tier_agreement(b.cube(spark, d))


def tier_agreement(cube: DataFrame) -> DataFrame:
    """Both tiers side by side from one pass over the cube."""
    tiered = cube.filter("gene_in_matrix").withColumn("donor", F.concat_ws("/", "qc", "donor"))
    names = {q: [f"{q}/{x}" for x in b.DONORS] for q in ops.TIERS}
    won = ranking.unique_winner(ranking.comparisons(tiered, ["gene_id"], b.PRIMARY_TYPES, names, score()), b.PRIMARY_TYPES)
    pick = lambda q: F.max(F.when(F.col("donor_set") == q, F.col("top_type")))
    wide = won.groupBy("gene_id").agg(pick("primary").alias("primary_top"), pick("strict").alias("strict_top"))
    return wide.withColumn("same_top", F.coalesce(F.col("primary_top") == F.col("strict_top"), F.lit(False)))


# A second study: the same cells' line statuses taken as two distributions of samples.
SECOND_DONORS = ["C0", "C1", "C2", "C3"]


def second_study(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a second study, made once a run: open lines only, donors by groups of nations."""
    return stored(spark, d, "second-study", lambda: _second_study(spark, d))


def _second_study(spark: SparkSession, d: str) -> DataFrame:
    cells = b.cell_labels(spark, d).select(
        "cell_id", "cell_type", F.concat(F.lit("C"), F.pmod(F.col("nation"), F.lit(4)).cast("string")).alias("donor")
    )
    line = load(spark, d, "lineitem").filter(F.col("l_linestatus") == "O").select(
        F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene_id"), F.col("l_quantity").cast("int").alias("umi")
    )
    sums = cut_lineage(
        line.join(cells, "cell_id").groupBy("donor", "cell_type", "gene_id").agg(F.sum("umi").alias("sum_gene"))
    )
    totals = sums.groupBy("donor", "cell_type").agg(F.sum("sum_gene").alias("sum_all"))
    listed = sums.select("gene_id").distinct().withColumn("gene_in_matrix", F.lit(True))
    frame = ops.cube_frame(sums.withColumnRenamed("sum_gene", "_g"), listed, SECOND_DONORS, b.TYPES).withColumnRenamed("_g", "sum_gene")
    # the declared donors and types bound the totals
    joined = frame.join(F.broadcast(totals), ["donor", "cell_type"], "left")
    cpm = F.lit(1e6) * F.coalesce("sum_gene", F.lit(0)) / F.col("sum_all")
    return joined.select("gene_id", "donor", "cell_type", F.when(F.col("sum_all") > 0, F.log1p(cpm)).alias("log1p_cpm"))


SECOND = (
    """sums2 AS (SELECT 'C' || (nation % 4) AS donor, cell_type, l_partkey AS gene_id, sum(CAST(l_quantity AS INTEGER)) AS g
  FROM lineitem JOIN labels0 ON cell_id = l_orderkey WHERE l_linestatus = 'O' GROUP BY 1, 2, 3),
totals2 AS (SELECT donor, cell_type, sum(g) AS a FROM sums2 GROUP BY 1, 2),
donors2 AS (SELECT 'C' || i AS donor FROM range(4) t(i)),
cube2 AS (SELECT gene_id, donor, cell_type, CASE WHEN a > 0 THEN ln(1 + 1e6 * coalesce(g, 0)::DOUBLE / a) END AS log1p_cpm
  FROM (SELECT DISTINCT gene_id FROM sums2) CROSS JOIN donors2 CROSS JOIN (SELECT cell_type FROM types)
  LEFT JOIN totals2 USING (donor, cell_type) LEFT JOIN sums2 USING (donor, cell_type, gene_id)),
base2_scores AS (SELECT gene_id, cell_type, avg(log1p_cpm) AS s FROM cube2
  WHERE cell_type IN (SELECT cell_type FROM primary_types) GROUP BY 1, 2),
"""
    + winner_sql("base2_scores", "base2", "gene_id", 4)
    + """,
fold2_scores AS (SELECT gene_id, o.donor AS omitted_donor, cell_type, avg(log1p_cpm) AS s FROM cube2 JOIN donors2 o ON o.donor <> cube2.donor
  WHERE cell_type IN (SELECT cell_type FROM primary_types) GROUP BY 1, 2, 3),
"""
    + winner_sql("fold2_scores", "fold2", "gene_id, omitted_donor", 4)
    + """,
rho AS (SELECT gene_id, corr(r1, r2) AS rank_spearman FROM (
  SELECT gene_id, rank() OVER (PARTITION BY gene_id ORDER BY s1) + (count(*) OVER (PARTITION BY gene_id, s1) - 1) / 2.0::DOUBLE AS r1,
    rank() OVER (PARTITION BY gene_id ORDER BY s2) + (count(*) OVER (PARTITION BY gene_id, s2) - 1) / 2.0::DOUBLE AS r2
  FROM (SELECT gene_id, round(a.s, 9) AS s1, round(c.s, 9) AS s2 FROM base_scores a JOIN base2_scores c USING (gene_id, cell_type)))
  GROUP BY gene_id HAVING stddev_pop(r1) > 0 AND stddev_pop(r2) > 0),
concord AS (SELECT b.gene_id, b.top_type AS first_top, c.top_type AS second_top,
  coalesce(b.status = 'unique' AND c.status = 'unique', false) AS evaluable,
  coalesce(b.status = 'unique' AND c.status = 'unique' AND b.top_type = c.top_type, false) AS concordant,
  CASE WHEN b.status = 'unique' AND c.status = 'unique' THEN rank_spearman END AS rank_spearman,
  coalesce(ag, 0) AS second_agreeing_folds, coalesce(ev, 0) AS second_evaluable_folds
  FROM base b LEFT JOIN base2 c USING (gene_id) LEFT JOIN rho USING (gene_id)
  LEFT JOIN (SELECT c.gene_id, count(*) FILTER (WHERE c.status = 'unique' AND f.status = 'unique') AS ev,
    count(*) FILTER (WHERE c.status = 'unique' AND f.status = 'unique' AND c.top_type = f.top_type) AS ag
    FROM base2 c JOIN fold2 f USING (gene_id) GROUP BY 1) x USING (gene_id) WHERE b.gene_in_matrix)"""
)


def concordance(spark: SparkSession, d: str, cube: DataFrame | None = None) -> DataFrame:
    """Winner, leave-one-out and rank agreement of two studies, one row per gene of the first."""
    types = b.PRIMARY_TYPES
    one = ranking.comparisons(
        (cube if cube is not None else b.cube(spark, d)).filter("qc = 'primary' AND gene_in_matrix"),
        ["gene_id"], types, {ranking.ALL_DONORS: b.DONORS}, score(),
    )
    first = ranking.unique_winner(one, types).select(
        "gene_id", F.col("top_type").alias("first_top"), F.transform("scores", lambda x: F.round(x, 9)).alias("_p")
    )
    two = ranking.comparisons(second_study(spark, d), ["gene_id"], types, ranking.omission_sets(SECOND_DONORS), score())
    won = ranking.unique_winner(two, types)
    folds = ranking.judge_folds(won, ["gene_id"]).groupBy("gene_id").agg(
        F.max("baseline_top_type").alias("second_top"),
        F.count_if("agrees").alias("second_agreeing_folds"),
        F.count_if("evaluable").alias("second_evaluable_folds"),
    )
    scores = won.filter(F.col("donor_set") == ranking.ALL_DONORS).select(
        "gene_id", F.transform("scores", lambda x: F.round(x, 9)).alias("_q")
    )
    joined = first.join(folds, "gene_id", "left").join(scores, "gene_id", "left")
    ranked = ranking.array_spearman(joined, "_p", "_q", "_rho")
    ok = F.col("first_top").isNotNull() & F.col("second_top").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return ranked.select(
        "gene_id", "first_top", "second_top", ok.alias("evaluable"),
        (ok & F.coalesce(F.col("first_top") == F.col("second_top"), F.lit(False))).alias("concordant"),
        F.when(ok, F.col("_rho")).alias("rank_spearman"), zero("second_agreeing_folds"), zero("second_evaluable_folds"),
    )


@query(
    "cross_study_concordance",
    with_ctes(
        f"SELECT * REPLACE ({r('rank_spearman')} AS rank_spearman) FROM concord",
        "cube", "primary_types", "types", "donors", extra=f"{BASE},\n{SECOND}",
    ),
)
def cross_study_concordance(spark: SparkSession, d: str) -> DataFrame:
    return concordance(spark, d).withColumn("rank_spearman", rounded(F.col("rank_spearman")))


@query(
    "rank_bins",
    """SELECT gene_id, CAST((SELECT count(*) FROM range(1, 10) t(k) WHERE 1 + (n - 1) * (k * 0.1::DOUBLE * 100.0::DOUBLE / 100.0::DOUBLE) < rk) AS INTEGER) AS bin
FROM (SELECT l_partkey AS gene_id, count(*) OVER () AS n, row_number() OVER (ORDER BY sum(CAST(l_quantity AS INTEGER)), l_partkey) AS rk
  FROM lineitem GROUP BY l_partkey)""",
)
def rank_bins(spark: SparkSession, d: str) -> DataFrame:
    return ranking.quantile_bins(gene_totals(spark, d), "total", ["gene_id"], 10).select("gene_id", "bin")


@query(
    "floor_rank_bins",
    """SELECT gene_id, CAST(least(19, ((rk - 1) * 20) // n) AS INTEGER) AS bin
FROM (SELECT l_partkey AS gene_id, count(*) OVER () AS n, row_number() OVER (ORDER BY sum(CAST(l_quantity AS INTEGER)), l_partkey) AS rk
  FROM lineitem GROUP BY l_partkey)""",
)
def floor_rank_bins(spark: SparkSession, d: str) -> DataFrame:
    return ranking.floor_rank_bins(gene_totals(spark, d), "total", ["gene_id"], 20).select("gene_id", "bin")


def gene_totals(spark: SparkSession, d: str) -> DataFrame:
    return (
        load(spark, d, "lineitem")
        .groupBy(F.col("l_partkey").alias("gene_id"))
        .agg(F.sum(F.col("l_quantity").cast("int")).alias("total"))
    )


@query(
    "top_features",
    """SELECT l_partkey AS gene_id, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS total FROM lineitem
GROUP BY 1 ORDER BY total DESC, gene_id LIMIT 100""",
)
def top_features(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_n(gene_totals(spark, d), [F.desc("total"), F.col("gene_id")], 100)


@query(
    "best_item_per_group",
    """SELECT l_suppkey, arg_min(l_partkey, (l_extendedprice, l_partkey)) AS best_l_partkey, min(l_extendedprice) AS best_score
FROM lineitem GROUP BY 1""",
)
def best_item_per_group(spark: SparkSession, d: str) -> DataFrame:
    line = load(spark, d, "lineitem")
    return ranking.best_per_group(line, ["l_suppkey"], "l_partkey", F.col("l_extendedprice"), F.col("l_partkey"))


CASES = ["LARGE", "NOT LISTED", "SMALL", "PROMO"]


@query(
    "declared_case_report",
    """SELECT v.p_type, list_position, n_parts, max_size FROM (VALUES ('LARGE', 0), ('NOT LISTED', 1), ('SMALL', 2), ('PROMO', 3)) v(p_type, list_position)
LEFT JOIN (SELECT p_type, count(*) AS n_parts, max(p_size) AS max_size FROM part GROUP BY 1) USING (p_type) ORDER BY list_position""",
)
def declared_case_report(spark: SparkSession, d: str) -> DataFrame:
    parts = load(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n_parts"), F.max("p_size").alias("max_size"))
    return ranking.declared_order(parts, "p_type", CASES)
