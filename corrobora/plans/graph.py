"""Embedding queries: components, nearest neighbours and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.functions.numeric import rounded
from corrobora.operators import counts as ops
from corrobora.operators import graph as gr
from corrobora.operators import neighbours as nb
from corrobora.plans.bindings import r
from corrobora.plans.registry import query
from corrobora.session import stored
from corrobora.sources.tables import load

K = 15
QUERY_STEP, RECALL = 20, 0.95
SQL_ROUNDS = 60  # for the checking SQL only, whose recursion cannot look back
RESOLUTIONS = [0.5, 1.0]

KNN = f"""vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS v FROM embeddings),
knn AS (SELECT * FROM (SELECT a.vec_id AS src, b.vec_id AS dst, array_distance(a.v, b.v) AS distance,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY array_distance(a.v, b.v), b.vec_id) AS rank FROM vec a JOIN vec b ON a.vec_id <> b.vec_id)
  WHERE rank <= {K}),
directed AS (SELECT src, dst, CAST(floor(1000000.0::DOUBLE / (1.0 + round(distance, 4))) AS BIGINT) AS weight FROM knn),
edges AS (SELECT src, dst, max(weight) AS weight FROM (SELECT src, dst, weight FROM directed UNION ALL SELECT dst, src, weight FROM directed) GROUP BY 1, 2)"""


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Exact neighbours of all vectors, made once a run."""
    return stored(spark, d, "neighbours", lambda: gr.nearest_neighbours(load(spark, d, "embeddings"), "vec_id", "embedding", K))


@query("nearest_neighbours", f"WITH {KNN} SELECT src, dst, {r('distance')} AS distance, CAST(rank AS INTEGER) AS rank FROM knn")
def nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours(spark, d).withColumn("distance", rounded(F.col("distance")))


@query("approximate_neighbours")
def approximate_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours from tables of random projections; no SQL repeats their draws."""
    found = nb.approximate_neighbours(load(spark, d, "embeddings"), "vec_id", "embedding", K)
    return found.withColumn("distance", rounded(F.col("distance")))


@query(
    "approximate_neighbour_recall",
    f"""SELECT {K} AS k, CAST(sum(least({K}, n - 1)) AS BIGINT) AS n_true, true AS recall_reached
FROM embeddings, (SELECT count(*) AS n FROM embeddings) WHERE vec_id % {QUERY_STEP} = 0""",
)
def approximate_neighbour_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the approximate neighbours of every twentieth vector, among all, hold 0.95 of the exact ones."""
    vectors = load(spark, d, "embeddings")
    queries = vectors.filter(F.col("vec_id") % QUERY_STEP == 0).select("vec_id")
    truth = gr.nearest_neighbours(vectors, "vec_id", "embedding", K, queries=queries)
    found = nb.approximate_neighbours(vectors, "vec_id", "embedding", K, queries=queries)
    return nb.recall(found, truth).select(F.lit(K).alias("k"), "n_true", (F.col("recall") >= RECALL).alias("recall_reached"))


def rounds_sql(resolution: float) -> str:
    """Label propagation as a recursion over rounds, and the round whose state came up before."""
    tag = str(resolution).replace(".", "")
    return f"""own{tag} AS (SELECT vec_id AS id, coalesce(CAST(floor(avg(weight) * {resolution}::DOUBLE) AS BIGINT), 1) AS w FROM vec LEFT JOIN edges ON src = vec_id GROUP BY 1),
walk{tag} AS (SELECT 0 AS i, vec_id AS id, vec_id AS community FROM vec
  UNION ALL SELECT i + 1, id, arg_max(community, (w, -community)) FROM (SELECT i, id, community, sum(weight) AS w FROM (
    SELECT i, dst AS id, community, weight FROM edges JOIN walk{tag} ON src = id UNION ALL SELECT i, id, community, w FROM walk{tag} JOIN own{tag} USING (id))
    WHERE i < {SQL_ROUNDS} GROUP BY ALL) GROUP BY i, id),
state{tag} AS (SELECT i, sum(hash(id, community)::HUGEINT) AS h FROM walk{tag} GROUP BY i),
stop{tag} AS (SELECT b.i, max(a.i) AS before FROM state{tag} a JOIN state{tag} b ON a.h = b.h AND a.i < b.i GROUP BY b.i ORDER BY b.i LIMIT 1)"""


COMMUNITIES = ", ".join(rounds_sql(x) for x in RESOLUTIONS)
LABELLED = "labelled AS (" + " UNION ALL ".join(
    f"SELECT {x}::DOUBLE AS resolution, id AS vec_id, community, CAST(i AS INTEGER) AS rounds, before = i - 1 AS settled FROM walk{t} JOIN stop{t} USING (i)"
    for x, t in ((x, str(x).replace(".", "")) for x in RESOLUTIONS)
) + ")"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Communities of both resolutions, made once a run."""

    def build() -> DataFrame:
        vertices = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
        found = gr.communities_by_resolution(vertices, gr.edge_weights(neighbours(spark, d)), RESOLUTIONS)
        return found.select("resolution", F.col("id").alias("vec_id"), "community", "rounds", "settled")

    return stored(spark, d, "communities", build)


@query("graph_communities", f"WITH RECURSIVE {KNN}, {COMMUNITIES}, {LABELLED} SELECT * FROM labelled")
def graph_communities(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d)


@query(
    "community_label_contingency",
    f"WITH RECURSIVE {KNN}, {COMMUNITIES}, {LABELLED} SELECT resolution, community, "
    + ", ".join(f"count(*) FILTER (WHERE label = {i}) AS \"n_{i}\"" for i in range(10))
    + " FROM labelled JOIN embeddings USING (vec_id) GROUP BY 1, 2",
)
def community_label_contingency(spark: SparkSession, d: str) -> DataFrame:
    known = load(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"))
    members = labelled(spark, d).join(known, "vec_id").withColumn("_key", F.struct("resolution", "community"))
    return ops.contingency(members, "_key", "label", [str(i) for i in range(10)]).select("_key.*", *[f"n_{i}" for i in range(10)])


@query("component_variance")
def component_variance(spark: SparkSession, d: str) -> DataFrame:
    _, ratio = gr.principal_components(load(spark, d, "embeddings"), "vec_id", "embedding", 8)
    return ratio.withColumn("variance_ratio", rounded(F.col("variance_ratio")))


@query(
    "component_power_sums",
    f"""WITH x AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings CROSS JOIN range(1, 65) t(i)),
m AS (SELECT i, avg(x) AS m FROM x GROUP BY 1),
z AS (SELECT vec_id, i, x - m AS z FROM x JOIN m USING (i)),
c AS (SELECT a.i AS i, b.i AS j, sum(a.z * b.z) AS c FROM z a JOIN z b USING (vec_id) GROUP BY 1, 2),
t1 AS (SELECT sum(c) AS t FROM c WHERE i = j), t2 AS (SELECT sum(c * c) AS t FROM c),
t3 AS (SELECT sum(a.c * b.c * d.c) AS t FROM c a JOIN c b ON a.j = b.i JOIN c d ON b.j = d.i AND d.j = a.i)
SELECT 64::BIGINT AS n_components, {r('1')} AS p1, {r('t2.t / (t1.t * t1.t)')} AS p2, {r('t3.t / (t1.t * t1.t * t1.t)')} AS p3 FROM t1, t2, t3""",
)
def component_power_sums(spark: SparkSession, d: str) -> DataFrame:
    """First three power sums of all components' shares of the variance."""
    _, ratio = gr.principal_components(load(spark, d, "embeddings"), "vec_id", "embedding", 64)
    x = F.col("variance_ratio")
    return ratio.agg(
        F.count(F.lit(1)).alias("n_components"), *[rounded(F.sum(F.pow(x, F.lit(k)))).alias(f"p{k}") for k in (1, 2, 3)]
    )


@query(
    "component_total_variance",
    f"""SELECT count(*) AS n_features, {r('sum(v)')} AS total_variance FROM (
  SELECT i, var_samp(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings CROSS JOIN range(1, 65) t(i) GROUP BY 1)""",
)
def component_total_variance(spark: SparkSession, d: str) -> DataFrame:
    """All components together carry exactly the variance of the features."""
    scores, _ = gr.principal_components(load(spark, d, "embeddings"), "vec_id", "embedding", 64)
    long = scores.select(F.posexplode("components").alias("i", "x"))
    per = long.groupBy("i").agg(F.var_samp("x").alias("v"))
    return per.agg(F.count(F.lit(1)).alias("n_features"), rounded(F.sum("v")).alias("total_variance"))
