"""Interval, token and coordinate queries over events, documents and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.functions.strings import locus_parts, span_parts, tokens
from corrobora.operators import intervals as iv
from corrobora.plans.registry import query
from corrobora.session import scratch_path
from corrobora.sources import text
from corrobora.sources.tables import load

BIN_SECONDS = 3600
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def points(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(
        F.col("event_id").alias("variant_id"),
        F.concat(F.lit("u"), F.col("user_id")).alias("chrom"),
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").alias("pos"),
        F.col("event_type").alias("gene"),
    )


def peaks(spark: SparkSession, d: str) -> DataFrame:
    """Closed spans [start, stop] of ``value`` minutes after each event, as half-open intervals."""
    spans = (
        points(spark, d)
        .join(load(spark, d, "events").select(F.col("event_id").alias("variant_id"), "value"), "variant_id")
        .select(
            F.col("variant_id").alias("peak_id"),
            "chrom",
            F.col("pos").alias("start"),
            (F.col("pos") + F.floor(F.col("value") * 60)).alias("stop"),
            F.col("gene").alias("label"),
        )
    )
    return iv.closed_to_half_open(spans, "stop")


def hits(spark: SparkSession, d: str, known: DataFrame | None = None) -> DataFrame:
    """Points, or those whose variant_id is in ``known``, with the peaks that hold them."""
    asked = points(spark, d)
    if known is not None:
        asked = asked.join(known, "variant_id", "left_semi")
    return iv.point_in_interval(asked, peaks(spark, d), BIN_SECONDS)


POINTS = """points AS (SELECT event_id AS variant_id, 'u' || user_id AS chrom, CAST(floor(epoch(ts)) AS BIGINT) AS pos, event_type AS gene FROM events),
peaks AS (SELECT event_id AS peak_id, 'u' || user_id AS chrom, CAST(floor(epoch(ts)) AS BIGINT) AS start,
  CAST(floor(epoch(ts)) + floor(value * 60) AS BIGINT) AS stop, event_type AS label FROM events),
hits AS (SELECT points.*, peak_id, start, stop, label FROM points JOIN peaks ON points.chrom = peaks.chrom AND start <= pos AND pos < stop + 1)"""


@query("interval_hits", f"WITH {POINTS} SELECT variant_id, peak_id, chrom, pos FROM hits")
def interval_hits(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).select("variant_id", "peak_id", "chrom", "pos")


@query(
    "endpoint_sensitivity",
    f"WITH {POINTS} SELECT variant_id, peak_id, start <= pos AND pos < stop AS robust_to_endpoint FROM hits",
)
def endpoint_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return iv.endpoint_sensitivity(hits(spark, d)).select("variant_id", "peak_id", "robust_to_endpoint")


LOOPS = """loops AS (SELECT peak_id AS loop_id, p.chrom, start AS a1_start, stop + 1 AS a1_end, start + 86400 AS a2_start, stop + 86401 AS a2_end,
  label || ', ' || CASE WHEN value > 50 THEN 'error' ELSE 'signup' END AS a1_genes,
  CASE WHEN value > 20 THEN 'click' ELSE 'view' END || ',purchase' AS a2_genes FROM peaks p JOIN events ON event_id = peak_id)"""


@query(
    "loop_links",
    f"""WITH {POINTS}, {LOOPS}
SELECT variant_id, gene, loop_id, 1 AS variant_anchor, 2 AS gene_anchor FROM points JOIN loops USING (chrom)
WHERE pos >= a1_start AND pos < a1_end AND list_contains(list_transform(string_split(a2_genes, ','), lambda x: trim(x)), gene)
UNION ALL SELECT variant_id, gene, loop_id, 2, 1 FROM points JOIN loops USING (chrom)
WHERE pos >= a2_start AND pos < a2_end AND list_contains(list_transform(string_split(a1_genes, ','), lambda x: trim(x)), gene)""",
)
def loop_links(spark: SparkSession, d: str) -> DataFrame:
    """Each event span and its copy a day later are the two anchors; tokens list event types."""
    day = 86400
    value = load(spark, d, "events").select(F.col("event_id").alias("peak_id"), "value")
    loops = peaks(spark, d).join(value, "peak_id").select(
        F.col("peak_id").alias("loop_id"),
        F.col("chrom").alias("anchor_1_chrom"),
        F.col("start").alias("anchor_1_start"),
        F.col("end").alias("anchor_1_end"),
        F.concat("label", F.lit(", "), F.when(F.col("value") > 50, "error").otherwise("signup")).alias("anchor_1_genes"),
        F.col("chrom").alias("anchor_2_chrom"),
        (F.col("start") + day).alias("anchor_2_start"),
        (F.col("end") + day).alias("anchor_2_end"),
        F.concat(F.when(F.col("value") > 20, "click").otherwise("view"), F.lit(",purchase")).alias("anchor_2_genes"),
    )
    return iv.loop_links(points(spark, d), loops, BIN_SECONDS).select(
        "variant_id", "gene", "loop_id", "variant_anchor", "gene_anchor"
    )


@query(
    "token_links",
    """SELECT doc_id, count(*) AS n_tokens FROM (SELECT DISTINCT doc_id, trim(unnest(string_split(text, ' '))) AS t FROM documents)
WHERE t <> '' AND t IN (SELECT trim(unnest(string_split(text, ' '))) FROM benchmark) GROUP BY 1""",
)
def token_links(spark: SparkSession, d: str) -> DataFrame:
    """Whole words of every document that also occur in the benchmark texts."""
    words = load(spark, d, "benchmark").select(F.explode(tokens(F.col("text"), " ")).alias("word")).distinct()
    linked = iv.token_join(load(spark, d, "documents").select("doc_id", "text"), "text", words, "word", " ")
    return linked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"))


CANONICAL = {"click": "browse", "view": "browse", "purchase": "buy", "signup": "join"}


@query(
    "canonical_label_lists",
    """SELECT event_id, array_to_string(list_sort(list_distinct(list_filter([
  CASE event_type WHEN 'click' THEN 'browse' WHEN 'view' THEN 'browse' WHEN 'purchase' THEN 'buy' WHEN 'signup' THEN 'join' END,
  CASE WHEN value > 50 THEN 'buy' ELSE 'browse' END], lambda x: x IS NOT NULL))), ';') AS canonical, event_type = 'error' AS has_unknown FROM events""",
)
def canonical_label_lists(spark: SparkSession, d: str) -> DataFrame:
    listed = load(spark, d, "events").select(
        "event_id", F.concat(F.col("event_type"), F.lit(" , "), F.when(F.col("value") > 50, "purchase").otherwise("view")).alias("labels")
    )
    out = iv.canonical_labels(listed, "labels", CANONICAL, "canonical")
    return out.select("event_id", F.array_join("canonical", ";").alias("canonical"), (F.size("unknown_labels") > 0).alias("has_unknown"))


@query(
    "coordinate_resolution",
    """SELECT variant_id, chrom, CASE WHEN second IS NULL OR second = first THEN first END AS position,
  CASE WHEN second IS NULL OR second = first THEN 'unique_position' ELSE 'not_returned_or_ambiguous' END AS status
FROM (SELECT 'rs' || event_id AS variant_id, 'u' || user_id AS chrom, CAST(json_extract(props, '$.k') AS BIGINT) AS first,
  CASE WHEN event_type IN ('error', 'click') THEN CAST(floor(value) AS BIGINT) END AS second FROM events)""",
)
def coordinate_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Nested JSON records with one or two mappings on the wanted assembly, one off chromosome and one long."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    chrom = F.concat(F.lit("u"), F.col("user_id"))
    second = F.floor("value").cast("bigint")

    def mapping(assembly, region, start, end):
        return F.struct(assembly.alias("assembly_name"), region.alias("seq_region_name"), start.alias("start"), end.alias("end"))

    good = F.when(F.col("event_type").isin("error", "click"), "GRCh38").otherwise("GRCh37")
    maps = F.array(
        mapping(F.lit("GRCh38"), chrom, k, k),
        mapping(good, chrom, second, second),
        mapping(F.lit("GRCh38"), F.lit("other"), k + 1, k + 1),
        mapping(F.lit("GRCh38"), chrom, k, k + 5),
    )
    record = F.create_map(
        F.concat(F.lit("rs"), F.col("event_id")), F.struct(F.concat(F.lit("name"), F.col("event_id")).alias("name"), maps.alias("mappings"))
    )
    source = load(spark, d, "events").select(F.to_json(record).alias("line"), F.concat(chrom, F.lit(":"), k).alias("locus"), F.concat(F.lit("rs"), F.col("event_id")).alias("variant_id"))
    parsed = text.explode_mappings(source, "line").join(source.select("variant_id", "locus"), "variant_id")
    located, _ = locus_parts(F.col("locus"))
    return iv.resolve_coordinates(parsed, "variant_id", F.col("mappings"), "GRCh38", located)


@query(
    "span_text_parse",
    f"WITH {POINTS} SELECT peak_id, chrom || '-x' AS name, start, stop + 1 AS \"end\" FROM peaks",
)
def span_text_parse(spark: SparkSession, d: str) -> DataFrame:
    """Span text whose name holds a dash, split from the right and made half-open."""
    spans = peaks(spark, d).select("peak_id", F.concat_ws("-", "chrom", F.lit("x"), "start", "stop").alias("peak"))
    name, start, stop = span_parts(F.col("peak"))
    parsed = spans.select("peak_id", name.alias("name"), start.alias("start"), stop.alias("stop"))
    return iv.closed_to_half_open(parsed, "stop").drop("stop")


LINKS = """links AS (SELECT event_id AS variant_id, event_type || CASE WHEN value > 150 THEN ' view' ELSE '' END AS target,
  CASE WHEN value > 120 THEN 'click error' ELSE 'view purchase' END AS promoter FROM events WHERE value > 100),
types AS (SELECT variant_id, list_sort(list_distinct(list(label))) AS types FROM hits GROUP BY 1),
evidence AS (SELECT p.variant_id, p.gene, l.variant_id IS NOT NULL AS assessed,
  CASE WHEN l.variant_id IS NOT NULL THEN 'source_assessed' ELSE 'not_in_source_table' END AS assessment_status,
  coalesce(array_to_string(types, ';'), '') AS overlap_types,
  coalesce(list_contains(types, CASE p.gene WHEN 'view' THEN 'click' WHEN 'click' THEN 'view' ELSE p.gene END), false) AS top_type_overlaps,
  coalesce(list_contains(string_split(target, ' '), p.gene), false) AS target_match,
  coalesce(list_contains(string_split(promoter, ' '), p.gene), false) AS promoter_match
  FROM (SELECT DISTINCT variant_id, gene FROM points) p LEFT JOIN links l USING (variant_id) LEFT JOIN types USING (variant_id))"""


def evidence(spark: SparkSession, d: str) -> DataFrame:
    value = F.col("value")
    links = load(spark, d, "events").filter("value > 100").select(
        F.col("event_id").alias("variant_id"),
        F.concat(F.col("event_type"), F.when(value > 150, " view").otherwise("")).alias("target"),
        F.when(value > 120, "click error").otherwise("view purchase").alias("promoter"),
    )
    swapped = {**{t: t for t in EVENT_TYPES}, "view": "click", "click": "view"}
    contexts = spark.createDataFrame(list(swapped.items()), "gene string, top_type string")
    overlaps = iv.overlap_labels(hits(spark, d), "variant_id", "label", "types")
    pairs = points(spark, d).select("variant_id", "gene")
    return iv.regulatory_table(pairs, overlaps, links, contexts, ["target", "promoter"])


@query("regulatory_evidence", f"WITH {POINTS}, {LINKS} SELECT *, target_match OR promoter_match AS any_link FROM evidence")
def regulatory_evidence(spark: SparkSession, d: str) -> DataFrame:
    return evidence(spark, d)


@query(
    "evidence_layer_counts",
    f"""WITH {POINTS}, {LINKS} SELECT gene, count(DISTINCT variant_id) FILTER (WHERE target_match OR promoter_match) AS n_any_link,
  count(DISTINCT variant_id) FILTER (WHERE target_match) AS n_target, count(DISTINCT variant_id) FILTER (WHERE promoter_match) AS n_promoter,
  count(DISTINCT variant_id) FILTER (WHERE top_type_overlaps) AS n_overlap FROM evidence GROUP BY 1""",
)
def evidence_layer_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct variants per layer; layers stay separate. Pairs are distinct already, so plain counts suffice."""
    return evidence(spark, d).groupBy("gene").agg(
        F.count_if("any_link").alias("n_any_link"),
        F.count_if("target_match").alias("n_target"),
        F.count_if("promoter_match").alias("n_promoter"),
        F.count_if("top_type_overlaps").alias("n_overlap"),
    )


@query(
    "overlap_agreement",
    f"""WITH {POINTS}, computed AS (SELECT variant_id, list_sort(list_distinct(list(label))) AS c FROM hits GROUP BY 1),
published AS (SELECT variant_id, list_sort(list_distinct(list(label))) AS p FROM hits WHERE pos < stop - 600 GROUP BY 1)
SELECT variant_id, coalesce(array_to_string(c, ';'), '') AS computed_types, array_to_string(p, ';') AS published_types,
  coalesce(c = p, false) AS types_agree FROM published LEFT JOIN computed USING (variant_id)""",
)
def overlap_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Computed labels against a published list that ends its spans ten minutes earlier."""
    computed = iv.overlap_labels(hits(spark, d), "variant_id", "label", "types")
    shorter = peaks(spark, d).withColumn("end", F.col("stop") - 600)
    published = iv.overlap_labels(iv.point_in_interval(points(spark, d), shorter, BIN_SECONDS), "variant_id", "label", "types")
    return iv.label_agreement(computed, published, "variant_id")


@query(
    "gene_set_scan",
    """SELECT c_name AS program, ord AS ordinal, g AS gene_id FROM (
  SELECT c_name, unnest(CASE WHEN c_mktsegment = 'n' || c_nationkey THEN ['n' || c_nationkey] ELSE [c_mktsegment, 'n' || c_nationkey] END) AS g,
    unnest([0, 1]) AS ord FROM customer) WHERE g IS NOT NULL""",
)
def gene_set_scan(spark: SparkSession, d: str) -> DataFrame:
    """Set lines with a repeated member and a prefixed one that is dropped."""
    nation = F.col("c_nationkey").cast("string")
    line = F.concat_ws(
        "\t", "c_name", F.lit("url"), "c_mktsegment", F.concat(F.lit("MT-"), nation), F.concat(F.lit("n"), nation), "c_mktsegment"
    )
    path = scratch_path(spark, "sets")
    load(spark, d, "customer").select(line.alias("value")).write.text(path)
    return text.read_gene_sets(spark, path)


@query(
    "annotation_scan",
    """SELECT p_name AS gene, p_brand AS chrom, p_size * 100 - 1 AS start, p_size * 100 + p_partkey AS "end", '+' AS strand
FROM part WHERE p_type = 'PROMO'""",
)
def annotation_scan(spark: SparkSession, d: str) -> DataFrame:
    first = F.col("p_size") * 100
    attributes = F.concat(F.lit('gene_id "G'), F.col("p_partkey"), F.lit('"; gene_name "'), F.col("p_name"), F.lit('";'))
    line = F.concat_ws(
        "\t", "p_brand", F.lit("src"), F.when(F.col("p_type") == "PROMO", "gene").otherwise("exon"), first.cast("string"),
        (first + F.col("p_partkey")).cast("string"), F.lit("."), F.lit("+"), F.lit("."), attributes,
    )
    path = scratch_path(spark, "annotation")
    part = load(spark, d, "part").select(line.alias("value"))
    part.unionByName(spark.createDataFrame([("# header",)], "value string")).write.text(path)
    return text.read_annotation(spark, path)
