"""URL rules, with block decisions carried over redirects and canonical links to all aliases of a page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.llm.components import components
from corrobora.session import cut_lineage, join_statistics

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
"""Action, host and path of the default rules."""


def parts(df: DataFrame, url: str, host: str, path: str, query: str) -> DataFrame:
    """``df`` with a URL's host, path and query in columns of these names.

    The host is what follows the first ``://`` up to a slash, question mark, hash or the end, lower-cased;
    the path then goes up to a question mark, hash or the end, and the query, if any, up to a hash or the
    end. All are empty for null and for URLs without ``://``.
    """
    at = F.instr(F.col(url), "://")
    return (
        df.withColumn("_rest", F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise(""))
        .withColumn(host, F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), UPPER, UPPER.lower()))
        .withColumn(path, F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1))
        .withColumn(query, F.regexp_extract("_rest", r"^[^?#]*(\?[^#]*)?", 1))
        .drop("_rest")
    )


def plain_path(path: str) -> Column:
    """A path without dot segments, ``/`` if it is empty; leading ``..`` go nowhere."""
    dotted = F.col(path).rlike(r"/\.\.?$")
    segments = F.split(F.substr(F.col(path), F.lit(2)), "/")
    whole = F.concat(segments, F.when(dotted, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))

    def step(done: Column, segment: Column) -> Column:
        up = F.regexp_replace(done, r"/[^/]*$", "")
        return F.when(segment == "..", up).when(segment == ".", done).otherwise(F.concat(done, F.lit("/"), segment))

    return F.when(F.col(path) == "", "/").otherwise(F.aggregate(whole, F.lit(""), step))


def node(host: str, path: str, query: str) -> Column:
    """A page's identity for links: host, plain path and query, without scheme and fragment; null without a host."""
    return F.when(F.col(host) != "", F.concat(F.col(host), plain_path(path), F.col(query)))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct of the longest rule that fits, null if none does.

    A rule fits its host and all subdomains, if the path starts with the rule's. Of equally long rules
    the one with the longer host counts, then the one that allows.
    """
    listed = F.array(
        *(
            F.struct(
                F.lit(len(h) + len(p)).alias("length"), F.lit(len(h)).alias("host_length"), F.lit(int(a == "allow")).alias("allows"),
                F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action"),
            )
            for a, h, p in rules
        )
    )
    return F.array_max(
        F.filter(
            listed,
            lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]),
        )
    )


LINK = r"(?is)<link\s[^>]*>"
META = r"(?is)<meta\s[^>]*>"
CANONICAL = r"""(?is)\srel\s*=\s*["']?[^"'>]*\bcanonical\b"""
REFRESH = r"""(?is)\shttp-equiv\s*=\s*["']?refresh\b"""
HREF = r"""(?is)\shref\s*=\s*["']?\s*([^"'\s>]*)"""
REFRESH_URL = r"""(?is)\scontent\s*=[^>]*?\burl\s*=\s*["']?\s*([^"'\s>]*)"""
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
ENTITIES = {"quot": '"', "apos": "'", "lt": "<", "gt": ">"}
CODED = "&/:?=#%.+;'\""
"""Characters of URLs whose decimal and hexadecimal references are read."""


def unescaped(text: Column) -> Column:
    """``text`` with character references of HTML replaced, those of ``&`` last."""
    for c in sorted(CODED, key="&".__eq__):
        text = F.regexp_replace(text, f"(?i)&#(0*{ord(c)}|x0*{ord(c):x});", c)
    for name, c in ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(c))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Alias edges (u, v) between page nodes: canonical links and refreshes found in the pages' HTML.

    A reference is unescaped and taken with its scheme, from ``//``, from the host's root, as another query of the page, or
    beside the page; dot segments are resolved. Null URLs, null HTML, other schemes and references without a
    host give no edge.
    """
    text = F.coalesce(F.col(html), F.lit(""))
    refs = F.concat(
        F.transform(
            F.filter(F.regexp_extract_all(text, F.lit(LINK), F.lit(0)), lambda t: t.rlike(CANONICAL)),
            lambda t: F.regexp_extract(t, HREF, 1),
        ),
        F.transform(
            F.filter(F.regexp_extract_all(text, F.lit(META), F.lit(0)), lambda t: t.rlike(REFRESH)),
            lambda t: F.regexp_extract(t, REFRESH_URL, 1),
        ),
    )
    found = pages.select(F.col(url).alias("_url"), F.explode(refs).alias("_ref")).filter("_ref <> ''")
    based = parts(found.withColumn("_ref", unescaped(F.col("_ref"))), "_url", "_h", "_p", "_q").filter("_h <> ''")
    ref, root = F.col("_ref"), F.concat(F.lit("http://"), F.col("_h"))
    absolute = (
        F.when(ref.rlike(SCHEME + "//"), ref)
        .when(ref.rlike(SCHEME), None)
        .when(F.startswith(ref, F.lit("//")), F.concat(F.lit("http:"), ref))
        .when(F.startswith(ref, F.lit("/")), F.concat(root, ref))
        .when(F.startswith(ref, F.lit("?")), F.concat(root, F.col("_p"), ref))
        .when(F.startswith(ref, F.lit("#")), F.col("_url"))
        .otherwise(F.concat(root, F.concat(F.regexp_extract("_p", r"^(.*)/", 1), F.lit("/")), ref))
    )
    ends = parts(based.withColumn("_to", absolute), "_to", "_th", "_tp", "_tq")
    return (
        ends.select(node("_h", "_p", "_q").alias("u"), node("_th", "_tp", "_tq").alias("v"))
        .filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    )


def judged(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    redirects: DataFrame | None = None,
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """``pages`` without the HTML, with host, path, rule and verdict.

    A page's own rule decides, by its path as it stands. Without one, the rule of its node decides, in which an empty path is ``/``
    and dot segments are resolved. Else it is blocked if any of its aliases, near or far, is blocked by a
    rule; else it is allowed. Aliases are the pages joined by canonical links, refreshes and
    the given ``redirects`` (from_url, to_url). A page that a rule allows stays allowed, whatever its
    aliases. Columns host, path, rule and verdict of ``pages`` are replaced, all others may have any name;
    null and malformed URLs have no alias and no rule. Repeated rows stay, an empty table stays empty.
    """
    kept = [c for c in pages.columns if c not in (html, "host", "path", "rule", "verdict")]
    free = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(url).alias("url"), F.col(html).alias("html"))
    edges = links(free)
    if redirects is not None:
        given = parts(parts(redirects, "from_url", "_h", "_p", "_q"), "to_url", "_th", "_tp", "_tq")
        given = given.select(node("_h", "_p", "_q").alias("u"), node("_th", "_tp", "_tq").alias("v"))
        edges = edges.unionByName(given.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v"))
    edges = cut_lineage(edges.distinct())
    own = parts(free.drop("html"), "url", "host", "path", "query").withColumn("node", node("host", "path", "query"))
    own = own.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    own = own.withColumn("by_node", best_rule(F.col("host"), plain_path("path"), rules)["action"])
    action = F.coalesce(F.col("best.action"), "by_node")
    if edges.isEmpty():
        told = own.withColumn("bad", F.lit(False))
    else:
        groups = cut_lineage(components(edges))
        placed = parts(groups.withColumn("as_url", F.concat(F.lit("http://"), "node")), "as_url", "host", "path", "query")
        named = placed.select("component", (best_rule(F.col("host"), F.col("path"), rules)["action"] == "block").alias("bad"))
        blocking = own.filter((action == "block") & F.col("node").isNotNull()).select("node").distinct()
        seen = groups.join(blocking, "node", "left_semi").select("component", F.lit(True).alias("bad"))
        bad = named.unionByName(seen).filter("bad").select("component").distinct()
        blocked = groups.join(bad, "component").select("node", F.lit(True).alias("bad"))
        told = join_statistics(own, blocked, ["node"], "left")
    verdict = F.coalesce(action, F.when(F.col("bad"), "block").otherwise("allow"))
    return told.select("row.*", "host", "path", F.concat("best.host", "best.path").alias("rule"), verdict.alias("verdict"))
