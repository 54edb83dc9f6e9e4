"""Text column expressions: versions, labels, token lists and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_version(identifier: Column) -> Column:
    """Drop a trailing numeric version such as ``.12``."""
    return F.regexp_replace(identifier, r"\.\d+$", "")


def strip_cluster(label: Column) -> Column:
    """Drop a trailing cluster tag, ``C`` or ``CCA`` and a number."""
    return F.regexp_replace(label, r" C(CA)?\d+$", "")


def tokens(text: Column, separator: str = ",") -> Column:
    """Trimmed, non-empty tokens; missing text is an empty list."""
    parts = F.split(F.coalesce(text, F.lit("")), separator)
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def has_token(text: Column, token: Column, separator: str = ",") -> Column:
    """Whole-token membership, never a substring match."""
    return F.array_contains(tokens(text, separator), token)


def list_text(values: Column, separator: str = ";") -> Column:
    """Aggregate to a sorted, distinct list written as text."""
    return F.array_join(F.sort_array(F.collect_set(values)), separator)


def span_parts(text: Column) -> tuple[Column, Column, Column]:
    """``name-start-stop`` split from the right, as the name may hold dashes."""
    pattern = r"^(.*)-(\d+)-(\d+)$"
    name = F.regexp_extract(text, pattern, 1)
    start = F.regexp_extract(text, pattern, 2).try_cast("bigint")
    stop = F.regexp_extract(text, pattern, 3).try_cast("bigint")
    return name, start, stop


def locus_parts(text: Column) -> tuple[Column, Column]:
    """Chromosome and position of ``chrom:pos`` text."""
    parts = F.split(text, ":")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1)).try_cast("bigint")
