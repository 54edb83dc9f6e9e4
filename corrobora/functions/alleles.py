"""Allele keys and effect orientation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def variant_key(chrom: Column, pos: Column, first: Column, second: Column) -> Column:
    """Order-free key ``chrom:pos:low:high``; NULL unless both alleles are distinct ACGT text."""
    a, b = F.upper(first), F.upper(second)
    usable = a.rlike("^[ACGT]+$") & b.rlike("^[ACGT]+$") & (a != b)
    key = F.concat_ws(
        ":",
        F.regexp_replace(chrom.cast("string"), "^chr", ""),
        pos.cast("bigint").cast("string"),
        F.least(a, b),
        F.greatest(a, b),
    )
    return F.when(usable, key)


def palindromic(first: Column, second: Column) -> Column:
    """True when the pair reads the same on both strands."""
    return F.concat(F.least(first, second), F.greatest(first, second)).isin("AT", "CG")


def orientation(effect: Column, other: Column, ref_effect: Column, ref_other: Column) -> Column:
    """``same``, ``swapped`` or ``inconsistent`` relative to a reference pair."""
    return (
        F.when((effect == ref_effect) & (other == ref_other), "same")
        .when((effect == ref_other) & (other == ref_effect), "swapped")
        .otherwise("inconsistent")
    )


def aligned(beta: Column, direction: Column) -> Column:
    """Flip the effect of swapped pairs; inconsistent pairs have no aligned effect."""
    return F.when(direction == "same", beta).when(direction == "swapped", -beta)
