"""Hash-based draws: the same for any partitioning, order or engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_hash(*labels: Column | str | int) -> Column:
    """Uniform 128-bit hex text keyed by the labels."""
    parts = [x if isinstance(x, Column) else F.lit(str(x)) for x in labels]
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def hash_number(hexa: Column, digits: int = 15) -> Column:
    """Leading hex digits as a non-negative integer (60 bits at the default)."""
    return F.conv(F.substring(hexa, 1, digits), 16, 10).cast("bigint")


def hash_uniform(hexa: Column) -> Column:
    """Uniform value in [0, 1) from the leading 52 bits, exact in a double."""
    return hash_number(hexa, 13) / F.lit(float(16**13))


def distinct_positions(pool_size: Column, k: Column, *labels: Column | str | int) -> Column:
    """``k`` distinct positions below ``pool_size``, every subset equally likely.

    Robert Floyd's sampling: one hash per position, no pool is listed, so the
    cost is that of ``k`` alone. ``k`` must not exceed ``pool_size``.
    """

    def step(chosen: Column, upper: Column) -> Column:
        pick = F.pmod(hash_number(draw_hash(*labels, upper)), upper + F.lit(1))
        return F.array_append(chosen, F.when(F.array_contains(chosen, pick), upper).otherwise(pick))

    low = (pool_size - k).cast("bigint")
    uppers = F.when(k > 0, F.sequence(low, pool_size.cast("bigint") - F.lit(1))).otherwise(
        F.array().cast("array<bigint>")
    )
    return F.aggregate(uppers, F.array().cast("array<bigint>"), step)
