"""Numeric column expressions. All stay inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

NEG_INF = float("-inf")


def nudge(digits: int) -> float:
    return float(f"1.7e-{digits + 3}")


def rounded(value: Column, digits: int = 6) -> Column:
    """Round for presentation; adding zero turns -0.0 into 0.0.

    The nudge keeps exact halves from depending on the last bit of a sum's order.
    """
    return F.round(value + F.lit(nudge(digits)), digits) + F.lit(0.0)



def finite(value: Column) -> Column:
    """True for a present value that is neither NaN nor infinite."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))


def close_to(left: Column, right: Column, tolerance: float = 1e-10) -> Column:
    """Absolute closeness where two missing values count as equal."""
    return F.coalesce(F.abs(left - right) <= F.lit(tolerance), left.isNull() & right.isNull())


def share(part: Column, whole: Column) -> Column:
    """``part / whole``; a zero or missing whole gives NULL."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def mean_present(values: list[Column]) -> Column:
    """Mean of the non-NULL columns, summed in list order; NULL if none is present."""
    total = reduce(add, [F.coalesce(v, F.lit(0.0)) for v in values])
    present = reduce(add, [v.isNotNull().cast("int") for v in values])
    return F.when(present > 0, total / present)


def cpm(part: Column, whole: Column) -> Column:
    """Counts per million; an empty library gives NULL."""
    return share(part * F.lit(1e6), whole)


def depth_normalised(count: Column, total: Column, target: float = 1e4) -> Column:
    """``log1p`` of the count rescaled to a common depth."""
    return F.log1p(count * F.lit(float(target)) / total)


def log2_contrast(value: Column, others: list[Column], pseudo: float = 0.01) -> Column:
    """``log2`` ratio of a value to the mean of the others, with a pseudo-count on both sides."""
    return F.log2((value + F.lit(pseudo)) / (mean_present(others) + F.lit(pseudo)))


def minus_log10(p: Column) -> Column:
    """Infinite for a p of zero, of which Spark's logarithm is NULL."""
    return F.when(p == 0, F.lit(float("inf"))).otherwise(-F.log10(p))


def log_abf(beta: Column, se: Column, prior_sd: Column) -> Column:
    """Wakefield's log approximate Bayes factor; invalid input gives NULL."""
    v, w = se * se, prior_sd * prior_sd
    z2 = (beta / se) * (beta / se)
    value = F.lit(0.5) * (F.log(v) - F.log(v + w) + w / (v + w) * z2)
    return F.when(finite(beta) & finite(se) & (se > 0) & (prior_sd > 0), value)


def safe_log(value: Column) -> Column:
    """Natural log with ``log(0) = -inf`` instead of Spark's NULL."""
    return F.when(value > 0, F.log(value)).when(value == 0, F.lit(NEG_INF))


def checked_cast(value: Column, to: str) -> tuple[Column, Column]:
    """A lenient cast and a flag for present text that did not convert."""
    converted = value.try_cast(to)
    return converted, value.isNotNull() & converted.isNull()
