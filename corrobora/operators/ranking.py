"""Winners, adjusted p-values, rank bins and rank agreement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.functions.numeric import mean_present
from corrobora.operators.ordering import average_rank, rank_in_group, suffix_minimum

TIE_TOLERANCE = 1e-10


def benjamini_hochberg(
    df: DataFrame, p: str, tie_break: Sequence[str], family: Sequence[str] = (), name: str = "q"
) -> DataFrame:
    """Step-up adjusted p-values within each family; families may be of any size.

    Rows without a p-value do not count in their family and get no adjusted one.
    """
    family = list(family)
    ranked = rank_in_group(
        df.filter(F.col(p).isNotNull()), family, [F.col(p), *[F.col(c) for c in tie_break]], "_rank", "_m", keep_slices=True
    )
    ranked = ranked.withColumn("_raw", F.col(p) * F.col("_m") / F.col("_rank"))
    out = suffix_minimum(ranked, family, "_raw", name)
    out = out.withColumn(name, F.least(F.col(name), F.lit(1.0))).drop("_rank", "_m", "_raw")
    return out.unionByName(df.filter(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double")))


def quantile_bins(
    df: DataFrame, value: str, tie_break: Sequence[str], bins: int, name: str = "bin"
) -> DataFrame:
    """Equal-width bins over the rank of ``value``: edges are interpolated rank quantiles, 0-based."""
    ranked = rank_in_group(df, [], [F.col(value), *[F.col(c) for c in tie_break]], "_rank", "_m")
    step = 1.0 / bins
    edges = [
        F.lit(1.0) + (F.col("_m") - F.lit(1)) * F.lit(k * step * 100.0 / 100.0) for k in range(1, bins)
    ]
    above = reduce(add, [(F.col("_rank") > edge).cast("int") for edge in edges], F.lit(0))
    return ranked.withColumn(name, above).drop("_rank", "_m")


def floor_rank_bins(
    df: DataFrame, value: str, tie_break: Sequence[str], bins: int, name: str = "bin"
) -> DataFrame:
    """Bin ``min(bins - 1, floor(i * bins / n))`` of the 0-based rank ``i``."""
    ranked = rank_in_group(df, [], [F.col(value), *[F.col(c) for c in tie_break]], "_rank", "_m")
    floor = F.floor((F.col("_rank") - F.lit(1)) * F.lit(bins) / F.col("_m"))
    return ranked.withColumn(name, F.least(F.lit(bins - 1), floor).cast("int")).drop("_rank", "_m")


def unique_winner(df: DataFrame, types: Sequence[str], scores: str = "scores") -> DataFrame:
    """Add ``top_type``, ``status`` and ``top_score`` for an array of scores in the order of ``types``.

    A missing score makes the comparison ``insufficient_groups``; a maximum that is not
    positive is ``no_UMIs`` even when tied; more than one score at the maximum is a ``tie``.
    """
    judged = _judge(df, scores)
    status = (
        F.when(F.col("_missing"), "insufficient_groups")
        .when(F.col("_best") <= 0, "no_UMIs")
        .when(F.size("_near") > 1, "tie")
        .otherwise("unique")
    )
    label = F.get(_literals(types), F.get("_near", F.lit(0)))
    return (
        judged.withColumn("status", status)
        .withColumn("top_type", F.when(F.col("status") == "unique", label))
        .withColumn("top_score", F.when(~F.col("_missing"), F.col("_best")))
        .drop("_best", "_missing", "_near")
    )


def joined_winners(df: DataFrame, types: Sequence[str], scores: str = "scores") -> DataFrame:
    """Text variant: all tied names joined, and zero (not negative) maxima count as no signal."""
    judged = _judge(df, scores)
    status = (
        F.when(F.col("_missing"), "insufficient_groups")
        .when(F.col("_best") == 0, "no_detected_UMIs")
        .when(F.size("_near") > 1, "tie")
        .otherwise("unique")
    )
    names = F.array_join(F.transform("_near", lambda i: F.get(_literals(types), i)), ";")
    return (
        judged.withColumn("status", status)
        .withColumn("top_type", F.when(F.col("status").isin("tie", "unique"), names))
        .withColumn("top_score", F.when(~F.col("_missing"), F.col("_best")))
        .drop("_best", "_missing", "_near")
    )


def _literals(labels: Sequence[str]) -> Column:
    return F.array(*[F.lit(x) for x in labels])


def _judge(df: DataFrame, scores: str) -> DataFrame:
    """Maximum, whether any score is missing, and the positions within the tie tolerance."""
    place = lambda x, i: F.when(F.abs(x - F.col("_best")) <= TIE_TOLERANCE, i)
    return (
        df.withColumn("_missing", F.exists(scores, lambda x: x.isNull() | F.isnan(x)))
        .withColumn("_best", F.array_max(scores))
        .withColumn("_near", F.filter(F.transform(scores, place), lambda i: i.isNotNull()))
    )


def first_maximum(label: str, score: str, types: Sequence[str]) -> Column:
    """Aggregate: label of the largest score, the earliest declared label on a tie."""
    order = F.array_position(F.array(*[F.lit(t) for t in types]), F.col(label))
    return F.max_by(F.col(label), F.struct(F.col(score), -order))


def comparisons(
    df: DataFrame,
    keys: Sequence[str],
    types: Sequence[str],
    donor_sets: Mapping[str, Sequence[str]],
    score: Column,
    type_col: str = "cell_type",
    donor_col: str = "donor",
    absent: float | None = None,
) -> DataFrame:
    """Equal-donor mean scores of each declared type, for several sets of donors.

    One shuffle by key brings a key's few scores together, combined before they move; every
    donor set is then arithmetic on that row. One row per key and set, with ``scores`` in the
    order of ``types`` and NULL where no listed donor has a score. ``absent`` is the score of
    a type and donor without a row, for tables that leave zeros out.
    """
    value = (lambda n: F.col(n)) if absent is None else (lambda n: F.coalesce(n, F.lit(absent)))
    donors = list(dict.fromkeys(d for members in donor_sets.values() for d in members))
    names = {(t, d): f"_s{i}_{j}" for i, t in enumerate(types) for j, d in enumerate(donors)}
    grid = df.groupBy(*keys).agg(
        *[
            F.max(F.when((F.col(type_col) == t) & (F.col(donor_col) == d), score)).alias(n)
            for (t, d), n in names.items()
        ]
    )
    sets = [
        F.struct(
            F.lit(label).alias("donor_set"),
            F.array(*[mean_present([value(names[(t, d)]) for d in members]) for t in types]).alias("scores"),
        )
        for label, members in donor_sets.items()
    ]
    return grid.select(*keys, F.explode(F.array(*sets)).alias("_c")).select(*keys, "_c.donor_set", "_c.scores")


ALL_DONORS = "all"


def omission_sets(donors: Sequence[str]) -> dict[str, list[str]]:
    """All donors, and all but each one (named by the donor left out)."""
    return {ALL_DONORS: list(donors), **{d: [x for x in donors if x != d] for d in donors}}


def leave_one_out(
    df: DataFrame, keys: Sequence[str], types: Sequence[str], donors: Sequence[str], score: Column
) -> DataFrame:
    """Winner over all donors and again with each donor left out, one row per key and fold."""
    won = unique_winner(comparisons(df, keys, types, omission_sets(donors), score), types)
    return judge_folds(won, keys)


def judge_folds(won: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Put each fold beside the winner over all donors; a fold counts only if both are unique."""
    base = F.col("donor_set") == ALL_DONORS
    gathered = won.groupBy(*keys).agg(
        F.max(F.when(base, F.col("top_type"))).alias("baseline_top_type"),
        F.max(F.when(base, F.col("status"))).alias("baseline_status"),
        F.max(F.when(base, F.col("top_score"))).alias("baseline_score"),
        F.collect_list(
            F.when(
                ~base,
                F.struct(
                    F.col("donor_set").alias("omitted_donor"),
                    F.col("top_type").alias("fold_top_type"),
                    F.col("status").alias("fold_status"),
                    F.col("top_score").alias("fold_score"),
                ),
            )
        ).alias("_folds"),
    )
    long = gathered.withColumn("_f", F.explode("_folds")).select("*", "_f.*").drop("_f", "_folds")
    evaluable = (F.col("baseline_status") == "unique") & (F.col("fold_status") == "unique")
    return long.withColumn("evaluable", evaluable).withColumn(
        "agrees", F.col("evaluable") & F.coalesce(F.col("baseline_top_type") == F.col("fold_top_type"), F.lit(False))
    )


def stability(
    df: DataFrame, keys: Sequence[str], types: Sequence[str], donors: Sequence[str], score: Column
) -> DataFrame:
    """One row per key: winner plus agreeing and evaluable leave-one-out folds."""
    folds = leave_one_out(df, keys, types, donors, score)
    tally = folds.groupBy(*keys).agg(
        F.max("baseline_top_type").alias("top_type"),
        F.max("baseline_status").alias("status"),
        F.max("baseline_score").alias("top_score"),
        F.count_if("agrees").alias("agreeing_folds"),
        F.count_if("evaluable").alias("evaluable_folds"),
    )
    n = len(donors)
    return tally.withColumn("all_folds_agree", (F.col("agreeing_folds") == n) & (F.col("evaluable_folds") == n))


def donor_winners(
    df: DataFrame, keys: Sequence[str], types: Sequence[str], donors: Sequence[str], score: Column
) -> DataFrame:
    """Winner within each single donor."""
    scores = comparisons(df, keys, types, {d: [d] for d in donors}, score)
    return joined_winners(scores, types).select(
        *keys, F.col("donor_set").alias("donor"), "top_type", "status", "top_score"
    )


def spearman(df: DataFrame, groups: Sequence[str], left: str, right: str) -> DataFrame:
    """Rank correlation per group over the rows with both values; NULL when either side is constant."""
    groups = list(groups)
    complete = df.filter(F.col(left).isNotNull() & F.col(right).isNotNull())
    ranked = average_rank(complete, groups, left, "_rl")
    ranked = average_rank(ranked, groups, right, "_rr")
    return ranked.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), guarded_correlation(F.col("_rl"), F.col("_rr")).alias("spearman")
    )


def guarded_correlation(x: Column, y: Column) -> Column:
    """Pearson correlation that is NULL, not an error, when a side is constant."""
    varies = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), spread))


def array_average_ranks(values: Column) -> Column:
    """Average ranks of the elements of a short array."""
    below = lambda x: F.size(F.filter(values, lambda y: y < x))
    same = lambda x: F.size(F.filter(values, lambda y: y == x))
    return F.transform(values, lambda x: below(x) + (same(x) + F.lit(1.0)) / F.lit(2.0))


def array_spearman(df: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """Rank correlation of two short arrays within a row; NULL if a side is constant or incomplete."""
    zero = F.lit(0.0)
    ranked = df.withColumn("_rl", array_average_ranks(F.col(left))).withColumn("_rr", array_average_ranks(F.col(right)))
    centre = (F.size("_rl") + F.lit(1.0)) / F.lit(2.0)
    dot = lambda a, b: F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - centre) * (y - centre)), zero, lambda acc, x: acc + x
    )
    sums = ranked.withColumn("_xy", dot("_rl", "_rr")).withColumn("_xx", dot("_rl", "_rl")).withColumn("_yy", dot("_rr", "_rr"))
    complete = ~F.exists(left, lambda x: x.isNull()) & ~F.exists(right, lambda x: x.isNull())
    rho = F.when(complete & (F.col("_xx") > 0) & (F.col("_yy") > 0), F.try_divide("_xy", F.sqrt(F.col("_xx") * F.col("_yy"))))
    return sums.withColumn(name, rho).drop("_rl", "_rr", "_xy", "_xx", "_yy")


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of the whole table in the given total order."""
    return df.orderBy(*order).limit(n)


def best_per_group(df: DataFrame, groups: Sequence[str], item: str, score: Column, tie: Column) -> DataFrame:
    """Item with the smallest score per group; the smallest tie key decides between equals."""
    return df.groupBy(*groups).agg(
        F.min_by(F.col(item), F.struct(score, tie)).alias(f"best_{item}"), F.min(score).alias("best_score")
    )


def declared_order(df: DataFrame, column: str, listed: Sequence[str]) -> DataFrame:
    """Rows for the listed keys in list order; a listed key without a row stays, with NULLs."""
    frame = df.sparkSession.createDataFrame(
        [(key, i) for i, key in enumerate(listed)], f"{column} string, list_position int"
    )
    return frame.join(df, column, "left").orderBy("list_position")
