"""Quality rules as a ledger of failure bits: every rule is evaluated once, policies are masks over the bits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``fails`` is true for a document that breaks the rule; it sees the measurements as columns."""

    name: str
    fails: Column


def rules() -> tuple[Rule, ...]:
    """The rules in bit order; new ones go to the end, so that stored ledgers stay readable."""
    c = F.col
    return (
        Rule("too_few_words", c("n_words") < 20),
        Rule("repeated_windows", 100 * c("n_repeat_words") > 30 * c("n_words")),
        Rule("symbol_heavy", c("n_symbols") > c("n_words")),
        Rule("repeated_lines", 100 * c("n_dup_lines") > 30 * c("n_lines")),
        Rule("words_too_short", c("word_chars") < 2 * c("n_words")),
        Rule("words_too_long", c("word_chars") > 25 * c("n_words")),
    )


POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbol_heavy", "words_too_short", "words_too_long"),
    "v2": ("too_few_words", "repeated_windows", "symbol_heavy", "repeated_lines", "words_too_short", "words_too_long"),
}
"""Versioned policies: the rules whose failure rejects a document."""


def mask(policy: str) -> int:
    bits = {r.name: 1 << i for i, r in enumerate(rules())}
    return sum(bits[n] for n in POLICIES[policy])


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows that occur twice or more, the first occurrence included.

    The windows' hashes are sorted with their places; places whose neighbour has the same hash are put
    back in order, and each covers up to ``WINDOW`` words, until the next one starts.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - WINDOW),
        lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))),
    )

    def places(w: Column) -> Column:
        tagged = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.sort_array(
            F.aggregate(
                F.array(tagged),
                F.array().cast("array<int>"),
                lambda _, s: F.filter(
                    F.transform(
                        s,
                        lambda x, i: F.when(
                            (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"]
                        ),
                    ),
                    lambda i: i.isNotNull(),
                ),
            )
        )

    def covered(w: Column) -> Column:
        return F.aggregate(
            F.array(places(w)),
            F.lit(0).cast("long"),
            lambda _, p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
                F.lit(0).cast("long"),
                lambda a, b: a + b,
            ),
        )

    # Binding the windows once keeps Spark from computing them again for each use.
    total = F.aggregate(
        F.array(windows),
        F.lit(0).cast("long"),
        lambda _, w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)),
    )
    return F.when(F.size(hashes) > WINDOW, total).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements that the rules read, from whole texts.

    Words are maximal runs without ``[\\x20\\x09-\\x0D]``. Equal windows of words are told by 64-bit
    hashes within one document. A null text has no words, and all its counts are zero.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_parts", F.split(whole, SPACE, -1)).withColumn("_words", F.array_remove("_parts", ""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        out.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", (F.length(whole) - F.size("_parts") + 1).cast("long"))
        .withColumn("n_symbols", (F.size(F.split(whole, SYMBOLS, -1)) - 1).cast("long"))
        .withColumn("_lines", lines)
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn(
            "n_repeat_words",
            F.aggregate(
                F.array(F.transform("_words", lambda w: F.xxhash64(w))),
                F.lit(0).cast("long"),
                lambda _, h: _repeat_words(h),
            ),
        )
        .drop("_parts", "_words", "_lines")
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document the measurements and ``fail_bits``: bit i is set if rule i fails.

    Columns of ``docs`` that share a name with a measurement or with ``fail_bits`` are replaced.
    Every row counts for itself: repeated rows and null ids stay as they are, an empty table gives none.
    """
    free = docs.drop(*MEASURES, "fail_bits")
    bits = F.lit(0).cast("long")
    for i, r in enumerate(rules()):
        bits = bits.bitwiseOR(F.when(r.fails, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured(free, text).withColumn("fail_bits", bits)


def keeps(policy: str, bits: str = "fail_bits") -> Column:
    """True for documents that break no rule of the policy."""
    return F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: how many documents it fails, and how many it alone rejects.

    One pass over the stored bits; leaving a rule out of the policy would bring back ``only_here`` documents.
    """
    whole = mask(policy)
    cols = []
    names = [r.name for r in rules() if r.name in POLICIES[policy]]
    bit = {r.name: 1 << i for i, r in enumerate(rules())}
    hit = F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long"))
    for n in names:
        cols.append(F.count(F.when(hit.bitwiseAND(F.lit(bit[n]).cast("long")) != 0, 1)).alias(f"fails_{n}"))
        cols.append(F.count(F.when(hit == bit[n], 1)).alias(f"only_{n}"))
    one = entries.agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(hit != 0, 1)).alias("rejected"), *cols)
    rows = [
        F.struct(
            F.lit(policy).alias("policy"), F.lit(n).alias("rule"), F.col("documents"), F.col("rejected"),
            F.col(f"fails_{n}").alias("fails"), F.col(f"only_{n}").alias("only_here"),
        )
        for n in names
    ]
    return one.select(F.inline(F.array(*rows)))
