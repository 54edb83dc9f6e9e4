"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

All patterns run in time linear in the text: repeated parts are possessive, as what follows never
begins with their characters, or of the length that the country gives, and a pattern may start only where a run of its first characters starts
or the previous match ended.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_CHARS = 40
"""Characters before a span, earlier matches included, in which context words count; after it, up to the next match."""

BLOCK = 128
LEAST_SCORE = 0.5
"""Spans of kinds that need context are reported from this score on."""


@dataclass(frozen=True)
class Kind:
    """``pattern`` proposes where a text has ``sign``; ``base`` is the score of a confirmed span; ``words`` nearby add 0.4."""

    name: str
    pattern: str
    base: float
    words: str
    sign: str
    needs_score: bool = False


EMAIL_CHARS = "A-Za-z0-9._%+-"
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
"""Countries by the characters of their account numbers; other codes take the longest run."""

_IBAN = "|".join(
    rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, c in IBAN_LENGTHS.items()
)
KINDS = (
    Kind("email", rf"(?:\G|(?<![{EMAIL_CHARS}]))[{EMAIL_CHARS}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, r"(?i)mail|contact|write", r"@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"(?i)\bip\b|server|host|address", r"[0-9]\.[0-9]"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.7, r"(?i)card|visa|credit|payment|carte|karte", r"[0-9][\x20-]?[0-9]"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, r"(?i)phone|tel|call|mobile|fax", r"\+[0-9]"),
    Kind("iban", rf"(?<![A-Za-z0-9])(?:{_IBAN}|[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+(?![A-Za-z0-9]))", 0.8, r"(?i)iban|account|konto|compte", r"[A-Z]{2}[0-9]{2}"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.2, r"(?i)ssn|social\s+security|insurance\s+n", r"[0-9]-[0-9]{2}-[0-9]", True),
)
_KEYS = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}", r"gh[opsur]_[A-Za-z0-9]{36}", r"xox[abprs]-[A-Za-z0-9-]{10,250}+", r"AIza[0-9A-Za-z_-]{35}",
    r"sk-[A-Za-z0-9_-]{20,250}+", r"eyJ[A-Za-z0-9_-]{10,2000}+\.eyJ[A-Za-z0-9_-]{10,4000}+\.[A-Za-z0-9_-]{10,2000}+",
)
"""Published forms of access keys and signed tokens."""

KINDS += (
    Kind("key", rf"(?<![A-Za-z0-9])(?:{'|'.join(_KEYS)})(?![A-Za-z0-9])|-----BEGIN [A-Z ]{{0,30}}PRIVATE KEY-----", 0.8, r"(?i)key|token|secret|access",
         r"AKIA|ASIA|gh[opsur]_|xox[abprs]-|AIza|sk-|eyJ|PRIVATE KEY"),
    Kind("secret", r"(?i)(?<![a-z0-9])(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key)[\"']?\x20{0,3}[=:]\x20{0,3}[\"']?[A-Za-z0-9+/_.~!@#$%^&*-]{8,250}+",
         0.6, r"(?i)login|user|account|config|credential", r"(?i)passw|passphrase|pwd|secret|token|api[_-]?key"),
)
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "key", "secret")


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check: every second digit from the right counts double."""
    padded = F.lpad(digits, 20, "0")
    total = F.lit(0)
    for i in range(20):
        d = F.substring(padded, 20 - i, 1).cast("int")
        total = total + (d if i % 2 == 0 else F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    return total % 10 == 0


def _mod97(text: Column) -> Column:
    """Whether an account number passes the mod-97 check: its first four characters go last, letters count from 10."""
    plain = F.regexp_replace(text, r"\x20", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    return (
        F.aggregate(
            F.transform(F.split(turned, ""), lambda c: F.when(c == "", F.lit(None)).otherwise(F.ascii(c))),
            F.lit(0),
            lambda a, c: F.when(c.isNull(), a).when(c < 58, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97),
        )
        == 1
    )


def _confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(
            F.split(match, r"\."),
            lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255),
        )
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return _mod97(match)
    if kind == "secret":
        value = F.regexp_extract(match, r"[=:]\x20*[\"']?(.*)$", 1)
        return value.rlike("[0-9]") & (F.size(F.array_distinct(F.split(value, ""))) > 4)
    if kind == "ssn":
        return ~match.rlike(r"^(000|666|9..)-|-00-|-0000$")
    return F.lit(True)


SPAN = "array<struct<kind:string,start:int,end:int,score:double,text:string>>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used and inside whatever function."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spans(kind: Kind, whole: Column) -> Column:
    """Confirmed leftmost non-overlapping spans of a kind in order; places count code points, the end is exclusive.

    The text is split at the matches, so that a match starts after all earlier pieces and matches. Matches are worked off in
    blocks of ``BLOCK``: each begins at the sum of the lengths before it, so the cost grows with the matches, not their square.
    """
    pieces = F.split(whole, kind.pattern, -1)
    found = F.regexp_extract_all(whole, F.lit(kind.pattern), F.lit(0))

    def zipped(pieces: Column, found: Column) -> Column:
        steps = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("piece"), m.alias("text")))
        return F.zip_with(
            steps, F.slice(pieces, 2, F.size(found)),
            lambda s, p: F.struct(s["piece"].alias("piece"), s["text"].alias("text"), F.left(p, F.lit(CONTEXT_CHARS)).alias("after")),
        )

    start_type = "struct<at:int,tail:string,spans:" + SPAN + ">"

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["piece"])
        before = F.right(F.concat(state["tail"], F.right(x["piece"], F.lit(CONTEXT_CHARS))), F.lit(CONTEXT_CHARS))
        score = F.lit(kind.base) + F.when(before.rlike(kind.words) | x["after"].rlike(kind.words), F.lit(0.4)).otherwise(F.lit(0.0))
        score = F.least(score, F.lit(1.0))
        good = _confirmed(kind.name, x["text"])
        if kind.needs_score:
            good = good & (score >= LEAST_SCORE)
        span = F.struct(
            F.lit(kind.name).alias("kind"),
            start.alias("start"),
            (start + F.length(x["text"])).alias("end"),
            score.alias("score"),
            x["text"].alias("text"),
        )
        return F.struct(
            (start + F.length(x["text"])).alias("at"),
            F.right(F.concat(before, x["text"]), F.lit(CONTEXT_CHARS)).alias("tail"),
            F.when(good, F.concat(state["spans"], F.array(span).cast(SPAN))).otherwise(state["spans"]).alias("spans"),
        ).cast(start_type)

    def block(steps: Column, at: Column, tail: Column) -> Column:
        begin = F.struct(at.alias("at"), tail.alias("tail"), F.array().cast(SPAN).alias("spans")).cast(start_type)
        return F.aggregate(steps, begin, step, lambda s: s["spans"])

    def tail(before: Column) -> Column:
        """The last characters of some steps."""
        short = lambda s: F.concat(F.right(s["piece"], F.lit(CONTEXT_CHARS)), F.right(s["text"], F.lit(CONTEXT_CHARS)))
        return F.right(F.array_join(F.transform(before, short), ""), F.lit(CONTEXT_CHARS))

    def in_blocks(steps: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int"))
        own = lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))
        size = lambda s: F.length(s["piece"]) + F.length(s["text"])
        sizes = F.transform(numbers, lambda b: F.aggregate(own(b), F.lit(0), lambda a, s: a + size(s)))
        starts = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
        # A match and the piece before it have two characters at least.
        earlier = lambda b: F.slice(steps, F.greatest(F.lit(1), b * BLOCK + 1 - CONTEXT_CHARS // 2), F.least(b * BLOCK, F.lit(CONTEXT_CHARS // 2)))
        return _bound(starts, lambda at: F.flatten(F.transform(numbers, lambda b: block(own(b), F.get(at, b), tail(earlier(b))))))

    spans = _bound(zipped(pieces, found), lambda steps: F.when(F.size(steps) <= BLOCK, block(steps, F.lit(0), F.lit(""))).otherwise(in_blocks(steps)))
    return F.when(whole.rlike(kind.sign), spans).otherwise(F.array().cast(SPAN))


def find(docs: DataFrame, text: str = "text", kinds: tuple[str, ...] = BASE_KINDS + ADDED_KINDS) -> DataFrame:
    """``docs`` with ``spans``: an array of (kind, start, end, score, text), kinds in order, then by start.

    A null text has no spans. A column ``spans`` of ``docs`` is replaced. Kinds are searched apart from
    each other, so spans of different kinds may overlap; base kinds are never dropped for their score.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    by_name = {k.name: k for k in KINDS}
    return docs.withColumn("spans", F.concat(*(_spans(by_name[k], whole) for k in kinds)))


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``masked_text``: the characters of every span of ``spans`` replaced by its kind in brackets.

    Spans that overlap an earlier one are left to it.
    """
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substr(F.col(text), state["at"] + 1, s["start"] - state["at"])
        return F.when(s["start"] < state["at"], state).otherwise(
            F.struct(s["end"].alias("at"), F.concat(state["out"], gap, F.lit("["), s["kind"], F.lit("]")).alias("out"))
        )

    done = lambda s: F.concat(s["out"], F.substr(F.col(text), s["at"] + 1, F.length(F.col(text))))
    return docs.withColumn("masked_text", F.aggregate(ordered, begin, step, done))


def count_of(kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def places(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
