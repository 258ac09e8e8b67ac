"""Personal data by patterns, checksums and context, in column expressions only.

A pattern proposes spans, a check on the value (Luhn, modulo 97, ranges, numbers of digits) confirms them, and words nearby
raise the score. The four base kinds are reported whenever confirmed; added kinds need a score of ``THRESHOLD``: an account
number has it by its checksum, an identity number only among words that speak of one.

Patterns are possessive and begin at the start of a run, so a long run of digits or letters is read once, without
backtracking; that changes none of their matches, because a run's first place fails or succeeds for all later ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import spans, written

#: Characters on either side in which context words count.
CONTEXT = 40
THRESHOLD = 0.5
CONTEXT_BONUS = 0.3


@dataclass(frozen=True)
class Kind:
    """``score`` without context; ``words`` is an alternation of context words; ``hint`` must occur in a text with any."""

    name: str
    pattern: str
    score: float
    words: str
    hint: str
    base: bool = True


# The patterns of the base kinds are given.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "e-?mail|contact|write", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "ip|host|server|address", "[0-9]\\."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.7, "card|visa|credit|payment|expires", "[0-9]"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|tel|call|mobile|fax", "\\+[0-9]"),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b", 0.7, "iban|bank|account|konto|cuenta|compte", "[A-Z]{2}[0-9]{2}", base=False),
    Kind("identity", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0.3, "ssn|social security|passport|identity|taxpayer", "[0-9]-[0-9]{2}-[0-9]", base=False),
)
BASE = tuple(k.name for k in KINDS if k.base)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def mod97(value: Column) -> Column:
    """Remainder of an account number as the standard reads it: the first four characters last, letters as 10 to 35."""
    compact = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substr(compact, F.lit(5)), F.left(compact, F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        digit = c < "A"
        return (rest * F.when(digit, 10).otherwise(100) + F.ascii(c) - F.when(digit, 48).otherwise(55)) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c)))


def confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return value.rlike(f"^{part}(?:[.]{part}){{3}}$")
    if kind == "card":
        return F.length(digits(value)).between(16, 19) & F.call_function("luhn_check", digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    if kind == "iban":
        return mod97(value) == 1
    if kind == "identity":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def detected(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind: ``kind, start, end, score``."""
    found = F.filter(spans(text, kind.pattern, CONTEXT, text.rlike(kind.hint)), lambda s: confirmed(kind.name, s["value"]))

    def scored(s: Column) -> Column:
        near = F.concat(s["before"], F.lit("\n"), s["after"]).rlike(rf"(?i)\b(?:{kind.words})\b")
        score = F.when(near, F.lit(min(1.0, kind.score + CONTEXT_BONUS))).otherwise(F.lit(kind.score))
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

    found = F.transform(found, scored)
    return found if kind.base else F.filter(found, lambda s: s["score"] >= THRESHOLD)


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and, for each kind, the array of its spans (``kind, start, end, score``) in the whole text.

    One row for each row of ``docs``. A NULL text is empty: it has no spans. Positions count code points, ends are exclusive.
    """
    text = F.coalesce(docs[text_column], F.lit(""))
    texts = docs.select(docs[id_column].alias("doc_id"), text.alias("text"))
    return texts.select("doc_id", *[detected(F.col("text"), k).alias(k.name) for k in KINDS])


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of their spans, all spans as text (kinds as listed, then by start), and their scores in
    the same order, with a decimal each."""
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.concat(*BASE)
    everything = F.concat(*[k.name for k in KINDS])
    scores = F.array_join(F.transform(everything, lambda s: F.round(s["score"], 1).cast("string")), ",")
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(everything).alias("spans"), scores.alias("scores"))
