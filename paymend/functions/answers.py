"""Checks on generated decision texts, one boolean column per check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paymend.policy import ACTIONS, CATEGORIES

# Words and shapes that must not appear in a customer-safe text.
ALARM_WORDS = ("fraud", "illegal", "stolen", "scam", "reject", "blacklist")
SHOUTING = r"[!?]{3,}"
TEXT_EMAIL = r"[a-z0-9_.+-]+@[a-z0-9-]+\.[a-z0-9-.]+"
TEXT_PHONE = r"(\+?91[\-\s]?)?[6-9]\d{9}"
PAYMENT_ID = r"(?i)pay_[a-z0-9]{8,}"
URL = r"https?://"

CHECKS = (
    "faithful",
    "tone_ok",
    "nothing_invented",
    "action_valid",
    "discount_ok",
    "confidence_ok",
)


def fact_share(text: Column, facts: Column) -> Column:
    """Share of the facts found in the text; 1 when there are no facts to find."""
    lowered = F.lower(text)
    hits = F.size(F.filter(facts, lambda fact: F.contains(lowered, F.lower(fact))))
    return F.when(F.size(facts) == 0, F.lit(1.0)).otherwise(hits / F.size(facts))


def has_shouted_word(text: Column) -> Column:
    """Some whitespace-separated word longer than three letters is all upper case."""
    words = F.split(text, r"\s+")
    return F.exists(
        words, lambda w: (F.length(w) > 3) & (F.upper(w) == w) & (F.lower(w) != w)
    )


def tone_ok(text: Column) -> Column:
    lowered = F.lower(text)
    alarm = F.lit(False)
    for word in ALARM_WORDS:
        alarm = alarm | F.contains(lowered, F.lit(word))
    return ~(
        alarm
        | F.regexp_like(text, F.lit(SHOUTING))
        | has_shouted_word(text)
        | F.regexp_like(lowered, F.lit(TEXT_EMAIL))
        | F.regexp_like(text, F.lit(TEXT_PHONE))
    )


def nothing_invented(text: Column, payment_id: Column) -> Column:
    """No payment id but the row's own, and no web address."""
    ids = F.regexp_extract_all(text, F.lit(PAYMENT_ID), F.lit(0))
    foreign = F.exists(ids, lambda found: F.lower(found) != F.lower(payment_id))
    return ~(foreign | F.regexp_like(text, F.lit(URL)))


def with_checks(
    df: DataFrame,
    text: str = "reasoning",
    facts: str = "facts",
    payment_id: str = "payment_id",
    action: str = "action",
    category: str = "failure_category",
    discount: str = "discount_pct",
    confidence: str = "confidence",
    score: str = "ml_score",
    max_discount: float = 15.0,
    tolerance: float = 0.6,
    faithful_from: float = 0.80,
) -> DataFrame:
    """Add the check columns, ``faithfulness`` and ``overall``.

    ``confidence_ok`` is reported but, as in the rules it follows, is not part
    of ``overall``.
    """
    share = fact_share(F.col(text), F.col(facts))
    out = df.withColumns(
        {
            "faithfulness": F.round(share, 4),
            "faithful": share >= faithful_from,
            "tone_ok": tone_ok(F.col(text)),
            "nothing_invented": nothing_invented(F.col(text), F.col(payment_id)),
            "action_valid": F.col(action).isin(*ACTIONS) & F.col(category).isin(*CATEGORIES),
            "discount_ok": F.col(discount) <= max_discount,
            "confidence_ok": F.abs(F.col(confidence) - F.col(score)) <= tolerance,
        }
    )
    return out.withColumn(
        "overall",
        F.col("faithful")
        & F.col("tone_ok")
        & F.col("nothing_invented")
        & F.col("action_valid")
        & F.col("discount_ok"),
    )
