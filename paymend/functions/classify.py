"""Row-level labels: failure category, bands, routing, experiment arm, gates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from paymend.policy import DEFAULT_POLICY, Policy

# Keyword -> category, tested in this order.
CATEGORY_KEYWORDS = (
    ("GATEWAY_ERROR", "GATEWAY_DOWN"),
    ("GATEWAY_DOWN", "GATEWAY_DOWN"),
    ("SERVER_ERROR", "GATEWAY_DOWN"),
    ("NETWORK_ERROR", "NETWORK_TIMEOUT"),
    ("NETWORK_TIMEOUT", "NETWORK_TIMEOUT"),
    ("TIMEOUT", "NETWORK_TIMEOUT"),
    ("PAYMENT_CANCELLED", "USER_CANCELLED"),
    ("USER_CANCELLED", "USER_CANCELLED"),
    ("BAD_REQUEST_ERROR", "USER_CANCELLED"),
    ("INSUFFICIENT_FUNDS", "INSUFFICIENT_FUNDS"),
    ("LOW_BALANCE", "INSUFFICIENT_FUNDS"),
    ("INVALID_CARD", "INVALID_DETAILS"),
    ("INVALID_DETAILS", "INVALID_DETAILS"),
    ("CARD_DECLINED", "BANK_DECLINE"),
    ("BANK_DECLINE", "BANK_DECLINE"),
)

# Category -> model code and base recovery rate.
CODE_INDEX = {
    "GATEWAY_DOWN": 0,
    "USER_CANCELLED": 1,
    "NETWORK_TIMEOUT": 2,
    "INSUFFICIENT_FUNDS": 3,
    "INVALID_DETAILS": 4,
    "BANK_DECLINE": 5,
    "UNKNOWN": 6,
}
BASE_RATE = {0: 0.72, 1: 0.41, 2: 0.68, 3: 0.22, 4: 0.18, 5: 0.45, 6: 0.35}

# Category -> (first attempt, later attempt).
ACTION_MATRIX = {
    "GATEWAY_DOWN": ("RETRY_PAYMENT", "OFFER_ALTERNATE_UPI"),
    "NETWORK_TIMEOUT": ("RETRY_PAYMENT", "OFFER_ALTERNATE_UPI"),
    "USER_CANCELLED": ("SEND_REMINDER", "OFFER_EMI"),
    "INSUFFICIENT_FUNDS": ("OFFER_EMI", "NOTIFY_SUPPORT"),
    "INVALID_DETAILS": ("SEND_REMINDER", "NOTIFY_SUPPORT"),
    "BANK_DECLINE": ("OFFER_ALTERNATE_UPI", "NOTIFY_SUPPORT"),
    "UNKNOWN": ("NOTIFY_SUPPORT", "NO_ACTION"),
}

# Categories worth routing around the failing provider.
REROUTE_CATEGORIES = ("GATEWAY_DOWN", "BANK_DECLINE")

# Requests per minute by plan.
PLAN_LIMITS = {"Enterprise": 1000, "Growth": 200}
PLAN_LIMIT_DEFAULT = 50


def literal(value) -> str:
    """SQL text of a constant."""
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"{value}D" if isinstance(value, float) else str(value)


def switch_sql(subject: str, table: dict, default) -> str:
    """Value of a small constant map; the subject expression appears only once."""
    entries = ", ".join(literal(part) for pair in table.items() for part in pair)
    return f"coalesce(try_element_at(map({entries}), {subject}), {literal(default)})"


def switch(subject: str, table: dict, default) -> Column:
    return F.expr(switch_sql(subject, table, default))


def failure_category(code: str = "failure_code", reason: str = "failure_reason") -> Column:
    """First keyword found in the code or the reason column; UNKNOWN when none is."""
    text = f"upper(concat_ws(' ', coalesce({code}, ''), coalesce({reason}, '')))"
    branches = " ".join(f"WHEN contains({text}, '{word}') THEN '{label}'" for word, label in CATEGORY_KEYWORDS)
    return F.expr(f"CASE {branches} ELSE 'UNKNOWN' END")


def code_index(code: str = "failure_code") -> Column:
    """Model feature 0..6 for an error-code column; anything unlisted is 6."""
    normal = f"replace(upper(coalesce({code}, 'UNKNOWN')), ' ', '_')"
    return switch(normal, CODE_INDEX, CODE_INDEX["UNKNOWN"])


def amount_band(rupees: Column) -> Column:
    return F.when(rupees < 1000, "small").when(rupees < 10000, "medium").otherwise("large")


def score_band(score: Column) -> Column:
    return F.when(score < 0.3, "low").when(score < 0.7, "mid").otherwise("high")


def context_key(category: Column, score: Column, rupees: Column) -> Column:
    """Discrete bandit context ``category|score band|amount band``."""
    return F.concat_ws(
        "|",
        F.coalesce(category, F.lit("UNKNOWN")),
        score_band(F.coalesce(score, F.lit(0.5))),
        amount_band(F.coalesce(rupees, F.lit(0.0))),
    )


def is_low_priority(score: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    return score < F.lit(policy.low_priority_below)


def hash_bucket(key: str, buckets: int = 100) -> Column:
    """SHA-256 of a key column, read as one 256-bit number, modulo ``buckets``.

    The number does not fit any SQL integer, so it is reduced 15 hex digits at
    a time, which is exact.
    """
    total = "0L"
    for start in range(1, 65, 15):
        width = min(15, 65 - start)
        piece = f"cast(conv(substring(sha2({key}, 256), {start}, {width}), 16, 10) as bigint)"
        total = f"(({total} * {pow(16, width, buckets)} + {piece} % {buckets}) % {buckets})"
    return F.expr(f"cast({total} as int)")


def experiment_arm(payment_id: str = "payment_id", policy: Policy = DEFAULT_POLICY) -> Column:
    return F.when(hash_bucket(payment_id) < policy.variant_percent, "variant").otherwise("control")


def rule_action(category: str, attempts: str, policy: Policy = DEFAULT_POLICY) -> Column:
    """Action of the deterministic matrix; NO_ACTION once attempts run out."""
    first, later = (
        switch_sql(category, {k: v[i] for k, v in ACTION_MATRIX.items()}, ACTION_MATRIX["UNKNOWN"][i])
        for i in (0, 1)
    )
    tries = f"coalesce({attempts}, 0)"
    return F.expr(
        f"CASE WHEN {tries} >= {policy.max_attempts} THEN 'NO_ACTION' WHEN {tries} < 1 THEN {first} ELSE {later} END"
    )


def rule_status(attempts: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    return F.when(attempts >= policy.max_attempts, "EXPIRED").otherwise("ACTION_TRIGGERED")


def rule_confidence(attempts: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    return F.when(attempts >= policy.max_attempts, F.lit(1.0)).otherwise(F.lit(0.85))


def review_reason(
    amount_paise: Column,
    discount: Column,
    score: Column,
    attempts: Column,
    policy: Policy = DEFAULT_POLICY,
) -> Column:
    """Why a person must look at the row, first match wins; null when nobody must."""
    return (
        F.when(amount_paise >= policy.review_amount_paise, "HIGH_VALUE")
        .when(discount > policy.review_discount_above, "HIGH_DISCOUNT")
        .when(attempts >= policy.review_attempts, "REPEATED_FAIL")
        .when(score.between(policy.review_score_low, policy.review_score_high), "AMBIGUOUS_SCORE")
    )


def wants_rerouting(category: Column) -> Column:
    return F.upper(F.coalesce(category, F.lit(""))).isin(*REROUTE_CATEGORIES)


def plan_limit(plan: Column) -> Column:
    return F.when(plan == "Enterprise", PLAN_LIMITS["Enterprise"]).when(
        plan == "Growth", PLAN_LIMITS["Growth"]
    ).otherwise(PLAN_LIMIT_DEFAULT)
