"""Feature columns, the rule score and its additive explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paymend.functions.classify import BASE_RATE, code_index, switch_sql

FEATURES = ("amount_rupees", "code_index", "hour_of_day", "retry_count")
CONTRIBUTIONS = ("amount_rupees", "failure_code_hash", "recovery_attempts", "hour_of_day")


def with_features(
    df: DataFrame,
    code: str = "failure_code",
    amount: str = "amount_paise",
    at: str = "created_at",
    attempts: str = "recovery_attempts",
) -> DataFrame:
    """Add the four model features. ``code`` may name the raw code or the category."""
    return df.withColumns(
        {
            "amount_rupees": F.col(amount) / F.lit(100.0),
            "code_index": code_index(code),
            "hour_of_day": F.hour(at),
            "retry_count": F.col(attempts),
        }
    )


def rule_score(amount: str, code: str, hour: str, retries: str) -> Column:
    """Closed-form recovery probability in [0.02, 0.98], four digits."""
    wave = f"0.1D * sin(pi() * ({amount} - 500) / 14500)"
    raw = (
        f"{switch_sql(code, BASE_RATE, BASE_RATE[6])} + greatest(-0.05D, least(0.10D, {wave}))"
        f" + CASE WHEN {hour} BETWEEN 9 AND 21 THEN 0.07D ELSE -0.05D END - {retries} * 0.08D"
    )
    return F.expr(f"round(greatest(0.02D, least(0.98D, {raw})), 4)")


def with_rule_score(df: DataFrame, **names) -> DataFrame:
    """Features plus ``score``."""
    return with_features(df, **names).withColumn("score", rule_score(*FEATURES))


def code_hash(code: Column) -> Column:
    """Stable stand-in for a hashed code, in [0, 1) with three digits."""
    head = F.conv(F.substring(F.md5(F.coalesce(code, F.lit("UNKNOWN"))), 1, 8), 16, 10).cast("bigint")
    return (head % 1000) / F.lit(1000.0)


def with_explanation(
    df: DataFrame,
    score: str = "score",
    amount: str = "amount_paise",
    code: str = "failure_code",
    attempts: str = "recovery_attempts",
    at: str = "created_at",
    category: str = "failure_category",
) -> DataFrame:
    """Add four ``c_*`` contributions, ``base_value``, ``advice`` and ``why``."""
    hour = F.coalesce(F.hour(at), F.lit(12))
    tries = F.coalesce(F.col(attempts), F.lit(0))
    value = F.coalesce(F.col(score), F.lit(0.0))
    parts = {
        "c_amount_rupees": (F.least(F.col(amount) / F.lit(100.0) / 15000, F.lit(1.0)) - 0.5) * 0.20,
        "c_failure_code_hash": (F.lit(0.5) - code_hash(F.col(code))) * 0.12,
        "c_recovery_attempts": -F.least(tries / F.lit(3.0), F.lit(1.0)) * 0.18,
        "c_hour_of_day": (F.lit(0.5) - F.abs(hour - 14) / F.lit(24.0)) * 0.06,
    }
    out = df.withColumns(parts)
    total = sum((F.col(name) for name in list(parts)[1:]), F.col("c_amount_rupees"))
    return out.withColumns(
        {
            "base_value": F.greatest(F.lit(0.0), F.least(F.lit(1.0), value - total)),
            "advice": F.when(value >= 0.15, "retry_or_reroute").otherwise("monitor_only"),
            "why": F.concat(
                F.lit("score "),
                value.cast("decimal(6,3)").cast("string"),
                F.lit("; cause "),
                F.coalesce(F.col(category), F.lit("UNKNOWN")),
                F.lit("; earlier attempts "),
                tries.cast("string"),
            ),
        }
    )
