"""Parsing of payment-failure event envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SUPPORTED_EVENT = "payment.failed"

_PAYMENT = (
    "id: STRING, entity: STRING, order_id: STRING, amount: BIGINT, currency: STRING, "
    "status: STRING, method: STRING, email: STRING, contact: STRING, error_code: STRING, "
    "error_description: STRING, error_reason: STRING, error_source: STRING, "
    "created_at: BIGINT, card: MAP<STRING, STRING>"
)
ENVELOPE_SCHEMA = (
    "entity STRING, event STRING, contains ARRAY<STRING>, account_id STRING, "
    f"payload STRUCT<payment: MAP<STRING, STRUCT<{_PAYMENT}>>>, _corrupt STRING"
)


def parse_events(df: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per raw text: transaction columns, ``outcome`` and ``reject_reason``.

    ``outcome`` is ``accepted``, ``ignored`` (another event type) or
    ``rejected`` (not JSON, or a required field is missing or not positive).
    """
    parsed = F.from_json(
        F.col(raw), ENVELOPE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    out = df.withColumn("_e", parsed)
    payments = F.col("_e.payload.payment")
    out = out.withColumn(
        "_p", F.coalesce(F.try_element_at(payments, F.lit("entity")), F.get(F.map_values(payments), 0))
    )
    described = F.when(F.col("_p.error_description") != "", F.col("_p.error_description"))
    reason = (
        F.when(F.col(raw).isNull() | F.col("_e._corrupt").isNotNull() | F.col("_e").isNull(), "malformed")
        .when(F.col("_e.event").isNull(), "malformed")
        .when(F.col("_e.event") != SUPPORTED_EVENT, None)
        .when(F.col("_p").isNull(), "no payment")
        .when(F.coalesce(F.col("_p.id"), F.lit("")) == "", "no id")
        .when(F.coalesce(F.col("_p.order_id"), F.lit("")) == "", "no order_id")
        .when(F.coalesce(F.col("_p.amount"), F.lit(0)) <= 0, "amount not positive")
    )
    out = out.withColumns(
        {
            "payment_id": F.col("_p.id"),
            "order_id": F.col("_p.order_id"),
            "amount_paise": F.col("_p.amount"),
            "currency": F.upper(F.coalesce(F.col("_p.currency"), F.lit("INR"))),
            "failure_code": F.col("_p.error_code"),
            "failure_reason": F.coalesce(described, F.col("_p.error_reason")),
            "email": F.col("_p.email"),
            "contact": F.col("_p.contact"),
            "event_epoch": F.col("_p.created_at"),
            "reject_reason": reason,
            "outcome": F.when(reason.isNotNull(), "rejected")
            .when(F.col("_e.event") != SUPPORTED_EVENT, "ignored")
            .otherwise("accepted"),
        }
    )
    return out.drop("_e", "_p")
