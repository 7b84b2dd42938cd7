"""Mapping views: the domain tables expressed over the generic parquet tables.

The texts run unchanged in Spark and in the SQL engine the results are checked
with, so both sides start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    "txn": """
SELECT 'pay_' || CAST(o_orderkey AS STRING) AS payment_id,
       'order_' || CAST(o_orderkey AS STRING) AS order_id,
       c_mktsegment AS merchant_id,
       CAST(round(o_totalprice * 12) AS BIGINT) AS amount_paise,
       'INR' AS currency,
       CASE o_orderkey % 9 WHEN 0 THEN 'GATEWAY_ERROR' WHEN 1 THEN 'NETWORK_TIMEOUT' WHEN 2 THEN 'PAYMENT_CANCELLED'
            WHEN 3 THEN 'BAD_REQUEST_ERROR' WHEN 4 THEN 'INSUFFICIENT_FUNDS' WHEN 5 THEN 'CARD_DECLINED'
            WHEN 6 THEN 'INVALID_CARD' WHEN 7 THEN 'E_OTHER' END AS failure_code,
       CASE WHEN o_orderkey % 9 >= 7 AND o_orderkey % 2 = 0 THEN 'upstream timeout' END AS failure_reason,
       CASE WHEN o_orderstatus = 'F' THEN 'RECOVERED'
            WHEN o_orderstatus = 'O' THEN CASE o_orderkey % 4 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'ML_SCORED' WHEN 2 THEN 'LOW_PRIORITY_SKIP' ELSE 'EXPIRED' END
            ELSE CASE o_orderkey % 5 WHEN 0 THEN 'AGENT_EVALUATED' WHEN 1 THEN 'ACTION_TRIGGERED' WHEN 2 THEN 'RECOVERING' WHEN 3 THEN 'PENDING_APPROVAL' ELSE 'EV_BYPASSED' END
       END AS status,
       CAST(o_custkey % 4 AS INT) AS recovery_attempts,
       o_orderdate + (o_orderkey % 1440) * INTERVAL '1' MINUTE AS created_at
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "outcomes": """
SELECT 'pay_' || CAST(event_id AS STRING) AS payment_id,
       'm' || CAST(user_id % 5 AS STRING) AS merchant_id,
       CASE event_id % 4 WHEN 0 THEN 'retry_now' WHEN 1 THEN 'retry_15m' WHEN 2 THEN 'offer_upi' ELSE 'offer_emi' END AS strategy,
       CASE user_id % 2 WHEN 0 THEN 'control' ELSE 'variant' END AS arm,
       CASE event_id % 7 WHEN 0 THEN 'GATEWAY_DOWN' WHEN 1 THEN 'USER_CANCELLED' WHEN 2 THEN 'NETWORK_TIMEOUT' WHEN 3 THEN 'INSUFFICIENT_FUNDS'
            WHEN 4 THEN 'INVALID_DETAILS' WHEN 5 THEN 'BANK_DECLINE' ELSE 'UNKNOWN' END AS failure_category,
       CAST(round(value * 3000) AS BIGINT) AS amount_paise,
       CAST((user_id * 7 + event_id) % 100 AS DOUBLE) / 100 AS ml_score,
       CASE WHEN event_type = 'purchase' OR (event_type = 'click' AND user_id % 2 = 1) THEN 1 ELSE 0 END AS recovered,
       CAST(event_id % 3 AS INT) AS friction,
       CAST(event_id % 60 AS INT) AS minutes_to_recovery,
       event_id AS call_id,
       ts AS occurred_at
FROM events""",
    "failures": """
SELECT 'pay_' || CAST(event_id AS STRING) AS payment_id, 'm' || CAST(user_id % 5 AS STRING) AS merchant_id,
       CAST(round(value * 3000) AS BIGINT) AS amount_paise, ts AS created_at
FROM events WHERE event_type = 'error'""",
    "dispatch_log": """
SELECT 'dsp_' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) AS dispatch_id,
       'pay_' || CAST(l_orderkey AS STRING) AS payment_id,
       CASE l_linenumber % 3 WHEN 0 THEN 'whatsapp' WHEN 1 THEN 'sms' ELSE 'email' END AS channel,
       CASE l_returnflag WHEN 'A' THEN 'delivered' WHEN 'N' THEN 'pending' ELSE 'failed' END AS status,
       CAST(l_partkey % 400 AS DOUBLE) / 4 AS latency_ms,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_paise,
       l_shipdate AS sent_at
FROM lineitem""",
    "audit_seed": """
SELECT 'm' || CAST(user_id % 8 AS STRING) AS chain_key, event_id AS seq, 'pay_' || CAST(event_id AS STRING) AS transaction_id,
       upper(event_type) AS action_taken, CASE event_id % 3 WHEN 0 THEN 'rule_engine' WHEN 1 THEN 'ml_scorer' ELSE 'system' END AS source,
       CAST((event_id % 101) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(7,6)) AS recoverability_score, ts AS logged_at
FROM events""",
    "hitl_queue": """
SELECT 'h_' || CAST(o_orderkey AS STRING) AS hitl_id, 'pay_' || CAST(o_orderkey AS STRING) AS transaction_id,
       CAST(round(o_totalprice * 12) AS BIGINT) AS amount_paise,
       CASE o_orderkey % 5 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'MODIFIED' WHEN 3 THEN 'ESCALATED' END AS decision,
       o_orderdate AS created_at
FROM orders WHERE o_totalprice * 12 >= 5000000""",
    "llm_answers": """
SELECT conv_id, turn, 'pay_' || CAST(conv_id AS STRING) AS payment_id, text AS reasoning,
       CASE turn % 7 WHEN 0 THEN 'RETRY_PAYMENT' WHEN 1 THEN 'SEND_REMINDER' WHEN 2 THEN 'OFFER_EMI' WHEN 3 THEN 'OFFER_ALTERNATE_UPI'
            WHEN 4 THEN 'NOTIFY_SUPPORT' WHEN 5 THEN 'NO_ACTION' ELSE 'REFUND' END AS action,
       CAST(conv_id % 21 AS DOUBLE) AS discount_pct, CAST(conv_id % 100 AS DOUBLE) / 100 AS confidence,
       CAST((conv_id * 37) % 100 AS DOUBLE) / 100 AS ml_score
FROM conversations WHERE role = 'assistant'""",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table. A file ``name.parquet`` or a partitioned folder of that name."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def tables_of(text: str) -> list[str]:
    """Base tables a view text reads."""
    return [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", text)]


def view(spark: SparkSession, folder: str, name: str, where: dict[str, Column] | None = None) -> DataFrame:
    """The mapping view ``name`` over the tables in ``folder``, of which ``where`` may filter some."""
    text = VIEWS[name]
    frames = {}
    for base in tables_of(text):
        text = re.sub(rf"\b(FROM|JOIN) {base}\b", rf"\1 {{{base}}}", text)
        rows = table(spark, folder, base)
        frames[base] = rows.filter(where[base]) if where and base in where else rows
    return spark.sql(text, **frames)
