"""Row-level rules against hand-worked values."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from paymend.functions import classify, money
from paymend.plans.decision import audit_rows, decide, shadow_rows
from paymend.policy import Policy


def one(spark, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])


EV_CASES = [
    (1_000_000, 1.0, 0.0, Policy(), "10000.00", "150.00", "152.50", "9847.50", "PROCEED"),
    (333_333, 0.333, 0.0, Policy(), "3333.33", "50.00", "52.50", "1057.50", "PROCEED"),
    (100_000, 0.9, 25.0, Policy(), "850.00", "12.75", "15.25", "749.75", "PROCEED"),
    (100, 0.1, 0.0, Policy(), "1.00", "0.02", "2.52", "-2.42", "BYPASS"),
    (500, 0.99, 0.0, Policy(operational_fee="10", gateway_percent="0"), "5.00", "0.00", "10.00", "-5.05", "BYPASS"),
    (100, 1.0, 0.0, Policy(operational_fee="1", gateway_percent="0"), "1.00", "0.00", "1.00", "0.00", "BYPASS"),
    (1_000_000, 1.0, 0.0, Policy(execution_mode="SHADOW"), "10000.00", "150.00", "152.50", "9847.50", "BYPASS"),
    (1_000_000, 7.0, -3.0, Policy(execution_mode="INVALID"), "10000.00", "150.00", "152.50", "9847.50", "PROCEED"),
]


@pytest.mark.parametrize("paise,p,d,policy,rec,gw,cost,ev,decision", EV_CASES)
def test_ev_rupees(spark, paise, p, d, policy, rec, gw, cost, ev, decision):
    df = money.with_ev(one(spark, amount_paise=paise, score=p, discount_pct=d), policy=policy)
    row = df.select("*", money.ev_reason(policy).alias("why")).first()
    assert (row.recoverable_amt, row.gateway_cost, row.total_cost, row.ev_rupees) == tuple(map(Decimal, (rec, gw, cost, ev)))
    assert row.ev_decision == decision
    assert ("shadow" in row.why) == policy.shadow


@pytest.mark.parametrize(
    "p,amount,fee,gateway,ev,allowed,reason",
    [
        (0.5, 1000, 500, 0, 0, False, "expected_value_zero"),
        (0.2, 1000, 201, 0, -1, False, "negative_expected_value"),
        (0.9, 1000, 0, 901, -1, False, "negative_expected_value"),
        (0.9, 1000, 0, 0, 900, True, "positive_expected_value"),
        (1.01, 1000, 0, 0, None, False, "probability must be between 0 and 1"),
        (0.5, -1, 0, 0, None, False, "monetary inputs cannot be negative"),
    ],
)
def test_ev_paise(spark, p, amount, fee, gateway, ev, allowed, reason):
    df = one(spark, probability=p, recoverable_paise=amount, fee_paise=fee, gateway_paise=gateway)
    row = money.with_ev_paise(df).first()
    assert row.expected_value_paise == ev and row.allowed is allowed and row.reason == reason
    if ev is None:
        with pytest.raises(Exception, match=reason):
            money.with_ev_paise(df, strict=True).collect()


@pytest.mark.parametrize(
    "paise,discount,score,attempts,reason",
    [
        (6_000_000, 0.0, 0.8, 0, "HIGH_VALUE"),
        (5_000_000, 0.0, 0.8, 0, "HIGH_VALUE"),
        (100_000, 12.0, 0.8, 0, "HIGH_DISCOUNT"),
        (100_000, 0.0, 0.8, 3, "REPEATED_FAIL"),
        (100_000, 0.0, 0.40, 0, "AMBIGUOUS_SCORE"),
        (100_000, 0.0, 0.60, 0, "AMBIGUOUS_SCORE"),
        (200_000, 3.0, 0.75, 1, None),
    ],
)
def test_review_gate(spark, paise, discount, score, attempts, reason):
    df = one(spark, a=paise, d=discount, s=score, n=attempts)
    assert df.select(classify.review_reason(F.col("a"), F.col("d"), F.col("s"), F.col("n"))).first()[0] == reason


def test_arms_and_low_priority(spark):
    df = spark.createDataFrame([("pay_1",), ("pay_2",), ("pay_3",)], "payment_id string")
    rows = df.select(classify.hash_bucket("payment_id").alias("b"), classify.experiment_arm().alias("arm")).collect()
    assert [(r.b, r.arm) for r in rows] == [(3, "variant"), (59, "control"), (52, "control")]
    low = spark.createDataFrame([(s,) for s in (0.0, 0.14, 0.15, 0.9)], "s double")
    assert [r[0] for r in low.select(classify.is_low_priority(F.col("s"))).collect()] == [True, True, False, False]


@pytest.mark.parametrize(
    "code,reason,category",
    [
        ("GATEWAY_ERROR", None, "GATEWAY_DOWN"),
        (None, "Request timeout", "NETWORK_TIMEOUT"),
        ("card_declined", "low_balance", "INSUFFICIENT_FUNDS"),
        (None, None, "UNKNOWN"),
    ],
)
def test_categories(spark, code, reason, category):
    df = spark.createDataFrame([(code, reason)], "failure_code string, failure_reason string")
    assert df.select(classify.failure_category()).first()[0] == category


def test_discount_rules(spark):
    df = spark.createDataFrame([(20.0,), (15.0,), (0.0,), (-2.0,)], "d double")
    got = {r: [x[0] for x in df.select(money.guard_discount(F.col("d"), r)).collect()] for r in ("zero", "cap", "clamp", "reject")}
    assert got == {
        "zero": [0.0, 15.0, 0.0, -2.0], "cap": [15.0, 15.0, 0.0, -2.0],
        "clamp": [15.0, 15.0, 0.0, 0.0], "reject": [None, 15.0, 0.0, -2.0],
    }


def test_plan_order_and_side_tables(spark):
    rows = [
        ("pay_1", "m", 100_000, "GATEWAY_DOWN", None, 2, 0.9),
        ("pay_2", "m", 100_000, "INVALID_CARD", None, 0, 0.05),
        ("pay_3", "m", 9_000_000, "GATEWAY_DOWN", None, 0, 0.9),
        ("pay_4", "m", 100, "GATEWAY_DOWN", None, 0, 0.2),
        ("pay_5", "m", 100_000, "GATEWAY_DOWN", None, 1, 0.9),
    ]
    df = spark.createDataFrame(
        rows, "payment_id string, merchant_id string, amount_paise long, failure_code string, failure_reason string, recovery_attempts int, score double"
    ).withColumn("created_at", F.lit("2024-01-01 10:00:00").cast("timestamp_ntz"))
    plan = decide(df)
    status = {r.payment_id: (r.final_status, r.action, r.recovery_attempts_after) for r in plan.collect()}
    assert status == {
        "pay_1": ("EXPIRED", "NO_ACTION", 2),
        "pay_2": ("LOW_PRIORITY_SKIP", None, 0),
        "pay_3": ("PENDING_APPROVAL", "RETRY_PAYMENT", 0),
        "pay_4": ("EV_BYPASSED", "RETRY_PAYMENT", 1),
        "pay_5": ("ACTION_TRIGGERED", "OFFER_ALTERNATE_UPI", 2),
    }
    trail = [(r.transaction_id, r.step, r.action_taken) for r in audit_rows(plan).orderBy("transaction_id", "step").collect()]
    assert trail == [
        ("pay_1", 0, "NO_ACTION"), ("pay_2", 0, "ML_SCORED"), ("pay_2", 1, "LOW_PRIORITY_SKIP"),
        ("pay_3", 0, "ML_SCORED"), ("pay_3", 1, "PENDING_APPROVAL"), ("pay_4", 0, "ML_SCORED"),
        ("pay_4", 1, "EV_BYPASS"), ("pay_5", 0, "ML_SCORED"), ("pay_5", 1, "OFFER_ALTERNATE_UPI"),
    ]
    assert [r.payment_id for r in shadow_rows(plan).collect()] == ["pay_4"]
    shadow = Policy(execution_mode="SHADOW")
    assert {r.payment_id for r in shadow_rows(decide(df, shadow), shadow).collect()} == {"pay_4", "pay_5"}


def test_plan_needs_no_shuffle(spark):
    df = spark.range(10).select(
        F.concat(F.lit("pay_"), "id").alias("payment_id"), F.lit("m").alias("merchant_id"), F.lit(5000).alias("amount_paise"),
        F.lit("X").alias("failure_code"), F.lit("").alias("failure_reason"), F.lit(0).alias("recovery_attempts"),
        F.current_timestamp().alias("created_at"),
    )
    text = decide(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text
