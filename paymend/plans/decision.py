"""The recovery decision job: one lazy plan from failed payments to actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paymend.functions.binding import bind
from paymend.functions.classify import (
    experiment_arm,
    failure_category,
    is_low_priority,
    review_reason,
    rule_action,
    rule_confidence,
)
from paymend.functions.money import ev_reason, guard_discount, with_ev
from paymend.functions.scoring import with_rule_score
from paymend.policy import DEFAULT_POLICY, Policy


def decide(df: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Decision columns for every transaction, in the order the stages run.

    Input: the transaction columns; optionally ``score`` (else the rule score
    is used), ``arm`` (else hashed), and proposals for variant rows in
    ``proposed_action, proposed_discount, proposed_confidence``. A stage a row
    never reaches leaves nulls. No shuffle, no join, no Python: the whole plan
    is one generated stage over the scan.
    """
    out = df if "score" in df.columns else with_rule_score(df)
    attempts = F.coalesce(F.col("recovery_attempts"), F.lit(0))
    expired = attempts >= policy.max_attempts
    out = bind(out, {"score": F.when(~expired, F.col("score"))})
    low = is_low_priority(F.col("score"), policy)
    decided = ~expired & ~low
    category = failure_category()
    arm = F.col("arm") if "arm" in df.columns else experiment_arm("payment_id", policy)
    out = bind(
        out,
        {
            "stage": F.when(expired, "EXPIRED").when(low, "LOW_PRIORITY_SKIP").otherwise("DECIDED"),
            "failure_category": F.when(decided, category),
            "arm": F.when(decided, arm),
        },
    )
    decided = F.col("stage") == "DECIDED"
    rule = rule_action("failure_category", "recovery_attempts", policy)
    action, discount = rule, F.lit(0.0)
    source, confidence = F.lit("rule_engine"), rule_confidence(attempts, policy)
    if "proposed_action" in df.columns:
        proposed = (F.col("arm") == "variant") & F.col("proposed_action").isNotNull()
        action = F.when(proposed, F.col("proposed_action")).otherwise(rule)
        source = F.when(proposed, "llm").otherwise("rule_engine")
        if "proposed_discount" in df.columns:
            raw = F.coalesce(F.col("proposed_discount").cast("double"), F.lit(0.0))
            discount = F.when(
                proposed, guard_discount(raw, "zero", float(policy.max_discount))
            ).otherwise(F.lit(0.0))
        if "proposed_confidence" in df.columns:
            confidence = F.when(proposed, F.col("proposed_confidence")).otherwise(confidence)
    reason = review_reason(F.col("amount_paise"), discount, F.col("score"), attempts, policy)
    out = bind(
        out,
        {
            "action": F.when(F.col("stage") == "EXPIRED", "NO_ACTION").when(decided, action),
            "source": F.when(decided, source).otherwise("system"),
            "confidence": F.when(decided, confidence),
            "discount_pct": F.when(decided, discount),
            "review_reason": F.when(decided, reason),
        },
    )
    gated = decided & F.col("review_reason").isNull()
    out = with_ev(out, policy=policy)
    value = ("recoverable_amt", "gateway_cost", "total_cost", "ev_rupees", "ev_decision")
    out = bind(out, {name: F.when(gated, F.col(name)) for name in value})
    final = (
        F.when(~decided, F.col("stage"))
        .when(F.col("review_reason").isNotNull(), "PENDING_APPROVAL")
        .when(F.col("ev_decision") == "BYPASS", "EV_BYPASSED")
        .otherwise("ACTION_TRIGGERED")
    )
    sent = F.when(gated, 1).otherwise(0)
    return out.withColumns(
        {
            "ev_reason": F.when(gated, ev_reason(policy)),
            "final_status": final,
            "recovery_attempts_after": attempts + sent,
        }
    ).drop("stage")


def audit_rows(plan: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Audit events of each decision, in the order they happened (``step``)."""
    score = F.col("score").cast("decimal(6,4)").cast("string")
    status = F.col("final_status")

    def event(when, action, text, source):
        row = F.struct(action.alias("action_taken"), text.alias("decision_rationale"), source.alias("source"))
        return F.when(when, row)

    system, scorer = F.lit("system"), F.lit("ml_scorer")
    events = F.array(
        event(status == "EXPIRED", F.lit("NO_ACTION"),
              F.concat(F.lit("attempts used up: "), F.col("recovery_attempts").cast("string")), system),
        event(F.col("score").isNotNull(), F.lit("ML_SCORED"), F.concat(F.lit("score "), score), scorer),
        event(status == "LOW_PRIORITY_SKIP", F.lit("LOW_PRIORITY_SKIP"),
              F.concat(F.lit("score "), score, F.lit(f" below {policy.low_priority_below}")), system),
        event(status == "PENDING_APPROVAL", F.lit("PENDING_APPROVAL"),
              F.concat(F.lit("review: "), F.col("review_reason")), system),
        event(status == "EV_BYPASSED", F.lit("EV_BYPASS"), F.col("ev_reason"), system),
        event(status == "ACTION_TRIGGERED", F.col("action"),
              F.concat_ws("; ", F.concat(F.lit("arm "), F.col("arm")),
                          F.concat(F.lit("category "), F.col("failure_category")),
                          F.concat(F.lit("score "), score), F.col("ev_reason")), F.col("source")),
    )
    kept = F.filter(events, lambda e: e.isNotNull())
    return plan.select(
        F.col("payment_id").alias("transaction_id"),
        "merchant_id",
        F.coalesce("score", F.lit(0.0)).alias("recoverability_score"),
        F.col("created_at").alias("logged_at"),
        F.posexplode(kept).alias("step", "_e"),
    ).select("transaction_id", "merchant_id", "recoverability_score", "logged_at", "step", "_e.*")


def shadow_rows(plan: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Shadow-ledger rows: decisions whose dispatch was held back by the value gate."""
    return plan.filter(F.col("ev_decision") == "BYPASS").select(
        F.sha2(F.concat_ws("|", F.lit("shadow"), F.col("payment_id")), 256).alias("shadow_id"),
        "payment_id", "merchant_id", F.col("arm").alias("ab_arm"), "ev_rupees",
        F.col("score").alias("p_recovery"), "recoverable_amt", "total_cost", "discount_pct",
        "ev_decision", "ev_reason", F.col("action").alias("proposed_action"),
        F.lit("ACTION_TRIGGERED").alias("proposed_status"),
        F.lit("SHADOW" if policy.shadow else "LIVE").alias("execution_mode"), "created_at",
    )


def review_rows(plan: DataFrame) -> DataFrame:
    """Review-queue rows of the decisions a person must confirm."""
    return plan.filter(F.col("final_status") == "PENDING_APPROVAL").select(
        F.sha2(F.concat_ws("|", F.lit("review"), F.col("payment_id")), 256).alias("hitl_id"),
        F.col("payment_id").alias("transaction_id"), "amount_paise",
        F.col("action").alias("proposed_action"), F.col("discount_pct").alias("proposed_discount"),
        F.col("review_reason").alias("trigger_reason"), F.col("score").alias("ml_score"),
        F.col("arm").alias("ab_arm"), F.lit(None).cast("string").alias("decision"), "created_at",
    )
