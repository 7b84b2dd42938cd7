"""Human review: applying decisions to the queue and the transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

RESUMING = ("APPROVED", "MODIFIED")


def apply_decisions(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Outcome of every incoming decision.

    ``queue``: hitl_id, transaction_id and decision (null while open).
    ``decisions``: hitl_id, decision, decided_by, decided_at, and where known
    override_discount and notes, which are carried along. Exactly one decision on an
    open item is ``applied``: the earliest, ties broken by person, decision and the
    rest of the row, and one of rows that are wholly equal. Any other is a
    ``conflict``; an unknown item is ``not found``. The earliest is found by a
    combinable minimum, so an item that many people decided is no big sort.
    """
    extra = [c for c in ("override_discount", "notes") if c in decisions.columns]
    names = ["decided_at", "decided_by", "decision", *extra]
    # Equal rows are counted, so that one of them can be the winner.
    rows = decisions.groupBy("hitl_id", *names).agg(F.count(F.lit(1)).alias("_n"))
    first = rows.groupBy("hitl_id").agg(F.min(F.struct(*names)).alias("_first"))
    known = queue.select("hitl_id", "transaction_id", F.col("decision").alias("_old"))
    joined = rows.join(first, "hitl_id").join(known, "hitl_id", "left")
    wins = F.col("_old").isNull() & F.struct(*names).eqNullSafe(F.col("_first"))
    result = (
        F.when(F.col("transaction_id").isNull(), "not found")
        .when(wins & (F.col("_i") == 0), "applied")
        .otherwise("conflict")
    )
    out = joined.withColumn("_i", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int")))).withColumn("result", result)
    resumes = (F.col("result") == "applied") & F.col("decision").isin(*RESUMING)
    return out.select(
        "hitl_id", "transaction_id", "decision", "decided_by", "decided_at", *extra, "result",
        F.when(resumes, "RECOVERING").alias("new_status"),
        F.when(resumes, "HITL_RESOLVED").alias("audit_action"),
    )


def resolve_transactions(transactions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Transactions with the status that applied decisions give them."""
    new = outcomes.filter(F.col("new_status").isNotNull()).select(
        F.col("transaction_id").alias("payment_id"), F.col("new_status").alias("_new")
    )
    return (
        transactions.join(new, "payment_id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")
    )


def review_audit(outcomes: DataFrame) -> DataFrame:
    """The audit rows of applied decisions that resume a transaction."""
    who = F.concat(F.lit("decided by "), F.col("decided_by"), F.lit(": "), F.col("decision"))
    return outcomes.filter(F.col("audit_action").isNotNull()).select(
        "transaction_id", F.col("audit_action").alias("action_taken"), F.lit("reviewer").alias("source"),
        who.alias("decision_rationale"), F.col("decided_at").alias("logged_at"),
    )


def resolve_queue(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Queue with the applied decisions written in."""
    applied = outcomes.filter(F.col("result") == "applied").select(
        "hitl_id", F.col("decision").alias("_new")
    )
    return (
        queue.join(applied, "hitl_id", "left")
        .withColumn("decision", F.coalesce("decision", "_new"))
        .drop("_new")
    )
