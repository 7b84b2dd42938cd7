"""Named queries that run a stream over the given tables and return what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paymend.functions import classify
from paymend.operators import health
from paymend.plans.queries import Query, coded, raw_events
from paymend.policy import Policy
from paymend.sources.scratch import scratch_dir
from paymend.sources.views import VIEWS, table, view
from paymend.streaming import io, jobs

STREAM_QUERIES: dict[str, Query] = {}
#: Rows that a file of a stream's input has, about.
FILE_ROWS = 600_000


def query(fn: Query) -> Query:
    STREAM_QUERIES[fn.__name__] = fn
    return fn


def outcome_stream(spark, d) -> DataFrame:
    """The outcomes view over a stream of the events table."""
    text = VIEWS["outcomes"].replace("FROM events", "FROM {events}")
    return spark.sql(text, events=io.file_events(spark, d, "events"))


def envelope_files(spark, d) -> str:
    """Event envelopes of every transaction as files, the input of a stream."""
    path = scratch_dir(spark, "envelopes")
    rows = raw_events(spark, d).select("raw", "merchant_id", F.col("created_at").alias("received_at"))
    # Several files, as a source would bring them, and no larger ones for more rows.
    rows.repartition(max(8, -(-table(spark, d, "orders").count() // FILE_ROWS))).write.parquet(f"{path}/envelopes.parquet")
    return path


def call_log(outcomes: DataFrame) -> DataFrame:
    channel = classify.switch(
        "strategy", {"retry_now": "links", "retry_15m": "whatsapp", "offer_upi": "sms", "offer_emi": "email"}, "links"
    )
    return outcomes.select(
        channel.alias("channel"), "call_id", F.col("occurred_at").alias("at"), (F.col("recovered") == 1).alias("ok")
    )


@query
def stream_round_trip(spark, d):
    """Events through a keyed sink and back."""
    stream = io.keyed(io.file_events(spark, d, "events").select("event_id", "user_id", "event_type"), "event_id")
    back = io.run_to_parquet(stream, "keyed")
    body = F.from_json("value", "event_id bigint, user_id bigint, event_type string")
    return back.select("key", body.alias("v")).select("key", "v.user_id", "v.event_type")


@query
def stream_decisions(spark, d):
    return decided(spark, d).decisions.select("payment_id", "merchant_id", "amount_paise", "failure_category", "score", "arm", "action", "final_status", "ev_rupees")


def decided(spark, d, **given) -> jobs.DecisionTables:
    stream = io.file_events(spark, envelope_files(spark, d), "envelopes")
    return jobs.decision_stream(stream, attempts=view(spark, d, "txn").select("payment_id", "recovery_attempts"), **given)


@query
def stream_audit(spark, d):
    """The audit rows that the decision stream writes."""
    return decided(spark, d).audit.select("transaction_id", "step", "action_taken", "source", "decision_rationale")


@query
def stream_reviews(spark, d):
    """The review queue that the decision stream fills."""
    return decided(spark, d).reviews.select("hitl_id", "transaction_id", "amount_paise", "proposed_action", "trigger_reason", "ml_score", "ab_arm")


@query
def stream_shadow(spark, d):
    """What the decision stream holds back in shadow mode."""
    return decided(spark, d, policy=Policy(execution_mode="SHADOW")).shadow.select(
        "shadow_id", "payment_id", "merchant_id", "ab_arm", "ev_rupees", "proposed_action", "execution_mode"
    )


@query
def stream_decision_retries(spark, d):
    """Decisions that fail (payment n, n mod 5 times) are made again; four failures end as a dead letter."""
    number = F.element_at(F.split("payment_id", "_"), 2).cast("bigint")
    made = decided(spark, d, failed=F.col("attempt") < number % 5)
    done = made.decisions.select("payment_id", "attempt", "final_status", "ev_rupees")
    dead = made.rejects.filter("reason = 'retries used up'").select(
        F.get_json_object("payload", "$.payment_id").alias("payment_id"), "attempt",
        F.lit("DEAD").alias("final_status"), F.lit(None).cast("decimal(18,2)").alias("ev_rupees"),
    )
    return done.unionByName(dead)


@query
def dead_letters(spark, d):
    """Rejected envelopes, and how many of them a replay would take in again."""
    stream = io.file_events(spark, envelope_files(spark, d), "envelopes")
    rejects = jobs.decision_stream(stream, label="dead").rejects
    again = jobs.replayable(rejects).agg(F.count(F.lit(1))).scalar()
    return rejects.groupBy("reason", "attempt").agg(F.count(F.lit(1)).alias("n")).withColumn("replayable", again)


@query
def dead_letters_replayed(spark, d):
    """Rejected envelopes put back into the input: they come out again, one attempt higher and with their tenant."""
    rejects = jobs.decision_stream(io.file_events(spark, envelope_files(spark, d), "envelopes"), label="dead").rejects
    path = scratch_dir(spark, "replay")
    jobs.replayable(rejects).write.parquet(f"{path}/envelopes.parquet")
    again = jobs.decision_stream(io.file_events(spark, path, "envelopes"), label="replayed").rejects
    return again.groupBy("merchant_id", "reason", "attempt").agg(F.count(F.lit(1)).alias("n"))


@query
def stream_first_seen(spark, d):
    return jobs.first_seen_stream(io.file_events(spark, d, "events"), "user_id", "ts", "event_id")


@query
def stream_minute_counters(spark, d):
    out = jobs.minute_counters(outcome_stream(spark, d), "occurred_at", by=("merchant_id",))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("minute"), "merchant_id", "n", "amount_paise")


@query
def stream_failure_bins(spark, d):
    out = jobs.minute_counters(outcome_stream(spark, d), "occurred_at", width="5 minutes", label="bins")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("bin_start"), "n", "amount_paise")


@query
def stream_posteriors(spark, d):
    rows = outcome_stream(spark, d).withColumn(
        "context",
        classify.context_key(F.col("failure_category"), F.col("ml_score"), F.col("amount_paise") / F.lit(100.0)),
    )
    return jobs.bandit_stream(rows, reward="recovered").select("arm", "context", "alpha", "beta", "pulls", F.round("mean", 6).alias("mean"))


@query
def stream_drift_monitor(spark, d):
    rows = outcome_stream(spark, d).withColumns(
        {"code_index": classify.code_index("failure_category"), "amount_rupees": F.col("amount_paise") / F.lit(100.0)}
    )
    reference = coded(spark, d).filter(~F.col("live"))
    return jobs.drift_stream(rows, reference, "merchant_id", "call_id", "code_index", "amount_rupees")


@query
def provider_health(spark, d):
    return health.provider_health(call_log(view(spark, d, "outcomes")))


@query
def stream_provider_health(spark, d):
    out = jobs.health_stream(call_log(outcome_stream(spark, d)))
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query
def stream_retries(spark, d):
    """Event n fails n mod 5 times: four failures end as a dead letter."""
    stream = io.file_events(spark, d, "events").select("event_id")
    done, dead = jobs.retry_stream(stream, F.col("attempt") < F.col("event_id") % 5)
    return done.withColumn("outcome", F.lit("done")).unionByName(dead.withColumn("outcome", F.lit("dead")))
