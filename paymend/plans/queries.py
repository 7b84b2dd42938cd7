"""Named queries: each reads whole tables of a folder and returns one DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from paymend.functions import answers, classify, crypto, messages, money, privacy, scoring
from paymend.operators import (
    anomaly, drift, experiments, ledger, locks, models, outbound, proofs, ranks, reports, retrieval, review, timeseries,
)
from paymend.plans.decision import audit_rows, decide, review_rows, shadow_rows
from paymend.policy import METHODS, RETRY_WINDOWS_MIN, Policy
from paymend.sources import envelope, tables
from paymend.sources.scratch import materialise, scratch_dir
from paymend.sources.views import table, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LEDGER_KEY = b"ledger-test-key"
HOOK_KEY = "hook-test-key"
CUTOVER = "2024-01-16"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- shared inputs -----------------------------------------------------------

def proposals(spark: SparkSession, d: str) -> DataFrame:
    """Transactions with the proposal columns another system would deliver."""
    amount = F.col("amount_paise")
    return view(spark, d, "txn").withColumns(
        {
            "proposed_action": F.when(amount % 3 == 0, "OFFER_EMI"),
            "proposed_discount": (amount % 20).cast("double"),
            "proposed_confidence": F.lit(0.9),
        }
    )


def planned(spark: SparkSession, d: str, policy: Policy = Policy()) -> DataFrame:
    return decide(proposals(spark, d), policy)


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Transactions with rule score and category."""
    out = scoring.with_rule_score(view(spark, d, "txn"))
    return out.withColumns(
        {
            "recoverability_score": F.col("score"),
            "failure_category": classify.failure_category(),
        }
    )


def routed(spark: SparkSession, d: str) -> DataFrame:
    """Scored transactions with a channel and a measured latency."""
    amount = F.col("amount_paise")
    return scored(spark, d).withColumns(
        {
            "channel": F.when(amount % 3 == 0, "whatsapp").when(amount % 3 == 1, "sms").otherwise("email"),
            "latency_ms": (amount % 400) / F.lit(4.0),
        }
    )


def message_log(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.personalise(routed(spark, d), retrieval.template_library(spark))


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    out = view(spark, d, "outcomes")
    context = classify.context_key(
        F.col("failure_category"), F.col("ml_score"), F.col("amount_paise") / F.lit(100.0)
    )
    return out.withColumns({"context": context, "live": F.col("occurred_at") >= F.lit(CUTOVER).cast("timestamp_ntz")})


def coded(spark: SparkSession, d: str) -> DataFrame:
    return outcomes(spark, d).withColumns(
        {
            "code_index": classify.code_index("failure_category"),
            "amount_rupees": F.col("amount_paise") / F.lit(100.0),
            "hour_of_day": F.hour("occurred_at"),
            "retry_count": F.col("friction"),
            "label": F.col("recovered"),
        }
    )


def chain(spark: SparkSession, d: str) -> DataFrame:
    return ledger.append(view(spark, d, "audit_seed"), LEDGER_KEY)


def tampered(spark: SparkSession, d: str) -> DataFrame:
    """The ledger after someone rewrote every 97th action text."""
    hit = F.col("seq") % 97 == 0
    return chain(spark, d).withColumn("action_taken", F.when(hit, "FORGED").otherwise(F.col("action_taken")))


def raw_events(spark: SparkSession, d: str) -> DataFrame:
    """Event envelopes as text, one per transaction, some broken in a known way."""
    txn = view(spark, d, "txn").withColumn("k", F.substring_index("payment_id", "_", -1).cast("bigint"))
    k = F.col("k")
    payment = F.struct(
        F.col("payment_id").alias("id"),
        F.when(k % 29 == 0, "").otherwise(F.col("order_id")).alias("order_id"),
        F.when(k % 23 == 0, F.lit(0)).otherwise(F.col("amount_paise")).alias("amount"),
        F.when(k % 2 == 0, "inr").otherwise("INR").alias("currency"),
        F.col("failure_code").alias("error_code"),
        F.when(k % 3 == 0, "").otherwise(F.col("failure_reason")).alias("error_description"),
        F.lit("declined at source").alias("error_reason"),
        F.unix_timestamp(F.col("created_at").cast("timestamp")).alias("created_at"),
        F.create_map(F.lit("network"), F.lit("visa")).alias("card"),
        F.lit(1).alias("unknown_extra"),
    )
    body = F.to_json(
        F.struct(
            F.lit("event").alias("entity"),
            F.when(k % 13 == 0, "payment.captured").otherwise("payment.failed").alias("event"),
            F.struct(
                F.create_map(F.when(k % 19 == 0, "item_1").otherwise("entity"), payment).alias("payment")
            ).alias("payload"),
        )
    )
    broken = F.substring(body, 1, 60)
    return txn.select("k", F.when(k % 17 == 0, broken).otherwise(body).alias("raw"), "created_at", "merchant_id")


# --- sources and tables --------------------------------------------------------

@query
def parsed_events(spark, d):
    out = envelope.parse_events(raw_events(spark, d))
    kept = F.col("outcome") == "accepted"
    names = ("payment_id", "order_id", "amount_paise", "currency", "failure_code", "failure_reason")
    return out.select("k", "outcome", "reject_reason", *[F.when(kept, F.col(n)).alias(n) for n in names])


@query
def signed_payloads(spark, d):
    body = F.concat_ws("|", "event_id", "props")
    right = crypto.hmac_sha256(body, HOOK_KEY)
    k = F.col("event_id")
    given = F.when(k % 7 == 0, None).when(k % 5 == 0, F.reverse(right)).when(k % 3 == 0, F.upper(right)).otherwise(right)
    return table(spark, d, "events").select(
        "event_id", right.alias("signature"), crypto.signature_valid(body, given, HOOK_KEY).alias("valid")
    )


@query
def link_callbacks(spark, d):
    link, pay = F.col("dispatch_id"), F.col("payment_id")
    right = crypto.hmac_sha256(F.concat(link, F.lit("|"), pay), HOOK_KEY)
    given = F.when(F.col("amount_paise") % 4 == 0, F.lit("")).otherwise(right)
    return view(spark, d, "dispatch_log").select(
        "dispatch_id", crypto.callback_valid(link, pay, given, HOOK_KEY).alias("valid")
    )


def failure_batch(spark, d):
    """Failure events that hit known payments (often many times) and new ones."""
    e = table(spark, d, "events")
    number = F.when(F.col("event_type") == "error", F.col("user_id")).otherwise(F.col("event_id") * 3)
    return e.select(
        F.concat(F.lit("pay_"), number.cast("string")).alias("payment_id"),
        F.concat(F.lit("order_e"), F.col("event_id").cast("string")).alias("order_id"),
        F.round(F.col("value") * 3000).cast("bigint").alias("amount_paise"),
        F.lit("INR").alias("currency"),
        F.upper("event_type").alias("failure_code"),
        F.col("props").alias("failure_reason"),
        F.col("ts").alias("event_time"),
    )


@query
def upserted_transactions(spark, d):
    snapshot = view(spark, d, "txn").drop("merchant_id", "created_at").withColumn(
        "updated_at", F.lit(None).cast("timestamp_ntz")
    )
    return tables.upsert_transactions(snapshot, failure_batch(spark, d))


@query
def partial_updates(spark, d):
    snapshot = view(spark, d, "txn").select(
        "payment_id", "status", F.lit("UNKNOWN").alias("failure_category"), F.lit(0.5).alias("recoverability_score")
    )
    updates = planned(spark, d).select(
        "payment_id", F.col("final_status").alias("status"), "failure_category",
        F.col("score").alias("recoverability_score"),
    )
    return tables.partial_update(snapshot, updates)


@query
def tenant_rows(spark, d):
    return tables.tenant_view(view(spark, d, "txn"), "BUILDING", ["payment_id", "amount_paise", "status"])


@query
def tenant_leaks(spark, d):
    """Payments that more than one of all tenants sees."""
    seen = view(spark, d, "txn").groupBy("payment_id").agg(F.min("merchant_id").alias("one"), F.max("merchant_id").alias("other"))
    return seen.where("one <> other").agg(F.count(F.lit(1)).alias("shared"))


@query
def inserted_or_ignored(spark, d):
    stored = view(spark, d, "hitl_queue").select(F.col("transaction_id").alias("payment_id"))
    rows = view(spark, d, "dispatch_log").select("payment_id", "dispatch_id", "channel", "sent_at")
    return tables.insert_or_ignore(stored, rows, "payment_id", F.struct("sent_at", "dispatch_id"))


@query
def monthly_partitions(spark, d):
    path = scratch_dir(spark, "monthly")
    tables.write_monthly(view(spark, d, "txn"), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("created_month").cast("string").alias("created_month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_paise").alias("amount_paise")
    )


@query
def latest_transactions(spark, d):
    return tables.latest(view(spark, d, "txn"), "created_at", "payment_id", 500).select(
        "payment_id", "created_at", "status", "amount_paise"
    )


@query
def latest_audit(spark, d):
    audit = view(spark, d, "audit_seed").drop("recoverability_score")
    txn = scored(spark, d).select(F.col("payment_id").alias("transaction_id"), "amount_paise", "failure_category")
    joined = audit.join(txn, "transaction_id", "inner")
    return joined.orderBy(F.col("seq").desc()).limit(200).select(
        "seq", "transaction_id", "action_taken", "source", "amount_paise", "failure_category"
    )


@query
def latest_dispatches(spark, d):
    log = view(spark, d, "dispatch_log").select("dispatch_id", "payment_id", "channel", "sent_at")
    txn = view(spark, d, "txn").select("payment_id", "merchant_id", F.col("amount_paise").alias("txn_amount"))
    # The newest rows are picked first: the join then needs only them.
    newest = tables.latest(log, "sent_at", "dispatch_id", 200)
    return newest.join(txn, "payment_id", "left")


@query
def open_reviews(spark, d):
    queue = view(spark, d, "hitl_queue").filter(F.col("decision").isNull())
    return tables.latest(queue, "created_at", "hitl_id", 100).select("hitl_id", "transaction_id", "amount_paise", "created_at")


@query
def latest_shadow(spark, d):
    rows = shadow_rows(planned(spark, d, Policy(execution_mode="SHADOW")), Policy(execution_mode="SHADOW"))
    return tables.latest(rows, "created_at", "payment_id", 200).select(
        "payment_id", "created_at", "ev_rupees", "proposed_action", "execution_mode"
    )


@query
def point_lookup(spark, d):
    """One transaction by id. The id holds the order key, so the scan gets an equality that it can push down."""
    wanted = "pay_42"
    rows = view(spark, d, "txn", {"orders": F.col("o_orderkey") == int(wanted.removeprefix("pay_"))})
    return tables.lookup(rows, "payment_id", wanted).select("payment_id", "amount_paise", "status")


@query
def attempt_counters(spark, d):
    return tables.attempts_from_log(view(spark, d, "txn"), view(spark, d, "dispatch_log")).select(
        "payment_id", F.col("recovery_attempts").cast("bigint").alias("recovery_attempts")
    )


@query
def latest_states(spark, d):
    log = view(spark, d, "audit_seed").select("chain_key", "seq", "action_taken", "logged_at")
    return tables.latest_state(log, "chain_key", F.struct("logged_at", "seq"))


# --- row-level decisions --------------------------------------------------------

@query
def failure_categories(spark, d):
    return scored(spark, d).select("payment_id", "failure_category")


@query
def code_indexes(spark, d):
    return scored(spark, d).select(
        "payment_id", F.col("code_index").alias("raw_index"),
        classify.code_index("failure_category").alias("category_index"),
    )


@query
def context_keys(spark, d):
    rupee = F.col("amount_rupees")
    return scored(spark, d).select(
        "payment_id", classify.amount_band(rupee).alias("amount_band"),
        classify.score_band(F.col("score")).alias("score_band"),
        classify.context_key(F.col("failure_category"), F.col("score"), rupee).alias("context"),
    )


@query
def low_priority(spark, d):
    return scored(spark, d).filter(classify.is_low_priority(F.col("score"))).select("payment_id", "score")


@query
def rule_actions(spark, d):
    tries = F.col("recovery_attempts")
    return scored(spark, d).select(
        "payment_id", classify.rule_action("failure_category", "recovery_attempts").alias("action"),
        classify.rule_status(tries).alias("new_status"), classify.rule_confidence(tries).alias("confidence"),
    )


@query
def experiment_arms(spark, d):
    return view(spark, d, "txn").select(
        "payment_id", classify.hash_bucket("payment_id").alias("bucket"),
        classify.experiment_arm("payment_id").alias("arm"),
    )


@query
def review_gate(spark, d):
    discount = (F.col("amount_paise") % 20).cast("double")
    return scored(spark, d).select(
        "payment_id",
        classify.review_reason(F.col("amount_paise"), discount, F.col("score"), F.col("recovery_attempts")).alias("trigger_reason"),
    )


@query
def discount_rules(spark, d):
    asked = (F.col("amount_paise") % 25 - 3).cast("double")
    return view(spark, d, "txn").select(
        "payment_id", *[money.guard_discount(asked, rule).alias(f"d_{rule}") for rule in ("zero", "cap", "clamp", "reject")]
    )


def ev_input(spark, d):
    return view(spark, d, "txn").withColumns(
        {
            "score": (F.col("amount_paise") % 1000) / F.lit(1000.0),
            "discount_pct": (F.col("amount_paise") % 20).cast("double"),
        }
    )


@query
def ev_rupees(spark, d):
    return money.with_ev(ev_input(spark, d)).select(
        "payment_id", "recoverable_amt", "gateway_cost", "total_cost", "ev_rupees", "ev_decision",
        money.ev_reason().alias("ev_reason"),
    )


@query
def ev_shadow_mode(spark, d):
    policy = Policy(execution_mode=" shadow ")
    out = money.with_ev(ev_input(spark, d), policy=policy)
    return out.groupBy("merchant_id").agg(
        F.count(F.lit(1)).alias("n"), reports.count_if(F.col("ev_decision") == "PROCEED").alias("proceeding"),
        F.sum("ev_rupees").cast("decimal(30,2)").alias("ev_total"),
    )


@query
def ev_paise(spark, d):
    rows = view(spark, d, "txn").select(
        "payment_id", ((F.col("amount_paise") % 1030 - 10) / F.lit(1000.0)).alias("probability"),
        (F.col("amount_paise") % 5000 - 20).alias("recoverable_paise"),
        (F.col("amount_paise") % 700).alias("fee_paise"), (F.col("amount_paise") % 300).alias("gateway_paise"),
    )
    return money.with_ev_paise(rows).select(
        "payment_id", F.col("expected_value_paise").cast("decimal(20,6)").alias("expected_value_paise"), "allowed", "reason"
    )


@query
def ev_for_ids(spark, d):
    ids = table(spark, d, "events").select(
        F.concat(F.lit("pay_"), (F.col("event_id") * 2).cast("string")).alias("payment_id")
    )
    known = ev_input(spark, d).select("payment_id", "amount_paise", "score", "discount_pct", F.lit(True).alias("found"))
    out = money.with_ev(ids.join(known, "payment_id", "left"))
    return out.select(
        "payment_id", F.when(F.col("found").isNull(), "not found").alias("error"),
        F.when(F.col("found"), F.col("ev_rupees")).alias("ev_rupees"),
        F.when(F.col("found"), F.col("ev_decision")).alias("ev_decision"),
    )


def typical_amounts(spark, d):
    rupee = F.col("amount_paise") / F.lit(100.0)
    return view(spark, d, "txn").groupBy("merchant_id", classify.amount_band(rupee).alias("band")).agg(
        F.round(F.avg("amount_paise") / 100, 2).alias("amount")
    )


@query
def ev_surface(spark, d):
    grid = typical_amounts(spark, d).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(20)))).withColumn(
        "discount", F.explode(F.sequence(F.lit(0), F.lit(15)))
    )
    p = F.col("step") / F.lit(20.0)
    return grid.select(
        "merchant_id", "band", F.round(p, 2).alias("p"), "discount",
        F.round(money.grid_ev(F.col("amount"), p, F.col("discount")), 8).alias("ev"),
    )


@query
def breakeven(spark, d):
    rows = typical_amounts(spark, d).withColumn("discount", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return rows.select(
        "merchant_id", "band", "discount",
        F.round(money.breakeven_probability(F.col("amount"), F.col("discount")), 8).alias("p_breakeven"),
    )


PLAN_COLUMNS = (
    "payment_id", "merchant_id", "score", "failure_category", "arm", "action", "source", "discount_pct",
    "review_reason", "recoverable_amt", "total_cost", "ev_rupees", "ev_decision", "ev_reason", "final_status",
    "recovery_attempts_after",
)


@query
def recovery_plan(spark, d):
    return planned(spark, d).select(*PLAN_COLUMNS)


@query
def recovery_funnel(spark, d):
    """The flagship: how much of each merchant's failed revenue is worth pursuing."""
    status = F.col("final_status")
    live = status == "ACTION_TRIGGERED"
    return planned(spark, d).groupBy("merchant_id").agg(
        F.count(F.lit(1)).alias("ingested"),
        reports.count_if(F.col("score") > 0).alias("ml_scored"),
        reports.count_if(status == "EXPIRED").alias("expired"),
        reports.count_if(status == "LOW_PRIORITY_SKIP").alias("low_priority"),
        reports.count_if(status == "PENDING_APPROVAL").alias("pending_approval"),
        reports.count_if(status == "EV_BYPASSED").alias("ev_bypassed"),
        reports.count_if(live).alias("action_triggered"),
        F.sum("amount_paise").alias("at_risk_paise"),
        F.sum(F.when(live, F.col("amount_paise")).otherwise(0)).alias("pursued_paise"),
        F.coalesce(F.sum(F.when(live, F.col("ev_rupees"))), F.lit(0)).cast("decimal(28,2)").alias("expected_rupees"),
    )


@query
def decision_audit(spark, d):
    return audit_rows(planned(spark, d)).select(
        "transaction_id", "step", "action_taken", "source", "decision_rationale"
    )


@query
def review_queue(spark, d):
    return review_rows(planned(spark, d)).select(
        "hitl_id", "transaction_id", "amount_paise", "proposed_action", "proposed_discount", "trigger_reason", "ml_score", "ab_arm"
    )


@query
def channel_fallback(spark, d):
    sent = outbound.channel_results(view(spark, d, "dispatch_log"))
    rows = ev_input(spark, d).join(sent, "payment_id", "left")
    return outbound.channel_fallback(rows, first="whatsapp").select(
        "payment_id", "fallback_status", "final_channel", "hops", "path"
    )


@query
def smart_routing(spark, d):
    return scored(spark, d).select(
        "payment_id", classify.wants_rerouting(F.col("failure_category")).alias("smart_routing")
    )


@query
def link_requests(spark, d):
    now = F.unix_timestamp(F.col("created_at").cast("timestamp"))
    rows = scored(spark, d).withColumn("asked", (F.col("amount_paise") % 20).cast("double"))
    out = outbound.link_requests(rows, now, discount="asked")
    return out.select(
        "reference_id", "amount", "currency", "description", "expire_by", "smart_routing", "discount_pct",
        F.coalesce(F.col("options.upi"), F.lit(False)).alias("offers_upi"),
    )


@query
def rendered_messages(spark, d):
    rows = routed(spark, d)
    body = messages.render(
        F.col("channel"), F.col("amount_paise"), F.col("merchant_id"),
        F.coalesce(F.col("failure_reason"), F.lit("the bank could not complete the payment")),
        F.concat(F.lit("https://pay.example/"), F.col("payment_id")), F.lit("Customer"),
    )
    return rows.select("payment_id", "channel", body.alias("body"))


@query
def scoring_features(spark, d):
    return scored(spark, d).select("payment_id", "amount_rupees", "code_index", "hour_of_day", "retry_count")


@query
def rule_scores(spark, d):
    return scored(spark, d).select("payment_id", "score")


@query
def explanations(spark, d):
    out = scoring.with_explanation(scored(spark, d))
    names = [f"c_{n}" for n in scoring.CONTRIBUTIONS] + ["base_value"]
    return out.select("payment_id", *[F.round(n, 6).alias(n) for n in names], "advice", "why")


@query
def feature_importance(spark, d):
    out = scoring.with_explanation(scored(spark, d))
    means = out.agg(*[F.avg(F.abs(F.col(f"c_{n}"))).alias(n) for n in scoring.CONTRIBUTIONS])
    return means.unpivot([], list(scoring.CONTRIBUTIONS), "feature", "importance").select(
        "feature", F.round("importance", 6).alias("importance")
    )


@query
def pii_masks(spark, d):
    docs = table(spark, d, "documents")
    return privacy.mask_text(docs, "text", "masked").select(
        "doc_id", F.md5("masked").alias("masked_md5"), (F.col("masked") != F.col("text")).alias("changed")
    )


@query
def redacted_fields(spark, d):
    """Named sensitive fields of the event payload, nested map included."""
    rows = table(spark, d, "customer").select(
        "c_custkey",
        F.struct(
            F.col("c_name").alias("customer_name"),
            F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@mail.example")).alias("email"),
            F.concat(F.lit("98"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("contact"),
            F.create_map(
                F.lit("card_number"), F.concat(F.lit("4111 1111 1111 "), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")),
                F.lit("network"), F.lit("visa"),
            ).alias("card"),
            F.col("c_mktsegment").alias("segment"),
        ).alias("payload"),
        F.create_map(F.lit("contact"), F.lit(9800000000) + F.col("c_custkey"), F.lit("tries"), F.col("c_custkey").cast("bigint")).alias("numbers"),
        F.create_map(F.lit("email"), F.array(F.lit("joe@x.com")), F.lit("tags"), F.array(F.col("c_mktsegment"))).alias("lists"),
        F.create_map(F.lit("contact"), F.struct(F.lit("9876543210").alias("n")), F.lit("place"), F.struct(F.col("c_mktsegment").alias("n"))).alias("parts"),
    )
    return privacy.redact_frame(rows).select(
        "c_custkey", "payload.customer_name", "payload.email", "payload.contact",
        F.col("payload.card")["card_number"].alias("card_number"), F.col("payload.card")["network"].alias("network"),
        "payload.segment",
        F.col("numbers")["contact"].alias("map_contact"), F.col("numbers")["tries"].alias("map_tries"),
        F.col("lists")["email"].alias("map_email"), F.col("lists")["tags"].alias("map_tags"),
        F.col("parts")["contact"].alias("map_part"), F.col("parts")["place"].alias("map_place"),
    )


@query
def encrypted_columns(spark, d):
    key, other = crypto.derive_key("column-secret"), crypto.derive_key("another-secret")
    sealed = table(spark, d, "documents").select("doc_id", "text", crypto.encrypt(F.col("text"), key).alias("sealed"))
    return sealed.select(
        "doc_id", crypto.is_encrypted(F.col("sealed")).alias("encrypted"),
        F.md5(crypto.decrypt(F.col("sealed"), key)).alias("restored_md5"),
        (crypto.decrypt(F.col("sealed"), other) == F.col("sealed")).alias("other_key_unchanged"),
        (crypto.decrypt(F.col("text"), key) == F.col("text")).alias("plain_unchanged"),
    )


def checked_answers(spark, d):
    category = F.element_at(
        F.array(*[F.lit(c) for c in (*answers.CATEGORIES, "MADE_UP")]), (F.col("conv_id") % 8 + 1).cast("int")
    )
    rows = view(spark, d, "llm_answers").withColumns(
        {
            "failure_category": category,
            "facts": F.array(F.lit("le"), F.lit("THE"), F.substring("action", 1, 2)),
        }
    )
    return answers.with_checks(rows)


@query
def answer_checks(spark, d):
    return checked_answers(spark, d).select("conv_id", "turn", "faithfulness", *answers.CHECKS, "overall")


@query
def answer_pass_rates(spark, d):
    rates = [F.round(F.avg(F.col(c).cast("int")), 6).alias(c) for c in (*answers.CHECKS, "overall")]
    return checked_answers(spark, d).groupBy("action").agg(F.count(F.lit(1)).alias("n"), *rates)


@query
def tenant_rate_limits(spark, d):
    rows = view(spark, d, "outcomes").select("merchant_id", "occurred_at")
    plan = F.when(F.col("merchant_id") == "m0", "Enterprise").when(F.col("merchant_id") == "m1", "Growth").otherwise("Starter")
    plans = rows.select("merchant_id").distinct().withColumn("limit_per_min", classify.plan_limit(plan))
    return reports.rate_limits(rows, plans, "occurred_at")


def review_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Open items, decided by a lead, a day later by a clerk, and some twice at the same moment."""
    queue = view(spark, d, "hitl_queue")
    made = queue.filter(F.col("decision").isNotNull()).select(
        "hitl_id", "decision", F.lit("lead").alias("decided_by"), F.col("created_at").alias("decided_at"),
        F.lit("seen").alias("notes"),
    )
    later = queue.select(
        F.when(F.col("decision").isNull(), F.concat(F.col("hitl_id"), F.lit("_x"))).otherwise(F.col("hitl_id")).alias("hitl_id"),
        F.lit("REJECTED").alias("decision"), F.lit("clerk").alias("decided_by"),
        (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("decided_at"),
        F.lit("late").alias("notes"),
    )
    tied = made.filter("decision <> 'REJECTED'").withColumn("decision", F.lit("REJECTED"))
    open_queue = queue.withColumn("decision", F.lit(None).cast("string"))
    return review.apply_decisions(open_queue, made.unionByName(later).unionByName(tied).unionByName(tied))


@query
def review_decisions(spark, d):
    return review_outcomes(spark, d).select("hitl_id", "decision", "decided_by", "notes", "result", "new_status", "audit_action")


@query
def reviewed_transactions(spark, d):
    """Transactions after the review: what was approved goes on."""
    txn = view(spark, d, "txn").select("payment_id", "status")
    return review.resolve_transactions(txn, review_outcomes(spark, d))


@query
def review_audit(spark, d):
    """The audit rows that the review adds."""
    return review.review_audit(review_outcomes(spark, d))


# --- reports ---------------------------------------------------------------------

@query
def status_funnel(spark, d):
    return reports.funnel(scored(spark, d))


@query
def tenant_funnel(spark, d):
    return reports.funnel(scored(spark, d), "merchant_id")


@query
def root_causes(spark, d):
    return reports.root_causes(scored(spark, d))


@query
def minute_series(spark, d):
    return reports.minute_series(view(spark, d, "txn"))


@query
def revenue_summary(spark, d):
    return reports.summary(scored(spark, d))


@query
def shadow_summary(spark, d):
    policy = Policy(execution_mode="SHADOW")
    return reports.shadow_summary(shadow_rows(planned(spark, d, policy), policy))


@query
def message_audit(spark, d):
    """The audit row of every personalised message."""
    return retrieval.dispatch_audit(message_log(spark, d))


@query
def message_log_appended(spark, d):
    """Messages that the log does not hold yet; the log has those of even order keys."""
    log = message_log(spark, d).select("rag_log_id", "payment_id", "channel", "top_similarity", "created_at")
    stored = log.where(F.substring_index("payment_id", "_", -1).cast("bigint") % 2 == 0).select("rag_log_id")
    return tables.insert_or_ignore(stored, log, "rag_log_id", F.struct("created_at", "payment_id")).select("rag_log_id", "payment_id", "channel", "top_similarity")


@query
def dispatch_summary(spark, d):
    return reports.dispatch_summary(message_log(spark, d))


@query
def dispatch_by_category(spark, d):
    return reports.dispatch_by_category(message_log(spark, d))


@query
def template_influence(spark, d):
    return reports.template_influence(message_log(spark, d).withColumn("retrieved_ids", F.to_json("retrieved_ids")))


@query
def similarity_histogram(spark, d):
    return reports.equal_width_histogram(message_log(spark, d), "top_similarity", 20)


@query
def arm_counters(spark, d):
    return experiments.arm_counters(view(spark, d, "outcomes"))


@query
def arm_lift(spark, d):
    return experiments.ab_report(view(spark, d, "outcomes"))


@query
def status_distribution(spark, d):
    return reports.status_distribution(view(spark, d, "txn"))


@query
def score_histogram(spark, d):
    return reports.equal_width_histogram(scored(spark, d).filter(F.col("score") > 0), "score", 25)


@query
def latency_histogram(spark, d):
    return reports.equal_width_histogram(view(spark, d, "dispatch_log"), "latency_ms", 20)


@query
def latency_cumulative(spark, d):
    return reports.cumulative_histogram(view(spark, d, "dispatch_log"), "latency_ms")


@query
def category_strategy_rates(spark, d):
    return reports.pivot_mean(
        view(spark, d, "outcomes"), "failure_category", "strategy", "recovered",
        ["retry_now", "retry_15m", "offer_upi", "offer_emi"],
    )


@query
def report_by_category(spark, d):
    return reports.by_category(scored(spark, d))


@query
def report_by_status(spark, d):
    return reports.by_status(view(spark, d, "txn"))


@query
def report_by_action_source(spark, d):
    return reports.by_action_source(view(spark, d, "audit_seed"))


@query
def report_by_status_category(spark, d):
    return reports.by_status_category(scored(spark, d))


@query
def result_digest(spark, d):
    return reports.digest(view(spark, d, "txn"))


@query
def roi_report(spark, d):
    return experiments.roi(experiments.two_arms(view(spark, d, "outcomes")))


@query
def discount_what_if(spark, d):
    return experiments.discount_what_if(experiments.two_arms(view(spark, d, "outcomes")))


@query
def significance(spark, d):
    return experiments.z_test(experiments.two_arms(view(spark, d, "outcomes"))).select(
        "c_sent", "c_rec", "v_sent", "v_rec", "z_score", "sig_95", "sig_99"
    )


@query
def strategy_report(spark, d):
    return experiments.strategy_report(view(spark, d, "outcomes"), "retry_now")


@query
def tenant_comparison(spark, d):
    return reports.tenant_comparison(view(spark, d, "txn"))


@query
def delivery_by_channel(spark, d):
    return reports.delivery_stats(view(spark, d, "dispatch_log"), "channel")


@query
def link_outcomes(spark, d):
    log = view(spark, d, "dispatch_log")
    status = F.when(F.col("status") == "delivered", "paid").when(F.col("status") == "failed", "expired").otherwise("created")
    return reports.link_stats(log.withColumn("link_status", status))


@query
def latency_percentiles(spark, d):
    log = view(spark, d, "dispatch_log").withColumn("ok", F.col("status") != "failed")
    keys = ["channel"]
    good = ranks.nearest_rank(log.filter("ok"), keys, "latency_ms", (50, 95, 99))
    epoch = F.unix_timestamp(F.col("sent_at").cast("timestamp"))
    span = F.greatest((F.max(epoch) - F.min(epoch)).cast("double"), F.lit(0.001))
    totals = log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        reports.count_if(~F.col("ok") & (F.col("latency_ms") == 0)).alias("dropped"),
        F.round(F.avg(F.when(F.col("ok"), F.col("latency_ms"))), 4).alias("mean_ms"),
        F.round(F.count(F.lit(1)) / span * 86400, 4).alias("per_day"),
    )
    return totals.join(good, keys).select(
        "channel", "total", F.col("n").alias("succeeded"), "dropped", "mean_ms", "per_day", "p50", "p95", "p99",
        (F.col("p95") < 30).alias("sla_ok"),
    )


@query
def merchant_impact(spark, d):
    return reports.merchant_impact(view(spark, d, "failures"))


@query
def modal_causes(spark, d):
    return reports.modal_cause(scored(spark, d), "merchant_id")


@query
def review_stats(spark, d):
    return reports.review_stats(view(spark, d, "hitl_queue"))


@query
def arm_posteriors(spark, d):
    rows = outcomes(spark, d).withColumn("reward", F.col("recovered") * 0.75 + 0.25 * (F.col("friction") == 0).cast("int"))
    return experiments.posteriors(rows).select(
        "arm", "context", F.round("alpha", 2).alias("alpha"), F.round("beta", 2).alias("beta"), F.round("mean", 4).alias("mean"), "pulls"
    )


@query
def arm_mean_rates(spark, d):
    return experiments.arm_means(experiments.posteriors(outcomes(spark, d), reward="recovered"))


def with_window(df):
    index = (F.col("call_id") % len(RETRY_WINDOWS_MIN)).cast("int")
    return df.withColumn("window_min", F.get(F.array(*[F.lit(m) for m in RETRY_WINDOWS_MIN]), index))


@query
def method_posteriors(spark, d):
    rows = experiments.with_method(view(spark, d, "outcomes"))
    return experiments.option_posteriors(rows, "method", METHODS).drop("rank")


@query
def timing_posteriors(spark, d):
    rows = with_window(view(spark, d, "outcomes"))
    out = experiments.option_posteriors(rows, "window_min", RETRY_WINDOWS_MIN)
    return out.withColumn("upper", F.round(experiments.upper_bound(F.col("alpha"), F.col("beta")), 6)).drop("rank")


def _measure(df, *names):
    return df.select("merchant_id", *[F.round(n, 6).alias(n) for n in names])


@query
def ks_amounts(spark, d):
    return _measure(drift.ks_two_sample(outcomes(spark, d), ["merchant_id"], "amount_paise", F.col("live")), "ks_stat", "ks_pval")


@query
def ks_codes(spark, d):
    return _measure(drift.ks_two_sample(coded(spark, d), ["merchant_id"], "code_index", F.col("live")), "ks_stat", "ks_pval")


@query
def psi_amounts(spark, d):
    return drift.psi(outcomes(spark, d), ["merchant_id"], "amount_paise", F.col("live"))


@query
def drift_verdicts(spark, d):
    out = drift.drift_report(coded(spark, d), ["merchant_id"], "code_index", "amount_rupees", F.col("live"))
    return out.select(
        "merchant_id", "n_live", F.round("ks_stat", 4).alias("ks_stat"), F.round("ks_pval", 4).alias("ks_pval"), "psi", "drift", "level"
    )


@query
def brier_scores(spark, d):
    return drift.brier(view(spark, d, "outcomes"), "ml_score", "recovered", "merchant_id")


# --- time series and ledger --------------------------------------------------------

@query
def failure_bins(spark, d):
    return timeseries.resample(view(spark, d, "failures")).select("merchant_id", "bin", "failures", "amount_paise")


@query
def rolling_anomalies(spark, d):
    return timeseries.rolling_z(timeseries.resample(view(spark, d, "failures")))


@query
def anomaly_bins(spark, d):
    return anomaly.anomaly_report(timeseries.rolling_z(timeseries.resample(view(spark, d, "failures")), threshold=2.0))


@query
def anomaly_report(spark, d):
    """Bins that the rolling threshold or the isolation forest flags."""
    bins = timeseries.resample(view(spark, d, "failures"))
    flagged = anomaly.isolation_flags(bins, ["failures", "amount_paise"]).select("merchant_id", "bin", "isolation_anomaly")
    start = F.timestamp_seconds("bin").cast("timestamp_ntz").alias("bin_start")
    joined = timeseries.rolling_z(bins).join(flagged.select("merchant_id", start, "isolation_anomaly"), ["merchant_id", "bin_start"])
    return anomaly.anomaly_report(joined, "isolation_anomaly")


@query
def failure_forecast(spark, d):
    return timeseries.forecast(timeseries.resample(view(spark, d, "failures")))


@query
def drift_monitor(spark, d):
    rows = coded(spark, d)
    return drift.monitor(rows, rows.filter(~F.col("live")), "merchant_id", "call_id", "code_index", "amount_rupees")


@query
def audit_chain(spark, d):
    return chain(spark, d).select("chain_key", "seq", "previous_hash", "current_hash", "hmac_signature")


@query
def audit_roots(spark, d):
    return ledger.seal(chain(spark, d))


@query
def audit_verified(spark, d):
    return ledger.verify(chain(spark, d), LEDGER_KEY)


@query
def audit_deleted_block(spark, d):
    """The ledger after someone removed each chain's block 1, against what was sealed."""
    whole = chain(spark, d)
    return ledger.verify(whole.where("block <> 1"), LEDGER_KEY, sealed=ledger.seal_blocks(whole))


@query
def audit_cut_tail(spark, d):
    """Blocks that lost their rows with the highest sequence numbers."""
    whole = chain(spark, d)
    return ledger.missing(whole.where("seq % 1024 < 900"), ledger.seal_blocks(whole))


def tree(spark: SparkSession, d: str) -> DataFrame:
    """The Merkle tree over the ledger's sealed blocks, stored by two appends."""
    sealed = materialise(ledger.seal_blocks(chain(spark, d)), "sealed")
    first = materialise(proofs.grow(proofs.leaves(sealed.where("block < 5"))), "tree")
    second = proofs.grow(proofs.leaves(sealed.where("block >= 5"), first), first)
    return materialise(first.unionByName(second), "tree")


@query
def audit_tree_roots(spark, d):
    return proofs.roots(tree(spark, d))


@query
def audit_inclusion(spark, d):
    """A proof for every sealed block that it is in its chain's tree, checked against the root."""
    nodes = tree(spark, d)
    blocks = nodes.where("level = 0").select("chain_key", F.col("node").alias("leaf"), "hash")
    given = proofs.inclusion(nodes, blocks.join(proofs.tree_sizes(nodes), "chain_key"))
    steps = F.transform("path", lambda x: x.getField("hash"))
    return proofs.included(given, proofs.roots(nodes)).select(
        "chain_key", "leaf", F.size("path").alias("steps"), F.sha2(F.array_join(steps, ""), 256).alias("path_sha256"), "ok"
    )


@query
def audit_consistency(spark, d):
    """A proof per chain that its tree grew only at the end since it had half its blocks."""
    nodes = tree(spark, d)
    sizes = proofs.tree_sizes(nodes).where("size >= 2")
    asked = sizes.select("chain_key", F.floor(F.col("size") / 2).alias("old"), F.col("size").alias("new"))
    known = proofs.roots(nodes, sizes.unionByName(asked.select("chain_key", F.col("old").alias("size"))))
    parts = F.transform("proof", lambda x: x.getField("hash"))
    return proofs.consistent(proofs.consistency(nodes, asked), known).select(
        "chain_key", "old", "new", F.size("proof").alias("parts"), F.sha2(F.array_join(parts, ""), 256).alias("proof_sha256"), "ok"
    )


def decided(spark: SparkSession, d: str) -> DataFrame:
    """The audit events of all decisions as ledger rows: one chain per merchant, numbered by transaction and step."""
    rows = audit_rows(planned(spark, d))
    number = F.substring_index("transaction_id", "_", -1).cast("bigint")
    return rows.select(
        F.col("merchant_id").alias("chain_key"), (number * 8 + F.col("step")).alias("seq"), "transaction_id", "merchant_id",
        F.col("recoverability_score").cast("decimal(7,6)").alias("recoverability_score"), "logged_at", "action_taken", "decision_rationale", "source",
    )


@query
def decision_ledger(spark, d):
    """Every decision step in the hash chain of its merchant."""
    return ledger.append(decided(spark, d), LEDGER_KEY).select("chain_key", "seq", "action_taken", "previous_hash", "current_hash")


@query
def audit_forged_rationale(spark, d):
    """The decision ledger after someone rewrote the rationale of every 97th transaction."""
    whole = ledger.append(decided(spark, d), LEDGER_KEY)
    hit = F.floor(F.col("seq") / 8) % 97 == 0
    forged = whole.withColumn("decision_rationale", F.when(hit, "FORGED").otherwise(F.col("decision_rationale")))
    return ledger.verify(forged, LEDGER_KEY)


@query
def audit_tamper_summary(spark, d):
    return ledger.verify(tampered(spark, d), LEDGER_KEY)


@query
def audit_tampered_rows(spark, d):
    return ledger.tampered_rows(tampered(spark, d), LEDGER_KEY)


@query
def first_seen_events(spark, d):
    return locks.first_seen(table(spark, d, "events"), "user_id", "ts", "event_id")


# --- retrieval, choice and models ----------------------------------------------------

@query
def term_weights(spark, d):
    return retrieval.term_weights(table(spark, d, "documents"), "doc_id", "text").select(
        "doc_id", "token", F.round("weight", 6).alias("weight")
    )


@query
def template_ranking(spark, d):
    rows = routed(spark, d)
    asked = rows.withColumn(
        "q", retrieval.query_text(F.col("failure_category"), F.col("amount_paise"), F.col("channel"), F.col("failure_reason"))
    )
    ranked = retrieval.rank_templates(asked, retrieval.template_library(spark), "q")
    return ranked.select("payment_id", F.posexplode("hits").alias("i", "h")).select(
        "payment_id", (F.col("i") + 1).alias("position"), "h.template_id", "h.cosine", "h.score"
    )


@query
def personalised_messages(spark, d):
    return message_log(spark, d).select(
        "payment_id", "channel", "amount_band", F.array_join("retrieved_ids", ",").alias("retrieved_ids"),
        "top_similarity", "drafted_message", "llm_used",
    )


@query
def keyword_hits(spark, d):
    txn = scored(spark, d).select("payment_id", "status", "failure_category", "created_at")
    audit = view(spark, d, "audit_seed").select(
        F.col("transaction_id").alias("payment_id"), "action_taken", "source", F.col("logged_at").alias("created_at")
    )
    rows = txn.unionByName(audit, allowMissingColumns=True)
    return retrieval.keyword_hits(
        rows.withColumn("row_id", F.concat_ws(":", "payment_id", "action_taken", "source", "status")),
        "Which recovered insufficient_funds payments were clicked by the rule_engine?", "created_at", "row_id",
    ).select("row_id", "created_at", "hits")


@query
def dense_neighbours(spark, d):
    e = table(spark, d, "embeddings")
    out = retrieval.dense_top_k(e, retrieval.centroids(e), "vec_id")
    return out.select("vec_id", F.posexplode("hits").alias("i", "h")).select(
        "vec_id", (F.col("i") + 1).alias("position"), "h.label", F.round(-F.col("h.order"), 5).alias("cosine")
    )


@query
def chosen_arms_ucb(spark, d):
    rows = outcomes(spark, d)
    post = experiments.posteriors(rows, reward="recovered")
    return experiments.choose_arm(rows, post, mode="ucb").select("payment_id", "context", "chosen_arm")


@query
def chosen_arms_greedy(spark, d):
    rows = outcomes(spark, d)
    post = experiments.posteriors(rows, reward="recovered")
    return experiments.choose_arm(rows, post, mode="epsilon_greedy", epsilon=0.0).select("payment_id", "context", "chosen_arm")


@query
def chosen_arms_thompson(spark, d):
    rows = outcomes(spark, d)
    post = experiments.posteriors(rows, reward="recovered")
    return experiments.choose_arm(rows, post).select("payment_id", "context", "chosen_arm")


def advise(spark, d, mode):
    won = view(spark, d, "outcomes")
    methods = experiments.option_posteriors(experiments.with_method(won), "method", METHODS)
    windows = experiments.option_posteriors(with_window(won), "window_min", RETRY_WINDOWS_MIN)
    return experiments.recommend_retry(scored(spark, d), methods, windows, mode=mode, digits=6).select(
        "payment_id", "payment_method", "retry_timing_minutes", "retry_count_advised",
        "expected_success_probability", "expected_revenue",
    )


@query
def retry_advice(spark, d):
    return advise(spark, d, "mean")


@query
def retry_advice_sampled(spark, d):
    return advise(spark, d, "thompson")


@query
def isolation_flags(spark, d):
    bins = timeseries.resample(view(spark, d, "failures"))
    flags = anomaly.isolation_flags(bins, ["failures", "amount_paise"])
    return flags.select("merchant_id", "bin", "failures", "amount_paise", F.round("isolation_score", 6).alias("isolation_score"), "isolation_anomaly")


@query
def model_scores(spark, d):
    rows = coded(spark, d)
    model, value, ok = models.train(rows, "payment_id", "logistic")
    return models.score(model, rows).select(
        "payment_id", "score", F.lit(round(value, 6)).alias("brier"), F.lit(ok).alias("accepted")
    )


@query
def boosted_model_scores(spark, d):
    rows = coded(spark, d)
    model, value, ok = models.train(rows, "payment_id", "boosted")
    return models.score(model, rows).select(
        "payment_id", "score", F.lit(round(value, 6)).alias("brier"), F.lit(ok).alias("accepted")
    )


@query
def retrained_on_drift(spark, d):
    """Live calls against an earlier period with other amounts: drift, retrain, publish, score."""
    rows = coded(spark, d)
    reference = rows.filter(~F.col("live")).withColumn("amount_rupees", F.col("amount_rupees") * 10)
    return rescored(spark, rows, reference, rows.filter("live"))


@query
def kept_without_drift(spark, d):
    """The same with live calls that look like the earlier ones: the model in use scores on."""
    rows = coded(spark, d)
    return rescored(spark, rows, rows, rows)


@query
def model_registry(spark, d):
    """Pointers of a registry after a retrain on drift, a call without drift, a rollback and another retrain."""
    rows = coded(spark, d)
    reference = rows.filter(~F.col("live")).withColumn("amount_rupees", F.col("amount_rupees") * 10)
    live = materialise(rows.filter("live"), "live-calls")
    base, value, _ = models.train(reference, "payment_id", "logistic")
    registry = models.publish(spark, base, None, value, reference)
    models.retrain_on_drift(None, live, "payment_id", registry, "logistic")
    models.retrain_on_drift(None, live, "payment_id", registry, "logistic")
    models.rollback(spark, registry)
    models.retrain_on_drift(None, live, "payment_id", registry, "logistic")
    return models.history(spark, registry).drop("brier")


def rescored(spark: SparkSession, rows: DataFrame, reference: DataFrame, live: DataFrame) -> DataFrame:
    """Scores of the model that is in use after the drift check: the one fitted on the reference, or its successor."""
    base, _, _ = models.train(reference, "payment_id", "logistic")
    registry = models.publish(spark, base, None)
    result = models.retrain_on_drift(reference, live, "payment_id", registry=registry, kind="logistic")
    model = models.current(spark, result["registry"])
    return models.score(model, rows).select("payment_id", "score", F.lit(result["drift"]).alias("drift"))
