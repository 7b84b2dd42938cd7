"""Dashboard aggregates. Every one is a combinable aggregate on low-cardinality keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paymend.functions.money import MONEY, rupees

TRIGGERED = ("ACTION_TRIGGERED", "RECOVERING", "RECOVERED")
LATENCY_BOUNDS_MS = (5, 10, 15, 20, 25, 30, 50, 100, 250, 500, 1000)
REVENUE = "decimal(30,2)"


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint")


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole rounded, 0 when the whole is 0."""
    share = F.try_divide(part.cast("double") * 100, whole.cast("double"))
    return F.coalesce(F.round(share, digits), F.lit(0.0))


def funnel(df: DataFrame, *by: str, score: str = "recoverability_score", status: str = "status") -> DataFrame:
    """Counts per stage, overall or per the given columns."""
    state = F.col(status)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("ingested"),
        count_if(F.col(score) > 0).alias("ml_scored"),
        count_if(~state.isin("FAILED", "LOW_PRIORITY_SKIP")).alias("agent_evaluated"),
        count_if(state.isin(*TRIGGERED)).alias("action_triggered"),
        count_if(state == "RECOVERED").alias("recovered"),
    )


def root_causes(df: DataFrame, category: str = "failure_category") -> DataFrame:
    return (
        df.filter(F.col(category).isNotNull())
        .groupBy(category)
        .agg(F.count(F.lit(1)).alias("failures"))
        .orderBy(F.col("failures").desc(), category)
    )


def minute_series(df: DataFrame, at: str = "created_at") -> DataFrame:
    """Money at risk and recovered per minute, in rupees."""
    won = F.when(F.col("status") == "RECOVERED", F.col("amount_paise")).otherwise(0)
    return (
        df.groupBy(F.date_trunc("minute", F.col(at)).alias("minute"))
        .agg(F.sum("amount_paise").alias("_risk"), F.sum(won).alias("_won"))
        .select(
            "minute",
            rupees(F.col("_risk")).cast(REVENUE).alias("revenue_at_risk"),
            rupees(F.col("_won")).cast(REVENUE).alias("revenue_recovered"),
        )
    )


def summary(df: DataFrame, score: str = "recoverability_score") -> DataFrame:
    won = F.col("status") == "RECOVERED"
    zero = F.lit(0).cast(REVENUE)
    agg = df.agg(
        F.sum("amount_paise").alias("_risk"),
        F.sum(F.when(won, F.col("amount_paise")).otherwise(0)).alias("_won"),
        F.count(F.lit(1)).alias("_n"),
        count_if(won).alias("_k"),
        F.avg(score).alias("_s"),
    )
    return agg.select(
        F.coalesce(rupees(F.col("_risk")).cast(REVENUE), zero).alias("total_at_risk"),
        F.coalesce(rupees(F.col("_won")).cast(REVENUE), zero).alias("total_recovered"),
        percent(F.col("_k"), F.col("_n")).alias("recovery_rate"),
        F.coalesce(F.round("_s", 4), F.lit(0.0)).alias("avg_recoverability_score"),
    )


def shadow_summary(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Totals of the shadow ledger. ``approximate`` trades the exact distinct count for a sketch."""
    distinct = F.approx_count_distinct("payment_id") if approximate else F.countDistinct("payment_id")
    return df.agg(
        F.count(F.lit(1)).alias("total_events"),
        count_if(F.col("ev_decision") == "BYPASS").alias("bypassed"),
        count_if(F.col("ev_decision") == "PROCEED").alias("would_proceed"),
        F.round(F.avg(F.col("ev_rupees").cast("decimal(18,2)")).cast("double"), 4).alias("avg_ev"),
        F.sum("recoverable_amt").cast(REVENUE).alias("total_recoverable"),
        distinct.alias("unique_transactions"),
    )


def dispatch_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_dispatches"),
        count_if(F.col("llm_used")).alias("llm_drafted"),
        count_if(~F.col("llm_used")).alias("template_only"),
        F.round(F.avg("top_similarity"), 4).alias("avg_similarity"),
        F.round(F.avg("latency_ms"), 4).alias("avg_latency_ms"),
        F.countDistinct("failure_category").alias("unique_categories"),
    )


def dispatch_by_category(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("failure_category") != "")
        .groupBy("failure_category")
        .agg(F.count(F.lit(1)).alias("dispatches"), F.round(F.avg("top_similarity"), 4).alias("avg_sim"))
    )


def status_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def equal_width_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """``bin, lower, upper, n`` over the observed range; empty bins are not listed."""
    rows = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    span = rows.agg(F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi"))).scalar()
    lo, hi = F.col("_s.lo"), F.col("_s.hi")
    width = (hi - lo) / F.lit(float(bins))
    index = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_v") - lo) / width), F.lit(bins - 1))
    )
    return (
        rows.withColumn("_s", span)
        .groupBy(index.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.max(lo).alias("_lo"), F.max(width).alias("_w"))
        .select(
            "bin",
            F.round(F.col("_lo") + F.col("bin") * F.col("_w"), 6).alias("lower"),
            F.round(F.col("_lo") + (F.col("bin") + 1) * F.col("_w"), 6).alias("upper"),
            "n",
        )
    )


def cumulative_histogram(df: DataFrame, value: str, bounds=LATENCY_BOUNDS_MS) -> DataFrame:
    """Rows at or below each fixed bound, all bounds in one pass over the data."""
    sums = [count_if(F.col(value) <= b).alias(f"b{b}") for b in bounds]
    pairs = F.array(
        *[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{b}").alias("n")) for b in bounds],
        F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("n")),
    )
    return (
        df.agg(*sums, F.count(value).alias("total"))
        .select(F.explode(pairs).alias("_r"))
        .select(F.col("_r.le").cast("string").alias("le"), "_r.n")
    )


def pivot_mean(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Mean of ``value`` per row label and listed column label; absent pairs are 0."""
    wide = df.groupBy(row).pivot(column, columns).agg(F.avg(value))
    return wide.select(row, *[F.round(F.coalesce(F.col(c), F.lit(0.0)), 6).alias(c) for c in columns])


def by_category(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("failure_category").isNotNull())
        .groupBy("failure_category")
        .agg(F.count(F.lit(1)).alias("failures"), F.sum("amount_paise").alias("amount_paise"))
    )


def by_status(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(
        F.count(F.lit(1)).alias("transactions"), F.sum("amount_paise").alias("amount_paise")
    )


def by_action_source(audit: DataFrame) -> DataFrame:
    return audit.groupBy("action_taken", "source").agg(F.count(F.lit(1)).alias("actions"))


def by_status_category(df: DataFrame) -> DataFrame:
    return df.groupBy("status", "failure_category").agg(
        F.count(F.lit(1)).alias("transactions"), F.sum("amount_paise").alias("amount_paise")
    )


def report_for(question: str) -> str:
    """Name of the canned report a merchant question selects."""
    text = question.lower()
    if any(word in text for word in ("root", "cause", "category")):
        return "by_category"
    if "recovered" in text or "recovery rate" in text:
        return "by_status"
    if "audit" in text or "action" in text:
        return "by_action_source"
    return "by_status_category"


def digest(df: DataFrame) -> DataFrame:
    """Row count, represented value and recovered rows of any transaction frame."""
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        F.coalesce(rupees(F.sum("amount_paise")).cast(REVENUE), F.lit(0).cast(REVENUE)).alias("value_rupees"),
        count_if(F.col("status") == "RECOVERED").alias("recovered"),
    )


def template_influence(log: DataFrame, ids: str = "retrieved_ids") -> DataFrame:
    """Uses per template id; the id list may be an array or JSON text."""
    column = F.col(ids)
    if log.schema[ids].dataType.typeName() == "string":
        column = F.from_json(column, "array<string>")
    return log.select(F.explode(column).alias("template_id")).groupBy("template_id").agg(
        F.count(F.lit(1)).alias("uses")
    )


def tenant_comparison(df: DataFrame) -> DataFrame:
    won = count_if(F.col("status") == "RECOVERED")
    return df.groupBy("merchant_id").agg(
        F.count(F.lit(1)).alias("txns"),
        won.alias("recovered"),
        percent(won, F.count(F.lit(1))).alias("recovery_rate"),
    )


def delivery_stats(df: DataFrame, *by: str) -> DataFrame:
    """Counts and delivered share, overall or per column."""
    sent = count_if(F.col("status") == "delivered")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("dispatches"),
        sent.alias("delivered"),
        percent(sent, F.count(F.lit(1))).alias("delivery_rate"),
    )


def link_stats(df: DataFrame, status: str = "link_status") -> DataFrame:
    paid, gone = count_if(F.col(status) == "paid"), count_if(F.col(status) == "expired")
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("links"),
        paid.alias("paid"),
        gone.alias("expired"),
        percent(paid, total).alias("paid_pct"),
        percent(gone, total).alias("expired_pct"),
    )


def merchant_impact(df: DataFrame) -> DataFrame:
    """Rupees at stake per merchant."""
    return df.groupBy(F.coalesce("merchant_id", F.lit("default")).alias("merchant_id")).agg(
        rupees(F.sum("amount_paise")).cast(REVENUE).alias("impact_rupees")
    )


def modal_cause(df: DataFrame, *by: str) -> DataFrame:
    """Most frequent category, else code, else UNKNOWN; names break ties."""
    label = F.coalesce(
        F.when(F.col("failure_category") != "", F.col("failure_category")),
        F.when(F.col("failure_code") != "", F.col("failure_code")),
        F.lit("UNKNOWN"),
    )
    counts = df.groupBy(*by, label.alias("root_cause")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(
        F.min_by("root_cause", F.struct(-F.col("n"), F.col("root_cause"))).alias("root_cause"),
        F.max("n").alias("n"),
    )


def review_stats(queue: DataFrame) -> DataFrame:
    decided = F.col("decision")
    return queue.agg(
        count_if(decided.isNull()).alias("pending"),
        *[
            count_if(decided == word).alias(word.lower())
            for word in ("APPROVED", "REJECTED", "MODIFIED", "ESCALATED")
        ],
    )


def rate_limits(requests: DataFrame, plans: DataFrame, at: str) -> DataFrame:
    """Requests per tenant and minute against the plan limit. ``plans``: merchant_id, limit_per_min."""
    per_minute = requests.groupBy(
        "merchant_id", F.date_trunc("minute", F.col(at)).alias("minute")
    ).agg(F.count(F.lit(1)).alias("requests"))
    return per_minute.join(plans, "merchant_id").withColumn(
        "over_limit", F.col("requests") > F.col("limit_per_min")
    )
