"""Experiment statistics, bandit posteriors and arm choice."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from paymend.functions.classify import switch
from paymend.operators.reports import REVENUE, count_if, percent
from paymend.functions.money import rupees
from paymend.policy import ARMS, METHODS, RETRY_WINDOWS_MIN


def arm_counters(df: DataFrame, arm: str = "arm") -> DataFrame:
    """Sent, recovered and revenue per arm, with each arm's rate."""
    won = F.col("recovered") == 1
    agg = df.groupBy(arm).agg(
        F.count(F.lit(1)).alias("sent"),
        count_if(won).alias("recovered"),
        F.sum("amount_paise").alias("revenue_at_risk_paise"),
        F.sum(F.when(won, F.col("amount_paise")).otherwise(0)).alias("revenue_recovered_paise"),
    )
    return agg.withColumn("recovery_rate_pct", percent(F.col("recovered"), F.col("sent")))


def two_arms(df: DataFrame, arm: str = "arm") -> DataFrame:
    """Both arms side by side in one row: ``c_*`` for control, ``v_*`` for variant."""
    sides = []
    for prefix, name in (("c", "control"), ("v", "variant")):
        here = F.col(arm) == name
        won = here & (F.col("recovered") == 1)
        sides += [
            count_if(here).alias(f"{prefix}_sent"),
            count_if(won).alias(f"{prefix}_rec"),
            F.coalesce(F.sum(F.when(won, F.col("amount_paise"))), F.lit(0)).alias(f"{prefix}_won_paise"),
        ]
    return df.agg(*sides)


def ab_report(df: DataFrame, arm: str = "arm") -> DataFrame:
    """Rates in percent and relative lift, both two digits."""
    wide = two_arms(df, arm)
    wide = wide.withColumns(
        {
            "control_rate": percent(F.col("c_rec"), F.col("c_sent")),
            "variant_rate": percent(F.col("v_rec"), F.col("v_sent")),
        }
    )
    lift = F.round((F.col("variant_rate") - F.col("control_rate")) / F.col("control_rate") * 100, 2)
    return wide.select(
        "c_sent", "c_rec", "v_sent", "v_rec", "control_rate", "variant_rate",
        F.when(F.col("control_rate") > 0, lift).otherwise(F.lit(0.0)).alias("lift_pct"),
    )


def z_test(wide: DataFrame) -> DataFrame:
    """Add ``z_score, sig_95, sig_99`` to a :func:`two_arms` row (n > 10 on both sides)."""
    n1, n2 = F.col("c_sent").cast("double"), F.col("v_sent").cast("double")
    k1, k2 = F.col("c_rec").cast("double"), F.col("v_rec").cast("double")
    pooled = (k1 + k2) / (n1 + n2)
    se = F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    usable = (n1 > 10) & (n2 > 10) & (k1 > 0)
    z = F.when(usable, F.when(se > 0, (k2 / n2 - k1 / n1) / se).otherwise(0.0)).otherwise(0.0)
    return wide.withColumn("z_score", F.round(z, 4)).withColumns(
        {"sig_95": F.abs(z) > 1.96, "sig_99": F.abs(z) > 2.576}
    )


def roi(
    wide: DataFrame,
    margin_pct: float = 30.0,
    control_cost: float = 0.5,
    variant_cost: float = 2.0,
    platform_fee: float = 5.0,
    discount_avg: float = 3.0,
) -> DataFrame:
    """Gross, margin, cost and net per side, net lift, ROI and the waterfall step."""
    out = wide
    for side, cost in (("c", control_cost), ("v", variant_cost)):
        rec = F.col(f"{side}_rec").cast("double")
        avg = F.coalesce(
            F.try_divide(F.col(f"{side}_won_paise") / F.lit(100.0), rec), F.lit(0.0)
        )
        out = out.withColumn(f"{side}_avg", avg)
        out = out.withColumn(f"{side}_gross", rec * F.col(f"{side}_avg") * (1 - discount_avg / 100))
        out = out.withColumn(f"{side}_margin", F.col(f"{side}_gross") * margin_pct / 100)
        out = out.withColumn(f"{side}_cost", F.col(f"{side}_sent") * F.lit(cost) + rec * platform_fee)
        out = out.withColumn(f"{side}_net", F.col(f"{side}_margin") - F.col(f"{side}_cost"))
    lift = F.col("v_net") - F.col("c_net")
    step = (F.col("v_rec") - F.col("c_rec")) * F.col("v_avg") * (1 - discount_avg / 100) * margin_pct / 100
    money = ["c_gross", "c_margin", "c_cost", "c_net", "v_gross", "v_margin", "v_cost", "v_net"]
    return out.select(
        *[F.round(m, 2).alias(m) for m in money],
        F.round(lift, 2).alias("net_lift"),
        F.round(F.when(F.col("v_cost") > 0, lift / F.col("v_cost") * 100).otherwise(0.0), 2).alias("roi_pct"),
        F.round(step, 2).alias("recovery_step"),
        F.round(-(F.col("v_cost") - F.col("c_cost")), 2).alias("cost_step"),
    )


def discount_what_if(wide: DataFrame, margin_pct: float = 30.0, variant_cost: float = 2.0,
                     platform_fee: float = 5.0, top: int = 15) -> DataFrame:
    """Net variant revenue at each whole discount."""
    rec = F.col("v_rec").cast("double")
    avg = F.coalesce(F.try_divide(F.col("v_won_paise") / F.lit(100.0), rec), F.lit(0.0))
    cost = F.col("v_sent") * F.lit(variant_cost) + rec * platform_fee
    return wide.select(F.explode(F.sequence(F.lit(0), F.lit(top))).alias("discount"), rec.alias("r"),
                       avg.alias("a"), cost.alias("c")).select(
        "discount",
        F.round(F.col("r") * F.col("a") * (1 - F.col("discount") / 100) * margin_pct / 100 - F.col("c"), 2)
        .alias("net_revenue"),
    )


def strategy_report(df: DataFrame, baseline: str) -> DataFrame:
    """Rate with 95 % Wald interval, lift on the baseline, friction and time per strategy."""
    won = F.col("recovered") == 1
    agg = df.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("sent"),
        count_if(won).alias("recovered"),
        rupees(F.sum(F.when(won, F.col("amount_paise")).otherwise(0))).cast(REVENUE).alias("recovered_revenue"),
        (F.sum("friction") / F.count(F.lit(1))).alias("_friction"),
        F.sum(F.when(won, F.col("minutes_to_recovery"))).alias("_minutes"),
    )
    rate = F.col("recovered") / F.col("sent").cast("double")
    margin = 1.96 * F.sqrt(F.greatest(rate * (1 - rate), F.lit(0.000001)) / F.col("sent"))
    base = (
        df.filter(F.col("strategy") == baseline)
        .agg((count_if(won) / F.count(F.lit(1)).cast("double")).alias("r"))
        .scalar()
    )
    return agg.withColumn("_base", base).select(
        "strategy", "sent", "recovered",
        F.round(rate, 6).alias("recovery_rate"),
        "recovered_revenue",
        F.round(F.when(F.col("_base") > 0, (rate - F.col("_base")) / F.col("_base")).otherwise(0.0), 6).alias("lift"),
        F.round(F.greatest(F.lit(0.0), rate - margin), 6).alias("ci_low"),
        F.round(F.least(F.lit(1.0), rate + margin), 6).alias("ci_high"),
        F.round("_friction", 6).alias("customer_friction"),
        F.round(F.coalesce(F.try_divide(F.col("_minutes"), F.col("recovered")), F.lit(0.0)), 6)
        .alias("time_to_recovery_minutes"),
    )


def posteriors(updates: DataFrame, arm: str = "arm", context: str = "context", reward: str = "reward",
               arms: tuple[str, ...] = ARMS) -> DataFrame:
    """Beta posterior per (arm, context) from a flat prior; unlisted arms are ignored."""
    r = F.col(reward).cast("double")
    return (
        updates.filter(F.col(arm).isin(*arms))
        .groupBy(F.col(arm).alias("arm"), F.col(context).alias("context"))
        .agg(
            (F.sum(r) + 1).alias("alpha"),
            (F.sum(1 - r) + 1).alias("beta"),
            F.count(F.lit(1)).alias("pulls"),
        )
        .withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))
    )


def arm_means(post: DataFrame) -> DataFrame:
    """Mean of the context means per arm."""
    return post.groupBy("arm").agg(F.round(F.avg("mean"), 6).alias("mean"))


def merge_posteriors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two posteriors over disjoint updates into one; the prior is counted once."""
    both = old.select("arm", "context", "alpha", "beta", "pulls").unionByName(
        new.select("arm", "context", "alpha", "beta", "pulls")
    )
    return (
        both.groupBy("arm", "context")
        .agg(
            (F.sum(F.col("alpha") - 1) + 1).alias("alpha"),
            (F.sum(F.col("beta") - 1) + 1).alias("beta"),
            F.sum("pulls").alias("pulls"),
        )
        .withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))
    )


def beta_draw(key: Column, alpha: Column, beta: Column) -> Column:
    """Repeatable draw from Beta(alpha, beta): the same key always gives the same number.

    Two gamma draws (Marsaglia and Tsang, 2000) over whole Arrow batches. The
    uniforms come from a counter hash of the key, so the result depends on
    neither partitioning nor batch order.
    """
    def uniforms(seed, counter):
        with np.errstate(over="ignore"):
            x = seed + np.uint64(0x9E3779B97F4A7C15) * np.uint64(counter + 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
        return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53

    def gamma(seed, shape, lane):
        boosted = np.where(shape < 1, shape + 1, shape)
        d = boosted - 1 / 3
        c = 1 / np.sqrt(9 * d)
        out = np.full(len(shape), np.nan)
        open_rows = np.arange(len(shape))
        counter = lane
        while len(open_rows):
            s, dd, cc = seed[open_rows], d[open_rows], c[open_rows]
            u1, u2, u3 = (uniforms(s, counter + i) for i in range(3))
            normal = np.sqrt(-2 * np.log(u1)) * np.cos(2 * np.pi * u2)
            v = (1 + cc * normal) ** 3
            with np.errstate(invalid="ignore", divide="ignore"):
                ok = (v > 0) & (np.log(u3) < 0.5 * normal**2 + dd - dd * v + dd * np.log(v))
            out[open_rows[ok]] = dd[ok] * v[ok]
            open_rows = open_rows[~ok]
            counter += 3
        small = uniforms(seed, lane + 900_000)
        return np.where(shape < 1, out * small ** (1 / np.maximum(shape, 1e-9)), out)

    @F.pandas_udf(DoubleType())
    def draw(seed: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        s = seed.to_numpy(dtype=np.int64).view(np.uint64)
        x = gamma(s, np.maximum(a.to_numpy(dtype=float), 0.01), 1_000_000)
        y = gamma(s, np.maximum(b.to_numpy(dtype=float), 0.01), 3_000_000)
        return pd.Series(x / (x + y))

    return draw(F.xxhash64(key), alpha, beta)


def choose_arm(
    df: DataFrame,
    post: DataFrame,
    key: str = "payment_id",
    context: str = "context",
    mode: str = "thompson",
    epsilon: float = 0.15,
    arms: tuple[str, ...] = ARMS,
) -> DataFrame:
    """Add ``chosen_arm``: thompson, ucb or epsilon_greedy; the first arm wins a tie.

    The posterior comes as one row per context (63 with the closed category
    list). No hint: the planner broadcasts it when its measured size allows.
    """
    states = post.groupBy("context").agg(
        *[
            F.max(F.when(F.col("arm") == a, F.struct("alpha", "beta", "pulls"))).alias(f"_s{i}")
            for i, a in enumerate(arms)
        ]
    )
    total = post.agg(F.sum("pulls")).scalar()
    joined = df.join(states.withColumnRenamed("context", context), context, "left")
    joined = joined.withColumn("_t", F.greatest(F.coalesce(total, F.lit(0)), F.lit(1)))
    scores = []
    for i, name in enumerate(arms):
        alpha = F.coalesce(F.col(f"_s{i}.alpha"), F.lit(1.0))
        beta = F.coalesce(F.col(f"_s{i}.beta"), F.lit(1.0))
        pulls = F.greatest(F.coalesce(F.col(f"_s{i}.pulls"), F.lit(0)), F.lit(1))
        if mode == "ucb":
            score = alpha / (alpha + beta) + F.sqrt(2 * F.log(F.col("_t")) / pulls)
        elif mode == "epsilon_greedy":
            score = alpha / (alpha + beta)
        elif mode == "thompson":
            score = beta_draw(F.concat_ws("|", F.col(key), F.lit(name)), alpha, beta)
        else:
            raise ValueError(f"unknown mode: {mode}")
        scores.append(F.struct(score.alias("s"), F.lit(-i).alias("o"), F.lit(name).alias("arm")))
    best = F.array_max(F.array(*scores)).getField("arm")
    if mode == "epsilon_greedy" and epsilon > 0:
        spin = F.pmod(F.xxhash64(F.col(key), F.lit("explore")), F.lit(1_000_000)) / F.lit(1e6)
        other = F.pmod(F.xxhash64(F.col(key), F.lit("pick")), F.lit(len(arms)))
        best = F.when(spin < epsilon, F.element_at(F.array(*[F.lit(a) for a in arms]), (other + 1).cast("int"))).otherwise(best)
    return joined.withColumn("chosen_arm", best).drop("_t", *[f"_s{i}" for i in range(len(arms))])


def option_posteriors(df: DataFrame, option: str, options: tuple, revenue: str = "amount_paise") -> DataFrame:
    """Posterior and recovered revenue for each option of a fixed list, tried or not.

    One pass of conditional sums, so untried options need no outer join.
    """
    won = F.col("recovered") == 1
    sums = []
    for i, name in enumerate(options):
        here = F.col(option) == F.lit(name)
        sums += [
            count_if(here).alias(f"n{i}"),
            count_if(here & won).alias(f"k{i}"),
            F.coalesce(F.sum(F.when(here & won, F.col(revenue))), F.lit(0)).alias(f"r{i}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("option"),
                F.lit(i).alias("rank"),
                (F.col(f"k{i}") + 1).cast("double").alias("alpha"),
                (F.col(f"n{i}") - F.col(f"k{i}") + 1).cast("double").alias("beta"),
                F.col(f"n{i}").alias("trials"),
                F.col(f"r{i}").alias("revenue_paise"),
            )
            for i, name in enumerate(options)
        ]
    )
    return df.agg(*sums).select(F.explode(rows).alias("_r")).select("_r.*")


def upper_bound(alpha: Column, beta: Column) -> Column:
    """Posterior mean plus 1.96 standard deviations."""
    total = alpha + beta
    return alpha / total + 1.96 * F.sqrt(alpha * beta / (total * total * (total + 1)))


def recommend_retry(
    df: DataFrame, methods: DataFrame, windows: DataFrame, key: str = "payment_id", mode: str = "thompson",
    digits: int = 2,
) -> DataFrame:
    """Add method, timing, probability, retry count and expected revenue per row.

    ``methods`` and ``windows`` come from :func:`option_posteriors`: four and
    six rows, read as scalar subqueries. ``mode='mean'`` replaces the draw by
    the posterior mean.
    """
    packed = methods.agg(F.sort_array(F.collect_list(F.struct("rank", "option", "alpha", "beta")))).scalar()
    timing = windows.agg(
        F.max_by("option", F.struct(F.round(upper_bound(F.col("alpha"), F.col("beta")), 12), -F.col("rank")))
    ).scalar()
    out = df.withColumns({"_m": packed, "retry_timing_minutes": timing})
    scores = []
    for i, name in enumerate(METHODS):
        state = F.get(F.col("_m"), i)
        a, b = state.getField("alpha"), state.getField("beta")
        score = a / (a + b) if mode == "mean" else beta_draw(F.concat_ws("|", F.col(key), F.lit(name)), a, b)
        scores.append(F.struct(score.alias("s"), F.lit(-i).alias("o"), F.lit(name).alias("method")))
    best = F.array_max(F.array(*scores))
    context = F.upper(F.coalesce("failure_category", "failure_code", F.lit("UNKNOWN")))
    lift = F.when(context.isin("GATEWAY_DOWN", "NETWORK_TIMEOUT", "GATEWAY_ERROR"), 0.08).otherwise(0.0)
    base = F.when(F.coalesce(F.col("score"), F.lit(0.0)) == 0, 0.35).otherwise(F.col("score"))
    out = out.withColumn("_b", best)
    out = out.withColumn(
        "_p", F.greatest(F.lit(0.01), F.least(F.lit(0.99), base + lift + (F.col("_b.s") - 0.5) * 0.25))
    )
    return out.withColumns(
        {
            "payment_method": F.col("_b.method"),
            "expected_success_probability": F.round("_p", 4),
            "retry_count_advised": F.when(F.col("_p") > 0.65, 1).otherwise(2),
            "expected_revenue": F.round(F.col("amount_paise") / F.lit(100.0) * F.col("_p"), digits),
            "context": context,
        }
    ).drop("_m", "_b", "_p")


WINDOWS = RETRY_WINDOWS_MIN
METHOD_OF_STRATEGY = dict(zip(("retry_now", "retry_15m", "offer_upi", "offer_emi"), METHODS))


def with_method(df: DataFrame) -> DataFrame:
    """Payment method behind each strategy, for optimizer posteriors."""
    return df.withColumn("method", switch("strategy", METHOD_OF_STRATEGY, METHODS[0]))
