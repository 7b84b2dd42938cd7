"""Expected value in exact decimals, discount rules and break-even columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paymend.policy import DEFAULT_POLICY, Policy

CENT = "decimal(3,2)"
MONEY = "decimal(18,2)"


def dec(text, kind: str) -> Column:
    return F.lit(str(text)).cast(kind)


def rupees(paise: Column) -> Column:
    """Exact rupees. Multiplying by 0.01 keeps the decimal type that dividing loses."""
    return (paise.cast("decimal(18,0)") * dec("0.01", CENT)).cast("decimal(20,2)")


def guard_discount(discount: Column, policy: str, cap: float = 15.0) -> Column:
    """Discount after one of four rules.

    ``zero``  above the cap becomes 0; ``cap`` above the cap becomes the cap;
    ``clamp`` is forced into [0, cap]; ``reject`` above the cap becomes null.
    """
    limit = F.lit(float(cap))
    if policy == "zero":
        return F.when(discount > limit, F.lit(0.0)).otherwise(discount)
    if policy == "cap":
        return F.least(discount, limit)
    if policy == "clamp":
        return F.greatest(F.lit(0.0), F.least(discount, limit))
    if policy == "reject":
        return F.when(discount <= limit, discount)
    raise ValueError(f"unknown discount rule: {policy}")


def with_ev(
    df: DataFrame,
    amount: str = "amount_paise",
    probability: str = "score",
    discount: str = "discount_pct",
    policy: Policy = DEFAULT_POLICY,
    fee: Column | None = None,
    prefix: str = "",
) -> DataFrame:
    """Add the rupee expected-value columns, each rounded half up to two digits.

    Adds ``recoverable_amt, gateway_cost, total_cost, ev_rupees, ev_decision``
    (with ``prefix``). A threshold equal to the value does not pass.
    """
    name = lambda col: f"{prefix}{col}"
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(probability).cast("double"))).cast("decimal(12,10)")
    d = F.greatest(
        F.lit(0.0), F.least(F.col(discount).cast("double"), F.lit(float(policy.max_discount)))
    ).cast("decimal(7,4)")
    keep = (dec("1", "decimal(1,0)") - d * dec("0.01", CENT)).cast("decimal(9,6)")
    rate = (dec(policy.gateway_percent, "decimal(7,4)") * dec("0.01", CENT)).cast("decimal(9,6)")
    flat = (dec(policy.operational_fee, MONEY) if fee is None else fee).cast(MONEY)
    minimum = dec(policy.minimum_ev, MONEY)
    out = df.withColumn(
        name("recoverable_amt"), F.round(rupees(F.col(amount)) * keep, 2).cast(MONEY)
    )
    out = out.withColumn(
        name("gateway_cost"), F.round(F.col(name("recoverable_amt")) * rate, 2).cast(MONEY)
    )
    out = out.withColumn(name("total_cost"), (flat + F.col(name("gateway_cost"))).cast(MONEY))
    out = out.withColumn(
        name("ev_rupees"),
        F.round(p * F.col(name("recoverable_amt")) - F.col(name("total_cost")), 2).cast(MONEY),
    )
    passes = (F.col(name("ev_rupees")) > minimum) & F.lit(not policy.shadow)
    return out.withColumn(name("ev_decision"), F.when(passes, "PROCEED").otherwise("BYPASS"))


def ev_reason(policy: Policy = DEFAULT_POLICY, ev: str = "ev_rupees", cost: str = "total_cost") -> Column:
    """Short explanation of the decision beside ``ev``."""
    value, spent = F.col(ev).cast("string"), F.col(cost).cast("string")
    floor = F.lit(str(policy.minimum_ev))
    if policy.shadow:
        return F.concat(F.lit("shadow run, nothing sent; ev "), value)
    return F.when(
        F.col(ev) > dec(policy.minimum_ev, MONEY),
        F.concat(F.lit("ev "), value, F.lit(" above "), floor, F.lit(", costs "), spent),
    ).otherwise(F.concat(F.lit("ev "), value, F.lit(" not above "), floor, F.lit(", costs "), spent))


def with_ev_paise(
    df: DataFrame,
    probability: str = "probability",
    amount: str = "recoverable_paise",
    fee: str = "fee_paise",
    gateway: str = "gateway_paise",
    strict: bool = False,
) -> DataFrame:
    """Unrounded paise variant: adds ``expected_value_paise, allowed, reason``.

    A probability outside [0, 1] or a negative amount is an error row (null
    value, not allowed), or fails the job when ``strict``.
    """
    p = F.col(probability).cast("decimal(12,10)")
    money = [F.col(c).cast("decimal(18,2)") for c in (amount, fee, gateway)]
    bad_p = p.isNull() | ~p.between(0, 1)
    bad_money = F.least(*money) < 0
    ev = (p * money[0] - (money[1] + money[2])).cast("decimal(32,12)")
    message = F.when(bad_p, "probability must be between 0 and 1").when(
        bad_money, "monetary inputs cannot be negative"
    )
    if strict:
        checked = F.when(message.isNotNull(), F.raise_error(message)).otherwise(ev)
        df = df.withColumn("expected_value_paise", checked.cast("decimal(32,12)"))
        message = F.lit(None).cast("string")
    else:
        df = df.withColumn("expected_value_paise", F.when(message.isNull(), ev))
    value = F.col("expected_value_paise")
    return df.withColumn("allowed", F.coalesce(value > 0, F.lit(False))).withColumn(
        "reason",
        F.coalesce(
            message,
            F.when(value > 0, "positive_expected_value")
            .when(value == 0, "expected_value_zero")
            .otherwise("negative_expected_value"),
        ),
    )


def grid_ev(rupee: Column, p: Column, discount: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    """Unrounded double EV used by the sensitivity surface."""
    rest = rupee * (F.lit(1.0) - discount / F.lit(100.0))
    cost = F.lit(float(policy.operational_fee)) + rest * F.lit(float(policy.gateway_percent)) / F.lit(100.0)
    return p * rest - cost


def breakeven_probability(rupee: Column, discount: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    """Smallest probability that pays for the costs, at most 1."""
    rest = rupee * (F.lit(1.0) - discount / F.lit(100.0))
    cost = F.lit(float(policy.operational_fee)) + rest * F.lit(float(policy.gateway_percent)) / F.lit(100.0)
    return F.when(rest > 0, F.least(F.lit(1.0), cost / rest)).otherwise(F.lit(1.0))
