"""What leaves the system: link requests and channel fallback plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paymend.functions.classify import wants_rerouting
from paymend.functions.money import MONEY, dec, with_ev
from paymend.policy import CHANNELS, DEFAULT_POLICY, Policy

# Share of the operational fee a channel costs.
FEE_SHARE = {"whatsapp": "1.0", "sms": "0.7", "email": "0.4", "notify_support": "0.1"}
MAX_EXTRA_HOPS = 2


def link_requests(
    df: DataFrame, now_epoch: Column, expire_minutes: int = 60, discount: str | None = None
) -> DataFrame:
    """One outbound payment-link request per transaction."""
    reroute = wants_rerouting(F.col("failure_category"))
    options = F.when(
        reroute,
        F.struct(F.lit(True).alias("upi"), F.lit(True).alias("wallet"), F.lit(True).alias("smart_routing")),
    )
    cols = [
        F.col("payment_id").alias("reference_id"),
        F.col("amount_paise").alias("amount"),
        "currency",
        F.concat(F.lit("Recovery: "), F.coalesce("failure_reason", F.lit("Payment failed"))).alias("description"),
        (now_epoch + expire_minutes * 60).alias("expire_by"),
        reroute.alias("smart_routing"),
        options.alias("options"),
    ]
    if discount:
        cols.append(F.least(F.col(discount), F.lit(15.0)).alias("discount_pct"))
    return df.select(*cols)


def channel_results(dispatches: DataFrame) -> DataFrame:
    """Per payment and channel whether any dispatch was delivered: ``ok_<channel>`` columns."""
    return dispatches.groupBy("payment_id").agg(
        *[
            F.max(F.when((F.col("channel") == c) & (F.col("status") == "delivered"), True).otherwise(False))
            .alias(f"ok_{c}")
            for c in CHANNELS
        ]
    )


def channel_fallback(
    df: DataFrame, first: str = "email", policy: Policy = DEFAULT_POLICY, extra_hops: int = MAX_EXTRA_HOPS
) -> DataFrame:
    """Follow the fallback order for each payment, at most ``extra_hops`` further channels.

    ``df`` holds ``score, amount_paise, discount_pct`` and the
    :func:`channel_results` columns. Each hop is gated by expected value with
    the cheaper channel's fee; a failed hop moves on; after the last allowed
    hop the result is accepted as it is. Adds ``final_channel, hops, path,
    fallback_status`` (DELIVERED, ACCEPTED or EV_BYPASSED).
    """
    at = CHANNELS.index(first)
    route = [CHANNELS[min(at + i, len(CHANNELS) - 1)] for i in range(extra_hops + 1)]
    out = df
    for i, channel in enumerate(route):
        # The first send always pays the whole fee, whatever its channel.
        share = "1.0" if i == 0 else FEE_SHARE[channel]
        fee = (dec(policy.operational_fee, MONEY) * dec(share, "decimal(3,1)")).cast(MONEY)
        out = with_ev(out, policy=policy, fee=fee, prefix=f"_h{i}_")
    status, final, hops = None, None, None
    for i, channel in reversed(list(enumerate(route))):
        passes = F.col(f"_h{i}_ev_decision") == "PROCEED"
        ok = F.coalesce(F.col(f"ok_{channel}"), F.lit(False))
        last = status is None
        status = F.when(~passes, "EV_BYPASSED").when(ok, "DELIVERED").otherwise("ACCEPTED" if last else status)
        here = F.lit(channel)
        final = here if last else F.when(~passes | ok, here).otherwise(final)
        hops = F.lit(i) if last else F.when(~passes | ok, F.lit(i)).otherwise(hops)
    out = out.withColumns({"fallback_status": status, "final_channel": final, "hops": hops})
    out = out.withColumn(
        "path", F.array_join(F.slice(F.array(*[F.lit(c) for c in route]), F.lit(1), F.col("hops") + 1), ">")
    )
    return out.drop(*[c for c in out.columns if c.startswith("_h")])
