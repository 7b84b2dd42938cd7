"""Provider health from a log of provider calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paymend.operators.ranks import ordered_blocks

# Consecutive failures that open a circuit, and seconds until a probe.
LIMITS = {"links": (5, 30), "whatsapp": (3, 60), "sms": (3, 60), "email": (5, 120)}


def _limit(channel: Column, i: int, default: int) -> Column:
    out = F.lit(default)
    for name, pair in LIMITS.items():
        out = F.when(channel == name, F.lit(pair[i])).otherwise(out)
    return out


def provider_health(
    calls: DataFrame,
    channel: str = "channel",
    order: str = "call_id",
    at: str = "at",
    ok: str = "ok",
    block: Column | None = None,
    carry: DataFrame | None = None,
) -> DataFrame:
    """Circuit state before and after every call of each channel.

    A success closes the circuit; a failure that makes the run of consecutive
    failures reach the channel's limit opens it; an open circuit whose last
    failure is at least the time-out ago is half open for the next call. So the
    state is a function of the failure run and the previous call, and no row by
    row replay is needed.

    Runs are counted inside blocks of a bounded number of calls, cut by the calls
    that are there unless ``block`` is given, and a block starts with the run its
    predecessors left, read from one row per block. ``carry`` (``channel, run, last_at``) continues an
    earlier log.
    """
    own = [] if block is None else [block.alias("_b")]
    rows = calls.select(
        F.col(channel).alias("channel"), F.col(order).alias("call"), F.col(at).alias("at"),
        F.col(ok).cast("boolean").alias("ok"), *own,
    )
    if block is None:
        rows = ordered_blocks(rows, ["channel"], "call", "_b")
    by_block = Window.partitionBy("channel", "_b").orderBy("call")
    so_far = by_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumns(
        {
            "_i": F.row_number().over(by_block),
            "_last_ok": F.max(F.when(F.col("ok"), F.struct("call"))).over(so_far),
            "_prev_at": F.lag("at").over(by_block),
        }
    )
    inside = inside.withColumn(
        "_ok_at", F.coalesce(F.max(F.when(F.col("ok"), F.col("_i"))).over(so_far), F.lit(0))
    ).drop("_last_ok")
    blocks = rows.groupBy("channel", "_b").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.when(F.col("ok"), F.col("call"))).alias("_lo"),
        F.max_by("at", "call").alias("_end_at"),
    )
    trailing = (
        rows.join(blocks.select("channel", "_b", "_lo"), ["channel", "_b"])
        .groupBy("channel", "_b")
        .agg(F.sum(F.when(F.col("_lo").isNull() | (F.col("call") > F.col("_lo")), 1).otherwise(0)).alias("_tail"))
    )
    blocks = blocks.join(trailing, ["channel", "_b"])
    # One row per block: carry the failure run across blocks that hold no success.
    order_b = Window.partitionBy("channel").orderBy("_b")
    earlier = order_b.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_cum", F.sum("_tail").over(order_b.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = blocks.withColumn(
        "_base", F.max(F.when(F.col("_lo").isNotNull(), F.col("_cum") - F.col("_tail"))).over(earlier)
    )
    before = F.coalesce(F.lag("_cum").over(order_b), F.lit(0))
    starts = blocks.select(
        "channel", "_b",
        (before - F.coalesce("_base", F.lit(0))).alias("_run0"),
        F.col("_base").isNull().alias("_open_start"),
        F.lag("_end_at").over(order_b).alias("_at0"),
    )
    if carry is not None:
        old = carry.select("channel", F.col("run").alias("_crun"), F.col("last_at").alias("_cat"))
        starts = starts.join(old, "channel", "left").select(
            "channel", "_b",
            (F.col("_run0") + F.when(F.col("_open_start"), F.coalesce("_crun", F.lit(0))).otherwise(0)).alias("_run0"),
            F.coalesce("_at0", "_cat").alias("_at0"),
        )
    else:
        starts = starts.select("channel", "_b", "_run0", "_at0")
    joined = inside.join(starts, ["channel", "_b"])
    run_in_block = F.col("_i") - F.col("_ok_at")
    run = F.when(F.col("_ok_at") == 0, F.col("_run0") + run_in_block).otherwise(run_in_block)
    prev_run = F.when(F.col("ok"), _run_before()).otherwise(run - 1)
    limit, wait = _limit(F.col("channel"), 0, 3), _limit(F.col("channel"), 1, 60)
    prev_at = F.coalesce("_prev_at", "_at0")
    waited = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(prev_at.cast("timestamp"))
    joined = joined.withColumns({"run": run, "_before": prev_run})
    return joined.select(
        "channel", F.col("call").alias(order), "at", "ok",
        F.col("run").cast("bigint").alias("run"),
        F.when(F.col("_before") < limit, "CLOSED")
        .when(waited >= wait * 1_000_000, "HALF_OPEN")
        .otherwise("OPEN")
        .alias("state_before"),
        F.when(F.col("run") >= limit, "OPEN").otherwise("CLOSED").alias("state_after"),
    )


def _run_before() -> Column:
    """Failure run just before a success: the distance to the success before it."""
    w = Window.partitionBy("channel", "_b").orderBy("call")
    earlier_ok = F.max(F.when(F.col("ok"), F.col("_i"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return F.when(earlier_ok.isNull(), F.col("_run0") + F.col("_i") - 1).otherwise(F.col("_i") - 1 - earlier_ok)


def carry_of(health: DataFrame, order: str = "call_id") -> DataFrame:
    """What the next part of the log must know: failure run and last call time per channel."""
    return health.groupBy("channel").agg(
        F.max_by("run", order).alias("run"), F.max_by("at", order).alias("last_at")
    )
