"""Two-sample drift measures: Kolmogorov-Smirnov, population stability, Brier, verdicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from paymend.operators.ranks import cumulative_counts, running_index
from paymend.sources import files
from paymend.sources.scratch import materialise, scratch_dir

KS_P_LIMIT = 0.05
PSI_LIMIT = 0.20
MIN_SAMPLE = 10
MIN_LIVE = 50
BRIER_LIMIT = 0.30


def ks_p_value(n: Column, m: Column, distance: Column) -> Column:
    """Asymptotic p-value, kept inside [0, 1]."""
    en = F.sqrt(n * m / (n + m))
    t = (en + 0.12 + F.lit(0.11) / en) * distance
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * F.exp(-2.0 * t * t)))


def ks_two_sample(df: DataFrame, keys: list[str], value: str, is_live: Column) -> DataFrame:
    """Per group: ``n_ref, n_live, ks_stat, ks_pval`` of reference against live rows.

    Works on distinct values and their cumulative counts, so a group may be any
    size. Fewer than ten rows on a side give (0, 1).
    """
    rows = df.filter(F.col(value).isNotNull()).withColumn("_live", is_live)
    live = F.when(F.col("_live"), 1).otherwise(0)
    cum = cumulative_counts(rows, keys, value, {"live": live, "ref": 1 - live})
    sizes = rows.groupBy(*keys).agg(F.sum(live).alias("n_live"), F.sum(1 - live).alias("n_ref"))
    if keys:
        joined = cum.join(sizes, keys)
    else:
        joined = cum.withColumn("_z", sizes.select(F.struct("n_live", "n_ref")).scalar()).select("*", "_z.*")
    gap = F.abs(F.col("cum_live") / F.col("n_live") - F.col("cum_ref") / F.col("n_ref"))
    enough = (F.col("n_live") >= MIN_SAMPLE) & (F.col("n_ref") >= MIN_SAMPLE)
    out = joined.groupBy(*keys).agg(
        F.max("n_ref").alias("n_ref"),
        F.max("n_live").alias("n_live"),
        F.max(F.when(enough, gap)).alias("_d"),
    )
    n, m = F.col("n_ref").cast("double"), F.col("n_live").cast("double")
    return out.withColumns(
        {
            "ks_stat": F.coalesce("_d", F.lit(0.0)),
            "ks_pval": F.when(F.col("_d").isNull(), F.lit(1.0)).otherwise(ks_p_value(n, m, F.col("_d"))),
        }
    ).drop("_d")


def psi(df: DataFrame, keys: list[str], value: str, is_live: Column, buckets: int = 10) -> DataFrame:
    """Per group: population stability index over equal-width buckets of the joint range.

    Shares are floored at 1e-6; a flat range or fewer than ten rows on a side
    give 0. Two combinable passes: range and sizes, then one conditional count
    per bucket, so nothing is exploded and empty buckets need no outer join.
    """
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull()).withColumns({"_v": v, "_live": is_live})
    live = F.when(F.col("_live"), 1).otherwise(0)
    span = rows.groupBy(*keys).agg(
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
        F.sum(live).alias("_nl"),
        F.sum(1 - live).alias("_nr"),
    )
    if keys:
        # One row per group: small against the rows, and skew-safe as a broadcast
        # or, when groups are many, as an AQE-split shuffle join.
        joined = rows.join(span, keys)
    else:
        joined = rows.withColumn("_z", span.select(F.struct("*")).scalar()).select("*", "_z.*")
    spread = F.col("_hi") - F.col("_lo")
    index = F.when(spread > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / spread * buckets), F.lit(buckets - 1))).otherwise(0)
    joined = joined.withColumn("_i", index)
    counts = []
    for i in range(buckets):
        here = F.col("_i") == i
        counts.append(F.sum(F.when(here, live).otherwise(0)).alias(f"_l{i}"))
        counts.append(F.sum(F.when(here, 1 - live).otherwise(0)).alias(f"_r{i}"))
    agg = joined.groupBy(*keys).agg(
        *counts, *[F.max(c).alias(c) for c in ("_lo", "_hi", "_nl", "_nr")]
    )
    total = F.lit(0.0)
    for i in range(buckets):
        cur = F.greatest(F.try_divide(F.col(f"_l{i}"), F.col("_nl")), F.lit(1e-6))
        ref = F.greatest(F.try_divide(F.col(f"_r{i}"), F.col("_nr")), F.lit(1e-6))
        total = total + (cur - ref) * F.log(cur / ref)
    usable = (F.col("_nl") >= MIN_SAMPLE) & (F.col("_nr") >= MIN_SAMPLE) & (F.col("_hi") > F.col("_lo"))
    return agg.select(*keys, F.when(usable, F.round(total, 4)).otherwise(F.lit(0.0)).alias("psi"))


def verdict(ks_pval: Column, psi_value: Column, n_live: Column) -> Column:
    """Drift when either measure trips and there are at least fifty live rows."""
    return (n_live >= MIN_LIVE) & ((ks_pval < KS_P_LIMIT) | (psi_value > PSI_LIMIT))


def psi_level(psi_value: Column) -> Column:
    return F.when(psi_value < 0.10, "none").when(psi_value <= PSI_LIMIT, "moderate").otherwise("significant")


def drift_report(df: DataFrame, keys: list[str], code: str, amount: str, is_live: Column) -> DataFrame:
    """KS on the code column, PSI on the amount column and the verdict, per group."""
    ks = ks_two_sample(df, keys, code, is_live)
    stability = psi(df, keys, amount, is_live)
    joined = ks.join(stability, keys) if keys else ks.withColumn("psi", stability.scalar())
    return joined.withColumns(
        {
            "drift": verdict(F.col("ks_pval"), F.col("psi"), F.col("n_live")),
            "level": psi_level(F.col("psi")),
        }
    )


@dataclass(frozen=True)
class Sketch:
    """What checks need of a reference sample, per group: ``base`` (counts per code, size and range) and
    ``values`` (``_a, w``: every distinct amount with its rows)."""

    base: DataFrame
    values: DataFrame


def reference_sketch(reference: DataFrame, key: str, code: str, amount: str, folder: str | None = None) -> Sketch:
    """Reads a reference sample once and stores its sketch, which is exact.

    ``folder`` names the version: a sketch that is whole there is used as it is and the sample is not
    read. Without it the sketch goes to the scratch folder. Null amounts are in the size only.
    """
    spark = reference.sparkSession
    path = folder or scratch_dir(spark, "sketch")
    rows = reference.select(key, F.col(code).alias("_c"), F.col(amount).cast("double").alias("_a"))
    # The base is written last, so it stands for both.
    if "_SUCCESS" not in files.names(spark, f"{path}/base"):
        values = rows.filter(F.col("_a").isNotNull()).groupBy(key, "_a").agg(F.count(F.lit(1)).alias("w"))
        values.write.mode("overwrite").parquet(f"{path}/values")
        base = rows.groupBy(key).agg(
            *_per_code("r"), F.count(F.lit(1)).alias("n_ref"), F.min("_a").alias("_rl"), F.max("_a").alias("_rh")
        )
        base.write.mode("overwrite").parquet(f"{path}/base")
    return Sketch(spark.read.parquet(f"{path}/base"), spark.read.parquet(f"{path}/values"))


def _per_code(prefix: str) -> list[Column]:
    return [F.sum(F.when(F.col("_c") == i, 1).otherwise(0)).alias(f"{prefix}{i}") for i in range(7)]


def monitor(
    calls: DataFrame,
    reference: DataFrame | Sketch,
    key: str,
    order: str,
    code: str,
    amount: str,
    window: int = 500,
    every: int = 200,
    block: Column | None = None,
) -> DataFrame:
    """Verdict at every ``every``-th call of each group over its last ``window`` calls.

    A call belongs to at most ``ceil(window / every)`` checks, so it is copied
    to those instead of being put in a sliding window. A check is one row with
    its at most ``window`` live amounts; it is compared with the group's whole
    reference sample, which enters as counts per code and per distinct amount
    (``reference_sketch``), never as raw rows per check.
    """
    sketch = reference if isinstance(reference, Sketch) else reference_sketch(reference, key, code, amount)
    placed = running_index(calls.select(key, order, code, amount), [key], order, block)
    first = F.ceil(F.col("position") / every)
    last = F.floor((F.col("position") + (window - 1)) / every)
    total = calls.groupBy(key).agg(F.floor(F.count(F.lit(1)) / every).alias("_ticks"))
    live = (
        placed.join(total, key)
        .withColumn("_last", F.least(last, F.col("_ticks")))
        .filter(first <= F.col("_last"))
        .withColumn("tick", F.explode(F.sequence(first, F.col("_last"))))
        .select(key, "tick", F.col(code).alias("_c"), F.col(amount).cast("double").alias("_a"))
    )
    checks = live.groupBy(key, "tick").agg(
        *_per_code("l"), F.count(F.lit(1)).alias("n_live"), F.min("_a").alias("_l"), F.max("_a").alias("_h"),
        F.collect_list("_a").alias("_live"),
    )
    both = checks.join(sketch.base, key).withColumns({"_lo": F.least("_l", "_rl"), "_hi": F.greatest("_h", "_rh")})
    # One row per check, read by several branches below: written once, so the
    # windowed calls behind it are worked out once and not per branch.
    both = materialise(both, "drift-checks")
    gaps, cl, cr = [], F.lit(0), F.lit(0)
    for i in range(7):
        cl, cr = cl + F.col(f"l{i}"), cr + F.col(f"r{i}")
        gaps.append(F.abs(cl / F.col("n_live") - cr / F.col("n_ref")))
    enough = (F.col("n_live") >= MIN_SAMPLE) & (F.col("n_ref") >= MIN_SAMPLE)
    judged = both.withColumn("ks_stat", F.when(enough, F.greatest(*gaps)).otherwise(0.0))
    judged = judged.withColumn(
        "ks_pval",
        F.when(enough, ks_p_value(F.col("n_ref").cast("double"), F.col("n_live").cast("double"), F.col("ks_stat")))
        .otherwise(1.0),
    )
    return _with_psi(judged, sketch.values, key).select(
        key,
        F.col("tick").cast("bigint").alias("tick"),
        "n_live",
        F.round("ks_stat", 4).alias("ks_stat"),
        F.round("ks_pval", 4).alias("ks_pval"),
        "psi",
        verdict(F.col("ks_pval"), F.col("psi"), F.col("n_live")).alias("drift"),
    )


def _bucket(value: Column, lo: Column, hi: Column, buckets: int) -> Column:
    """Unclipped equal-width bucket position of a value."""
    return (value - lo) / (hi - lo) * buckets


def _edges(lo: Column, hi: Column, buckets: int) -> Column:
    """Borders 1 .. buckets-1: the smallest double that falls into each bucket or a later one.

    A computed border may be a few rounding steps off the one the bucket
    formula uses, so its neighbours are asked too.
    """

    def border(i: Column) -> Column:
        guess = lo + (hi - lo) * i / buckets
        near = F.transform(F.sequence(F.lit(-8), F.lit(8)), lambda k: guess + F.abs(guess) * k * F.lit(2.0**-53))
        return F.coalesce(F.array_min(F.filter(near, lambda v: _bucket(v, lo, hi, buckets) >= i)), guess)

    return F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)), border)


def _with_psi(checks: DataFrame, values: DataFrame, key: str, buckets: int = 10) -> DataFrame:
    """Adds ``psi`` to checks, each of which has its own joint range ``_lo`` to ``_hi``.

    Live shares are counted in the check's own list. The reference share of a
    bucket is the difference of its cumulative counts at two borders. All
    borders of all checks are put between the reference values as rows of
    weight zero and read off one running total, so the cost is distinct
    reference values plus nine rows per check, never their product.
    """
    lo, hi = F.col("_lo"), F.col("_hi")
    borders = checks.filter(hi > lo).select(
        key,
        "tick",
        F.posexplode(_edges(lo, hi, buckets)).alias("_p", "_a"),
    )
    points = values.select(key, "_a", "w").unionByName(borders.select(key, "_a", F.lit(0).cast("bigint").alias("w")))
    running = cumulative_counts(points, [key], "_a", {"w": F.col("w")})
    below = running.select(key, "_a", (F.col("cum_w") - F.col("w")).alias("_below"))
    # A border is one value of a group; the merge join may meet many equal ones, AQE splits them.
    at_borders = borders.join(below, [key, "_a"]).groupBy(key, "tick").agg(
        F.sort_array(F.collect_list(F.struct("_p", "_below"))).alias("_at")
    )
    cells = F.transform("_live", lambda v: F.least(F.floor(_bucket(v, lo, hi, buckets)), F.lit(buckets - 1)))
    upto = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("_at", lambda x: x.getField("_below")), F.array("n_ref"))
    joined = checks.join(at_borders, [key, "tick"], "left").withColumns({"_cells": F.when(hi > lo, cells), "_upto": upto})

    def add(acc: Column, i: Column) -> Column:
        cur = F.greatest(F.size(F.filter("_cells", lambda c: c == i)) / F.col("n_live"), F.lit(1e-6))
        old = F.greatest((F.get("_upto", i + 1) - F.get("_upto", i)) / F.col("n_ref"), F.lit(1e-6))
        return acc + (cur - old) * F.log(cur / old)

    total = F.aggregate(F.sequence(F.lit(0), F.lit(buckets - 1)), F.lit(0.0), add)
    usable = (F.col("n_live") >= MIN_SAMPLE) & (F.col("n_ref") >= MIN_SAMPLE) & (hi > lo)
    return joined.withColumn("psi", F.when(usable, F.round(total, 4)).otherwise(0.0))


def brier(df: DataFrame, p: str, y: str, *by: str) -> DataFrame:
    """Mean squared error of the probabilities and the acceptance gate."""
    score = F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y)))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(score, 6).alias("brier"), (score <= BRIER_LIMIT).alias("accepted")
    )
