"""Gap-filled bins, rolling anomaly scores and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BIN_SECONDS = 300
DAY_SECONDS = 86400
#: Days that one row of the grid stands for before it is spread over the tasks.
STRETCH_DAYS = 288


def _epoch(at: Column) -> Column:
    return F.unix_timestamp(at.cast("timestamp"))


def _stamp(epoch: Column) -> Column:
    return F.timestamp_seconds(epoch).cast("timestamp_ntz")


def _steps(start: str, end: Column, step: int) -> Column:
    return F.explode(F.sequence(F.col(start), end, F.lit(step).cast("bigint")))


def _end(start: str, span: int) -> Column:
    """The last bin of a span, or of its key."""
    return F.least(F.col(start) + span - BIN_SECONDS, F.col("hi"))


def resample(
    df: DataFrame, key: str = "merchant_id", at: str = "created_at", amount: str = "amount_paise"
) -> DataFrame:
    """Count and amount per five-minute bin of each key, empty bins as zero.

    Rows are reduced to bins by a combinable aggregate first, so the later
    steps see one row per bin whatever the traffic; the grid of a key runs from
    its own first to its own last bin. It is opened in three steps (stretches
    of ``STRETCH_DAYS`` days, days, bins) and dealt by stretch after the first, so a
    key with one date far off is many tasks and no row ever holds more than
    some thousand stretches. Unreadable times are dropped, unreadable amounts
    count as zero.
    """
    bin_col = F.floor(_epoch(F.col(at)) / BIN_SECONDS) * BIN_SECONDS
    bins = (
        df.withColumn("bin", bin_col)
        .filter(F.col("bin").isNotNull())
        .groupBy(key, "bin")
        .agg(
            F.count(F.lit(1)).alias("failures"),
            F.sum(F.coalesce(F.col(amount), F.lit(0))).alias("amount_paise"),
        )
    )
    # A given number, as by their few bytes the stretches would be merged into one task.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = (
        bins.groupBy(key)
        .agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
        .select(key, "lo", "hi", _steps("lo", F.col("hi"), STRETCH_DAYS * DAY_SECONDS).alias("stretch"))
        .repartition(tasks, key, "stretch")
        .select(key, "lo", "hi", _steps("stretch", _end("stretch", STRETCH_DAYS * DAY_SECONDS), DAY_SECONDS).alias("day"))
        .select(key, "lo", _steps("day", _end("day", DAY_SECONDS), BIN_SECONDS).alias("bin"))
    )
    return grid.join(bins, [key, "bin"], "left").select(
        key,
        "bin",
        ((F.col("bin") - F.col("lo")) / BIN_SECONDS).cast("bigint").alias("position"),
        F.coalesce("failures", F.lit(0)).alias("failures"),
        F.coalesce("amount_paise", F.lit(0)).alias("amount_paise"),
    )


def rolling_z(bins: DataFrame, key: str = "merchant_id", span: int = 6, threshold: float = 3.0) -> DataFrame:
    """Z-score of each bin in the frame of the last ``span`` bins, itself included.

    The series of a key is cut into days; the last ``span - 1`` bins of a day
    are copied into the next one, so the frames are complete and a long series
    is spread over many tasks.
    """
    per_day = 86400 // BIN_SECONDS
    day = F.floor(F.col("position") / per_day)
    tail = F.col("position") % per_day >= per_day - (span - 1)
    copies = F.when(tail, F.array(day, day + 1)).otherwise(F.array(day))
    cut = bins.withColumn("_own", day).withColumn("_day", F.explode(copies))
    frame = Window.partitionBy(key, "_day").orderBy("position").rowsBetween(-(span - 1), 0)
    n = F.count(F.lit(1)).over(frame)
    mean = F.avg("failures").over(frame)
    std = F.stddev_samp("failures").over(frame)
    scored = cut.withColumns({"_n": n, "_mean": mean, "_std": std}).filter(F.col("_day") == F.col("_own"))
    spread = F.when(F.col("_std") > 0, F.col("_std")).otherwise(1.0)
    z = F.when(F.col("_n") >= 2, (F.col("failures") - F.col("_mean")) / spread)
    return scored.select(
        key,
        _stamp(F.col("bin")).alias("bin_start"),
        "failures",
        "amount_paise",
        F.round(z, 6).alias("failure_zscore"),
        F.coalesce(F.round(z, 9) >= threshold, F.lit(False)).alias("threshold_anomaly"),
    )


def forecast(bins: DataFrame, key: str = "merchant_id", last: int = 6, periods: int = 12) -> DataFrame:
    """Mean of the last bins, repeated for the bins that follow."""
    ends = bins.groupBy(key).agg(F.max("bin").alias("hi"), F.count(F.lit(1)).alias("n"))
    recent = (
        bins.join(ends, key)
        .filter(F.col("bin") > F.col("hi") - last * BIN_SECONDS)
        .groupBy(key, "hi", "n")
        .agg(F.sum("failures").alias("s"))
    )
    mean = F.col("s") / F.least(F.col("n"), F.lit(last))
    return recent.select(
        key, mean.alias("m"), "hi", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step")
    ).select(
        key,
        _stamp(F.col("hi") + F.col("step") * BIN_SECONDS).alias("bin_start"),
        F.round("m", 6).alias("predicted_failures"),
    )
