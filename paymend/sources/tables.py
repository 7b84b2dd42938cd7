"""Table maintenance as joins: upsert, partial update, insert-or-ignore, scans, partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

IDENTITY = ("order_id", "amount_paise", "currency", "merchant_id", "email_redacted", "created_at")
LATEST = ("failure_code", "failure_reason")


def upsert_transactions(
    snapshot: DataFrame, batch: DataFrame, key: str = "payment_id", at: str = "event_time"
) -> DataFrame:
    """New snapshot after a batch of failure events.

    First write wins for identity columns and status; last write wins for the
    failure columns. The batch is reduced per key by a map-side combinable
    aggregate first, so a key with very many repeats costs one row per map
    task; then one full outer join on the key.
    """
    identity = [c for c in batch.columns if c in IDENTITY]
    latest = [c for c in batch.columns if c in LATEST]
    tie = F.struct(F.col(at), *[F.col(c) for c in latest + identity])
    reduced = batch.groupBy(key).agg(
        F.min_by(F.struct(*identity), tie).alias("_first"),
        F.max_by(F.struct(*latest), tie).alias("_last"),
        F.max(at).alias("_at"),
    )
    old = snapshot.withColumn("_old", F.lit(True))
    joined = old.join(reduced, key, "full_outer")
    known = F.coalesce(F.col("_old"), F.lit(False))
    out = [F.col(key)]
    for name in snapshot.columns:
        if name == key:
            continue
        if name in latest:
            value = F.when(F.col("_at").isNotNull(), F.col(f"_last.{name}")).otherwise(F.col(name))
        elif name in identity:
            value = F.when(known, F.col(name)).otherwise(F.col(f"_first.{name}"))
        elif name == "status":
            value = F.when(known, F.col(name)).otherwise(F.lit("FAILED"))
        elif name == "updated_at":
            value = F.coalesce(F.col("_at"), F.col(name))
        elif name == "recovery_attempts":
            value = F.coalesce(F.col(name), F.lit(0))
        else:
            value = F.col(name)
        out.append(value.alias(name))
    return joined.select(*out)


def partial_update(snapshot: DataFrame, updates: DataFrame, key: str = "payment_id") -> DataFrame:
    """Status is replaced; category and score only where the update gives one.

    ``updates`` holds one row per key.
    """
    changed = [c for c in updates.columns if c != key]
    new = updates.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in changed])
    joined = snapshot.join(new, key, "left")
    for name in changed:
        joined = joined.withColumn(name, F.coalesce(F.col(f"_n_{name}"), F.col(name)))
    return joined.select(*snapshot.columns)


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: str, order: Column) -> DataFrame:
    """Rows of ``rows`` to append: first per key by ``order``, keys already stored left out before anything is sorted."""
    others = [c for c in rows.columns if c != key]
    fresh = rows.join(table.select(key), key, "left_anti")
    first = fresh.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_row"))
    return first.select(key, "_row.*").select(*rows.columns)


def tenant_view(df: DataFrame, tenant: str | None, columns: list[str] | None = None) -> DataFrame:
    """Rows of one tenant, as a filter the scan can use; no tenant, no rows."""
    scoped = df.filter(F.lit(False)) if not tenant else df.filter(F.col("merchant_id") == F.lit(tenant))
    return scoped.select(*columns) if columns else scoped


def latest(df: DataFrame, at: str, key: str, n: int) -> DataFrame:
    """Newest ``n`` rows; the key breaks ties. Runs as a per-task top-n, not a sort."""
    return df.orderBy(F.col(at).desc(), F.col(key)).limit(n)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def attempts_from_log(
    snapshot: DataFrame, log: DataFrame, key: str = "payment_id", into: str = "recovery_attempts"
) -> DataFrame:
    """Counter after one increment per log row."""
    counted = log.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return (
        snapshot.join(counted, key, "left")
        .withColumn(into, F.coalesce(F.col(into), F.lit(0)) + F.coalesce(F.col("_n"), F.lit(0)))
        .select(*snapshot.columns)
    )


def write_monthly(df: DataFrame, path: str, at: str = "created_at") -> None:
    """Parquet partitioned by calendar month.

    The rebalance hint brings the rows of a month together and lets the
    adaptive planner cut a big month into several well-sized files and merge
    small ones, so neither a busy month nor many tasks decide the file sizes.
    """
    (
        df.withColumn("created_month", F.date_format(F.col(at), "yyyy-MM"))
        .hint("rebalance", "created_month")
        .write.mode("errorifexists")
        .partitionBy("created_month")
        .parquet(path)
    )


def latest_state(log: DataFrame, key: str, order: Column) -> DataFrame:
    """Last row per key of an event log, as a combinable aggregate (no per-key sort)."""
    others = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_row")).select(key, "_row.*")
