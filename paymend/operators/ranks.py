"""Exact ranks and cumulative counts without a global sort in one task.

A window over a whole column would pull every row of a group into one task.
Here the values are first counted per distinct value (a combinable aggregate),
then cut into ordered blocks by a monotone function of the value, then summed
inside each block and shifted by the totals of the blocks before it.

Blocks that turn out too full are cut again, between their own smallest and largest value and into as
many cells as their exact count asks for. All borders come from minima, maxima and counts, so a task
that runs again cuts in the same places, which a drawn sample would not promise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


#: Rows above which a block is cut again.
FULL = 65_536


def order_block(value: Column, per_octave: int = 64) -> Column:
    """Monotone block number of a numeric value.

    Blocks are about one per cent of the value wide, so integers up to 10**9
    have at most some 10**7 distinct values in a block, whatever the row count
    and the distribution; no data pass is needed to find the borders.
    """
    size = F.floor(F.log2(F.lit(1.0) + F.abs(value.cast("double")) * 100) * per_octave)
    return F.when(value < 0, -size).otherwise(size)


def finer(df: DataFrame, keys: list[str], value: str, into: str, full: int = FULL) -> DataFrame:
    """Adds ``into``: a cell number, monotone in a numeric ``value``, inside groups of more than ``full`` rows.

    Cells are equally wide and hold ``full / 2`` rows on average. Other groups are one cell, 0; null values
    come before all cells, as -1. Only groups that are too full enter the join.
    """
    v = F.col(value).cast("double")
    spans = (
        df.groupBy(*keys)
        .agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count(F.lit(1)).alias("_many"))
        .filter((F.col("_many") > full) & (F.col("_hi") > F.col("_lo")))
    )
    cells = F.ceil(F.col("_many") / (full / 2))
    cell = F.least(F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * cells), cells - 1)
    if keys:
        joined = df.join(spans, keys, "left")
    else:
        joined = df.withColumn("_z", spans.select(F.struct("_lo", "_hi", "_many")).scalar()).select("*", "_z.*").drop("_z")
    number = F.when(v.isNull(), -1).otherwise(F.coalesce(cell, F.lit(0)))
    return joined.withColumn(into, number.cast("bigint")).drop("_lo", "_hi", "_many")


def ordered_blocks(df: DataFrame, keys: list[str], order: str, into: str = "_block", full: int = FULL) -> DataFrame:
    """Adds ``into``, which orders by ``order`` and holds about ``full`` rows of a group at most.

    Cut twice, so that ids with gaps, or times that crowd, are spread as well as dense numbers.
    """
    first = finer(df, keys, order, "_cut1", full)
    second = finer(first, [*keys, "_cut1"], order, "_cut2", full)
    return second.withColumn(into, F.struct("_cut1", "_cut2")).drop("_cut1", "_cut2")


def cumulative_counts(
    df: DataFrame, keys: list[str], value: str, weights: dict[str, Column]
) -> DataFrame:
    """Per group and distinct value: each weight and its running total ``cum_<name>``."""
    counts = df.groupBy(*keys, value).agg(*[F.sum(w).alias(n) for n, w in weights.items()])
    # About one per cent of the value wide, and cut again where more distinct values than a task should sort lie in that.
    counts = finer(counts.withColumn("_wide", order_block(F.col(value))), [*keys, "_wide"], value, "_fine")
    counts = counts.withColumn("_block", F.struct("_wide", "_fine")).drop("_wide", "_fine")
    inside = Window.partitionBy(*keys, "_block").orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    totals = counts.groupBy(*keys, "_block").agg(*[F.sum(n).alias(f"_t_{n}") for n in weights])
    # A few thousand wide blocks per group at most, and one row per half full cell.
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_block",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in weights],
    )
    local = counts.withColumns({f"_c_{n}": F.sum(n).over(inside) for n in weights})
    joined = local.join(offsets, [*keys, "_block"])
    return joined.select(
        *keys,
        value,
        *weights,
        *[(F.col(f"_c_{n}") + F.col(f"_o_{n}")).alias(f"cum_{n}") for n in weights],
    )


def nearest_rank(
    df: DataFrame, keys: list[str], value: str, percents: tuple[int, ...]
) -> DataFrame:
    """Exact nearest-rank percentiles: the value at position ``ceil(p/100 * n)``.

    One row per group with ``n`` and ``p<percent>`` columns.
    """
    rows = df.filter(F.col(value).isNotNull())
    ranked = cumulative_counts(rows, keys, value, {"n": F.lit(1)})
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total")) if keys else rows.agg(
        F.count(F.lit(1)).alias("total")
    )
    if keys:
        ranked = ranked.join(sizes, keys)
    else:
        ranked = ranked.withColumn("total", sizes.scalar())
    picks = []
    for p in percents:
        # Integer arithmetic: ceil(p * n / 100) without a rounding error.
        rank = F.greatest(F.lit(1), F.floor((F.col("total") * p + 99) / 100))
        picks.append(F.min(F.when(F.col("cum_n") >= rank, F.col(value))).alias(f"p{p}"))
    return ranked.groupBy(*keys).agg(F.max("total").alias("n"), *picks)


def running_index(
    df: DataFrame, keys: list[str], order: str, block: Column | None = None, name: str = "position"
) -> DataFrame:
    """1-based position of every row in its group by a unique, numeric ``order`` column.

    No task sorts more than one block. Blocks are cut by the rows that are there; a caller that knows
    better gives ``block``, monotone in ``order`` with a bounded number of rows (for a dense id: ``id div 65536``).
    """
    cut = ordered_blocks(df, keys, order) if block is None else df.withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    sizes = cut.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o")
    )
    return (
        cut.withColumn("_r", F.row_number().over(inside))
        .join(offsets, [*keys, "_block"])
        .withColumn(name, F.col("_r") + F.col("_o"))
        .drop("_block", "_r", "_o")
    )
