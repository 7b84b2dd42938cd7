"""Isolation-forest flags and the combined anomaly report."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

SAMPLE = 256
MIN_ROWS = 8


def _average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(data: np.ndarray, rng: np.random.Generator) -> dict:
    """One isolation tree as flat arrays; a leaf stores its expected extra depth."""
    limit = max(1, math.ceil(math.log2(max(len(data), 2))))
    nodes: dict[str, list] = {"feature": [], "cut": [], "left": [], "right": [], "depth": []}
    todo = [(np.arange(len(data)), 0, -1, "left")]
    while todo:
        rows, depth, parent, side = todo.pop()
        here = len(nodes["feature"])
        if parent >= 0:
            nodes[side][parent] = here
        low, high = data[rows].min(axis=0), data[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        leaf = depth >= limit or len(rows) <= 1 or len(usable) == 0
        feature = -1 if leaf else int(rng.choice(usable))
        cut = 0.0 if leaf else float(rng.uniform(low[feature], high[feature]))
        for name, value in (("feature", feature), ("cut", cut), ("left", here), ("right", here)):
            nodes[name].append(value)
        nodes["depth"].append(float(depth + (_average_path(len(rows)) if leaf else 0)))
        if not leaf:
            goes_left = data[rows, feature] <= cut
            todo.append((rows[~goes_left], depth + 1, here, "right"))
            todo.append((rows[goes_left], depth + 1, here, "left"))
    return nodes


def isolation_flags(
    df: DataFrame,
    features: list[str],
    trees: int = 100,
    seed: int = 42,
    flag: str = "isolation_anomaly",
    sample: int = SAMPLE,
) -> DataFrame:
    """Add an isolation-forest score and flag (score above one half).

    Trees are grown in parallel, one group each, on at most ``sample`` rows.
    The tasks that read the rows draw them: a row takes part if its hash lies below a
    threshold that follows from the number of rows, and its hash names the tree, so there
    is no order over all rows. Per tree each task passes on its ``sample`` smallest
    hashes, which bounds a group even if one row is repeated without end. The
    fitted forest is a few hundred kilobytes, so it goes to every task; scoring
    is one vectorised pass. Fewer than eight rows: no flags.
    """
    vec = [F.col(c).cast("double").alias(c) for c in features]
    size = df.count()
    if size < MIN_ROWS:
        return df.withColumns({"isolation_score": F.lit(None).cast("double"), flag: F.lit(False)})
    wanted = min(sample, size) * trees
    hashed = df.select(*vec, F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns]).alias("_h"))
    pool = hashed.filter(F.shiftrightunsigned("_h", 11) < int(min(1.0, wanted / size) * 2**53))
    copies = max(1, math.ceil(wanted / size))
    drawn = pool.withColumn("_j", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn(
        "_tree", F.pmod(F.xxhash64("_h", "_j"), F.lit(trees)).cast("int")
    )
    smallest = F.row_number().over(Window.partitionBy("_tree").orderBy("_h", "_j"))
    drawn = drawn.withColumn("_n", smallest).filter(F.col("_n") <= sample).drop("_n")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["_tree"].iloc[0])
        ordered = pdf.sort_values(["_h", "_j"])
        data = ordered[features].to_numpy(dtype=float)
        nodes = _grow(data, np.random.default_rng([seed, tree]))
        return pd.DataFrame([{"tree": tree, "rows": len(data), **nodes}])

    schema = (
        "tree int, rows int, feature array<int>, cut array<double>, "
        "left array<int>, right array<int>, depth array<double>"
    )
    fitted = drawn.groupBy("_tree").applyInPandas(grow, schema).orderBy("tree").collect()
    forest = [
        tuple(np.asarray(t[n]) for n in ("feature", "cut", "left", "right", "depth")) for t in fitted
    ]
    usual = _average_path(float(np.mean([t["rows"] for t in fitted])))
    shared = df.sparkSession.sparkContext.broadcast((forest, usual))

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        trees_here, norm = shared.value
        data = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        total = np.zeros(len(data))
        rows = np.arange(len(data))
        for feature, cut, left, right, depth in trees_here:
            node = np.zeros(len(data), dtype=int)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                goes_left = data[rows, np.maximum(f, 0)] <= cut[node]
                node = np.where(inner, np.where(goes_left, left[node], right[node]), node)
            total += depth[node]
        return pd.Series(2.0 ** (-(total / len(trees_here)) / norm))

    return df.withColumn("isolation_score", score(*vec)).withColumn(flag, F.col("isolation_score") > 0.5)


def anomaly_report(scored: DataFrame, isolation: str | None = None) -> DataFrame:
    """Bins flagged by the rolling threshold or by the forest."""
    hit = F.col("threshold_anomaly")
    if isolation:
        hit = hit | F.col(isolation)
    return scored.filter(hit)
