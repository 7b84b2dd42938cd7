"""Evaluate-once columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def bind(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns whose expressions later filters and projections see as plain inputs.

    Catalyst copies an aliased expression into every filter pushed through it.
    In a long decision chain those copies multiply. A one-row ``inline`` is a
    border it does not push through, still part of the generated stage, and
    filters on the other columns pass it as before.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    packed = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*kept, F.inline(F.array(packed)))
