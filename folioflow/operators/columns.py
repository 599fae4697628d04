"""Computed columns that are evaluated once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose expressions later filters must not repeat.

    A filter on a projected column is moved below the projection, even below an earlier
    shuffle, and evaluates the expression again; exploding a column adds such a filter by
    itself. Passing the values through a one-row generator keeps costly ones where they are.
    """
    values = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(values)))
