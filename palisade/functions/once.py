"""Keeping costly expressions from being evaluated more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns whose expressions are evaluated exactly once per row.

    The optimizer copies an ordinary projected expression into every filter
    above it, below joins and even below the repartitioning, so that a filter on
    the result repeats all regular expressions, or the model, on more rows than
    the projection sees.  As the output of a one-row generator the values are
    plain columns to it, while filters on the other columns still move down to
    the scan.
    """
    values = F.struct(*[expression.alias(name) for name, expression in columns.items()])
    return df.select(*[F.col(f"`{c}`") for c in df.columns], F.inline(F.array(values)))
