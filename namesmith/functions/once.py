"""Columns that are computed once per row.

The optimizer writes a column's definition into every filter and projection above it.
For a rule with dozens of regular expressions that multiplies the work per row, and the
size of the plan, at each step. A one-element explode is a boundary it does not cross, at
no shuffle and one small array per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add (or replace) columns behind such a boundary."""
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*kept, F.explode(F.array(row)).alias("_once")).select(*kept, "_once.*")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used; in lambdas as well."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
