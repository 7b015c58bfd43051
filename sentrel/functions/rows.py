"""Evaluate an expensive column once per row.

The optimizer merges neighbouring projections and pushes filters through them, and it adds
a size test under a plain ``explode``. For cheap columns that is free; for a column that
runs dozens of regexes, or that a lambda above reads once per element, it repeats the
work. A generator is a boundary that neither merge crosses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, *keep: str | Column, **columns: Column) -> DataFrame:
    """``keep`` plus the named columns, each computed exactly once per row."""
    made = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*keep, F.inline(F.array(made)))


def explode_once(df: DataFrame, *keep: str | Column, **array: Column) -> DataFrame:
    """``keep`` plus one row per non-null element of the (single) named array column."""
    ((name, column),) = array.items()
    return df.select(*keep, F.explode_outer(column).alias(name)).filter(F.col(name).isNotNull())


def inline_once(df: DataFrame, *keep: str, structs: Column) -> DataFrame:
    """``keep`` plus the fields of each non-null struct of an array, one row per struct."""
    return explode_once(df, *keep, element__=structs).select(*keep, "element__.*")
