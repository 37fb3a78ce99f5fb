"""Budgeted selections: the best rows by a score, as many as a count or an amount allows, put back in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_then_restore(df: DataFrame, order: list[Column], n: int, restore: list[str]) -> DataFrame:
    """The first n rows by order, given back in the order of restore. One top-k, no global sort of all rows."""
    return df.orderBy(*order).limit(n).orderBy(*restore)


def take_until(df: DataFrame, group: list[str], order: list[Column], amount: str, budget: int, most: int) -> DataFrame:
    """Rows of each group in order until the amounts before a row reach the budget, or most rows are taken.

    The test comes before a row is added, so the last row may pass the budget. Adds taken_before.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    before = F.coalesce(F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("taken_before", before).withColumn("_rn", F.row_number().over(w)).where((F.col("taken_before") < budget) & (F.col("_rn") <= most)).drop("_rn")


def batch_numbers(df: DataFrame, group: list[str], order: list, size: int) -> DataFrame:
    """Adds batch_no: consecutive rows of a group in batches of the same size, from 0."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("batch_no", F.floor((F.row_number().over(w) - 1) / size).cast("bigint"))
