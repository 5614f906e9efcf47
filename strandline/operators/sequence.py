"""Ordered operators within a document: runs, islands, greedy pairs, renumbering, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(keys: list[str], by: list[str]):
    return Window.partitionBy(*keys).orderBy(*by)


def runs(df: DataFrame, keys: list[str], by: list[str], value: str, into: str = "run") -> DataFrame:
    """Numbers maximal runs of equal values (null equals null), from 0."""
    w = ordered(keys, by)
    change = F.when(F.row_number().over(w) == 1, 0).when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    return df.withColumn("_c", change).withColumn(into, F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def islands(df: DataFrame, keys: list[str], by: list[str], joins: Column, into: str = "island") -> DataFrame:
    """Numbers groups of rows that ``joins`` (an expression over lag columns, null: no) ties to the row before."""
    w = ordered(keys, by)
    return df.withColumn("_c", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn(into, F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_c")


def greedy_pairs(df: DataFrame, keys: list[str], by: list[str], joins_next: Column, into: str = "pair") -> DataFrame:
    """Groups rows as a left-to-right pass does that joins two rows and steps over both.

    Edges depend on the rows alone, so in a run of consecutive edges every other one, from the first, holds.
    """
    w = ordered(keys, by)
    df = df.withColumn("_e", F.coalesce(joins_next, F.lit(False)))
    df = df.withColumn("_r", F.sum(F.when(F.col("_e"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("_r", F.coalesce("_r", F.lit(0)))
    inner = Window.partitionBy(*keys, "_r").orderBy(*by)
    df = df.withColumn("_n", F.row_number().over(inner))
    head = F.when(F.col("_n") % 2 == 1, 1).otherwise(0)
    return df.withColumn(into, F.sum(head).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_e", "_r", "_n")


def renumber(df: DataFrame, keys: list[str], by: list[str], into: str, base: int) -> DataFrame:
    return df.withColumn(into, F.row_number().over(ordered(keys, by)) - 1 + base)


def neighbours(df: DataFrame, keys: list[str], by: list[str], value: str) -> DataFrame:
    """The value of the rows before and after, empty at the ends."""
    w = ordered(keys, by)
    return df.withColumns({"prev_" + value: F.lag(value, 1, "").over(w), "next_" + value: F.lead(value, 1, "").over(w)})
