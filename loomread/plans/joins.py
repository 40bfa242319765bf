"""Joins with a table that has one row for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tables of keys up to so many rows (of a few dozen bytes) are broadcast.
BROADCAST_ROWS = 500_000


def few_rows(table: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether ``table`` has at most ``most`` rows; no more than that are counted."""
    return table.limit(most + 1).count() <= most


def sized(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``table``, marked for a broadcast if it is counted to be small."""
    return F.broadcast(table) if few_rows(table, most) else table


def looked_up(rows: DataFrame, table: DataFrame, key: str, has: Column, otherwise: dict[str, Column], most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` with the columns of ``table`` by ``key`` where ``has`` holds; ``otherwise`` is what they are in other
    rows, and in those whose key ``table`` lacks.

    A small table is broadcast. A large one meets only the rows that look something up: the others, which may be many
    and share one key, stay where they are.
    """
    has = F.coalesce(has, F.lit(False))
    filled = lambda found: found.withColumns({c: F.coalesce(c, v) for c, v in otherwise.items()})
    if few_rows(table, most):
        hit = table.withColumn("__has", F.lit(True)).withColumnRenamed(key, "__key")
        return filled(rows.join(F.broadcast(hit), (F.col(key) == F.col("__key")) & has & F.col("__has"), "left")).drop("__has", "__key")
    return filled(rows.where(has).join(table, key, "left")).unionByName(rows.where(~has).withColumns(otherwise))
