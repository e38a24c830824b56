"""Keep one row per key by an explicit, total order.

``row_number() = 1`` plans as a group limit on both sides of the shuffle, so
each map task ships at most one row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirmark.functions.names import free_names

def keep_first(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each key; null is a key like others."""
    (place,) = free_names(df, "place")
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) == 1).drop(place)


def rank_of(column: Column, first: list[str]) -> Column:
    """0, 1, ... for the listed values, then everything else."""
    rank = F.lit(len(first))
    for i, value in reversed(list(enumerate(first))):
        rank = F.when(column == value, F.lit(i)).otherwise(rank)
    return rank


def priority_dedup(df: DataFrame, keys: list[str | Column], moment: str, source: str = "source", first: tuple[str, ...] = ("backfill", "live"), ties: tuple[Column, ...] = ()) -> DataFrame:
    """One row per key and hour: the preferred source, then the earliest moment, then ``ties``."""
    bucket = F.date_trunc("hour", F.col(moment).cast("timestamp"))
    return keep_first(df, [*keys, bucket], [rank_of(F.col(source), list(first)), F.col(moment).asc_nulls_last(), *ties])


def keep_latest(df: DataFrame, keys: list[str | Column], moment: str, ties: tuple[Column, ...] = ()) -> DataFrame:
    """The row of each key with the latest moment; null moments come last."""
    return keep_first(df, keys, [F.col(moment).desc_nulls_last(), *ties])


def first_of(order: list[tuple[Column, str]], values: dict[str, Column], where: Column | None = None) -> Column:
    """The values of a group's first row as an aggregate, so that several of them need one pass; null if no row counts.

    ``order`` has numbers, dates or strings with ``'asc'`` or ``'desc'``, nulls
    last in either; strings only ascending. Rows that tie in ``order`` are
    ordered by their values. It equals ``keep_first`` of the same order, but
    each map task keeps one row per group and nothing is sorted.
    """
    keys = []
    for i, (column, direction) in enumerate(order):
        keys += [column.isNull().alias(f"n{i}"), (column if direction == "asc" else -column).alias(f"o{i}")]
    row = F.struct(*keys, F.struct(*(c.alias(n) for n, c in values.items())).alias("row"))
    return F.min(row if where is None else F.when(where, row))["row"]


def first_non_null(df: DataFrame, keys: list[str | Column], value: str, order: list[Column]) -> DataFrame:
    """Rows without the value never win."""
    return keep_first(df.where(F.col(value).isNotNull()), keys, order)
