"""Unnesting, filters, windows of days, lineage."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, array: str, name: str, keep: list[str | Column] = ("*",), position: str | None = None) -> DataFrame:
    """One row per element; a null or empty array gives none."""
    if position is None:
        return df.select(*keep, F.explode(array).alias(name))
    return df.select(*keep, F.posexplode(array).alias(position, name))


def zip_daily(df: DataFrame, arrays: dict[str, str], keep: list[str | Column]) -> DataFrame:
    """Parallel arrays to rows by position; ``arrays`` names the output column of each.

    Short arrays are padded with null; quarantine them first by
    ``sources.readers.unequal_lengths``.
    """
    zipped = F.arrays_zip(*(F.col(path).alias(name) for name, path in arrays.items()))
    return df.select(*keep, F.inline(zipped).alias(*arrays))


def keep_kinds(df: DataFrame, kinds: tuple[str, ...], column: str = "_meta.kind") -> DataFrame:
    return df.where(F.col(column).isin(*kinds))


def keep_filled(df: DataFrame, column: str) -> DataFrame:
    """Rows whose string is neither null nor empty."""
    return df.where(F.coalesce(F.col(column), F.lit("")) != "")


def keep_open(df: DataFrame, closed: str = "closed") -> DataFrame:
    """An unknown state counts as open."""
    return df.where(~F.coalesce(F.col(closed), F.lit(False)))


def keep_closed(df: DataFrame, closed: str = "closed") -> DataFrame:
    return df.where(F.coalesce(F.col(closed), F.lit(False)))


def tagged(df: DataFrame, value: str, column: str = "source") -> DataFrame:
    return df.withColumn(column, F.lit(value))


def lookback(df: DataFrame, day: str, as_of: datetime.date, days: int = 7) -> DataFrame:
    """The ``days`` days before ``as_of``, which is not one of them."""
    return df.where(F.col(day).between(F.lit(as_of - datetime.timedelta(days)), F.lit(as_of - datetime.timedelta(1))))


def horizon(df: DataFrame, day: str, as_of: datetime.date, days: int = 3) -> DataFrame:
    """``as_of`` and the days after it, ``days`` in all."""
    return df.where(F.col(day).between(F.lit(as_of), F.lit(as_of + datetime.timedelta(days - 1))))


def date_range(df: DataFrame, day: str, start: datetime.date, end: datetime.date) -> DataFrame:
    """Both ends included."""
    if end < start:
        raise ValueError("end is before start")
    return df.where(F.col(day).between(F.lit(start), F.lit(end)))


def first_or_self(items: Column, single: Column, usable: Column | None = None) -> Column:
    """Element 0 of a list response, else the object itself, if ``usable`` where that is given; null if there is neither."""
    return F.coalesce(F.get(items, F.lit(0)), single if usable is None else F.when(usable, single))
