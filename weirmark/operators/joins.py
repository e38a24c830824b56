"""Joins: lookups, outer merges, fallbacks, grids and intervals."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmark.functions.names import free_names
from weirmark.functions.scalars import filled


def lookup_unit(df: DataFrame, cities: DataFrame, own: Column | None = None, city: str = "city", default: str = "celsius", out: str = "native_unit") -> DataFrame:
    """A row's own unit if filled, else its city's, else the default.

    The city table has one row per name; Spark broadcasts it if its size allows.
    """
    name, unit = free_names(df, "name", "unit")
    units = cities.select(F.col("name").alias(name), F.col("temperature_unit").alias(unit))
    joined = df.join(units, F.col(city) == F.col(name), "left")
    known = [F.col(unit), F.lit(default)]
    return joined.withColumn(out, filled(*([own] if own is not None else []), *known)).drop(name, unit)


def outer_merge(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join; keys of either side. Null keys match nothing, so quarantine them first."""
    return left.join(right, keys, "full_outer")


def with_fallback(base: DataFrame, detail: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The record of ``detail`` where it has the key, whole and with its nulls, else that of ``base``. ``detail`` has one row per key."""
    (fresh,) = free_names(base, "fresh")
    joined = base.join(detail.select(F.col(key), F.struct(*columns).alias(fresh)), key, "left")
    return joined.select(*(F.when(F.col(fresh).isNotNull(), F.col(fresh)[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns))


def calendar_grid(items: DataFrame, start: datetime.date, end: datetime.date, day: str = "day") -> DataFrame:
    """Every row with every day from start to end, both included: one generator per row, no join."""
    return items.withColumn(day, F.explode(F.sequence(F.lit(start), F.lit(end))))


def within_life(points: DataFrame, lives: DataFrame, key: str, moment: str, start: str, end: str, slack: datetime.timedelta = datetime.timedelta(hours=1)) -> DataFrame:
    """Points of a key within its life and the slack at both ends; no bound if an end is missing.

    The equality on the key keeps this a hash or merge join.
    """
    seconds = int(slack.total_seconds())
    joined = points.join(lives, key)
    inside = F.col(moment).between(F.col(start) - seconds, F.col(end) + seconds)
    return joined.where(F.col(start).isNull() | F.col(end).isNull() | inside)


def within_life_in_bins(points: DataFrame, lives: DataFrame, key: str, moment: str, start: str, end: str, slack: datetime.timedelta = datetime.timedelta(hours=1), width: datetime.timedelta = datetime.timedelta(days=7)) -> DataFrame:
    """The same rows, joined on the key and a bin of time, so that a key with a large share of all points is many groups.

    A life has a row for each bin that it and the slack reach, so ``width``
    should not be much shorter than a usual life. Lives that lack an end have
    no bins; they are joined on the key alone.
    """
    own, taken = "bin", {c.lower() for c in (*points.columns, *lives.columns)}
    while own in taken:
        own += "_"
    before, size = int(slack.total_seconds()), int(width.total_seconds())
    bounded = F.col(start).isNotNull() & F.col(end).isNotNull()
    first, last = F.floor((F.col(start) - before) / size), F.floor((F.col(end) + before) / size)
    binned = lives.where(bounded & (F.col(start) - before <= F.col(end) + before)).withColumn(own, F.explode(F.sequence(first, last)))
    joined = points.withColumn(own, F.floor(F.col(moment) / size)).join(binned, [key, own]).drop(own)
    inside = joined.where(F.col(moment).between(F.col(start) - before, F.col(end) + before))
    return inside.unionByName(points.join(lives.where(~bounded), key))
