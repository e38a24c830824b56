"""Aggregates that build or count nested values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_winner(df: DataFrame, keys: list[str | Column], title: str, won: Column, position: str, out: str = "resolved_bucket") -> DataFrame:
    """Title of the last winning row in list order; null for a key without a winner."""
    return df.groupBy(*keys).agg(F.max_by(F.col(title), F.when(won, F.col(position))).alias(out))


def pivot_parts(df: DataFrame, keys: list[str], name: str, value: str, parts: list[str], pick=F.first) -> DataFrame:
    """One column per listed part; an absent part is null. Listing them saves a distinct job."""
    return df.groupBy(*keys).pivot(name, parts).agg(pick(value))


def map_by_key(df: DataFrame, keys: list[str], entry: str, value: Column, out: str) -> DataFrame:
    """Map per key; ``entry`` must be unique within it."""
    return df.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(entry), value.alias("value"))))).alias(out))


def total_size(outer: Column, *path: str) -> Column:
    """Elements of the arrays at the end of ``path``, through all the arrays on it; null arrays count 0."""
    if not path:
        return F.greatest(F.coalesce(F.size(outer), F.lit(0)), F.lit(0))
    first, *rest = path
    sizes = F.transform(outer, lambda x: total_size(x[first], *rest))
    return F.coalesce(F.aggregate(sizes, F.lit(0), lambda a, n: a + n), F.lit(0))


def mean_abs_error(df: DataFrame, keys: list[str], errors: dict[str, tuple[str, str]], decimals: int = 2) -> DataFrame:
    """Mean absolute difference of column pairs; each mean skips its own nulls.

    Halves are rounded up, by ten decimals of the mean: what lies beyond is
    noise of the order in which doubles were added.
    """
    mean = lambda a, b: F.avg(F.abs(F.col(a) - F.col(b))).cast("decimal(28, 10)")
    return df.groupBy(*keys).agg(*(F.round(mean(a, b), decimals).cast("double").alias(out) for out, (a, b) in errors.items()))
