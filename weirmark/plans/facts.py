"""Typed fact and dimension tables out of the raw zone.

Every fact comes as a pair of tables, the good rows and the bad ones with a
reason; the functions without ``split`` in their name give the good rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirmark.functions import scalars as S
from weirmark.operators.dedup import first_non_null, keep_first, priority_dedup
from weirmark.operators.joins import lookup_unit, outer_merge
from weirmark.operators.rows import keep_filled, keep_kinds, tagged, unnest, zip_daily
from weirmark.sources import schemas
from weirmark.sources.readers import split_quarantine, unequal_lengths
from weirmark.sources.versions import Store

KEYS = ["city", "target_date"]
PRICE_KEY = [*KEYS, "bucket_label"]
DAILY = {"day": "time", "tmax": "temperature_2m_max", "tmin": "temperature_2m_min"}


def _shaped(df: DataFrame, schema: str, *more: str) -> DataFrame:
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    return df.select(*names, *more)


# Prices -----------------------------------------------------------------------


def live_prices(snapshots: DataFrame, cities: DataFrame) -> DataFrame:
    """One row per market of a snapshot that has a price list, also one that cannot be read; the event ends on the target date."""
    events = unnest(snapshots, "gamma_events", "event", [F.col("_meta.city").alias("city"), S.iso_timestamp(F.col("_meta.fetched_at_utc")).alias("snapshot_ts")])
    markets = unnest(events, "event.markets", "market", ["city", "snapshot_ts", F.col("event.endDate").alias("endDate")])
    priced = markets.where(S.has_prices(F.col("market.outcomePrices")))
    rows = priced.select("city", S.target_date(F.col("endDate")).alias("target_date"), "snapshot_ts", F.col("market.groupItemTitle").alias("bucket_label"), S.first_price(F.col("market.outcomePrices")).alias("yes_price"))
    return tagged(lookup_unit(rows, cities), "live")


def backfill_prices(history: DataFrame, cities: DataFrame) -> DataFrame:
    """One row per price point of a history document."""
    markets = unnest(history, "markets", "market", ["city"])
    buckets = unnest(markets, "market.buckets", "bucket", ["city", "market"])
    points = unnest(buckets, "bucket.history", "point", ["city", "market", "bucket"])
    rows = points.select("city", S.iso_date(F.col("market.date")).alias("target_date"), S.epoch_timestamp(F.col("point.t")).alias("snapshot_ts"), F.col("bucket.bucket").alias("bucket_label"), F.col("point.p").alias("yes_price"))
    return tagged(lookup_unit(rows, cities), "backfill")


def price_rows(rows: DataFrame, signed: bool = False) -> DataFrame:
    """Adds bucket bounds in °C and the hours left."""
    parsed = S.with_bucket(rows, signed=signed)
    return _shaped(parsed.withColumn("hours_to_close", S.hours_to_close(F.col("snapshot_ts"), F.col("target_date"))), schemas.FACT_PRICE)


def key_rules() -> dict[str, Column]:
    return {"no city": F.col("city").isNull(), "no target date": F.col("target_date").isNull()}


def price_rules() -> dict[str, Column]:
    """Rules of ``split_quarantine`` for price rows."""
    return {"price is no number": F.col("yes_price").isNull(), "label without a number": S.no_number(F.col("bucket_label")), "no time": F.col("snapshot_ts").isNull(), **key_rules()}


def hourly_prices(rows: DataFrame) -> DataFrame:
    return priority_dedup(rows, PRICE_KEY, "snapshot_ts", ties=(F.col("yes_price").desc_nulls_last(), F.col("native_unit").asc_nulls_last()))


def split_prices(snapshots: DataFrame, history: DataFrame, cities: DataFrame, signed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Prices of both sources, one per city, target date, bucket and hour, backfill first; and the bad rows, of which none is merged.

    Rows are judged and merged first; labels are parsed for those that are left.
    """
    good, bad = split_quarantine(live_prices(snapshots, cities).unionByName(backfill_prices(history, cities)), price_rules())
    return price_rows(hourly_prices(good), signed), price_rows_bad(bad)


def price_rows_bad(bad: DataFrame) -> DataFrame:
    return bad.select(*KEYS, "snapshot_ts", "source", "bucket_label", "yes_price", "reason")


def fact_price(snapshots: DataFrame, history: DataFrame, cities: DataFrame, signed: bool = False) -> DataFrame:
    return split_prices(snapshots, history, cities, signed)[0]


# Weather ----------------------------------------------------------------------


def _days(df: DataFrame, response: str, keep: list) -> tuple[DataFrame, DataFrame]:
    """Days of the daily series; and the records whose series differ in length, which give none."""
    series = {name: f"{response}.daily.{field}" for name, field in DAILY.items()}
    rules = {"series of unequal length": unequal_lengths(*(F.col(path) for path in series.values()))}
    good, bad = split_quarantine(df, rules)
    return zip_daily(good, series, keep).withColumn("target_date", S.iso_date(F.col("day"))), bad.select(*keep, F.lit(None).cast("date").alias("target_date"), "reason")


def _live(snapshots: DataFrame, cities: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    found = keep_kinds(snapshots, kinds).withColumn("own_unit", F.col("_meta.temperature_unit")).withColumn("city", F.col("_meta.city"))
    return lookup_unit(found, cities, F.col("own_unit"))


def weather_days(snapshots: DataFrame, history: DataFrame, cities: DataFrame, kinds: tuple[str, ...], section: str) -> tuple[DataFrame, DataFrame]:
    """Days of snapshots of these kinds and of a section of the history documents, with the time of the fetch; and the bad ones.

    Days of history documents have no time; a document may lack the section.
    """
    live, live_bad = _days(_live(snapshots, cities, kinds), "response", ["city", "native_unit", S.iso_timestamp(F.col("_meta.fetched_at_utc")).alias("fetched"), F.lit("live").alias("source")])
    back = history.where(F.col(section).isNotNull()).withColumnRenamed("temperature_unit", "native_unit")
    back, back_bad = _days(back, section, ["city", "native_unit", F.lit(None).cast("timestamp").alias("fetched"), F.lit("backfill").alias("source")])
    good, bad = split_quarantine(live.unionByName(back), key_rules())
    return good, live_bad.unionByName(back_bad).unionByName(bad.select("city", "native_unit", "fetched", "source", "target_date", "reason"))


def split_forecasts(snapshots: DataFrame, history: DataFrame, cities: DataFrame, kinds: tuple[str, ...] = ("weather-forecast",)) -> tuple[DataFrame, DataFrame]:
    """Every fetched forecast day; those of history documents have no issue time."""
    good, bad = weather_days(snapshots, history, cities, kinds, "historical_forecast")
    rows = good.withColumnsRenamed({"tmax": "forecast_max_native", "tmin": "forecast_min_native", "fetched": "forecast_ts"})
    for end in ("max", "min"):
        rows = rows.withColumn(f"forecast_{end}_c", S.to_celsius(F.col(f"forecast_{end}_native"), F.col("native_unit")))
    return _shaped(rows, schemas.FACT_FORECAST), bad


def fact_forecast(snapshots: DataFrame, history: DataFrame, cities: DataFrame, kinds: tuple[str, ...] = ("weather-forecast",)) -> DataFrame:
    return split_forecasts(snapshots, history, cities, kinds)[0]


def split_actuals(snapshots: DataFrame, history: DataFrame, cities: DataFrame, prefer: str = "first") -> tuple[DataFrame, DataFrame]:
    """(city, target_date, era5_actual_max_c): live before backfill, then the earliest fetch, or with ``prefer='latest'`` the latest."""
    good, bad = weather_days(snapshots, history, cities, ("weather-archive",), "archive_actuals")
    rows = good.withColumn("era5_actual_max_c", S.to_celsius(F.col("tmax"), F.col("native_unit")))
    fetched = F.col("fetched").desc_nulls_last() if prefer == "latest" else F.col("fetched").asc_nulls_last()
    order = [F.when(F.col("source") == "live", 0).otherwise(1), fetched, F.col("era5_actual_max_c")]
    return first_non_null(rows, KEYS, "era5_actual_max_c", order).select(*KEYS, "era5_actual_max_c"), bad


def actuals(snapshots: DataFrame, history: DataFrame, cities: DataFrame, prefer: str = "first") -> DataFrame:
    return split_actuals(snapshots, history, cities, prefer)[0]


# Outcomes ---------------------------------------------------------------------


def split_resolved(history: DataFrame, cities: DataFrame, signed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Winning bucket per city and date, the first by label if documents disagree."""
    markets = unnest(history, "markets", "market", ["city"]).select("city", S.iso_date(F.col("market.date")).alias("target_date"), F.col("market.resolved_bucket").alias("resolved_bucket"))
    rules = {"label without a number": S.no_number(F.col("resolved_bucket")), **key_rules()}
    good, bad = split_quarantine(keep_filled(markets, "resolved_bucket"), rules)
    won = lookup_unit(keep_first(good, KEYS, [F.col("resolved_bucket")]), cities)
    parsed = S.with_bucket(won, "resolved_bucket", signed=signed)
    return parsed.select(*KEYS, "resolved_bucket", *(F.col(f"bucket_{x}_c").alias(f"resolved_{x}_c") for x in ("mid", "low", "high"))), bad


def resolved(history: DataFrame, cities: DataFrame, signed: bool = False) -> DataFrame:
    return split_resolved(history, cities, signed)[0]


def split_outcomes(market_history: DataFrame, weather: DataFrame, weather_history: DataFrame, cities: DataFrame, prefer: str = "first") -> tuple[DataFrame, DataFrame]:
    """Resolved bucket and actual of each city and date; bad rows of either, told apart by ``part``. Null keys match nothing, so they are bad."""
    won, won_bad = split_resolved(market_history, cities)
    actual, actual_bad = split_actuals(weather, weather_history, cities, prefer)
    bad = won_bad.select(*KEYS, F.lit("resolved").alias("part"), "reason").unionByName(actual_bad.select(*KEYS, F.lit("actual").alias("part"), "reason"))
    return _shaped(outer_merge(won, actual, KEYS), schemas.DIM_OUTCOME), bad


def dim_outcome(market_history: DataFrame, weather: DataFrame, weather_history: DataFrame, cities: DataFrame, prefer: str = "first") -> DataFrame:
    return split_outcomes(market_history, weather, weather_history, cities, prefer)[0]


# Tables -----------------------------------------------------------------------


def rebuild(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Idempotent: the table is what ``df`` is, whatever was there; with partitions only those of ``df`` are replaced."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def rebuild_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Replaces all the tables at once; returns them as they are stored.

    Each is written to a folder of its own, and one manifest then names them
    all. Until that, readers have the tables as they were, also while they
    read; if a write fails, nothing has changed. The state before stays until
    ``Store.forget``.
    """
    store = Store(next(iter(tables.values())).sparkSession, folder)
    number, _ = store.current()
    made = {name: store.new_folder(name) for name in tables}
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{made[name]}")
    store.commit(number, {name: {"folder": made[name], "schema": tables[name].schema.json()} for name in tables})
    return stored_tables(store.spark, folder)


def stored_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the last rebuild that was committed; none before the first."""
    _, manifest = Store(spark, folder).current()
    return {name: spark.read.schema(T.StructType.fromJson(json.loads(x["schema"]))).parquet(f"{folder}/{x['folder']}") for name, x in manifest.items()}


def save_tables(tables: dict[str, DataFrame], folder: str, database: str = "default") -> None:
    """The same under names of the catalog: views over the folders, each replaced after all tables are stored."""
    for name, df in rebuild_tables(tables, folder).items():
        spark = df.sparkSession
        path = df.inputFiles()[0].rpartition("/")[0]
        spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} AS SELECT * FROM parquet.`{path}`")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n): rows of each table."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    found = counts[0]
    for more in counts[1:]:
        found = found.unionByName(more)
    return found
