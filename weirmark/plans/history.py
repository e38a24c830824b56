"""Resolved markets with their price trajectories, and weather history per city."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirmark.functions import scalars as S
from weirmark.functions.names import free_names
from weirmark.operators.joins import calendar_grid, within_life
from weirmark.operators.nested import last_winner, total_size
from weirmark.operators.rows import keep_closed, unnest

HEAD = ["city", "date", "slug"]
HISTORY = "array<struct<t:bigint,p:double>>"
BUCKETS = f"array<struct<bucket:string,yes_token:string,resolved_yes:boolean,history:{HISTORY}>>"


def market_grid(cities: DataFrame, start: datetime.date, end: datetime.date) -> DataFrame:
    """(city, day, slug) of every city and day."""
    grid = calendar_grid(cities.select(F.col("name").alias("city")), start, end)
    return grid.withColumn("slug", S.market_slug(F.col("city"), F.col("day")))


def market_events(cities: DataFrame, events: DataFrame, start: datetime.date, end: datetime.date) -> DataFrame:
    """``market_grid`` joined to ``events`` by slug, with the cities' units.

    The grid is many times larger than the cities, by whose size Spark would
    broadcast it. So it isn't made: a slug is split into the parts of city and
    day, and the days of the window are a table of their own.
    """
    place, of_day = free_names(events, "place", "of_day")
    named = cities.select(F.col("name").alias("city"), "temperature_unit", S.city_part(F.col("name")).alias(place))
    days = calendar_grid(events.sparkSession.range(1).select(), start, end).select("day", S.day_part(F.col("day")).alias(of_day))
    parts = S.slug_parts(F.col("slug"))
    within = events.withColumns({place: parts[0], of_day: parts[1]}).join(F.broadcast(days), of_day)
    return within.join(named, place).drop(place, of_day)


def market_records(cities: DataFrame, events: DataFrame, points: DataFrame, start: datetime.date, end: datetime.date) -> DataFrame:
    """One row per city and day with a closed market: its buckets with their price points.

    ``events`` has one row per slug, ``points`` is (token_id, t, p). The winner
    is taken of all buckets, also those without a usable token, which get no
    bucket entry. A row holds one market, whatever the window.
    """
    closed = keep_closed(events).select("slug", "title", "endDate", "startDate", "conditionId", "markets")
    found = market_events(cities, closed, start, end).withColumn("date", F.date_format("day", "yyyy-MM-dd"))
    rows = unnest(found, "markets", "m", [*HEAD, "startDate", "endDate"], "position")
    life = {name: S.epoch_seconds(S.iso_timestamp(S.filled(F.col(f"m.{field}"), F.col(field)))).alias(name) for name, field in (("opened", "startDate"), ("ended", "endDate"))}
    rows = rows.select(*HEAD, "position", F.col("m.groupItemTitle").alias("bucket"), S.first_token(F.col("m.clobTokenIds")).alias("yes_token"), S.resolved_yes(F.col("m.outcomePrices")).alias("resolved_yes"), *life.values())
    winner = last_winner(rows, HEAD, "bucket", F.col("resolved_yes"), "position")
    usable = rows.where("yes_token is not null")
    lives = usable.select(*HEAD, "position", F.col("yes_token").alias("token_id"), "opened", "ended")
    paths = within_life(points, lives, "token_id", "t", "opened", "ended").groupBy(*HEAD, "position").agg(F.array_sort(F.collect_list(F.struct("t", "p"))).alias("history"))
    buckets = usable.join(paths, [*HEAD, "position"], "left")
    bucket = F.struct("position", F.struct("bucket", "yes_token", "resolved_yes", F.coalesce("history", F.array().cast(HISTORY)).alias("history")).alias("b"))
    buckets = buckets.groupBy(*HEAD).agg(F.array_sort(F.collect_list(bucket)).alias("b")).select(*HEAD, F.col("b.b").alias("buckets"))
    markets = found.join(winner, HEAD, "left").join(buckets, HEAD, "left")
    return markets.select("city", "date", "slug", "title", "endDate", "conditionId", "temperature_unit", "resolved_bucket", F.coalesce("buckets", F.array().cast(BUCKETS)).alias("buckets"))


def history_documents(cities: DataFrame, events: DataFrame, points: DataFrame, start: datetime.date, end: datetime.date) -> DataFrame:
    """One document per city: the requested window and its closed markets in order; a city without any has an empty list.

    A document is one row, so a city's markets in the window must fit a row;
    beyond some hundred MB of them keep ``market_records`` instead.
    """
    records = market_records(cities, events, points, start, end)
    market = F.struct(*(c for c in records.columns if c != "city"))
    listed = records.groupBy("city").agg(F.array_sort(F.collect_list(market)).alias("markets"))
    docs = cities.select(F.col("name").alias("city"), "station").join(listed, "city", "left")
    window = F.array(F.lit(start.isoformat()), F.lit(end.isoformat()))
    none = F.array().cast(dict(listed.dtypes)["markets"])
    return docs.select("city", "station", window.alias("window"), total_size(F.col("markets")).cast("long").alias("market_count"), F.coalesce("markets", none).alias("markets"))


def weather_documents(forecasts: DataFrame, archives: DataFrame, units: DataFrame) -> DataFrame:
    """One document per city out of two (city, response) tables; either part may be absent."""
    both = forecasts.select("city", F.col("response").alias("historical_forecast")).join(archives.select("city", F.col("response").alias("archive_actuals")), "city", "full_outer")
    named = both.join(units.select(F.col("name").alias("city"), "station", "temperature_unit"), "city", "left")
    return named.select("city", "station", "temperature_unit", "historical_forecast", "archive_actuals")


def write_documents(docs: DataFrame, path: str) -> None:
    """One folder with one file per city, replaced as a whole."""
    docs.repartition("city").write.mode("overwrite").partitionBy("city").json(path)


def write_market_documents(records: DataFrame, cities: DataFrame, start: datetime.date, end: datetime.date, path: str) -> None:
    """The documents of ``history_documents`` out of ``market_records``, replaced as a whole, one folder and file per city, of any size.

    A document is written market by market as they come in order, so no row
    and no task holds more of it than a market. One task writes a city's file;
    readers need not read it by one (``readers.read_large_history``).
    """
    order = F.struct("date", "slug")
    sizes = records.groupBy("city").agg(F.count("*").alias("market_count"), F.min(order).alias("first"))
    window = F.array(F.lit(start.isoformat()), F.lit(end.isoformat()))
    heads = cities.select(F.col("name").alias("city"), "station").join(sizes, "city", "left").select("city", F.struct("city", "station", window.alias("window"), F.coalesce("market_count", F.lit(0)).alias("market_count")).alias("head"))
    kept = {"ignoreNullFields": "false"}
    blank = F.lit("")
    begin = heads.select("city", F.lit(0).alias("part"), blank.alias("date"), blank.alias("slug"), F.regexp_replace(F.to_json("head", kept), r"\}$", ',"markets":[').alias("line"))
    market = F.to_json(F.struct(*(c for c in records.columns if c != "city")), kept)
    comma = F.when(order == F.col("first"), "").otherwise(",")
    middle = records.join(sizes.select("city", "first"), "city").select("city", F.lit(1).alias("part"), "date", "slug", F.concat(comma, market).alias("line"))
    ends = heads.select("city", F.lit(2).alias("part"), blank.alias("date"), blank.alias("slug"), F.lit("]}").alias("line"))
    lines = begin.unionByName(middle).unionByName(ends).repartition("city").sortWithinPartitions("city", "part", "date", "slug")
    lines.select("city", "line").write.mode("overwrite").option("maxRecordsPerFile", 0).partitionBy("city").text(path)


def snapshot_counts(snapshots: DataFrame) -> DataFrame:
    """(city, n_events, n_markets) of all market snapshots."""
    return snapshots.groupBy(F.col("_meta.city").alias("city")).agg(F.sum(total_size(F.col("gamma_events"))).alias("n_events"), F.sum(total_size(F.col("gamma_events"), "markets")).alias("n_markets"))


def document_counts(docs: DataFrame) -> DataFrame:
    """(city, n_markets, n_buckets, n_points) of history documents."""
    sizes = {"n_markets": (), "n_buckets": ("buckets",), "n_points": ("buckets", "history")}
    return docs.groupBy("city").agg(*(F.sum(total_size(F.col("markets"), *path)).alias(name) for name, path in sizes.items()))


def response_days(snapshots: DataFrame) -> DataFrame:
    """(city, kind, n_days) of weather snapshots."""
    return snapshots.groupBy(F.col("_meta.city").alias("city"), F.col("_meta.kind").alias("kind")).agg(F.sum(total_size(F.col("response.daily.time"))).alias("n_days"))
