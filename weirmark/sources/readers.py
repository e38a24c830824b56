"""Readers of the raw zone and the split of bad rows from good ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirmark.functions.names import free_names
from weirmark.sources import documents, schemas

CORRUPT = "_corrupt_record"
#: City dimension; fixed values.
DEFAULT_CITIES = [
    ("Munich", 48.3538, 11.7861, "Europe/Berlin", "celsius", "Munich Airport"),
    ("London", 51.5048, 0.0495, "Europe/London", "celsius", "London City Airport"),
    ("NYC", 40.7769, -73.8740, "America/New_York", "fahrenheit", "LaGuardia Airport"),
    ("Tokyo", 35.5494, 139.7798, "Asia/Tokyo", "celsius", "Tokyo Haneda Airport"),
]


def _json(spark: SparkSession, path: str, schema: str, whole_file: bool) -> DataFrame:
    declared = T.StructType.fromDDL(f"{schema}, {CORRUPT} string")
    return spark.read.schema(declared).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", whole_file).json(path)


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """Weather snapshots, one JSON object per line."""
    return _json(spark, path, schemas.RAW_WEATHER, False)


def read_markets(spark: SparkSession, path: str) -> DataFrame:
    """Market snapshots, one JSON object per line."""
    return _json(spark, path, schemas.RAW_MARKET, False)


def read_market_history(spark: SparkSession, path: str) -> DataFrame:
    """History documents, one JSON object per file; a file is one task, so for large ones see ``read_large_history``."""
    return _json(spark, path, schemas.MARKET_HISTORY, True)


def read_large_history(spark: SparkSession, path: str) -> DataFrame:
    """The same, a file dealt over many tasks: a row per market, each with its document's fields."""
    return documents.read_records(spark, path, schemas.MARKET_HISTORY, "markets")


def read_weather_history(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.WEATHER_HISTORY, True)


def cities(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """City dimension; an absent unit is celsius, an absent station ''."""
    found = spark.createDataFrame(DEFAULT_CITIES if rows is None else rows, schemas.CITIES)
    return found.withColumn("temperature_unit", F.coalesce("temperature_unit", F.lit("celsius"))).withColumn("station", F.coalesce("station", F.lit("")))


def split_quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that break no rule, and the others with ``reason``: the first rule they break.

    A rule is the condition of a bad row; a null condition is not bad.
    """
    reason = F.coalesce(*(F.when(bad, F.lit(name)) for name, bad in rules.items()))
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def write_quarantine(df: DataFrame, rules: dict[str, Column], path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """What ``split_quarantine`` gives, written in one pass over ``df`` to a folder for good rows and one for bad ones; and how many rows broke each rule first.

    The counts come with the write, of the rows that it wrote; good rows count
    under ''.
    """
    reason, verdict = free_names(df, "reason", "verdict")
    marked = df.withColumn(reason, F.coalesce(*(F.when(bad, F.lit(name)) for name, bad in rules.items()), F.lit("")))
    seen = Observation()
    counts = [F.count_if(F.col(reason) == name).alias(f"n{i}") for i, name in enumerate(["", *rules])]
    marked.observe(seen, *counts).withColumn(verdict, F.when(F.col(reason) == "", "good").otherwise("bad")).write.partitionBy(verdict).parquet(path)
    stored = df.sparkSession.read.schema(T.StructType([*marked.schema.fields, T.StructField(verdict, T.StringType())])).parquet(path)
    good, bad = stored.where(F.col(verdict) == "good").drop(reason, verdict), stored.where(F.col(verdict) == "bad").drop(verdict)
    return good, bad.withColumnRenamed(reason, "reason"), {name: seen.get[f"n{i}"] for i, name in enumerate(["", *rules])}


def corrupt_line() -> Column:
    return F.col(CORRUPT).isNotNull()


def unequal_lengths(*arrays: Column) -> Column:
    first, *others = (F.size(a) for a in arrays)
    bad = F.lit(False)
    for n in others:
        bad = bad | (n != first)
    return bad
