"""Market against forecast against outcome, one row per city and date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmark.operators.dedup import first_of, keep_first, keep_latest
from weirmark.operators.nested import mean_abs_error

KEYS = ["city", "target_date"]
VIEW = "mart_market_vs_forecast_vs_actual"


def near_close_mode(prices: DataFrame, snapshot: str = "tick", ties: tuple[Column, ...] = ()) -> DataFrame:
    """The most probable bucket of the last tick before the close.

    With ``snapshot='hour'`` it is the most probable one of the last hour, for
    buckets that do not tick together.
    """
    left = F.col("hours_to_close") if snapshot == "tick" else F.floor("hours_to_close")
    order = [left.asc_nulls_last(), F.col("yes_price").desc_nulls_last(), *(ties or (F.col("bucket_mid_c").asc_nulls_last(), F.col("bucket_label").asc_nulls_last()))]
    return keep_first(prices.where("hours_to_close >= 0"), KEYS, order)


def latest_forecast(forecasts: DataFrame) -> DataFrame:
    return keep_latest(forecasts, KEYS, "forecast_ts", (F.col("source").asc_nulls_last(), F.col("forecast_max_c").asc_nulls_last()))


def mart(outcomes: DataFrame, prices: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Every outcome with the market's mode and the latest forecast. Unordered: sort where it is shown."""
    market = near_close_mode(prices).select(*KEYS, F.col("bucket_mid_c").alias("market_mode_c"), F.col("yes_price").alias("market_mode_prob"))
    forecast = latest_forecast(forecasts).select(*KEYS, "forecast_max_c")
    joined = outcomes.join(market, KEYS, "left").join(forecast, KEYS, "left")
    return joined.select(*KEYS, "market_mode_c", "market_mode_prob", "forecast_max_c", F.col("resolved_mid_c").alias("actual_station_c"), "era5_actual_max_c")


def mart_in_one_pass(rows: DataFrame, market: Column, forecast: Column, resolved: Column, resolved_order: list[tuple[Column, str]], actual: Column, actual_order: list[tuple[Column, str]]) -> DataFrame:
    """The mart of one table that holds all four kinds of rows, read once and aggregated once by city and date.

    ``market``, ``forecast``, ``resolved`` and ``actual`` say which rows count
    as which; a row may be several. ``rows`` has the columns of price rows, and
    forecast_ts, forecast_max_c, resolved_mid_c and era5_actual_max_c. It gives
    what ``mart`` gives of the four tables, at a single shuffle of one row per
    key and task.
    """
    mode = [(F.col("hours_to_close"), "asc"), (F.col("yes_price"), "desc"), (F.col("bucket_mid_c"), "asc"), (F.col("bucket_label"), "asc")]
    latest = [(F.unix_micros("forecast_ts"), "desc"), (F.col("source"), "asc"), (F.col("forecast_max_c"), "asc")]
    found = rows.groupBy(*KEYS).agg(
        first_of(mode, {"market_mode_c": F.col("bucket_mid_c"), "market_mode_prob": F.col("yes_price")}, market & (F.col("hours_to_close") >= 0)).alias("mode"),
        first_of(latest, {"forecast_max_c": F.col("forecast_max_c")}, forecast).alias("latest"),
        first_of(resolved_order, {"resolved_mid_c": F.col("resolved_mid_c")}, resolved).alias("won"),
        first_of(actual_order, {"era5_actual_max_c": F.col("era5_actual_max_c")}, actual & F.col("era5_actual_max_c").isNotNull()).alias("actual"),
    )
    kept = found.where("won is not null or actual is not null")
    return kept.select(*KEYS, "mode.market_mode_c", "mode.market_mode_prob", "latest.forecast_max_c", F.col("won.resolved_mid_c").alias("actual_station_c"), "actual.era5_actual_max_c")


def city_errors(rows: DataFrame, market: str = "market_mode_c", forecast: str = "forecast_max_c", actual: str = "actual_station_c") -> DataFrame:
    return mean_abs_error(rows.where(F.col(market).isNotNull()), ["city"], {"market_mae_c": (market, actual), "forecast_mae_c": (forecast, actual)})


def city_errors_sql(view: str = VIEW) -> str:
    """The same as SQL over the registered view."""
    error = "CAST(ROUND(CAST(AVG(ABS({} - actual_station_c)) AS DECIMAL(28, 10)), 2) AS DOUBLE)"
    return f"""
        SELECT city, {error.format("market_mode_c")} AS market_mae_c, {error.format("forecast_max_c")} AS forecast_mae_c
        FROM {view} WHERE market_mode_c IS NOT NULL GROUP BY city
    """


def register_mart(df: DataFrame, name: str = VIEW) -> None:
    """Creates or replaces the lazy view."""
    df.createOrReplaceTempView(name)
