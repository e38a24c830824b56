"""Registered queries: every operator bound to the driver's tables, with its SQL.

The tables hold no markets, so events stand for price ticks, snapshots and
weather, and orders for daily series and resolved markets. What the raw zone
can have amiss (absent, empty, broken and short values) hangs on the rows'
properties. Each query reads its whole tables; windows of days are features.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirmark.functions import scalars as S
from weirmark.operators import dedup, joins, nested, rows
from weirmark.plans import discovery, facts, history, mart
from weirmark.sources import readers, schemas
from weirmark.sources.scratch import scratch_folder
from weirmark.streaming import incremental, landing, merge_on_read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Price ticks out of events --------------------------------------------------


def _with_k(events: DataFrame) -> DataFrame:
    """k of the properties; made as a row of its own, so that the JSON is parsed once however often k is named."""
    return events.withColumn("k", F.explode(F.array(F.get_json_object("props", "$.k").try_cast("int"))))


def source_of(k):
    return F.when(k % 3 == 0, "live").otherwise("backfill")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _with_k(_read(spark, sf_dir, "events"))
    k = F.col("k")
    label = (
        F.when(F.col("event_type") == "click", F.concat(k.cast("string"), F.lit("°C or below")))
        .when(F.col("event_type") == "error", F.concat(k.cast("string"), F.lit("°F or higher")))
        .when(F.col("event_type") == "purchase", F.concat(k.cast("string"), F.lit("-"), (k + 1).cast("string"), F.lit("°F")))
        .otherwise(F.concat(k.cast("string"), F.lit("°C")))
    )
    city = F.pmod("user_id", F.lit(4))
    found = events.select(
        "event_id",
        city.alias("city"),
        F.to_date("ts").alias("target_date"),
        F.col("ts").alias("snapshot_ts"),
        source_of(k).alias("source"),
        "k",
        (F.col("value") / F.lit(500.0)).alias("yes_price"),
        "event_type",
        "value",
        label.alias("bucket_label"),
        F.when(city == 2, "fahrenheit").otherwise("celsius").alias("native_unit"),
    )
    return S.with_bucket(found).withColumn("hours_to_close", S.hours_to_close(F.col("snapshot_ts"), F.col("target_date")))


TICKS = """
    ticks0 AS (
        SELECT event_id, user_id % 4 AS city, CAST(ts AS DATE) AS target_date, ts AS snapshot_ts,
               CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 = 0 THEN 'live' ELSE 'backfill' END AS source, value / 500.0 AS yes_price, event_type, value,
               TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
               CASE WHEN user_id % 4 = 2 THEN 'fahrenheit' ELSE 'celsius' END AS native_unit,
               epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP)) + 43200000000 - epoch_us(ts) AS us
        FROM events
    ), ticks1 AS (
        SELECT *, CASE event_type WHEN 'click' THEN k || '°C or below' WHEN 'error' THEN k || '°F or higher'
                  WHEN 'purchase' THEN k || '-' || (k + 1) || '°F' ELSE k || '°C' END AS bucket_label,
               sign(us) * floor((abs(us) + 18000000) / 36000000) / 100.0 AS hours_to_close,
               CASE event_type WHEN 'click' THEN 'below' WHEN 'error' THEN 'above' WHEN 'purchase' THEN 'range' ELSE 'exact' END AS bucket_kind,
               CASE WHEN event_type = 'click' THEN NULL ELSE CAST(k AS DOUBLE) END AS low,
               CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'purchase' THEN k + 1.0 ELSE CAST(k AS DOUBLE) END AS high,
               CASE WHEN event_type = 'purchase' THEN k + 0.5 ELSE CAST(k AS DOUBLE) END AS mid
        FROM ticks0
    ), ticks AS (
        SELECT *, CASE WHEN city = 2 THEN round((low - 32) * 5.0 / 9.0, 2) ELSE low END AS bucket_low_c,
               CASE WHEN city = 2 THEN round((high - 32) * 5.0 / 9.0, 2) ELSE high END AS bucket_high_c,
               CASE WHEN city = 2 THEN round((mid - 32) * 5.0 / 9.0, 2) ELSE mid END AS bucket_mid_c
        FROM ticks1
    )
"""


@query(f"WITH {TICKS} SELECT event_id, city, target_date, hours_to_close FROM ticks")
def hours_to_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).select("event_id", "city", "target_date", "hours_to_close")


@query(f"WITH {TICKS} SELECT event_id, bucket_label, bucket_kind, bucket_low_c, bucket_high_c, bucket_mid_c FROM ticks")
def parse_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).select("event_id", "bucket_label", "bucket_kind", "bucket_low_c", "bucket_high_c", "bucket_mid_c")


@query("SELECT event_id, CASE WHEN user_id % 4 = 2 THEN round((floor(value * 10) / 10 - 32) * 5.0 / 9.0, 2) ELSE floor(value * 10) / 10 END AS value_c FROM events")
def unit_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events")
    unit = F.when(F.col("user_id") % 4 == 2, "fahrenheit").otherwise("celsius")
    return events.select("event_id", S.to_celsius(F.floor(F.col("value") * 10) / F.lit(10.0), unit).alias("value_c"))


@query("SELECT event_id, value AS yes_price, value >= 0.99 AS won FROM events")
def json_double_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.to_json(F.array(F.col("value").cast("string"), F.lit("x")))
    decoded = _read(spark, sf_dir, "events").select("event_id", text.alias("prices")).where(F.size(S.json_list(F.col("prices"))) > 0)
    return decoded.select("event_id", S.first_price(F.col("prices")).alias("yes_price"), S.resolved_yes(F.col("prices")).alias("won"))


def _token_text():
    """Null for urgent orders, else by status: empty list, broken or empty text, or a list."""
    urgent, low, other = (F.col("o_orderpriority").startswith(x) for x in ("1", "5", "4"))
    return F.when(urgent, F.lit(None).cast("string")).when(low & (F.col("o_orderstatus") == "F"), "[]").when(low & (F.col("o_orderstatus") == "O"), '["broken').when(other & (F.col("o_orderstatus") == "F"), "").otherwise(F.concat(F.lit('["t'), F.col("o_custkey").cast("string"), F.lit('", "n"]')))


@query("""
    SELECT DISTINCT o_orderpriority AS city, o_orderstatus AS fetched_at_utc, 't' || o_custkey AS token_id FROM orders
    WHERE NOT (starts_with(o_orderpriority, '1') OR (starts_with(o_orderpriority, '5') AND o_orderstatus IN ('F', 'O')) OR (starts_with(o_orderpriority, '4') AND o_orderstatus = 'F'))
""")
def yes_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    market = F.array(F.struct(_token_text().alias("clobTokenIds")))
    events = _read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("city"), F.col("o_orderstatus").alias("fetched_at_utc"), market.alias("markets"))
    return discovery.yes_tokens(events)


# Dedup, windows of rows ------------------------------------------------------


@query(f"""
    WITH {TICKS}, r AS (
        SELECT *, row_number() OVER (PARTITION BY city, target_date, right(bucket_label, 8), date_trunc('hour', snapshot_ts)
            ORDER BY CASE source WHEN 'backfill' THEN 0 ELSE 1 END, snapshot_ts, event_id) AS n FROM ticks
    )
    SELECT event_id, city, target_date, source, yes_price FROM r WHERE n = 1
""")
def hourly_priority_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.priority_dedup(ticks(spark, sf_dir), ["city", "target_date", F.right("bucket_label", F.lit(8))], "snapshot_ts", ties=(F.col("event_id"),))
    return found.select("event_id", "city", "target_date", "source", "yes_price")


MODE = """
    mode AS (
        SELECT * FROM (
            SELECT city, target_date, bucket_mid_c, bucket_label, yes_price, hours_to_close,
                   row_number() OVER (PARTITION BY city, target_date ORDER BY hours_to_close ASC NULLS LAST, yes_price DESC NULLS LAST, bucket_mid_c ASC NULLS LAST, bucket_label ASC NULLS LAST) AS n
            FROM ticks WHERE hours_to_close >= 0
        ) WHERE n = 1
    )
"""


@query(f"WITH {TICKS}, {MODE} SELECT city, target_date, bucket_label, bucket_mid_c, yes_price, hours_to_close FROM mode")
def near_close_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart.near_close_mode(ticks(spark, sf_dir)).select("city", "target_date", "bucket_label", "bucket_mid_c", "yes_price", "hours_to_close")


@query(f"""
    WITH {TICKS}
    SELECT city, target_date, bucket_label, yes_price FROM (
        SELECT *, row_number() OVER (PARTITION BY city, target_date ORDER BY floor(hours_to_close), yes_price DESC NULLS LAST, bucket_mid_c, bucket_label) AS n FROM ticks WHERE hours_to_close >= 0
    ) WHERE n = 1
""")
def near_close_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart.near_close_mode(ticks(spark, sf_dir), snapshot="hour").select("city", "target_date", "bucket_label", "yes_price")


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = ticks(spark, sf_dir).where("event_type = 'signup'")
    issued = F.when(F.col("source") == "live", F.col("snapshot_ts"))
    return rows_.select("event_id", "city", "target_date", issued.alias("forecast_ts"), "source", F.col("value").alias("forecast_max_native"), S.to_celsius(F.col("value"), F.col("native_unit")).alias("forecast_max_c"))


FORECASTS = """
    forecasts AS (
        SELECT event_id, city, target_date, CASE WHEN source = 'live' THEN snapshot_ts END AS forecast_ts, source, value AS forecast_max_native,
               CASE WHEN city = 2 THEN round((value - 32) * 5.0 / 9.0, 2) ELSE value END AS forecast_max_c
        FROM ticks WHERE event_type = 'signup'
    ), latest AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city, target_date ORDER BY forecast_ts DESC NULLS LAST, source, forecast_max_c) AS n FROM forecasts) WHERE n = 1
    )
"""


@query(f"WITH {TICKS}, {FORECASTS} SELECT event_id, city, target_date, source, forecast_max_native FROM latest")
def latest_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart.latest_forecast(forecasts(spark, sf_dir)).select("event_id", "city", "target_date", "source", "forecast_max_native")


@query(f"""
    WITH {TICKS}, w AS (SELECT city, target_date, arg_max(bucket_label, event_id) FILTER (WHERE yes_price >= 0.08) AS resolved_bucket FROM ticks GROUP BY ALL)
    SELECT * FROM w
""")
def winner_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.last_winner(ticks(spark, sf_dir), ["city", "target_date"], "bucket_label", F.col("yes_price") >= 0.08, "event_id")


def actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as fetched actuals; those of small k are null."""
    found = ticks(spark, sf_dir).where("event_type = 'error'").withColumn("actual", F.when(F.col("k") >= 20, F.col("value")))
    order = [dedup.rank_of(F.col("source"), ["live", "backfill"]), F.col("snapshot_ts"), F.col("event_id")]
    return dedup.first_non_null(found, ["city", "target_date"], "actual", order).select("city", "target_date", F.col("actual").alias("era5_actual_max_c"))


ACTUALS = """
    actuals AS (
        SELECT city, target_date, value AS era5_actual_max_c FROM (
            SELECT *, row_number() OVER (PARTITION BY city, target_date ORDER BY CASE source WHEN 'live' THEN 0 ELSE 1 END, snapshot_ts, event_id) AS n
            FROM ticks WHERE event_type = 'error' AND k >= 20
        ) WHERE n = 1
    )
"""


@query(f"WITH {TICKS}, {ACTUALS} SELECT city, target_date, era5_actual_max_c FROM actuals")
def first_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actuals(spark, sf_dir)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase events as resolved buckets; those of small k resolve, others are null or empty."""
    label = F.when(F.col("k") >= 50, F.lit(None).cast("string")).when(F.col("k") >= 10, "").otherwise(F.col("bucket_label"))
    found = ticks(spark, sf_dir).where("event_type = 'purchase'").withColumn("resolved_bucket", label)
    kept = dedup.keep_first(rows.keep_filled(found, "resolved_bucket"), ["city", "target_date"], [F.col("resolved_bucket"), F.col("event_id")])
    return kept.select("city", "target_date", "resolved_bucket", F.col("bucket_mid_c").alias("resolved_mid_c"))


OUTCOMES = """
    resolved AS (
        SELECT city, target_date, bucket_label AS resolved_bucket, bucket_mid_c AS resolved_mid_c FROM (
            SELECT *, row_number() OVER (PARTITION BY city, target_date ORDER BY bucket_label, event_id) AS n
            FROM ticks WHERE event_type = 'purchase' AND k < 10
        ) WHERE n = 1
    ), outcome AS (
        SELECT coalesce(r.city, a.city) AS city, coalesce(r.target_date, a.target_date) AS target_date, resolved_bucket, resolved_mid_c, era5_actual_max_c
        FROM resolved r FULL OUTER JOIN actuals a ON r.city = a.city AND r.target_date = a.target_date
    )
"""


@query(f"WITH {TICKS}, {ACTUALS}, {OUTCOMES} SELECT city, target_date, resolved_bucket, resolved_mid_c FROM resolved")
def resolved_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir)


@query("""
    WITH a AS (SELECT o_custkey, count(*) AS n_early FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' GROUP BY 1),
         b AS (SELECT o_custkey, max(o_orderkey) AS last_order FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW' GROUP BY 1)
    SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, n_early, last_order FROM a FULL OUTER JOIN b ON a.o_custkey = b.o_custkey
""")
def outcome_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    a = orders.where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count("*").alias("n_early"))
    b = orders.where("o_orderstatus = 'P' and o_orderpriority = '5-LOW'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("last_order"))
    return joins.outer_merge(a, b, ["o_custkey"])


def _mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of it out of one scan of the events."""
    kind, k = F.col("event_type"), F.col("k")
    rows_ = ticks(spark, sf_dir).withColumns({
        "forecast_ts": F.when(F.col("source") == "live", F.col("snapshot_ts")).cast("timestamp"),
        "forecast_max_c": S.to_celsius(F.col("value"), F.col("native_unit")),
        "resolved_mid_c": F.col("bucket_mid_c"),
        "era5_actual_max_c": F.when(k >= 20, F.col("value")),
    })
    return mart.mart_in_one_pass(
        rows_, F.lit(True), kind == "signup", (kind == "purchase") & (k < 10), [(F.col("bucket_label"), "asc"), (F.col("event_id"), "asc")],
        kind == "error", [(dedup.rank_of(F.col("source"), ["live", "backfill"]), "asc"), (F.col("snapshot_ts"), "asc"), (F.col("event_id"), "asc")],
    )


MART = """
    mart AS (
        SELECT o.city, o.target_date, m.bucket_mid_c AS market_mode_c, m.yes_price AS market_mode_prob, l.forecast_max_c, o.resolved_mid_c AS actual_station_c, o.era5_actual_max_c
        FROM outcome o LEFT JOIN mode m USING (city, target_date) LEFT JOIN latest l USING (city, target_date)
    )
"""


@query(f"WITH {TICKS}, {FORECASTS}, {ACTUALS}, {OUTCOMES}, {MODE}, {MART} SELECT * FROM mart ORDER BY city, target_date")
def mart_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mart(spark, sf_dir).orderBy("city", "target_date")


QUERIES["mart"], ORACLES["mart"] = QUERIES.pop("mart_table"), ORACLES.pop("mart_table")


@query(f"""
    WITH {TICKS}, {FORECASTS}, {ACTUALS}, {OUTCOMES}, {MODE}, {MART}
    SELECT city, CAST(round(CAST(avg(abs(market_mode_c - actual_station_c)) AS DECIMAL(28, 10)), 2) AS DOUBLE) AS market_mae_c, CAST(round(CAST(avg(abs(forecast_max_c - actual_station_c)) AS DECIMAL(28, 10)), 2) AS DOUBLE) AS forecast_mae_c
    FROM mart WHERE market_mode_c IS NOT NULL GROUP BY city
""")
def city_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    mart.register_mart(_mart(spark, sf_dir))
    return spark.sql(mart.city_errors_sql(mart.VIEW))


flagship = city_mae


@query(f"WITH {TICKS} SELECT event_id, source, yes_price FROM ticks WHERE source = 'live' UNION ALL SELECT event_id, source, yes_price FROM ticks WHERE source = 'backfill'")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ticks(spark, sf_dir).select("event_id", "source", "yes_price")
    live, back = (found.where(F.col("source") == s).drop("source") for s in ("live", "backfill"))
    return rows.tagged(live, "live").unionByName(rows.tagged(back, "backfill")).select("event_id", "source", "yes_price")


# Unnesting -------------------------------------------------------------------


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item as a daily series of three days."""
    days = F.array(*(F.date_format(F.date_add("l_shipdate", i), "yyyy-MM-dd") for i in range(3)))
    daily = F.struct(days.alias("day"), F.array("l_quantity", "l_extendedprice", F.lit(None).cast("double")).alias("tmax"), F.array("l_discount", "l_tax", "l_quantity").alias("tmin"))
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", daily.alias("daily"))


@query("""
    SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) + i AS target_date, CASE i WHEN 0 THEN l_quantity WHEN 1 THEN l_extendedprice END AS tmax, CASE i WHEN 0 THEN l_discount WHEN 1 THEN l_tax ELSE l_quantity END AS tmin
    FROM lineitem, (SELECT unnest([0, 1, 2]) AS i)
""")
def daily_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    zipped = rows.zip_daily(_series(spark, sf_dir), {x: f"daily.{x}" for x in ("day", "tmax", "tmin")}, ["l_orderkey", "l_linenumber"])
    return zipped.select("l_orderkey", "l_linenumber", S.iso_date(F.col("day")).alias("target_date"), "tmax", "tmin")


def _event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item as a snapshot of two events, the first with two markets, the second with none or, if returned, a null list."""
    market = lambda key, price: F.struct(F.col(key).alias("key"), F.col(price).alias("price"))
    markets = F.array(market("l_partkey", "l_quantity"), market("l_suppkey", "l_extendedprice"))
    none = F.when(F.col("l_returnflag") != "R", F.slice(markets, 1, 0))
    event = lambda name, m: F.struct(F.lit(name).alias("name"), m.alias("markets"))
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array(event("a", markets), event("b", none)).alias("events"))


@query("SELECT l_orderkey, l_linenumber, 'a' AS name, l_partkey AS key, l_quantity AS price FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'a', l_suppkey, l_extendedprice FROM lineitem")
def unnest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = rows.unnest(_event_documents(spark, sf_dir), "events", "event", ["l_orderkey", "l_linenumber"])
    markets = rows.unnest(events, "event.markets", "market", ["l_orderkey", "l_linenumber", "event"])
    return markets.select("l_orderkey", "l_linenumber", "event.name", "market.key", "market.price")


@query("SELECT l_orderkey, l_linenumber, CAST(place AS INTEGER) AS place, CASE place WHEN 0 THEN l_discount WHEN 1 THEN l_tax ELSE l_quantity END AS p FROM lineitem, (SELECT unnest([0, 1, 2]) AS place)")
def unnest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.unnest(_series(spark, sf_dir), "daily.tmin", "p", ["l_orderkey", "l_linenumber"], "place").select("l_orderkey", "l_linenumber", "place", "p")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'signup')")
def kind_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.keep_kinds(_read(spark, sf_dir, "events"), ("click", "signup"), "event_type").select("event_id", "event_type")


AS_OF = datetime.date(2024, 1, 20)


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"))


@query("SELECT event_id, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-13' AND DATE '2024-01-19'")
def lookback_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.lookback(_days(spark, sf_dir), "day", AS_OF, 7)


@query("SELECT event_id, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-20' AND DATE '2024-01-22'")
def horizon_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.horizon(_days(spark, sf_dir), "day", AS_OF, 3)


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1996-06-20'")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.date_range(_read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")), "day", datetime.date(1995, 3, 1), datetime.date(1996, 6, 20))


# Joins -----------------------------------------------------------------------


@query("""
    SELECT c_custkey, coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN 'own' END, CASE WHEN n_regionkey < 3 THEN n_name END, 'celsius') AS native_unit
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
""")
def unit_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _read(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("name"), F.col("n_name").alias("temperature_unit"))
    own = F.when(F.col("c_mktsegment") == "MACHINERY", "").when(F.col("c_mktsegment") == "BUILDING", "own")
    return joins.lookup_unit(_read(spark, sf_dir, "customer"), nation, own, "c_nationkey").select("c_custkey", "native_unit")


@query("""
    WITH g AS (SELECT s_name AS city, CAST(d AS DATE) AS day FROM supplier, generate_series(TIMESTAMP '2026-03-01', TIMESTAMP '2026-06-20', INTERVAL 1 DAY) AS t(d))
    SELECT city, day, 'highest-temperature-in-' || replace(lower(city), ' ', '-') || '-on-' || lower(monthname(day)) || '-' || day(day) || '-' || year(day) AS slug FROM g
""")
def market_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.market_grid(_read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")), datetime.date(2026, 3, 1), datetime.date(2026, 6, 20))


@query("""
    WITH l AS (SELECT o_orderkey, CASE WHEN o_orderpriority <> '1-URGENT' THEN epoch_us(o_orderdate) // 1000000 END AS opened, epoch_us(o_orderdate) // 1000000 + 2592000 AS ended FROM orders),
         p AS (SELECT l_orderkey, epoch_us(l_shipdate) // 1000000 AS t, l_quantity FROM lineitem)
    SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS quantity FROM p JOIN l ON l_orderkey = o_orderkey
    WHERE opened IS NULL OR ended IS NULL OR t BETWEEN opened - 3600 AND ended + 3600 GROUP BY 1
""")
def trading_life_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = S.epoch_seconds(F.col("o_orderdate"))
    lives = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderpriority") != "1-URGENT", opened).alias("opened"), (opened + 30 * 86400).alias("ended"))
    points = _read(spark, sf_dir, "lineitem").select("l_orderkey", S.epoch_seconds(F.col("l_shipdate")).alias("t"), "l_quantity")
    return joins.within_life(points, lives, "l_orderkey", "t", "opened", "ended").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("""
    WITH d AS (SELECT l_orderkey AS o_orderkey, max(l_linestatus) AS o_orderstatus, max(CASE WHEN l_quantity > 45 THEN l_extendedprice END) AS o_totalprice FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT o.o_orderkey, CASE WHEN d.o_orderkey IS NULL THEN o.o_orderstatus ELSE d.o_orderstatus END AS o_orderstatus, CASE WHEN d.o_orderkey IS NULL THEN o.o_totalprice ELSE d.o_totalprice END AS o_totalprice
    FROM orders o LEFT JOIN d ON o.o_orderkey = d.o_orderkey
""")
def detail_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detail's null stays null, it is not filled from the order."""
    price = F.when(F.col("l_quantity") > 45, F.col("l_extendedprice"))
    detail = _read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("o_orderstatus"), F.max(price).alias("o_totalprice"))
    return joins.with_fallback(_read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), detail, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("""
    SELECT p_brand AS slug, min(p_partkey) AS position FROM part
    WHERE contains(lower(coalesce(p_name, '')), 'ring') AND NOT coalesce(p_size > 40, FALSE) GROUP BY 1
""")
def event_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part").select(F.col("p_brand").alias("slug"), F.col("p_partkey").alias("position"), F.col("p_name").alias("title"), (F.col("p_size") > 40).alias("closed"))
    found = rows.keep_open(discovery.matching(part, F.col("title"), F.lit("ring")))
    return dedup.keep_first(found, ["slug"], [F.col("position")]).select("slug", "position")


@query("""
    SELECT user_id, max(value) FILTER (WHERE event_type = 'click') AS click, max(value) FILTER (WHERE event_type = 'error') AS error, max(value) FILTER (WHERE event_type = 'purchase') AS purchase
    FROM events GROUP BY 1
""")
def quote_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.pivot_parts(_read(spark, sf_dir, "events"), ["user_id"], "event_type", "value", ["click", "error", "purchase"], F.max)


@query("""
    WITH t AS (SELECT user_id, event_type, CAST(max(event_id) AS VARCHAR) AS v FROM events GROUP BY ALL)
    SELECT user_id, string_agg(event_type || '=' || v, ',' ORDER BY event_type) AS quotes FROM t GROUP BY 1
""")
def quote_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("event_id").cast("string").alias("v"))
    mapped = nested.map_by_key(parts, ["user_id"], "event_type", F.col("v"), "quotes")
    text = F.transform(F.array_sort(F.map_entries("quotes")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return mapped.select("user_id", F.array_join(text, ",").alias("quotes"))


# Nested documents, landing ---------------------------------------------------


@query("SELECT event_id, event_type AS kind, strftime(ts, '%Y-%m-%d') AS fetched, props AS body FROM events")
def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = landing.envelope(_read(spark, sf_dir, "events"), {"source": F.lit("events"), "kind": F.col("event_type"), "event_id": F.col("event_id"), "fetched_at_utc": F.date_format("ts", "yyyy-MM-dd")}, "props")
    return wrapped.select("_meta.event_id", "_meta.kind", F.col("_meta.fetched_at_utc").alias("fetched"), "body")


@query("SELECT 'events-' || event_type AS source, CAST(ts AS DATE) AS ingest_date, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY ALL")
def raw_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    wrapped = landing.envelope(_read(spark, sf_dir, "events"), {"source": F.concat(F.lit("events-"), F.col("event_type")), "event_id": F.col("event_id"), "fetched_at_utc": stamp}, "props")
    return landing.landed(wrapped).groupBy("source", "ingest_date").agg(F.count("*").alias("n"), F.min("_meta.event_id").alias("first_id"), F.max("_meta.event_id").alias("last_id"))


@query("SELECT event_id, epoch_us(ts) AS us, CAST(ts AS DATE) AS target_date FROM events")
def iso_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = _read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("iso"))
    return iso.select("event_id", F.unix_micros(S.iso_timestamp(F.col("iso"))).alias("us"), S.target_date(F.col("iso")).alias("target_date"))


@query("SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS seconds, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour FROM events")
def epoch_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = S.epoch_seconds(F.col("ts"))
    back = S.epoch_timestamp(seconds)
    return _read(spark, sf_dir, "events").select("event_id", S.epoch_seconds(back).alias("seconds"), F.date_format(S.hour(back), "yyyy-MM-dd HH").alias("hour"))


# Raw zone, facts and mart as a whole -----------------------------------------

CITY_NAMES = [c[0] for c in readers.DEFAULT_CITIES]


def _named_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a city by name, k of their properties, and an ISO time."""
    city = F.get(F.array(*map(F.lit, CITY_NAMES)), F.pmod("user_id", F.lit(4)).cast("int"))
    return _with_k(_read(spark, sf_dir, "events")).select("event_id", "event_type", "value", city.alias("city"), "k", "ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("iso"))


def _label():
    k = F.col("k").cast("string")
    kind = F.col("event_type")
    return (
        F.when(kind == "click", F.concat(k, F.lit("°C or below")))
        .when(kind == "error", F.concat(k, F.lit("°F or higher")))
        .when(kind == "purchase", F.concat(k, F.lit("-"), (F.col("k") + 1).cast("string"), F.lit("°F")))
        .when((kind == "view") & (F.col("k") < 10), F.lit(None).cast("string"))
        .when((kind == "view") & (F.col("k") < 20), "n/a")
        .otherwise(F.concat(k, F.lit("°C")))
    )


def raw_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market snapshots: events of a k divisible by 3, one each, with one event of one market, or of two if clicked."""
    price = F.concat(F.lit('["'), (F.col("value") / F.lit(500.0)).cast("string"), F.lit('","0.5"]'))
    signup, k = F.col("event_type") == "signup", F.col("k")
    prices = F.when(signup & (k < 10), F.lit(None).cast("string")).when(signup & (k < 20), "").when(signup & (k < 30), "[]").when(signup & (k < 40), '["broken').when(signup & (k < 50), '["x","y"]').otherwise(price)
    market = lambda title, p: F.struct(title.alias("groupItemTitle"), p.alias("outcomePrices"))
    first, second = market(_label(), prices), market(F.concat((k + 2).cast("string"), F.lit("°C")), F.lit('["0.125"]'))
    markets = F.when(F.col("event_type") == "click", F.array(first, second)).otherwise(F.array(first))
    ends = F.when((F.col("event_type") != "error") | (k >= 6), F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T12:00:00Z")))
    event = F.struct(F.concat(F.lit("s"), F.col("event_id")).alias("slug"), ends.alias("endDate"), markets.alias("markets"))
    none = F.array().cast("array<struct<slug:string,endDate:string,markets:array<struct<groupItemTitle:string,outcomePrices:string>>>>")
    meta = F.struct(F.lit("markets").alias("source"), "city", F.col("iso").alias("fetched_at_utc"))
    return _named_events(spark, sf_dir).where(source_of(k) == "live").select(meta.alias("_meta"), F.when(F.col("event_type") == "view", F.array(event)).when(k > 97, none).otherwise(F.array(event)).alias("gamma_events"))


def raw_market_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History documents: the other events, one each, with one market of one bucket of one price point, or of two if clicked."""
    k = F.col("k")
    point = lambda more, p: F.struct((F.unix_seconds(F.col("ts").cast("timestamp")) + more).alias("t"), p.alias("p"))
    p = F.when(k < 96, F.col("value") / F.lit(500.0))
    points = F.when(F.col("event_type") == "click", F.array(point(0, p), point(3600, p / 2))).otherwise(F.array(point(0, p)))
    bucket = F.struct(_label().alias("bucket"), points.alias("history"))
    won = F.when(F.col("event_type") == "purchase", _label()).when(F.col("event_type") == "error", "").when((F.col("event_type") == "view") & (k < 30), "none")
    market = F.struct(F.when(k != 4, F.date_format("ts", "yyyy-MM-dd")).alias("date"), won.alias("resolved_bucket"), F.array(bucket).alias("buckets"))
    return _named_events(spark, sf_dir).where(source_of(k) == "backfill").select("city", F.array(market).alias("markets"))


def _daily(short):
    """Two days of a value; the second may be null, and the series may be too short by one."""
    days = F.array(*(F.date_format(F.date_add("ts", i), "yyyy-MM-dd") for i in range(2)))
    top = F.array("value", F.when(F.col("k") >= 10, F.col("value") + 1))
    return F.struct(F.struct(days.alias("time"), F.when(short, F.slice(top, 1, 1)).otherwise(top).alias("temperature_2m_max"), F.array(F.col("value") - 5, F.col("value") - 4).alias("temperature_2m_min")).alias("daily"))


def raw_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather snapshots: signups are forecasts, errors archives, views forecasts made for the past."""
    kind = F.when(F.col("event_type") == "signup", "weather-forecast").when(F.col("event_type") == "error", "weather-archive").otherwise("weather-historical-forecast")
    unit = F.when(F.col("k") < 30, F.lit(None).cast("string")).when(F.col("k") < 60, "").when(F.col("k") < 80, "celsius").otherwise("fahrenheit")
    city = F.when(F.col("k") != 50, F.col("city"))
    meta = F.struct(F.lit("weather").alias("source"), kind.alias("kind"), city.alias("city"), unit.alias("temperature_unit"), F.col("iso").alias("fetched_at_utc"))
    return _named_events(spark, sf_dir).where("event_type in ('signup', 'error', 'view')").select(meta.alias("_meta"), _daily(F.col("k").between(90, 93)).alias("response"))


def raw_weather_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather history documents: purchases, either section absent for some."""
    events = _named_events(spark, sf_dir).where("event_type = 'purchase'")
    unit = F.when(F.col("city") == "NYC", "fahrenheit").otherwise("celsius")
    return events.select("city", unit.alias("temperature_unit"), F.when(F.col("k") >= 20, _daily(F.col("k") == 33)).alias("historical_forecast"), F.when(F.col("k") < 80, _daily(F.col("k") == 34)).alias("archive_actuals"))


_CITY_SQL = "CASE user_id % 4 WHEN 0 THEN 'Munich' WHEN 1 THEN 'London' WHEN 2 THEN 'NYC' ELSE 'Tokyo' END"
RAW = f"""
    e AS (
        SELECT event_id, event_type, value, ts, {_CITY_SQL} AS city, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
               CASE WHEN user_id % 4 = 2 THEN 'fahrenheit' ELSE 'celsius' END AS native_unit FROM events
    ), el AS (
        SELECT *, k % 3 = 0 AS live, value / 500.0 AS p,
               CASE event_type WHEN 'click' THEN k || '°C or below' WHEN 'error' THEN k || '°F or higher' WHEN 'purchase' THEN k || '-' || (k + 1) || '°F'
                    WHEN 'view' THEN CASE WHEN k < 10 THEN NULL WHEN k < 20 THEN 'n/a' ELSE k || '°C' END ELSE k || '°C' END AS label
        FROM e
    )
"""
RAW_PRICES = f"""
    {RAW}, raw_prices AS (
        SELECT city, CASE WHEN event_type <> 'error' OR k >= 6 THEN CAST(ts AS DATE) END AS target_date, ts AS snapshot_ts, 'live' AS source, native_unit, label AS bucket_label,
               CASE WHEN event_type = 'signup' AND k < 50 THEN NULL ELSE p END AS yes_price
        FROM el WHERE live AND NOT (event_type = 'signup' AND k < 30) AND (k <= 97 OR event_type = 'view')
        UNION ALL
        SELECT city, CAST(ts AS DATE), ts, 'live', native_unit, (k + 2) || '°C', 0.125 FROM el WHERE live AND event_type = 'click' AND k <= 97
        UNION ALL
        SELECT city, CASE WHEN k <> 4 THEN CAST(ts AS DATE) END, date_trunc('second', ts), 'backfill', native_unit, label, CASE WHEN k < 96 THEN p END FROM el WHERE NOT live
        UNION ALL
        SELECT city, CASE WHEN k <> 4 THEN CAST(ts AS DATE) END, date_trunc('second', ts) + INTERVAL 1 HOUR, 'backfill', native_unit, label, CASE WHEN k < 96 THEN p / 2 END FROM el WHERE NOT live AND event_type = 'click'
    ), judged_prices AS (
        SELECT *, CASE WHEN yes_price IS NULL THEN 'price is no number' WHEN bucket_label IS NULL OR bucket_label = 'n/a' THEN 'label without a number' WHEN target_date IS NULL THEN 'no target date' END AS reason FROM raw_prices
    ), first_prices AS (
        SELECT *, row_number() OVER (PARTITION BY city, target_date, bucket_label, date_trunc('hour', snapshot_ts) ORDER BY source, snapshot_ts, yes_price DESC) AS n FROM judged_prices WHERE reason IS NULL
    ), split_labels AS (
        SELECT *, CAST(regexp_extract(bucket_label, '([0-9]+)', 1) AS INTEGER) AS a, TRY_CAST(regexp_extract(bucket_label, '-([0-9]+)', 1) AS INTEGER) AS b,
               CASE WHEN contains(bucket_label, 'below') THEN 'below' WHEN contains(bucket_label, 'higher') THEN 'above' WHEN contains(bucket_label, '-') THEN 'range' ELSE 'exact' END AS bucket_kind
        FROM first_prices WHERE n = 1
    ), bounds AS (
        SELECT *, CASE WHEN bucket_kind <> 'below' THEN CAST(a AS DOUBLE) END AS low, CASE WHEN bucket_kind = 'range' THEN CAST(b AS DOUBLE) WHEN bucket_kind <> 'above' THEN CAST(a AS DOUBLE) END AS high,
               CASE WHEN bucket_kind = 'range' THEN (a + b) / 2.0 ELSE CAST(a AS DOUBLE) END AS mid, epoch_us(CAST(target_date AS TIMESTAMP)) + 43200000000 - epoch_us(snapshot_ts) AS us
        FROM split_labels
    ), fact_price AS (
        SELECT city, target_date, snapshot_ts, source, native_unit, bucket_label, bucket_kind, CASE WHEN native_unit = 'fahrenheit' THEN round((low - 32) * 5.0 / 9.0, 2) ELSE low END AS bucket_low_c,
               CASE WHEN native_unit = 'fahrenheit' THEN round((high - 32) * 5.0 / 9.0, 2) ELSE high END AS bucket_high_c, CASE WHEN native_unit = 'fahrenheit' THEN round((mid - 32) * 5.0 / 9.0, 2) ELSE mid END AS bucket_mid_c,
               yes_price, sign(us) * floor((abs(us) + 18000000) / 36000000) / 100.0 AS hours_to_close
        FROM bounds
    )
"""
RAW_DAYS = f"""
    {RAW}, days AS (
        SELECT CASE WHEN event_type = 'purchase' OR k <> 50 THEN city END AS city, CAST(ts AS DATE) + i AS target_date, CASE WHEN event_type <> 'purchase' THEN ts END AS fetched,
               CASE WHEN event_type = 'purchase' THEN 'backfill' ELSE 'live' END AS source, event_type, k,
               CASE WHEN event_type = 'purchase' THEN native_unit WHEN k < 60 THEN CASE WHEN k = 50 THEN 'celsius' ELSE native_unit END WHEN k < 80 THEN 'celsius' ELSE 'fahrenheit' END AS native_unit,
               CASE WHEN i = 0 THEN value WHEN k >= 10 THEN value + 1 END AS top, value - 5 + i AS low
        FROM el, (SELECT unnest([0, 1]) AS i)
    ), judged_days AS (
        SELECT *, CASE WHEN event_type = 'purchase' AND k = 33 OR event_type <> 'purchase' AND k BETWEEN 90 AND 93 THEN 'series of unequal length' WHEN city IS NULL THEN 'no city' END AS reason
        FROM days WHERE event_type = 'signup' OR event_type = 'purchase' AND k >= 20
    ), fact_forecast AS (
        SELECT city, target_date, fetched AS forecast_ts, source, native_unit, top AS forecast_max_native, low AS forecast_min_native, CASE WHEN native_unit = 'fahrenheit' THEN round((top - 32) * 5.0 / 9.0, 2) ELSE top END AS forecast_max_c,
               CASE WHEN native_unit = 'fahrenheit' THEN round((low - 32) * 5.0 / 9.0, 2) ELSE low END AS forecast_min_c
        FROM judged_days WHERE reason IS NULL
    ), judged_actuals AS (
        SELECT *, CASE WHEN event_type = 'purchase' AND k = 34 OR event_type <> 'purchase' AND k BETWEEN 90 AND 93 THEN 'series of unequal length' WHEN city IS NULL THEN 'no city' END AS reason
        FROM days WHERE event_type = 'error' OR event_type = 'purchase' AND k < 80
    ), raw_actuals AS (
        SELECT city, target_date, fetched, source, CASE WHEN native_unit = 'fahrenheit' THEN round((top - 32) * 5.0 / 9.0, 2) ELSE top END AS era5_actual_max_c FROM judged_actuals WHERE reason IS NULL
    ), actuals AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city, target_date ORDER BY CASE source WHEN 'live' THEN 0 ELSE 1 END, fetched NULLS LAST, era5_actual_max_c) AS n FROM raw_actuals WHERE era5_actual_max_c IS NOT NULL) WHERE n = 1
    ), judged_won AS (
        SELECT city, CASE WHEN k <> 4 THEN CAST(ts AS DATE) END AS target_date, native_unit, k, CASE WHEN event_type = 'purchase' THEN label ELSE 'none' END AS resolved_bucket,
               CASE WHEN event_type = 'view' THEN 'label without a number' WHEN k = 4 THEN 'no target date' END AS reason
        FROM el WHERE NOT live AND (event_type = 'purchase' OR event_type = 'view' AND k < 30)
    ), won AS (
        SELECT *, CASE WHEN native_unit = 'fahrenheit' THEN round((k - 32) * 5.0 / 9.0, 2) ELSE k END AS low, CASE WHEN native_unit = 'fahrenheit' THEN round((k + 1 - 32) * 5.0 / 9.0, 2) ELSE k + 1 END AS high,
               CASE WHEN native_unit = 'fahrenheit' THEN round((k + 0.5 - 32) * 5.0 / 9.0, 2) ELSE k + 0.5 END AS mid
        FROM (SELECT *, row_number() OVER (PARTITION BY city, target_date ORDER BY resolved_bucket) AS n FROM judged_won WHERE reason IS NULL) WHERE n = 1
    ), dim_outcome AS (
        SELECT coalesce(w.city, a.city) AS city, coalesce(w.target_date, a.target_date) AS target_date, resolved_bucket, CAST(mid AS DOUBLE) AS resolved_mid_c, CAST(low AS DOUBLE) AS resolved_low_c, CAST(high AS DOUBLE) AS resolved_high_c, era5_actual_max_c
        FROM won w FULL OUTER JOIN actuals a ON w.city = a.city AND w.target_date = a.target_date
    )
"""


def _cities(spark: SparkSession) -> DataFrame:
    return readers.cities(spark)


@query(f"WITH {RAW_PRICES} SELECT * FROM fact_price")
def fact_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.fact_price(raw_markets(spark, sf_dir), raw_market_history(spark, sf_dir), _cities(spark))


@query(f"WITH {RAW_PRICES} SELECT city, target_date, source, bucket_label, reason, count(*) AS n FROM judged_prices WHERE reason IS NOT NULL GROUP BY ALL")
def bad_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = facts.split_prices(raw_markets(spark, sf_dir), raw_market_history(spark, sf_dir), _cities(spark))
    return bad.groupBy("city", "target_date", "source", "bucket_label", "reason").agg(F.count("*").alias("n"))


@query(f"WITH {RAW_DAYS} SELECT * FROM fact_forecast")
def fact_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.fact_forecast(raw_weather(spark, sf_dir), raw_weather_history(spark, sf_dir), _cities(spark))


@query(f"""
    WITH {RAW_DAYS}
    SELECT city, source, reason, CASE reason WHEN 'no city' THEN n ELSE n // 2 END AS n FROM (SELECT city, source, reason, count(*) AS n FROM judged_days WHERE reason IS NOT NULL GROUP BY ALL)
""")
def bad_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record whose series differ in length is one bad row, not one a day."""
    _, bad = facts.split_forecasts(raw_weather(spark, sf_dir), raw_weather_history(spark, sf_dir), _cities(spark))
    return bad.groupBy("city", "source", "reason").agg(F.count("*").alias("n"))


@query(f"WITH {RAW_DAYS} SELECT * FROM dim_outcome")
def dim_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.dim_outcome(raw_market_history(spark, sf_dir), raw_weather(spark, sf_dir), raw_weather_history(spark, sf_dir), _cities(spark))


@query(f"""
    WITH {RAW_DAYS}, bad AS (
        SELECT city, 'resolved' AS part, reason, count(*) AS n FROM judged_won WHERE reason IS NOT NULL GROUP BY ALL
        UNION ALL SELECT city, 'actual', reason, CASE reason WHEN 'no city' THEN n ELSE n // 2 END FROM (SELECT city, reason, count(*) AS n FROM judged_actuals WHERE reason IS NOT NULL GROUP BY ALL)
    )
    SELECT * FROM bad
""")
def bad_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = facts.split_outcomes(raw_market_history(spark, sf_dir), raw_weather(spark, sf_dir), raw_weather_history(spark, sf_dir), _cities(spark))
    return bad.groupBy("city", "part", "reason").agg(F.count("*").alias("n"))


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    markets, past, weather, weather_past, cities = raw_markets(spark, sf_dir), raw_market_history(spark, sf_dir), raw_weather(spark, sf_dir), raw_weather_history(spark, sf_dir), _cities(spark)
    made = {"fact_price": facts.fact_price(markets, past, cities), "fact_forecast": facts.fact_forecast(weather, weather_past, cities), "dim_outcome": facts.dim_outcome(past, weather, weather_past, cities)}
    return facts.rebuild_tables(made, scratch_folder(spark, "tables"))


@query(f"""
    WITH {RAW_PRICES}, {RAW_DAYS.replace(RAW + ",", "", 1)}, mode AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city, target_date ORDER BY hours_to_close, yes_price DESC NULLS LAST, bucket_mid_c NULLS LAST, bucket_label NULLS LAST) AS n FROM fact_price WHERE hours_to_close >= 0) WHERE n = 1
    ), latest AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city, target_date ORDER BY forecast_ts DESC NULLS LAST, source, forecast_max_c NULLS LAST) AS n FROM fact_forecast) WHERE n = 1
    ), mart AS (
        SELECT o.city, m.bucket_mid_c AS market_mode_c, l.forecast_max_c, o.resolved_mid_c AS actual_station_c FROM dim_outcome o LEFT JOIN mode m USING (city, target_date) LEFT JOIN latest l USING (city, target_date)
    )
    SELECT city, CAST(round(CAST(avg(abs(market_mode_c - actual_station_c)) AS DECIMAL(28, 10)), 2) AS DOUBLE) AS market_mae_c, CAST(round(CAST(avg(abs(forecast_max_c - actual_station_c)) AS DECIMAL(28, 10)), 2) AS DOUBLE) AS forecast_mae_c
    FROM mart WHERE market_mode_c IS NOT NULL GROUP BY city
""")
def mart_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables built from raw rows and stored, the view over them, and SQL over the view."""
    stored = _tables(spark, sf_dir)
    mart.register_mart(mart.mart(stored["dim_outcome"], stored["fact_price"], stored["fact_forecast"]), f"{mart.VIEW}_stored")
    return spark.sql(mart.city_errors_sql(f"{mart.VIEW}_stored"))


@query(f"""
    WITH {RAW_PRICES}, {RAW_DAYS.replace(RAW + ",", "", 1)}
    SELECT 'fact_price' AS "table", count(*) AS n FROM fact_price UNION ALL SELECT 'fact_forecast', count(*) FROM fact_forecast UNION ALL SELECT 'dim_outcome', count(*) FROM dim_outcome
""")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.table_counts(_tables(spark, sf_dir))


@query(f"""
    WITH {RAW}, m AS (
        SELECT city, sum(CASE WHEN k <= 97 OR event_type = 'view' THEN 1 ELSE 0 END) AS n_events, sum(CASE WHEN event_type = 'click' AND k <= 97 THEN 2 WHEN k <= 97 OR event_type = 'view' THEN 1 ELSE 0 END) AS n_markets FROM el WHERE live GROUP BY 1
    ), h AS (
        SELECT city, count(*) AS n_history, count(*) AS n_buckets, sum(CASE WHEN event_type = 'click' THEN 2 ELSE 1 END) AS n_points FROM el WHERE NOT live GROUP BY 1
    ), w AS (
        SELECT city, 2 * count(*) AS n_days FROM el WHERE event_type IN ('signup', 'error', 'view') AND k <> 50 GROUP BY 1
    )
    SELECT city, CAST(n_events AS BIGINT) AS n_events, CAST(n_markets AS BIGINT) AS n_markets, n_history, n_buckets, CAST(n_points AS BIGINT) AS n_points, n_days FROM m JOIN h USING (city) JOIN w USING (city)
""")
def volume_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and markets of snapshots, markets, buckets and points of history, days of weather responses."""
    past = history.document_counts(raw_market_history(spark, sf_dir)).withColumnRenamed("n_markets", "n_history")
    days = history.response_days(raw_weather(spark, sf_dir)).groupBy("city").agg(F.sum("n_days").alias("n_days"))
    return history.snapshot_counts(raw_markets(spark, sf_dir)).join(past, "city").join(days, "city")


# Files: readers, landing, streams ---------------------------------------------


def _as_json(df: DataFrame, name: str) -> str:
    path = f"{scratch_folder(df.sparkSession, name)}"
    df.write.json(path)
    return path


@query(f"""
    WITH {RAW_DAYS}, f AS (SELECT *, row_number() OVER () AS i FROM days WHERE event_type IN ('signup', 'error', 'view') AND NOT k BETWEEN 90 AND 93)
    SELECT CASE event_type WHEN 'signup' THEN 'weather-forecast' WHEN 'error' THEN 'weather-archive' ELSE 'weather-historical-forecast' END AS kind, city, CAST(count(*) AS BIGINT) AS n, count(top) AS n_max, round(sum(low), 4) AS total FROM f GROUP BY ALL
    UNION ALL SELECT 'corrupt', NULL, 1, 0, NULL
""")
def scan_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather lines written as files and read again with one broken line, which the quarantine takes."""
    path = _as_json(raw_weather(spark, sf_dir), "weather")
    spark.createDataFrame([('{"_meta": {"city": ',)], "value string").write.mode("append").text(path)
    good, bad = readers.split_quarantine(readers.read_weather(spark, path), {"corrupt": readers.corrupt_line(), "series": readers.unequal_lengths(F.col("response.daily.time"), F.col("response.daily.temperature_2m_max"))})
    days = rows.zip_daily(good, {"day": "response.daily.time", "top": "response.daily.temperature_2m_max", "low": "response.daily.temperature_2m_min"}, ["_meta.kind", "_meta.city"])
    counted = days.groupBy("kind", "city").agg(F.count("*").alias("n"), F.count("top").alias("n_max"), F.round(F.sum("low"), 4).alias("total"))
    broken = bad.where("reason = 'corrupt'").select(F.lit("corrupt").alias("kind"), F.lit(None).cast("string").alias("city"), F.col("_corrupt_record")).groupBy("kind", "city").agg(F.count("_corrupt_record").alias("n"))
    return counted.unionByName(broken.withColumns({"n_max": F.lit(0).cast("long"), "total": F.lit(None).cast("double")}))


@query(f"WITH {RAW_PRICES} SELECT city, bucket_label, count(*) AS n, max(snapshot_ts) AS last FROM raw_prices WHERE source = 'live' GROUP BY ALL")
def scan_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readers.read_markets(spark, _as_json(raw_markets(spark, sf_dir), "markets"))
    return facts.live_prices(found, _cities(spark)).groupBy("city", "bucket_label").agg(F.count("*").alias("n"), F.max("snapshot_ts").alias("last"))


@query("SELECT n_name AS city, count(DISTINCT s_suppkey) AS n, sum(s_acctbal) AS total FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def scan_market_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as cities with a market of one point for each supplier: written as documents, one file each, and read as whole files."""
    point = F.struct(F.col("s_suppkey").alias("t"), F.col("s_acctbal").alias("p"))
    market = F.struct(F.col("s_name").alias("slug"), F.array(F.struct(F.lit("20°C").alias("bucket"), F.array(point).alias("history"))).alias("buckets"))
    named = _read(spark, sf_dir, "supplier").join(_read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    docs = named.groupBy(F.col("n_name").alias("city")).agg(F.array_sort(F.collect_list(market)).alias("markets"))
    path = scratch_folder(spark, "history")
    history.write_documents(docs, path)
    prices = facts.backfill_prices(readers.read_market_history(spark, path), _cities(spark))
    return prices.groupBy("city").agg(F.count("*").alias("n"), F.sum("yes_price").alias("total"))


@query("""
    WITH d AS (SELECT n_name AS city, s_acctbal AS v, CASE WHEN n_regionkey > 0 THEN 1 END AS f, CASE WHEN n_regionkey < 3 THEN 1 END AS a FROM nation JOIN supplier ON s_nationkey = n_nationkey)
    SELECT city, count(f) AS forecast_days, count(a) AS archive_days, sum(CASE WHEN f = 1 THEN v END) AS total FROM d GROUP BY 1
""")
def scan_weather_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather documents of nations, either section absent for some regions: written one file each and read as whole files."""
    named = _read(spark, sf_dir, "supplier").join(_read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).withColumnRenamed("n_name", "city")
    series = F.array_sort(F.collect_list(F.struct("s_suppkey", "s_acctbal")))

    def part(kept: str) -> DataFrame:
        got = named.where(kept).groupBy("city").agg(series.alias("s"))
        days = F.struct(F.transform("s", lambda x: F.date_format(F.date_add(F.lit(AS_OF), x["s_suppkey"].cast("int")), "yyyy-MM-dd")).alias("time"), F.col("s.s_acctbal").alias("temperature_2m_max"), F.col("s.s_acctbal").alias("temperature_2m_min"))
        return got.select("city", F.struct(days.alias("daily")).alias("response"))

    units = _read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("").alias("station"), F.lit("celsius").alias("temperature_unit"))
    path = scratch_folder(spark, "weather-history")
    history.write_documents(history.weather_documents(part("n_regionkey > 0"), part("n_regionkey < 3"), units), path)
    found = readers.read_weather_history(spark, path)
    none = _empty_weather(spark)
    forecasts_ = facts.weather_days(none, found, _cities(spark), (), "historical_forecast")[0].groupBy("city").agg(F.count("*").alias("forecast_days"), F.sum("tmax").alias("total"))
    archives = facts.weather_days(none, found, _cities(spark), (), "archive_actuals")[0].groupBy("city").agg(F.count("*").alias("archive_days"))
    return joins.outer_merge(forecasts_, archives, ["city"]).select("city", F.coalesce("forecast_days", F.lit(0)).cast("long").alias("forecast_days"), F.coalesce("archive_days", F.lit(0)).cast("long").alias("archive_days"), "total")


def _empty_weather(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.RAW_WEATHER)


@query(f"SELECT {_CITY_SQL} AS city, CASE WHEN user_id % 4 = 2 THEN 'fahrenheit' ELSE 'celsius' END AS native_unit, count(*) AS n FROM events GROUP BY ALL")
def city_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default city table, by name, for every event."""
    found = joins.lookup_unit(_named_events(spark, sf_dir), _cities(spark))
    return found.groupBy("city", "native_unit").agg(F.count("*").alias("n"))


def _landing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _named_events(spark, sf_dir)
    return landing.envelope(events, {"source": F.concat(F.lit("events-"), F.col("event_type")), "event_id": F.col("event_id"), "fetched_at_utc": F.col("iso")}, "value")


_LANDED = "SELECT 'events-' || event_type AS source, CAST(ts AS DATE) AS ingest_date, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def _landed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("source", "ingest_date").agg(F.count("*").alias("n"), F.round(F.sum("body"), 4).alias("total"))


@query(_LANDED)
def batch_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark, "zone")
    landing.append_batch(_landing_records(spark, sf_dir), path)
    return _landed(spark, path)


@query(_LANDED)
def stream_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stream over files; a second run finds nothing new."""
    came, path, state = (scratch_folder(spark, x) for x in ("came", "zone", "state"))
    records = _landing_records(spark, sf_dir)
    records.write.parquet(came)
    for _ in range(2):
        landing.append_stream(spark.readStream.schema(records.schema).parquet(came), path, state).awaitTermination()
    return _landed(spark, path)


@query(f"""
    WITH {TICKS}, r AS (
        SELECT *, row_number() OVER (PARTITION BY city, target_date, bucket_label, date_trunc('hour', snapshot_ts)
            ORDER BY CASE source WHEN 'backfill' THEN 0 ELSE 1 END, snapshot_ts, yes_price DESC NULLS LAST) AS n FROM ticks
    )
    SELECT city, target_date, bucket_label, snapshot_ts, source, yes_price FROM r WHERE n = 1
""")
def incremental_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live rows land first and backfill later; after each the stream brings the table up to date."""
    rows_ = ticks(spark, sf_dir).select(F.col("city").cast("string").alias("city"), "bucket_label", F.col("snapshot_ts").cast("timestamp").alias("snapshot_ts"), "source", "yes_price", "native_unit", "target_date")
    raw, path, state = (scratch_folder(spark, x) for x in ("raw", "prices", "state"))
    for source in ("live", "backfill"):
        incremental.land(rows_.where(F.col("source") == source), raw)
        incremental.maintain(spark.readStream.schema(rows_.schema).parquet(raw), raw, path, state).awaitTermination()
    return spark.read.parquet(path).select(F.col("city").cast("long").alias("city"), "target_date", "bucket_label", "snapshot_ts", "source", "yes_price")


@query("""
    WITH f AS (SELECT o_orderstatus AS status, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, min(epoch_us(o_orderdate) // 1000000) AS first FROM orders GROUP BY ALL),
         l AS (SELECT status, month, CASE WHEN month <> DATE '1995-01-01' THEN first END AS opened, first + 864000 AS ended FROM f),
         p AS (SELECT l_linestatus AS status, epoch_us(l_shipdate) // 1000000 AS t, l_quantity FROM lineitem)
    SELECT status, month, count(*) AS n, sum(l_quantity) AS quantity FROM p JOIN l USING (status) WHERE opened IS NULL OR t BETWEEN opened - 3600 AND ended + 3600 GROUP BY ALL
""")
def hot_life_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two keys that hold all points between them, each with a life of ten days a month and one without a begin."""
    began = S.epoch_seconds(F.col("o_orderdate"))
    lives = _read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.trunc("o_orderdate", "month").alias("month")).agg(F.min(began).alias("first"))
    lives = lives.select("status", "month", F.when(F.col("month") != F.lit(datetime.date(1995, 1, 1)), F.col("first")).alias("opened"), (F.col("first") + 864000).alias("ended"))
    points = _read(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("status"), S.epoch_seconds(F.col("l_shipdate")).alias("t"), "l_quantity")
    return joins.within_life_in_bins(points, lives, "status", "t", "opened", "ended").groupBy("status", "month").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query(f"""
    WITH {TICKS}, r AS (SELECT CASE WHEN hours_to_close < 0 THEN 'after close' WHEN yes_price < 0.02 THEN 'low price' ELSE '' END AS reason FROM ticks)
    SELECT reason, count(*) AS n, count(*) AS observed FROM r GROUP BY 1
""")
def quarantine_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and bad ticks in one write, counted as they are written and again as they are read."""
    found = ticks(spark, sf_dir).select("event_id", "hours_to_close", "yes_price")
    good, bad, seen = readers.write_quarantine(found, {"after close": F.col("hours_to_close") < 0, "low price": F.col("yes_price") < 0.02}, scratch_folder(spark, "quarantine"))
    both = good.select(F.lit("").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return both.join(spark.createDataFrame([(k, n) for k, n in seen.items()], "reason string, observed long"), "reason")


QUERIES["merged_prices"], ORACLES["merged_prices"] = (lambda spark, sf_dir: merged_prices(spark, sf_dir)), ORACLES["incremental_prices"]


def merged_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table as base and deltas: live rows are added and compacted, backfill comes as a second delta, merged on reading."""
    rows_ = ticks(spark, sf_dir).select(F.col("city").cast("string").alias("city"), "bucket_label", F.col("snapshot_ts").cast("timestamp").alias("snapshot_ts"), "source", "yes_price", "native_unit", "target_date")
    table = merge_on_read.MergedTable(spark, scratch_folder(spark, "merged"), rows_.schema, ranges=8)
    for source in ("live", "backfill"):
        table.compact()
        table.upsert(rows_.where(F.col("source") == source), source, 0)
    return table.read().select(F.col("city").cast("long").alias("city"), "target_date", "bucket_label", "snapshot_ts", "source", "yes_price")


@query("SELECT 'events-' || event_type AS source, CAST(ts AS DATE) AS ingest_date, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def landing_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases land first, then all records, and all of them once more: each is there once."""
    path, records = scratch_folder(spark, "zone"), _landing_records(spark, sf_dir)
    for part in (records.where("_meta.source = 'events-purchase'"), records, records):
        landing.append_once(part, path)
    return _landed(spark, path)


@query("""
    SELECT n_name AS city, count(*) AS n, round(sum(l_discount), 4) AS total, count(DISTINCT o_orderkey) AS markets
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
""")
def large_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as cities with a market for each order: one large document each, written market by market and read by many tasks."""
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(S.epoch_seconds(F.col("l_shipdate")).alias("t"), F.col("l_discount").alias("p")).alias("point"))
    paths = lines.groupBy("l_orderkey").agg(F.collect_list("point").alias("history"))  # a few lines of an order
    named = _read(spark, sf_dir, "customer").join(_read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("city"))
    orders = _read(spark, sf_dir, "orders").join(paths, F.col("o_orderkey") == F.col("l_orderkey")).join(named, F.col("o_custkey") == F.col("c_custkey"))
    none = F.lit(None).cast("string")
    bucket = F.struct(F.lit('20°C {"or"} below').alias("bucket"), none.alias("yes_token"), F.lit(False).alias("resolved_yes"), "history")
    records = orders.select("city", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderkey").cast("string").alias("slug"), F.col("o_orderpriority").alias("title"), none.alias("endDate"), none.alias("conditionId"), none.alias("temperature_unit"), none.alias("resolved_bucket"), F.array(bucket).alias("buckets"))
    path, cities = scratch_folder(spark, "large-history"), _read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("").alias("station"), none.alias("temperature_unit"))
    history.write_market_documents(records, cities, HISTORY_START, HISTORY_END, path)
    found = readers.read_large_history(spark, path).select("city", "market_count", F.explode("markets").alias("m"))
    points = found.select("city", "m.slug", F.explode("m.buckets").alias("b")).select("city", "slug", F.explode("b.history").alias("h"))
    return points.groupBy("city").agg(F.count("*").alias("n"), F.round(F.sum("h.p"), 4).alias("total"), F.countDistinct("slug").alias("markets"))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as event bodies; closed ones have a fee, urgent ones a spread in their market, which nobody declared."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    market = F.struct(F.col("o_orderpriority").alias("groupItemTitle"), F.when(urgent, F.col("o_custkey")).alias("spread"))
    title = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("7")).otherwise(F.lit('"order "'))
    body = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("slug"), F.array(market).alias("markets"), F.when(F.col("o_orderstatus") == "F", F.struct(F.struct(F.col("o_custkey").alias("fee")).alias("costs"))).alias("extra")))
    body = F.concat(F.lit('{"title":'), title, F.lit(","), F.substr(body, F.lit(2)))
    orders = _read(spark, sf_dir, "orders").withColumn("payload", body)
    meta = {"source": F.concat(F.lit("orders-"), F.col("o_orderstatus")), "fetched_at_utc": F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-01-01T00:00:00Z")), "key": F.col("o_orderkey")}
    path = scratch_folder(spark, "verbatim")
    landing.append_batch(landing.verbatim(orders, meta, "payload"), path)
    return spark.read.parquet(path)


@query("""
    SELECT o_orderkey AS key, CASE WHEN o_orderpriority = '5-LOW' THEN '7' ELSE 'order ' END AS title, CAST(o_orderkey AS VARCHAR) AS slug,
           CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS fee, CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END AS spread FROM orders
""")
def verbatim_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies landed as they are: what no schema names is read back, too."""
    kept = _bodies(spark, sf_dir)
    field = lambda path, kind: F.try_variant_get("body", path, kind)
    return kept.select("_meta.key", field("$.title", "string").alias("title"), field("$.slug", "string").alias("slug"), field("$.extra.costs.fee", "bigint").alias("fee"), field("$.markets[0].spread", "bigint").alias("spread"))


@query("""
    WITH o AS (SELECT 'orders-' || o_orderstatus AS source, CAST(date_trunc('year', o_orderdate) AS DATE) AS ingest_date, * FROM orders)
    SELECT DISTINCT source, ingest_date, '$.extra' AS path, 'OBJECT' AS kind, 'undeclared' AS problem FROM o WHERE o_orderstatus = 'F'
    UNION SELECT source, ingest_date, '$.markets[*].spread', 'BIGINT', 'undeclared' FROM o WHERE o_orderpriority = '1-URGENT'
    UNION SELECT source, ingest_date, '$.title', CASE WHEN bool_and(o_orderpriority = '5-LOW') THEN 'BIGINT' ELSE 'VARIANT' END, 'other type' FROM o GROUP BY 1, 2 HAVING bool_or(o_orderpriority = '5-LOW')
""")
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a source's bodies of a day hold beyond, or unlike, the declared event."""
    return landing.drift(_bodies(spark, sf_dir), T.DataType.fromDDL(schemas.EVENT))


# Discovery and history as a whole ----------------------------------------------


DEALT = 25_000


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows by key, some ``DEALT`` to a task: one task may read a whole file of short rows, of which a query makes ones many times longer."""
    tasks = -(-df.count() // DEALT)
    return df.repartition(tasks, key) if tasks > 1 else df


def _searches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Search results of each customer, details of some segments, and quotes; the customers themselves."""
    customers = _dealt(_read(spark, sf_dir, "customer"), "c_custkey").withColumn("city", F.get(F.array(*map(F.lit, CITY_NAMES)), F.pmod("c_nationkey", F.lit(4)).cast("int")))
    key, segment = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    market = "struct<id:string,groupItemTitle:string,startDate:string,endDate:string,outcomePrices:string,outcomes:string,clobTokenIds:string>"

    def event(slug, title, closed, tokens):
        none = F.lit(None).cast("string")
        markets = F.array(*(F.struct(none.alias("id"), none.alias("groupItemTitle"), none.alias("startDate"), none.alias("endDate"), none.alias("outcomePrices"), none.alias("outcomes"), t.alias("clobTokenIds")) for t in tokens)).cast(f"array<{market}>")
        return F.struct(slug.alias("slug"), title.alias("title"), closed.alias("closed"), none.alias("startDate"), none.alias("endDate"), none.alias("conditionId"), markets.alias("markets"))

    slug = lambda x: F.concat(F.lit("s"), key, F.lit(x))
    token = lambda *x: F.concat(F.lit('["'), *x, F.lit('","n"]'))
    never, title = F.lit(None).cast("boolean"), F.concat(F.lit("Highest temperature in "), F.col("city"), F.lit(" today?"))
    searched = F.array(
        event(slug("a"), title, F.col("c_acctbal") < 0, [token(F.lit("t"), key, F.lit("a")), F.lit("")]),
        event(slug("a"), F.concat(F.lit("TEMPERATURE IN "), F.upper("city")), F.lit(False), []),
        event(slug("c"), F.lit(None).cast("string"), never, [token(key)]),
        event(slug("d"), F.concat(F.lit("temperature in "), F.lower("city")), never, [token(F.lit("t"), key, F.lit("d")), F.lit('["broken')]),
    )
    results = customers.select("city", F.concat(F.lit("f"), key).alias("fetched_at_utc"), searched.alias("events"))
    fresh = event(slug("d"), F.lit(None).cast("string"), F.lit(False), [token(F.lit("u"), key), token(F.lit("u"), key)])
    lone = event(slug("d"), F.lit("lone"), never, [])
    responses = customers.select(slug("d").alias("slug"), F.when(segment == "BUILDING", F.array(fresh)).alias("items"), F.when(segment == "MACHINERY", lone).alias("single"))
    part = lambda t, name, value: F.struct(t.alias("token_id"), F.lit(name).alias("key"), value.alias("value"))
    balance, new = F.col("c_acctbal").cast("string"), F.concat(F.lit("u"), key)
    parts = customers.select(F.inline(F.array(part(F.concat(F.lit("t"), key, F.lit("a")), "midpoint", balance), part(new, "midpoint", F.lit("1.5")), part(new, "price_buy", balance), part(new, "price_sell", F.lit("2.5")))))
    return customers, results, responses, parts


@query("""
    WITH c AS (SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'Munich' WHEN 1 THEN 'London' WHEN 2 THEN 'NYC' ELSE 'Tokyo' END AS city, c_mktsegment AS seg, c_acctbal AS bal FROM customer)
    SELECT city, 'f' || c_custkey AS fetched_at_utc, CAST(2 AS BIGINT) AS event_count,
           'a=' || 'Highest temperature in ' || city || ' today?' || ';d=' || CASE WHEN seg = 'BUILDING' THEN '-' WHEN seg = 'MACHINERY' THEN 'lone' ELSE 'temperature in ' || lower(city) END AS events,
           't' || c_custkey || 'a:' || CAST(bal AS VARCHAR) || '/-/-' ||
           CASE WHEN seg = 'BUILDING' THEN ';u' || c_custkey || ':1.5/' || CAST(bal AS VARCHAR) || '/2.5' WHEN seg = 'MACHINERY' THEN '' ELSE ';t' || c_custkey || 'd:-/-/-' END AS quotes
    FROM c
""")
def market_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results of each customer, details of some segments, quotes: discovered, completed, quoted and wrapped."""
    _, results, responses, parts = _searches(spark, sf_dir)
    made = discovery.market_snapshots(results, responses, parts)
    named = F.array_join(F.transform("gamma_events", lambda e: F.concat(F.right(e["slug"], F.lit(1)), F.lit("="), F.coalesce(e["title"], F.lit("-")))), ";")
    quoted = F.transform(F.array_sort(F.map_entries("clob_quotes")), lambda q: F.concat(q["key"], F.lit(":"), F.concat_ws("/", *(F.coalesce(q["value"][x], F.lit("-")) for x in discovery.QUOTE_PARTS))))
    return made.select("_meta.city", "_meta.fetched_at_utc", "_meta.event_count", named.alias("events"), F.array_join(quoted, ";").alias("quotes"))


@query("""
    WITH c AS (SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'Munich' WHEN 1 THEN 'London' WHEN 2 THEN 'NYC' ELSE 'Tokyo' END AS city, c_mktsegment AS seg, c_acctbal AS bal, CAST(c_nationkey AS VARCHAR) AS nation FROM customer)
    SELECT city, 'f' || c_custkey AS fetched_at_utc, 'public' AS access, CAST(2 AS BIGINT) AS event_count,
           'a=Highest temperature in ' || city || ' today?;d=' || CASE WHEN seg = 'BUILDING' THEN '-' WHEN seg = 'MACHINERY' THEN 'lone' ELSE 'temperature in ' || lower(city) END AS events,
           'search ' || nation || ';' || CASE WHEN seg IN ('BUILDING', 'MACHINERY') THEN 'detail ' ELSE 'search ' END || nation AS undeclared,
           't' || c_custkey || 'a:' || CAST(bal AS VARCHAR) || '/-/-' ||
           CASE WHEN seg = 'BUILDING' THEN ';u' || c_custkey || ':1.5/' || CAST(bal AS VARCHAR) || '/2.5' WHEN seg = 'MACHINERY' THEN '' ELSE ';t' || c_custkey || 'd:-/-/-' END AS quotes
    FROM c
""")
def verbatim_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same out of verbatim bodies, each event with a field that nobody declared, and with where the data came from."""
    customers, results, responses, parts = _searches(spark, sf_dir)
    nation = F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("fetched_at_utc"), F.col("c_nationkey").cast("string").alias("nation")
    noted = lambda e, where: F.struct(*(e[f] for f in ("slug", *discovery.EVENT_FIELDS)), F.struct(F.concat(F.lit(where), F.col("nation")).alias("note")).alias("more"))
    found = results.join(customers.select(*nation), "fetched_at_utc")
    found = found.select("city", "fetched_at_utc", F.parse_json(F.to_json(F.transform("events", lambda e: noted(e, "search ")))).alias("body"))
    details = responses.join(customers.select(F.concat(F.lit("s"), F.col("c_custkey").cast("string"), F.lit("d")).alias("slug"), nation[1]), "slug")
    body = F.coalesce(F.to_json(F.transform("items", lambda e: noted(e, "detail "))), F.to_json(F.when(F.col("single").isNotNull(), noted(F.col("single"), "detail "))))
    made = discovery.verbatim_snapshots(found, details.select("slug", F.parse_json(body).alias("body")), parts, {"access": F.lit("public"), "gamma_base": F.lit("g"), "clob_base": F.lit("c")})
    got = lambda e, path: F.coalesce(F.try_variant_get(e, path, "string"), F.lit("-"))
    named = F.array_join(F.transform("gamma_events", lambda e: F.concat(F.right(got(e, "$.slug"), F.lit(1)), F.lit("="), got(e, "$.title"))), ";")
    notes = F.array_join(F.transform("gamma_events", lambda e: got(e, "$.more.note")), ";")
    quoted = F.transform(F.array_sort(F.map_entries("clob_quotes")), lambda q: F.concat(q["key"], F.lit(":"), F.concat_ws("/", *(F.coalesce(q["value"][x], F.lit("-")) for x in discovery.QUOTE_PARTS))))
    return made.select("_meta.city", "_meta.fetched_at_utc", "_meta.access", "_meta.event_count", named.alias("events"), notes.alias("undeclared"), F.array_join(quoted, ";").alias("quotes"))


HISTORY_START, HISTORY_END = datetime.date(1995, 3, 1), datetime.date(1995, 3, 31)


@query("""
    WITH o AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS n FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1995-03-31') WHERE n = 1 AND o_orderstatus <> 'O'
    ), b AS (
        SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, i, o_orderpriority, epoch_us(o_orderdate) // 1000000 AS opened FROM o, (SELECT unnest([0, 1, 2]) AS i) WHERE NOT (i = 2 AND o_orderpriority = '1-URGENT')
    ), p AS (
        SELECT b.*, epoch_us(l_shipdate) // 1000000 AS t, l_discount AS p FROM b LEFT JOIN lineitem l ON l.l_orderkey = o_orderkey AND l_linenumber % 3 = i
            AND (o_orderpriority = '4-NOT SPECIFIED' OR epoch_us(l_shipdate) // 1000000 BETWEEN opened - 3600 AND opened + 60 * 86400 + 3600)
    ), bk AS (
        SELECT o_custkey, o_orderkey, day, i, o_orderpriority, (20 + i) || '=' || 't' || o_orderkey || '-' || i || '[' || coalesce(string_agg(t || '@' || CAST(p AS VARCHAR), ',' ORDER BY t, p), '') || ']' AS txt FROM p GROUP BY o_custkey, o_orderkey, day, i, o_orderpriority
    ), mk AS (
        SELECT o_custkey, day, strftime(day, '%Y-%m-%d') || '|' || CASE o_orderpriority WHEN '2-HIGH' THEN '20' WHEN '3-MEDIUM' THEN '21' WHEN '5-LOW' THEN '22' ELSE '-' END || '|' || string_agg(txt, ';' ORDER BY i) AS txt FROM bk GROUP BY o_custkey, o_orderkey, day, o_orderpriority
    )
    SELECT c_name AS city, '1995-03-01/1995-03-31' AS "window", count(mk.day) AS market_count, coalesce(string_agg(mk.txt, '#' ORDER BY mk.day), '') AS markets FROM customer LEFT JOIN mk ON o_custkey = c_custkey GROUP BY 1
""")
def history_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cities, orders that are not open as closed events of three buckets, line items as price points."""
    days = rows.date_range(_read(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate")), "day", HISTORY_START, HISTORY_END)
    orders = dedup.keep_first(days, ["o_custkey", "day"], [F.col("o_orderkey")])
    key, priority = F.col("o_orderkey").cast("string"), F.col("o_orderpriority")
    iso = lambda d: F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    winners = {0: ["2-HIGH", "5-LOW"], 1: ["3-MEDIUM"], 2: ["5-LOW"]}

    def market(i: int):
        token = F.concat(F.lit('["t'), key, F.lit(f'-{i}","n"]'))
        price = F.when(priority.isin(winners[i]), '["0.995"]').when(priority == "4-NOT SPECIFIED", "").otherwise('["0.01"]')
        starts = F.when(priority == "4-NOT SPECIFIED", "")
        none = F.lit(None).cast("string")
        return F.struct(none.alias("id"), F.lit(str(20 + i)).alias("groupItemTitle"), starts.alias("startDate"), iso(F.col("o_orderdate") + F.expr("interval 60 days")).alias("endDate"), price.alias("outcomePrices"), none.alias("outcomes"), (F.when(priority != "1-URGENT", token) if i == 2 else token).alias("clobTokenIds"))

    slug = S.market_slug(F.format_string("Customer#%09d", "o_custkey"), F.col("day"))
    starts = F.when(priority != "4-NOT SPECIFIED", iso(F.col("o_orderdate")))
    none = F.lit(None).cast("string")
    event = F.struct(slug.alias("slug"), none.alias("title"), (F.col("o_orderstatus") != "O").alias("closed"), starts.alias("startDate"), none.alias("endDate"), none.alias("conditionId"), F.array(*(market(i) for i in range(3))).alias("markets"))
    single = priority.isin("1-URGENT", "2-HIGH")
    responses = orders.select(slug.alias("slug"), F.when(~single, F.array(event)).alias("items"), F.when(single, event).alias("single"))
    token = F.concat(F.lit("t"), F.col("l_orderkey").cast("string"), F.lit("-"), (F.col("l_linenumber") % 3).cast("string"))
    points = _read(spark, sf_dir, "lineitem").select(token.alias("token_id"), S.epoch_seconds(F.col("l_shipdate")).alias("t"), F.col("l_discount").alias("p"))
    cities = _read(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.lit("celsius").alias("temperature_unit"), F.col("c_mktsegment").alias("station")).dropDuplicates(["name"])
    docs = history.history_documents(cities, discovery.fetched_events(responses, with_markets=True), points, HISTORY_START, HISTORY_END)
    point = lambda h: F.concat(h["t"].cast("string"), F.lit("@"), h["p"].cast("string"))
    bucket = lambda b: F.concat(b["bucket"], F.lit("="), b["yes_token"], F.lit("["), F.array_join(F.transform(b["history"], point), ","), F.lit("]"))
    text = F.transform("markets", lambda m: F.concat(m["date"], F.lit("|"), F.coalesce(m["resolved_bucket"], F.lit("-")), F.lit("|"), F.array_join(F.transform(m["buckets"], bucket), ";")))
    return docs.select("city", F.array_join("window", "/").alias("window"), "market_count", F.array_join(text, "#").alias("markets"))


@query("""
    WITH e AS (SELECT user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS city, event_type FROM events),
         f AS (SELECT city, count(*) AS n FROM e WHERE event_type = 'signup' GROUP BY 1),
         a AS (SELECT city, count(*) AS n FROM e WHERE event_type = 'error' GROUP BY 1)
    SELECT coalesce(f.city, a.city) AS city, f.n AS forecast_days, a.n AS archive_days FROM f FULL OUTER JOIN a ON f.city = a.city
""")
def weather_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups and errors of a user's day as two responses, counted and joined; many days have one or neither."""
    events = _read(spark, sf_dir, "events").select(F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd")).alias("city"), "event_type")

    def part(kind: str) -> DataFrame:
        return events.where(F.col("event_type") == kind).groupBy("city").agg(F.count("*").alias("days")).select("city", F.struct("days").alias("response"))

    units = events.select(F.col("city").alias("name")).distinct().withColumns({"station": F.lit(""), "temperature_unit": F.lit("celsius")})
    docs = history.weather_documents(part("signup"), part("error"), units)
    return docs.select("city", F.col("historical_forecast.days").alias("forecast_days"), F.col("archive_actuals.days").alias("archive_days"))
