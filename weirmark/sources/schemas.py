"""Declared schemas: a superset of what the raw files hold, never inferred."""

from __future__ import annotations

META = "_meta struct<source:string,kind:string,access:string,city:string,latitude:double,longitude:double,temperature_unit:string,station:string,fetched_at_utc:string,gamma_base:string,clob_base:string,event_count:bigint>"
DAILY = "struct<time:array<string>,temperature_2m_max:array<double>,temperature_2m_min:array<double>>"
RESPONSE = f"struct<latitude:double,longitude:double,generationtime_ms:double,utc_offset_seconds:bigint,timezone:string,timezone_abbreviation:string,elevation:double,daily_units:struct<time:string,temperature_2m_max:string,temperature_2m_min:string>,daily:{DAILY}>"
MARKET = "struct<id:string,groupItemTitle:string,startDate:string,endDate:string,outcomePrices:string,outcomes:string,clobTokenIds:string>"
EVENT = f"struct<slug:string,title:string,closed:boolean,startDate:string,endDate:string,conditionId:string,markets:array<{MARKET}>>"
QUOTE = "struct<midpoint:string,price_buy:string,price_sell:string>"
BUCKET = "struct<bucket:string,yes_token:string,resolved_yes:boolean,history:array<struct<t:bigint,p:double>>>"
HISTORY_MARKET = f"struct<date:string,slug:string,title:string,endDate:string,conditionId:string,temperature_unit:string,resolved_bucket:string,buckets:array<{BUCKET}>>"

RAW_WEATHER = f"{META}, response {RESPONSE}"
RAW_MARKET = f"{META}, gamma_events array<{EVENT}>, clob_quotes map<string,{QUOTE}>"
MARKET_HISTORY = f"city string, station string, window array<string>, market_count bigint, markets array<{HISTORY_MARKET}>"
WEATHER_HISTORY = f"city string, station string, temperature_unit string, historical_forecast {RESPONSE}, archive_actuals {RESPONSE}"
CITIES = "name string, latitude double, longitude double, timezone string, temperature_unit string, station string"

FACT_PRICE = "city string, target_date date, snapshot_ts timestamp, source string, native_unit string, bucket_label string, bucket_kind string, bucket_low_c double, bucket_high_c double, bucket_mid_c double, yes_price double, hours_to_close double"
FACT_FORECAST = "city string, target_date date, forecast_ts timestamp, source string, native_unit string, forecast_max_native double, forecast_min_native double, forecast_max_c double, forecast_min_c double"
DIM_OUTCOME = "city string, target_date date, resolved_bucket string, resolved_mid_c double, resolved_low_c double, resolved_high_c double, era5_actual_max_c double"
