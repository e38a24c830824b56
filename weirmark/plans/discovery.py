"""Finding a city's events, their tokens and quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmark.functions import scalars as S
from weirmark.operators.dedup import keep_first
from weirmark.operators.joins import with_fallback
from weirmark.operators.nested import map_by_key, pivot_parts
from weirmark.operators.rows import first_or_self, keep_open, unnest
from weirmark.sources import schemas

SNAPSHOT = ["city", "fetched_at_utc"]
QUOTE_PARTS = ["midpoint", "price_buy", "price_sell"]
EVENT_FIELDS = ["title", "closed", "startDate", "endDate", "conditionId", "markets"]


def matching(df: DataFrame, title: Column, needle: Column) -> DataFrame:
    """Rows whose lower-cased title has the lower-cased needle; a null title is ''."""
    return df.where(S.plain_title(title).contains(F.lower(needle)))


def discover_events(results: DataFrame, only_open: bool = False) -> DataFrame:
    """A city's events by title, the first of each slug in each fetch, in the order of the results."""
    rows = unnest(results, "events", "event", SNAPSHOT, "position")
    found = matching(rows, F.col("event.title"), F.concat(F.lit("temperature in "), F.col("city")))
    found = found.select(*SNAPSHOT, "position", "event.*")
    return keep_first(keep_open(found) if only_open else found, [*SNAPSHOT, "slug"], [F.col("position")])


def fetched_events(responses: DataFrame, with_markets: bool = False) -> DataFrame:
    """The event of each response (slug, items, single): the first of a list, else a lone object.

    ``with_markets``: a lone object counts only if it has markets, as for
    history. A response with neither gives no row. One response per slug.
    """
    usable = F.size(F.col("single.markets")) > 0 if with_markets else None
    found = responses.select("slug", first_or_self(F.col("items"), F.col("single"), usable).alias("event")).where("event is not null")
    return found.select("slug", *(F.col(f"event.{f}").alias(f) for f in EVENT_FIELDS))


def yes_tokens(events: DataFrame) -> DataFrame:
    """(city, fetched_at_utc, token_id) of every usable token, once each."""
    markets = unnest(events, "markets", "market", SNAPSHOT)
    tokens = markets.select(*SNAPSHOT, S.first_token(F.col("market.clobTokenIds")).alias("token_id"))
    return tokens.where("token_id is not null").dropDuplicates([*SNAPSHOT, "token_id"])


def quotes(parts: DataFrame) -> DataFrame:
    """One row per token of (token_id, key, value) rows; parts that failed are null."""
    return pivot_parts(parts, ["token_id"], "key", "value", QUOTE_PARTS, F.max)


def attach_quotes(tokens: DataFrame, quoted: DataFrame) -> DataFrame:
    """Merged, as either side has a row per token; by the size of what they were unnested from Spark would broadcast the quotes."""
    return tokens.join(quoted.hint("merge"), "token_id", "left")


def quote_maps(quoted: DataFrame, keys: list[str]) -> DataFrame:
    """Map from token to quote per snapshot; tokens are unique by ``yes_tokens``."""
    return map_by_key(quoted, keys, "token_id", F.struct(*QUOTE_PARTS), "clob_quotes")


def _field(column: str, path: str, kind: str) -> Column:
    return F.try_variant_get(column, path, kind)


def _elements(df: DataFrame, variant: str, keep: list[str], name: str) -> DataFrame:
    """(position, name) of the elements of a variant that is an array; any other gives no row."""
    rows = df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(variant).outer()))
    return rows.where("key is null").select(*keep, F.col("pos").alias("position"), F.col("value").alias(name))


def verbatim_snapshots(results: DataFrame, responses: DataFrame, parts: DataFrame, origin: dict[str, Column], only_open: bool = False) -> DataFrame:
    """What ``market_snapshots`` gives, of bodies as they came and with every field of theirs, declared or not.

    ``results`` is (city, fetched_at_utc, body) and ``responses`` (slug, body),
    the bodies being variants: a list of events, and a list of which the first
    counts or an event itself. ``gamma_events`` is an array of variants.
    ``origin`` adds fields to ``_meta``.
    """
    found = _elements(results, "body", [*SNAPSHOT], "event").withColumns({x: _field("event", f"$.{x}", kind) for x, kind in (("slug", "string"), ("title", "string"), ("closed", "boolean"))})
    found = matching(found, F.col("title"), F.concat(F.lit("temperature in "), F.col("city")))
    found = keep_first(keep_open(found) if only_open else found, [*SNAPSHOT, "slug"], [F.col("position")])
    listed = F.schema_of_variant("body").startswith("ARRAY")
    fresh = responses.select("slug", F.when(listed, _field("body", "$[0]", "variant")).otherwise(F.col("body")).alias("fresh")).where(F.schema_of_variant("fresh").startswith("OBJECT"))
    events = found.join(fresh, "slug", "left").select(*SNAPSHOT, "position", F.coalesce("fresh", "event").alias("event"))
    markets = _elements(events.select(*SNAPSHOT, _field("event", "$.markets", "variant").alias("markets")), "markets", [*SNAPSHOT], "market")
    tokens = markets.select(*SNAPSHOT, S.first_token(_field("market", "$.clobTokenIds", "string")).alias("token_id")).where("token_id is not null").dropDuplicates([*SNAPSHOT, "token_id"])
    quoted = quote_maps(attach_quotes(tokens, quotes(parts)), SNAPSHOT)
    # Variants have no order, so they are sorted as texts, by their position.
    texts = events.groupBy(*SNAPSHOT).agg(F.array_sort(F.collect_list(F.struct("position", F.to_json("event").alias("text")))).alias("e"))
    joined = texts.join(quoted, SNAPSHOT, "left")
    meta = F.struct(F.lit("markets").alias("source"), *SNAPSHOT, *(c.alias(n) for n, c in origin.items()), F.size("e").cast("long").alias("event_count"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{schemas.QUOTE}>"))
    return joined.select(meta.alias("_meta"), F.transform("e.text", F.parse_json).alias("gamma_events"), F.coalesce("clob_quotes", none).alias("clob_quotes"))


def market_snapshots(results: DataFrame, responses: DataFrame, parts: DataFrame, only_open: bool = False) -> DataFrame:
    """(_meta, gamma_events, clob_quotes): one record per city and fetch that found an event.

    Events are those of the search, each replaced as a whole by its fresh
    detail where there is one, in the order of the results. A record holds the
    events of one fetch, which a search bounds.
    """
    events = with_fallback(discover_events(results, only_open), fetched_events(responses), "slug", EVENT_FIELDS)
    found = quote_maps(attach_quotes(yes_tokens(events), quotes(parts)), SNAPSHOT)
    event = F.struct("slug", *EVENT_FIELDS)
    listed = events.groupBy(*SNAPSHOT).agg(F.array_sort(F.collect_list(F.struct("position", event.alias("event")))).alias("e"))
    joined = listed.join(found, SNAPSHOT, "left").withColumn("events", F.col("e.event"))
    meta = F.struct(F.lit("markets").alias("source"), "city", "fetched_at_utc", F.size("events").cast("long").alias("event_count"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{schemas.QUOTE}>"))
    return joined.select(meta.alias("_meta"), F.col("events").alias("gamma_events"), F.coalesce("clob_quotes", none).alias("clob_quotes"))
