"""Scalar rules as Column -> Column functions.

Timestamps are instants under a UTC session. Casts are the ``try_`` kind: a bad
value becomes null and is left to the quarantine, it never fails the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmark.functions.names import free_names

#: Markets close at this hour, UTC, of their target date.
CLOSE_HOUR = 12
#: An outcome priced at this or more has won.
WON = 0.99


def fahrenheit_to_celsius(x: Column) -> Column:
    """Rounded to 2 decimals; null stays null."""
    return F.round((x - 32) * F.lit(5.0) / F.lit(9.0), 2)


def to_celsius(x: Column, unit: Column) -> Column:
    return F.when(unit == "fahrenheit", fahrenheit_to_celsius(x.cast("double"))).otherwise(x.cast("double"))


def _integer(found: Column) -> Column:
    """Null for '', which a cast would find out by an exception, a hundred times slower."""
    return F.nullif(found, F.lit("")).try_cast("int")


def first_integer(label: Column, signed: bool = False) -> Column:
    return _integer(F.regexp_extract(label, "(-?[0-9]+)" if signed else "([0-9]+)", 1))


def no_number(label: Column) -> Column:
    """A label that is null or whose first number is absent or longer than nine digits."""
    return ~F.coalesce(label.rlike("^[^0-9]*[0-9]{1,9}([^0-9]|$)"), F.lit(False))


def _label_parts(label: Column, signed: bool) -> dict[str, Column]:
    number = "-?[0-9]+" if signed else "[0-9]+"
    low, high = (_integer(F.regexp_extract(label, rf"({number})\s*-\s*({number})", i)) for i in (1, 2))
    return {"first": first_integer(label, signed), "low": low, "high": high}


def _bucket(label: Column, unit: Column, first: Column, pair_low: Column, pair_high: Column, kind: Column | None = None) -> dict[str, Column]:
    said = (
        F.when(first.isNull(), F.lit(None).cast("string"))
        .when(label.contains("or below"), "below")
        .when(label.contains("or higher") | label.contains("or above"), "above")
        .when(pair_low.isNotNull(), "range")
        .otherwise("exact")
    )
    kind = said if kind is None else kind
    low = F.when(kind == "range", pair_low).when(kind.isin("above", "exact"), first)
    high = F.when(kind == "range", pair_high).when(kind.isin("below", "exact"), first)
    mid = F.when(kind == "range", (pair_low + pair_high) / F.lit(2.0)).otherwise(first.cast("double"))
    return {"bucket_kind": said, **{f"bucket_{n}_c": to_celsius(x, unit) for n, x in (("low", low), ("high", high), ("mid", mid))}}


def parse_bucket(label: Column, unit: Column, signed: bool = False) -> Column:
    """Struct of kind and °C low, high and mid of a bucket label.

    Signs are ignored unless ``signed``; a label without a digit, or null, has
    a null kind and null bounds. For whole tables ``with_bucket`` is faster.
    """
    return F.struct(*(c.alias(n) for n, c in _bucket(label, unit, *_label_parts(label, signed).values()).items()))


def with_bucket(df: DataFrame, label: str = "bucket_label", unit: str = "native_unit", signed: bool = False) -> DataFrame:
    """``df`` with the columns of ``parse_bucket``. Each pattern is looked for once: its result is a column before it is used."""
    names = free_names(df, "first", "low", "high", "kind")
    found = df.withColumns(dict(zip(names, _label_parts(F.col(label), signed).values(), strict=False)))
    first, low, high, kind = map(F.col, names)
    found = found.withColumn(names[3], _bucket(F.col(label), F.col(unit), first, low, high)["bucket_kind"])
    parsed = _bucket(F.col(label), F.col(unit), first, low, high, kind) | {"bucket_kind": kind}
    return found.withColumns(parsed).drop(*names)


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 with Z, an offset or neither; the last counts as UTC."""
    return F.try_to_timestamp(text)


def target_date(text: Column) -> Column:
    return iso_timestamp(text).cast("date")


def micros_to_close(snapshot: Column, day: Column) -> Column:
    close = F.unix_micros(day.cast("timestamp")) + F.lit(CLOSE_HOUR * 3_600_000_000)
    return close - F.unix_micros(snapshot.cast("timestamp"))


def hours_to_close(snapshot: Column, day: Column) -> Column:
    """Hours with 2 decimals, half away from zero, from whole microseconds; negative after the close."""
    us = micros_to_close(snapshot, day)
    return F.signum(us.cast("double")) * F.floor((F.abs(us) + 18_000_000) / F.lit(36_000_000)) / F.lit(100.0)


def epoch_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def epoch_seconds(moment: Column) -> Column:
    """Whole seconds, rounded down."""
    return F.unix_seconds(moment.cast("timestamp"))


def hour(moment: Column) -> Column:
    return F.date_trunc("hour", moment.cast("timestamp"))


def iso_date(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def filled(first: Column, *others: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (first, *others)))


def json_list(text: Column) -> Column:
    """Array of strings out of a JSON array in a string; null and '' are empty, broken text is null."""
    return F.from_json(filled(text, F.lit("[]")), "array<string>")


def has_prices(text: Column) -> Column:
    """Neither null nor an empty list; told from the text alone. Broken text counts as a price list, a bad one."""
    return ~F.translate(F.coalesce(text, F.lit("")), " \t\r\n", "").isin("", "[]", "null")


def first_price(text: Column) -> Column:
    return F.get(json_list(text), F.lit(0)).try_cast("double")


def resolved_yes(text: Column) -> Column:
    return F.coalesce(first_price(text) >= WON, F.lit(False))


def first_token(text: Column) -> Column:
    """Element 0, or null for a null, empty or broken list or an empty token."""
    return F.nullif(F.get(json_list(text), F.lit(0)), F.lit(""))


def city_slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("-"))


def city_part(name: Column) -> Column:
    return F.concat(F.lit("highest-temperature-in-"), city_slug(name))


def day_part(day: Column) -> Column:
    return F.concat(F.lit("-on-"), F.lower(F.date_format(day, "MMMM")), F.lit("-"), F.dayofmonth(day).cast("string"), F.lit("-"), F.year(day).cast("string"))


def market_slug(name: Column, day: Column) -> Column:
    return F.concat(city_part(name), day_part(day))


def slug_parts(slug: Column) -> tuple[Column, Column]:
    """The ``city_part`` and ``day_part`` of a market slug; what is no such slug has an empty day."""
    day = F.regexp_extract(slug, r"-on-[^-]+-[0-9]+-[0-9]+\z", 0)
    return F.left(slug, F.length(slug) - F.length(day)), day


def plain_title(title: Column) -> Column:
    return F.lower(F.coalesce(title, F.lit("")))
