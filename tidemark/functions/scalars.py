"""Scalar column functions: safe casts, flags, ratios, calendar labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.keys import safe_token

# The accepted spellings of true and false.
TRUE_WORDS = ("true", "1", "yes", "y", "t")
FALSE_WORDS = ("false", "0", "no", "n", "f")

# Words that mark a component or a maintenance type.
COMPONENT_WORDS = {
    "engine": ("engine",),
    "hydraulic": ("hydraulic",),
    "powertrain": ("power train", "powertrain", "transmission", "hst"),
    "scr": ("scr", "urea", "adblue", "def"),
    "workequipment": ("work equipment", "workequipment"),
    "cooling": ("cooling", "coolant", "radiator"),
    "final_drive": ("final drive", "final_drive"),
}
MAINTENANCE_WORDS = {
    "oil": ("oil",),
    "filter": ("filter",),
    "breather": ("breather",),
    "coolant": ("coolant",),
}

# Upper edges and labels of the lead-time buckets.
LEAD_TIME_BUCKETS = (
    (0, "0d"), (30, "1-30d"), (60, "31-60d"), (90, "61-90d"),
    (120, "91-120d"), (180, "121-180d"), (365, "181-365d"),
)


NUMBER_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
TIME_TYPES = ("date", "timestamp", "timestamp_ntz")


def number(value: Column, default: float | None = None) -> Column:
    """Double, NULL (or the default) where the text is no number."""
    cast = value.try_cast("double")
    cast = F.when(~F.isnan(cast), cast)
    return cast if default is None else F.coalesce(cast, F.lit(float(default)))


def mixed_boolean(value: Column, default: bool | None = False) -> Column:
    """Boolean from true/1/yes/y/t and false/0/no/n/f; anything else is the default.

    ``default=None`` keeps unknown spellings NULL.
    """
    text = F.lower(F.trim(value.cast("string")))
    parsed = F.when(text.isin(*TRUE_WORDS), F.lit(True)).when(
        text.isin(*FALSE_WORDS), F.lit(False)
    )
    return parsed if default is None else F.coalesce(parsed, F.lit(default))


def strict_boolean(value: Column) -> Column:
    """Boolean that accepts only true/1; false otherwise."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "1"), F.lit(False))


def flag(value: Column, default: float = 0.0) -> Column:
    """0/1 number from boolean words; other numbers are kept, other text is the default."""
    text = F.lower(F.trim(value.cast("string")))
    words = (
        F.when(text.isin(*TRUE_WORDS), F.lit(1.0))
        .when(text.isin(*FALSE_WORDS), F.lit(0.0))
        .otherwise(number(text, default))
    )
    # typeof is a constant of the plan, so typed columns never take the text path
    return F.when(F.typeof(value).isin(*NUMBER_TYPES), number(value, default)).otherwise(words)


def timestamp(value: Column) -> Column:
    """Timestamp without zone; text with an offset is moved to UTC, bad text is NULL."""
    text = F.trim(value.cast("string"))
    zoned = text.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$") & text.rlike(r"\d{2}:\d{2}")
    instant = F.to_timestamp_ntz(
        F.date_format(text.try_cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"),
    )
    parsed = F.when(zoned, instant).otherwise(text.try_cast("timestamp_ntz"))
    plain = value.cast("string").try_cast("timestamp_ntz")
    return F.when(F.typeof(value).isin(*TIME_TYPES), plain).otherwise(parsed)


def level_number(text: Column, numeric: Column | None = None) -> Column:
    """Action level: the numeric column if given and present, else the digits of the text."""
    digits = F.regexp_extract(text.cast("string"), r"(\d+)", 1).try_cast("double")
    return digits if numeric is None else F.coalesce(number(numeric), digits)


def clip(value: Column, low: float, high: float) -> Column:
    """Value forced into ``[low, high]``; NULL stays NULL."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def log_occurrence(log_value: Column, count: Column) -> Column:
    """Given log value, else ``log(1 + count)`` with a missing count as one."""
    return F.coalesce(
        number(log_value), F.log1p(F.greatest(number(count, 1.0), F.lit(0.0)))
    )


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True where the lower-cased text holds any of the words."""
    lowered = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    hit = F.lit(False)
    for word in words:
        hit = hit | lowered.contains(word.lower())
    return hit


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0 where the denominator is missing or zero."""
    return F.coalesce(
        F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0)
    )


def ratio_or_null(numerator: Column, denominator: Column) -> Column:
    """Quotient, NULL where the denominator is missing or zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days between two instants, rounded down (time of day counts)."""
    seconds = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(seconds / F.lit(86_400_000_000)).cast("int")


def first_midnight_at_or_after(instant: Column) -> Column:
    """Day on which ``floor_days`` of an instant starts to count from zero."""
    day = F.to_date(instant)
    return F.when(instant > day.cast("timestamp_ntz"), F.date_add(day, 1)).otherwise(day)


def category_indicators(value: Column, prefix: str, expected: Sequence[str]) -> list[Column]:
    """One 0/1 column per expected category, named by prefix and safe token."""
    text = F.upper(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    return [
        (text == name.upper()).cast("int").alias(f"{prefix}_{safe_token(name).lower() or 'missing'}_count")
        for name in expected
    ]


def season_label(day: Column) -> Column:
    """``Q1`` to ``Q4``."""
    return F.concat(F.lit("Q"), F.quarter(day).cast("string"))


def four_month_start(day: Column) -> Column:
    """First day of the four-month block (January, May, September)."""
    block = F.floor((F.month(day) - 1) / F.lit(4)).cast("int")
    return F.make_date(F.year(day), block * 4 + 1, F.lit(1))


def lead_time_bucket(days: Column) -> Column:
    """Label of the number of days to the next event."""
    label = F.when(days.isNull(), F.lit("no_future_claim_observed"))
    for edge, text in LEAD_TIME_BUCKETS:
        label = label.when(days <= edge, F.lit(text))
    return label.otherwise(F.lit("365d+"))
