"""Point-in-time joins: range, as-of, anti-range, carried values, sessions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bin(day: Column, width: int) -> Column:
    return F.floor(F.unix_date(day) / F.lit(width)).cast("int")


def interval_join(
    left: DataFrame,
    events: DataFrame,
    key: str,
    start: str,
    end: str,
    day: str,
    bin_days: int = 30,
) -> DataFrame:
    """Pairs of a left row and the events of its key with ``start <= day <= end``.

    Both sides meet on (key, day bin): an interval is listed once per bin it touches,
    and an event sits in one bin, so each pair appears once and a long history is
    never compared as a whole. The columns of both sides except the event key are kept.
    """
    spread = left.where(F.col(start) <= F.col(end)).withColumn(
        "__bin",
        F.explode(F.sequence(_bin(F.col(start), bin_days), _bin(F.col(end), bin_days))),
    )
    binned = (
        events.where(F.col(key).isNotNull() & F.col(day).isNotNull())
        .withColumn("__event_bin", _bin(F.col(day), bin_days))
        .withColumnRenamed(key, "__event_key")
    )
    return spread.join(
        binned,
        (F.col(key) == F.col("__event_key"))
        & (F.col("__bin") == F.col("__event_bin"))
        & F.col(day).between(F.col(start), F.col(end)),
        "inner",
    ).drop("__bin", "__event_bin", "__event_key")


def range_join(
    spine: DataFrame,
    events: DataFrame,
    key: str,
    at: str,
    day: str,
    oldest: int,
    newest: int = 1,
    bin_days: int | None = None,
) -> DataFrame:
    """Pairs with ``at - oldest <= day <= at - newest``, as column ``age_days``.

    ``oldest=90, newest=1`` is the left-closed window ``[at-90, at)``; ``newest=0``
    also takes the day itself, and negative values look ahead.
    """
    width = bin_days or max(1, (oldest - newest + 4) // 4)
    bounded = spine.withColumn("__from", F.date_sub(F.col(at), oldest)).withColumn(
        "__to", F.date_sub(F.col(at), newest)
    )
    return (
        interval_join(bounded, events, key, "__from", "__to", day, width)
        .withColumn("age_days", F.datediff(F.col(at), F.col(day)))
        .drop("__from", "__to")
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    at: str,
    day: str,
    columns: Sequence[str],
    direction: str = "backward",
    inclusive: bool = True,
    expiry_days: int | None = None,
    order: Sequence[str] = (),
    prefix: str = "",
) -> DataFrame:
    """Attach the nearest right row before (or after) ``at`` to every left row.

    The right side is first cut to one row per (key, day) and the left side to its
    distinct (key, at) points, so the sorted window of one key holds at most its
    calendar days however many raw rows the key has. ``order`` breaks ties within a
    day (the greatest tuple wins when looking back, the smallest when looking ahead).
    With ``expiry_days`` an older (or later) match counts as no match.
    """
    backward = direction == "backward"
    payload = F.struct(F.col(day).alias(day), *[F.col(c).alias(c) for c in columns if c != day])
    tie = F.struct(*[F.col(c) for c in order]) if order else payload
    pick = F.max_by if backward else F.min_by
    daily = (
        right.where(F.col(key).isNotNull() & F.col(day).isNotNull())
        .groupBy(F.col(key), F.col(day).alias("__day"))
        .agg(pick(payload, tie).alias("__row"))
    )
    event_side = 0 if inclusive else 1
    points = left.select(key, at).where(F.col(at).isNotNull()).distinct()
    empty = F.lit(None).cast(daily.schema["__row"].dataType)
    timeline = daily.select(
        key, "__day", F.lit(event_side).alias("__side"), "__row"
    ).unionByName(
        points.select(
            key, F.col(at).alias("__day"), F.lit(1 - event_side).alias("__side"), empty.alias("__row")
        )
    )
    first = F.col("__day").asc() if backward else F.col("__day").desc()
    window = (
        Window.partitionBy(key)
        .orderBy(first, F.col("__side"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = (
        timeline.withColumn("__hit", F.last("__row", ignorenulls=True).over(window))
        .where(F.col("__side") == 1 - event_side)
        .select(F.col(key).alias("__key"), F.col("__day").alias("__at"), "__hit")
    )
    gap = F.abs(F.datediff(F.col("__at"), F.col(f"__hit.{day}")))
    names = list(dict.fromkeys([*columns]))
    taken = [F.col(f"__hit.{c}") for c in names]
    if expiry_days is not None:
        taken = [F.when(gap <= expiry_days, c) for c in taken]
    found = found.select("__key", "__at", *[c.alias(f"{prefix}{n}") for c, n in zip(taken, names)])
    return left.join(
        found, (F.col(key) == F.col("__key")) & (F.col(at) == F.col("__at")), "left"
    ).drop("__key", "__at")


def anti_range(
    left: DataFrame, events: DataFrame, key: str, start: str, end: str, day: str
) -> DataFrame:
    """Left rows whose key has no event with ``start <= day <= end``.

    The first event on or after ``start`` decides, so no pairs are built at all.
    """
    looked = asof_join(
        left,
        events.select(F.col(key), F.col(day).alias("__next")),
        key, start, "__next", ["__next"], direction="forward",
    )
    return looked.where(F.col("__next").isNull() | (F.col("__next") > F.col(end))).drop("__next")


def rows_on_days(df: DataFrame, key: str, day: str, columns: Mapping[str, Column]) -> DataFrame:
    """One row per (key, day) with the given aggregates; combines before the shuffle."""
    return df.where(F.col(key).isNotNull() & F.col(day).isNotNull()).groupBy(key, day).agg(
        *[c.alias(n) for n, c in columns.items()]
    )


def session_starts(days: DataFrame, key: str, day: str, gap_days: int) -> DataFrame:
    """First and last day of every run of days whose gaps are at most ``gap_days``.

    ``days`` must hold one row per (key, day), so each window holds calendar days only.
    """
    ordered = Window.partitionBy(key).orderBy(day)
    opened = F.coalesce(
        (F.datediff(F.col(day), F.lag(day).over(ordered)) > gap_days).cast("int"), F.lit(1)
    )
    numbered = days.select(key, day).withColumn("__open", opened).withColumn(
        "session_number",
        F.sum("__open").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    )
    return numbered.groupBy(key, "session_number").agg(
        F.min(day).alias("session_start"), F.max(day).alias("session_end")
    )


def running_by_day(
    days: DataFrame, key: str, day: str, sums: Mapping[str, str]
) -> DataFrame:
    """Inclusive running sums over the days of each key (one input row per day)."""
    window = (
        Window.partitionBy(key).orderBy(day)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return days.select("*", *[F.sum(c).over(window).alias(n) for n, c in sums.items()])
