"""Spines, calendars, rosters, coverage and alignment checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import clean_model, clean_serial, stable_hash, hash_choice
from tidemark.operators.ordering import first_per_group


def _day(value: date | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def calendar(first: Column, last: Column, step: int, anchor: date | str | None = None) -> Column:
    """Array of days every ``step`` days inside the bounds, in phase with ``anchor`` if given.

    NULL-free: an empty array when the bounds are missing or no day fits.
    """
    if step <= 0:
        raise ValueError("step must be positive")
    begin = first
    if anchor is not None:
        at = _day(anchor)
        behind = F.greatest(F.datediff(first, at), F.lit(0))
        begin = F.date_add(at, (F.ceil(behind / F.lit(step)) * step).cast("int"))
    fits = first.isNotNull() & last.isNotNull() & (first <= last) & (begin <= last)
    return F.when(
        fits, F.sequence(begin, F.when(fits, last).otherwise(begin), F.expr(f"interval {step} day"))
    ).otherwise(F.array().cast("array<date>"))


def unique_backbone(
    rows: DataFrame, key: str, at: str, order: Sequence[str], keep: Column | None = None
) -> DataFrame:
    """One row per (key, day), the last by ``order``; other columns get a ``machine_`` prefix."""
    valid = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    if keep is not None:
        valid = valid.where(keep)
    extra = [c for c in rows.columns if c not in (key, at)]
    names = {c: c if c == "full_model" or c.startswith("machine_") else f"machine_{c}" for c in extra}
    last = F.max_by(F.struct(*[F.col(c).alias(n) for c, n in names.items()]), F.struct(*order))
    return valid.groupBy(key, at).agg(last.alias("__row")).select(key, at, "__row.*")


def rebuild_spine(
    backbone: DataFrame, key: str, at: str, step: int, scope: str = "global",
    anchor: date | str | None = None, columns: Sequence[str] = (),
) -> DataFrame:
    """An exact calendar inside each key's own first and last day, with as-of columns.

    ``global`` starts the calendar at the first day of all keys, ``per_key`` at each
    key's own. ``columns`` come from the key's latest row on or before the new day.
    """
    if scope not in ("global", "per_key"):
        raise ValueError("scope must be 'global' or 'per_key'")
    if columns:
        return _spine_of_held_rows(backbone, key, at, step, scope, anchor, columns)
    bounds = backbone.groupBy(key).agg(F.min(at).alias("__first"), F.max(at).alias("__last"))
    if scope == "global":
        origin = backbone.agg(F.min(at).alias("__origin"))
        bounds = bounds.join(F.broadcast(origin))
        lag = F.datediff("__first", "__origin")
        if anchor is None:
            # first day of the shared calendar at or after the key's first day
            begin = F.date_add("__origin", (F.ceil(lag / F.lit(step)) * step).cast("int"))
            days = F.when(begin <= F.col("__last"), calendar(begin, F.col("__last"), step)).otherwise(
                F.array().cast("array<date>")
            )
        else:
            days = calendar(F.col("__first"), F.col("__last"), step, anchor)
    else:
        days = calendar(F.col("__first"), F.col("__last"), step, anchor)
    return bounds.select(key, F.explode(days).alias(at))


def _spine_of_held_rows(backbone, key, at, step, scope, anchor, columns):
    """The calendar of ``rebuild_spine`` with columns.

    A day's row (the greatest by ``columns``) holds until the key's next one, so each row yields the calendar days
    that it holds for. Only one row per (key, day) is sorted, and no calendar day is shuffled.
    """
    known = F.col(key).isNotNull()
    # rows without a key have a calendar, but nothing to look up
    row = F.max(columns[0]) if len(columns) == 1 else F.max(F.struct(*columns))
    daily = backbone.where(F.col(at).isNotNull()).groupBy(key, F.col(at).alias("__day")).agg(row.alias("__row"))
    days = Window.partitionBy(key).orderBy("__day")
    held = daily.withColumns({
        "__until": F.date_sub(F.lead("__day").over(days), 1),
        "__first": F.first("__day").over(days.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    if anchor is not None and scope == "global":
        scope = "per_key"
    if scope == "global":
        held = held.join(F.broadcast(backbone.agg(F.min(at).alias("__origin"))))
        begin = F.date_add("__origin", (F.ceil(F.datediff("__first", "__origin") / F.lit(step)) * step).cast("int"))
    elif anchor is not None:
        begin = F.date_add(_day(anchor), (F.ceil(F.greatest(F.datediff("__first", _day(anchor)), F.lit(0)) / F.lit(step)) * step).cast("int"))
    else:
        begin = F.col("__first")
    held = held.withColumn("__begin", begin)
    behind = F.greatest(F.datediff("__day", "__begin"), F.lit(0))
    start = F.date_add("__begin", (F.ceil(behind / F.lit(step)) * step).cast("int"))
    taken = [F.col("__row")] if len(columns) == 1 else [F.col(f"__row.{c}") for c in columns]
    return held.select(
        key, F.explode(calendar(start, F.coalesce("__until", "__day"), step)).alias(at),
        *[F.when(known, x).alias(c) for x, c in zip(taken, columns, strict=True)],
    )


def greedy_dates(
    backbone: DataFrame, key: str, at: str, gap: int, anchor: date | str | None = None
) -> DataFrame:
    """Existing days of each key picked one after another at least ``gap`` days apart.

    The fold runs over the key's distinct days, which the calendar bounds.
    """
    days = F.sort_array(F.collect_set(at))
    listed = backbone.groupBy(key).agg(days.alias("__days"))
    if anchor is not None:
        listed = listed.withColumn("__days", F.filter("__days", lambda d: d >= _day(anchor)))
    step = lambda acc, d: F.when(
        (F.size(acc) == 0) | (F.datediff(d, F.element_at(acc, -1)) >= gap), F.concat(acc, F.array(d))
    ).otherwise(acc)
    # element_at on an empty array must not run, hence the seed with a far past day
    seed = F.array(F.lit("0001-01-01").cast("date"))
    picked = F.aggregate("__days", seed, step)
    return listed.select(key, F.explode(F.slice(picked, F.lit(2), F.size(picked))).alias(at))


def greedy_global_dates(backbone: DataFrame, at: str, gap: int) -> DataFrame:
    """The same greedy choice over the distinct days of the whole table."""
    one = backbone.select(at).distinct().withColumn("__all", F.lit(0))
    return greedy_dates(one, "__all", at, gap).drop("__all")


def first_entities(spine: DataFrame, key: str, count: int) -> DataFrame:
    """Rows of the first ``count`` entities in key order."""
    chosen = spine.select(key).distinct().orderBy(key).limit(count)
    return spine.join(chosen, key, "left_semi")


def bounded_spine(
    spine: DataFrame, at: str, first: date | str | None = None, last: date | str | None = None
) -> DataFrame:
    """Rows whose day lies inside the optional inclusive bounds."""
    out = spine
    if first is not None:
        out = out.where(F.col(at) >= _day(first))
    if last is not None:
        out = out.where(F.col(at) <= _day(last))
    return out


def label_end(tables: Sequence[tuple[DataFrame, str]], configured: date | str | None = None) -> DataFrame:
    """One row: the configured end, else the latest day over all tables."""
    if configured is not None:
        return tables[0][0].sparkSession.range(1).select(_day(configured).alias("label_end"))
    union = None
    for df, day in tables:
        part = df.agg(F.max(F.col(day)).cast("date").alias("label_end"))
        union = part if union is None else union.unionByName(part)
    return union.agg(F.max("label_end").alias("label_end"))


def complete_horizon(spine: DataFrame, end: DataFrame, horizon: int, at: str = "snapshot_date",
                     strict: bool = False) -> DataFrame:
    """Rows whose label window is observed: ``at <= end-(horizon-1)``, or ``end-horizon`` if strict."""
    days = horizon if strict else horizon - 1
    return (
        spine.join(F.broadcast(end.select("label_end").limit(1)))
        .where(F.col(at) <= F.date_sub("label_end", days))
        .drop("label_end")
    )


def spine_problems(spine: DataFrame, key: str, at: str) -> DataFrame:
    """One row of missing-key, missing-day and duplicate counts (all zero when sound)."""
    pairs = spine.groupBy(key, at).agg(F.count(F.lit(1)).alias("__rows"))
    return pairs.agg(
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("__rows"))), F.lit(0)).alias("missing_key_rows"),
        F.coalesce(F.sum(F.when(F.col(at).isNull(), F.col("__rows"))), F.lit(0)).alias("missing_day_rows"),
        F.coalesce(F.sum(F.col("__rows") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def alignment_report(spine: DataFrame, snapshot: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """One row comparing the keys of a source snapshot with the spine."""
    left = spine.groupBy(*keys).agg(F.count(F.lit(1)).alias("__left"))
    right = snapshot.groupBy(*keys).agg(F.count(F.lit(1)).alias("__right"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return (
        left.join(right, list(keys), "full_outer")
        .agg(
            total(F.col("__left")).alias("spine_rows"),
            total(F.col("__right")).alias("snapshot_rows"),
            total(F.when(F.col("__right").isNull(), 1)).alias("missing_keys"),
            total(F.when(F.col("__left").isNull(), 1)).alias("extra_keys"),
            total(F.col("__right") - 1).alias("duplicate_rows"),
        )
        .select(F.lit(name).alias("source"), "*")
    )


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` unchanged, failing when it is run if a key occurs twice.

    The check is an aggregate of the same keys that a later join needs anyway.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1")
    bad = counted.agg(F.count(F.lit(1)).alias("__bad"))
    guard = bad.select(
        F.when(F.col("__bad") > 0, F.raise_error(F.lit(f"duplicate keys {list(keys)}"))).cast("int").alias("__ok")
    )
    return df.join(F.broadcast(guard)).where(F.col("__ok").isNull()).drop("__ok")


def fleet_roster(tables: Sequence[DataFrame], key: str, extra: Sequence[str] = ()) -> DataFrame:
    """Distinct keys over all tables and an optional list of further keys."""
    union = None
    for df in tables:
        part = df.select(key).where(F.col(key).isNotNull()).distinct()
        union = part if union is None else union.unionByName(part)
    if extra:
        spark = union.sparkSession
        union = union.unionByName(spark.createDataFrame([(e,) for e in extra], f"{key} string"))
    return union.distinct()


def model_roster(rows: DataFrame, key: str, model: str) -> DataFrame:
    """The most frequent model of each key; the smaller name on ties."""
    counted = (
        rows.where(F.col(key).isNotNull()).groupBy(key, model).agg(F.count(F.lit(1)).alias("__rows"))
    )
    best = F.min_by(F.col(model), F.struct(-F.col("__rows"), F.col(model)))
    return counted.groupBy(key).agg(best.alias(model))


def machine_master(
    sources: Sequence[tuple[DataFrame, str | None, str | None]], key: str = "machine_key"
) -> DataFrame:
    """First non-blank model and serial of each key in the order of the sources."""
    union = None
    for turn, (df, model, serial) in enumerate(sources):
        part = df.select(
            key,
            (clean_model(F.col(model)) if model else F.lit("")).alias("full_model"),
            (clean_serial(F.col(serial)) if serial else F.lit("")).alias("serial"),
            F.lit(turn).alias("__turn"),
        ).distinct()
        union = part if union is None else union.unionByName(part)
    first = lambda c: F.coalesce(
        F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.struct("__turn", c))), F.lit("")
    ).alias(c)
    return union.where(F.col(key).isNotNull()).groupBy(key).agg(first("full_model"), first("serial"))


def source_coverage(
    sources: Mapping[str, tuple[DataFrame, str]], key: str = "machine_key"
) -> DataFrame:
    """First and last day, total rows and rows per source of each key."""
    union = None
    for name, (df, day) in sources.items():
        part = (
            df.where(F.col(key).isNotNull() & F.col(day).isNotNull())
            .groupBy(key)
            .agg(F.min(day).alias("__first"), F.max(day).alias("__last"), F.count(F.lit(1)).alias("__rows"))
            .withColumn("__source", F.lit(name))
        )
        union = part if union is None else union.unionByName(part)
    rows = lambda n: F.coalesce(F.sum(F.when(F.col("__source") == n, F.col("__rows"))), F.lit(0))
    return union.groupBy(key).agg(
        F.min("__first").alias("first_source_date"),
        F.max("__last").alias("last_source_date"),
        F.sum("__rows").alias("source_record_count_total"),
        *[rows(n).alias(f"source_count_total_{n}") for n in sources],
    )


def dense_grid(roster: DataFrame, days: Sequence[date | str], at: str = "snapshot_date") -> DataFrame:
    """Every roster row with every day of a short literal list."""
    return roster.withColumn(at, F.explode(F.array(*[_day(d) for d in days])))


def anchor_manifest(
    events: DataFrame, day: str, folds: Sequence[tuple[str, str, str]], mode: str = "even",
    count: int = 5, gap: int = 25, lookback: int = 90, horizon: int = 90, seed: int = 42,
    fixed: Mapping[str, Sequence[str]] | None = None, attempts: int = 500,
) -> DataFrame:
    """Anchor dates per fold whose outcome window is observed.

    ``even`` spreads them over the fold, ``random`` draws one per equal stretch by a
    seeded hash and takes the first attempt that keeps ``gap`` days between them (else
    falls back to even floor positions), ``fixed`` takes listed dates. The event table is only aggregated to its last
    day; everything after that is a few rows per fold. A NULL ``anchor_date`` marks a
    fold too short for its anchors.
    """
    last = events.agg(F.max(day).cast("date").alias("label_data_through"))
    names = F.array(*[
        F.struct(F.lit(n).alias("fold"), _day(a).alias("fold_start"), _day(b).alias("fold_end"))
        for n, a, b in folds
    ])
    rows = last.withColumn("__f", F.explode(names)).select("label_data_through", "__f.*").withColumn(
        "mature_end", F.least("fold_end", F.date_add("label_data_through", 2 - horizon))
    ).withColumn("__n", F.datediff("mature_end", "fold_start"))
    if mode == "fixed":
        lists = F.lit(None)
        for name, days in (fixed or {}).items():
            lists = F.when(F.col("fold") == name, F.array(*[_day(d) for d in sorted(days)])).otherwise(lists)
        placed = rows.select("*", F.posexplode(lists).alias("__i", "anchor_date"))
    else:
        turns = F.sequence(F.lit(0), F.lit(count - 1))
        at = lambda pos: F.date_add("fold_start", pos.cast("int"))
        if mode == "even":
            placed = rows.withColumn("__i", F.explode(turns)).withColumn(
                "anchor_date", at(F.rint((F.col("__n") - 1) * F.col("__i") / F.lit(max(count - 1, 1))))
            )
        else:
            drawn = rows.withColumn("__try", F.explode(F.sequence(F.lit(0), F.lit(attempts)))).withColumn(
                "__i", F.explode(turns)
            )
            edge = lambda i: F.floor(F.col("__n") * i / F.lit(count))
            low, high = edge(F.col("__i")), F.greatest(edge(F.col("__i") + 1), edge(F.col("__i")) + 1)
            pick = hash_choice(
                stable_hash(seed, F.col("fold"), F.lit("|"), F.col("__try"), F.lit("|"), F.col("__i")), high - low
            )
            fallback = F.floor((F.col("__n") - 1) * F.col("__i") / F.lit(max(count - 1, 1)))
            drawn = drawn.withColumn(
                "anchor_date", at(F.when(F.col("__try") < attempts, low + pick).otherwise(fallback))
            )
            chain = Window.partitionBy("fold", "__try").orderBy("__i")
            drawn = drawn.withColumn("__gap", F.datediff("anchor_date", F.lag("anchor_date").over(chain)))
            good = drawn.groupBy("fold", "__try").agg(F.min("__gap").alias("__least")).where(
                F.coalesce(F.col("__least") >= gap, F.lit(True))
            ).groupBy("fold").agg(F.min("__try").alias("__use"))
            placed = drawn.join(good, "fold", "left").where("__try = coalesce(__use, 0)").withColumn(
                "anchor_date", F.when(F.col("__use").isNotNull(), F.col("anchor_date"))
            ).drop("__use", "__try", "__gap")
    window = Window.partitionBy("fold").orderBy("anchor_date")
    out = placed.withColumn("__turn", F.row_number().over(window))
    if mode == "even":
        gaps = out.withColumn("__gap", F.datediff("anchor_date", F.lag("anchor_date").over(window)))
        ok = gaps.groupBy("fold").agg(F.coalesce(F.min("__gap") >= gap, F.lit(True)).alias("__ok"))
        out = out.join(ok, "fold").withColumn("anchor_date", F.when(F.col("__ok"), F.col("anchor_date")))
    return out.select(
        "fold",
        F.format_string("%s_A%02d", F.col("fold"), F.col("__turn")).alias("anchor_id"),
        "anchor_date",
        F.date_sub("anchor_date", lookback).alias("feature_window_start"),
        F.date_add("anchor_date", horizon).alias("outcome_window_end_exclusive"),
        (F.col("anchor_date") < F.col("mature_end")).cast("int").alias("outcome_window_complete"),
        "label_data_through",
    )


def spaced_dates(days: Column, count: int, gap: int) -> Column:
    """Dates of a sorted array near even positions, at least ``gap`` days apart, then the first others that fit.

    ``days`` holds distinct calendar dates, so the array is bounded by the calendar. One expression ranks the
    dates by their distance to each position in turn and keeps the nearest that the gap allows.
    """
    size, empty = F.size(days), F.slice(days, 1, 0)
    fits = lambda day, chosen: F.forall(chosen, lambda c: F.abs(F.datediff(day, c)) >= F.greatest(F.lit(gap), F.lit(1)))
    if count <= 1:
        return F.slice(days, F.floor(size / 2).cast("int") + 1, F.lit(min(count, 1)))
    wanted = F.least(F.lit(count), size)

    def add_nearest(chosen: Column, turn: Column) -> Column:
        place = (size - 1) * turn / F.greatest(wanted - 1, F.lit(1))
        ranked = F.array_sort(F.filter(
            F.transform(days, lambda d, i: F.struct(F.abs(i - place).alias("away"), d.alias("day"))), lambda x: fits(x["day"], chosen)
        ))
        return F.concat(chosen, F.transform(F.slice(ranked, 1, 1), lambda x: x["day"]))

    near = F.aggregate(F.sequence(F.lit(0), wanted - 1), empty, add_nearest)
    full = F.aggregate(days, near, lambda chosen, d: F.when((F.size(chosen) < count) & fits(d, chosen), F.concat(chosen, F.array(d))).otherwise(chosen))
    return F.when(size > 0, F.array_sort(full)).otherwise(empty)
