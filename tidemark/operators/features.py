"""Declarative window features over event tables.

A list of ``Feature`` specs is compiled into few passes, whatever the number of
windows: events are reduced to one row of partial aggregates per (key, day) before
anything is joined, bounded windows come from one binned range join at the widest
window, unbounded history from one sorted pass per key. The daily reduction combines
inside each map task, so an entity with a third of all events reaches the join with
no more rows than it has days.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.temporal import interval_join, range_join
from tidemark.session import cut_lineage


@dataclass(frozen=True)
class Feature:
    """One output column: an aggregate of the events of a key in a window of ages.

    ``agg`` is one of count, sum, mean, max, min, stddev, any, days (days with an
    event), distinct, recency (days since the last one), latest and first (value of the
    last or first event by ``order``). ``value``, ``when`` and ``order`` are SQL
    expressions over the event row. The window takes events whose day is ``newest`` to
    ``oldest`` days before the spine date; ``oldest=None`` means all history. ``day``
    names the event-day column. ``fill`` replaces NULL when no event matches.
    """

    name: str
    agg: str
    value: str | None = None
    when: str | None = None
    oldest: int | None = 90
    newest: int = 1
    order: str | None = None
    day: str | None = None
    fill: float | None = None


def counts(names_when: dict[str, str | None], oldest: int | None, newest: int = 1) -> list[Feature]:
    """Count features from a mapping of output name to condition."""
    return [Feature(n, "count", when=w, oldest=oldest, newest=newest) for n, w in names_when.items()]


# ``when`` guards the value of every partial.
def _guard(expression: Column, when: str | None) -> Column:
    return expression if when is None else F.when(F.expr(when), expression)


# Partials that an aggregate is put together from.
_PARTS = {
    "count": ("rows",),
    "sum": ("sum",),
    "mean": ("sum", "known"),
    "stddev": ("sum", "known", "spread"),
    "max": ("max",),
    "min": ("min",),
    "any": ("rows",),
    "days": ("rows",),
    "recency": ("max",),
    "latest": ("last", "last_order"),
    "first": ("first", "first_order"),
    "distinct": ("rows",),
}


def _ordering(f: Feature, guarded: Column) -> Column:
    # rows without a value get no order and are skipped; plain numbers keep the hash aggregate
    return F.when(guarded.isNotNull(), F.expr(f.order) if f.order else F.expr(f.value) if f.value else F.lit(1))


def _event_part(kind: str, f: Feature) -> Column:
    """The partial of some event rows."""
    guarded = _guard(F.expr(f.value) if f.value else F.lit(1), f.when)
    if kind == "rows":
        return F.count(_guard(F.lit(1), f.when))
    if kind == "sum":
        return F.sum(guarded.cast("double"))
    if kind == "known":
        return F.count(guarded)
    if kind == "spread":
        # squared distances from the rows' own mean, so that large values do not cancel
        return F.var_pop(guarded.cast("double")) * F.count(guarded)
    if kind == "max":
        return F.max(guarded)
    if kind == "min":
        return F.min(guarded)
    order = _ordering(f, guarded)
    if kind == "last_order":
        return F.max(order)
    if kind == "first_order":
        return F.min(order)
    return F.max_by(guarded, order) if kind == "last" else F.min_by(guarded, order)


def _part_keys(f: Feature) -> dict[str, tuple]:
    order = f.order if f.agg in ("latest", "first") else None
    value = None if f.agg == "distinct" else f.value
    return {k: (k, value if k != "rows" else None, f.when, order) for k in _PARTS[f.agg]}


def _moments(parts: dict[str, str], f: Feature) -> Column:
    """Mean and spread of the days of a bounded window, as a list of (rows, mean, spread)."""
    n, total, spread = (F.col(parts[_part_keys(f)[k]]) for k in ("known", "sum", "spread"))
    return F.struct(n.cast("double").alias("n"), (total / n).alias("mean"), spread.alias("spread"))


def _deviation(moments: Column) -> Column:
    """Sample standard deviation from merged (rows, mean, spread) triples."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("spread"))

    def merge(a: Column, b: Column) -> Column:
        n, away = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(
            n.alias("n"), (a["mean"] + away * b["n"] / n).alias("mean"), (a["spread"] + b["spread"] + away * away * a["n"] * b["n"] / n).alias("spread")
        )

    return F.aggregate(moments, start, merge, lambda x: F.when(x["n"] > 1, F.sqrt(x["spread"] / (x["n"] - 1))))


def _finish(f: Feature, merged: dict[str, Column], at: str) -> Column:
    if f.agg in ("count", "days"):
        out = F.coalesce(merged["rows"], F.lit(0)).cast("long")
    elif f.agg == "any":
        out = (F.coalesce(merged["rows"], F.lit(0)) > 0).cast("int")
    elif f.agg == "sum":
        out = F.coalesce(merged["sum"], F.lit(0.0))
    elif f.agg == "mean":
        out = F.try_divide(merged["sum"], merged["known"].cast("double"))
    elif f.agg == "recency":
        out = F.datediff(F.col(at), merged["max"])
    elif f.agg in ("latest", "first"):
        out = merged["last" if f.agg == "latest" else "first"]
    else:
        out = merged[f.agg]
    if f.fill is not None:
        out = F.coalesce(out, F.lit(f.fill))
    return out


class DailyPartials:
    """Partial aggregates of one source for all of ``specs``: one row per entity, day and counted value.

    The events are read once and combine inside the map tasks; every pass of ``window_features`` (bounded windows,
    history, distinct values) reads the partials, stored where there are several. Days are kept by every day column
    that a spec names and values by every expression that a spec counts, so a row stands for events that all passes
    treat alike.
    """

    def __init__(self, events: DataFrame, specs: Sequence[Feature], key: str = "model_id", day: str = "event_day", store: bool = True):
        self.key, self.day = key, day
        days = list(dict.fromkeys(f.day or day for f in specs)) or [day]
        values = list(dict.fromkeys(f.value for f in specs if f.agg == "distinct"))
        self.days = {d: f"__d{i}" for i, d in enumerate(days)}
        self.values = {v: f"__v{i}" for i, v in enumerate(values)}
        self.parts: dict[tuple, str] = {}
        columns = []
        for f in specs:
            for kind, ident in _part_keys(f).items():
                if ident not in self.parts:
                    self.parts[ident] = f"__p{len(self.parts)}"
                    columns.append(_event_part(kind, f).alias(self.parts[ident]))
        known_day = F.coalesce(*[F.col(d).cast("string") for d in days]).isNotNull()
        shown = lambda v: F.when(F.expr(v).cast("string") != "", F.expr(v))
        table = events.where(F.col(key).isNotNull() & known_day).groupBy(
            F.col(key), *[F.col(d).alias(n) for d, n in self.days.items()], *[shown(v).alias(n) for v, n in self.values.items()]
        ).agg(*columns)
        self.single = len(days) == 1 and not values
        if store:
            table = cut_lineage(table)
        self.table = table

    def _merged(self, kind: str, ident: tuple) -> Column:
        part = F.col(self.parts[ident])
        if kind in ("rows", "sum", "known"):
            return F.sum(part)
        if kind in ("max", "last_order"):
            return F.max(part)
        if kind in ("min", "first_order"):
            return F.min(part)
        order = F.col(self.parts[(kind + "_order", *ident[1:])])
        return F.max_by(part, order) if kind == "last" else F.min_by(part, order)

    def daily(self, specs: Sequence[Feature], day: str) -> DataFrame:
        """One row per (key, ``__day``) with the partials of ``specs``."""
        idents = {ident: kind for f in specs for kind, ident in _part_keys(f).items()}
        rows = self.table.where(F.col(self.days[day]).isNotNull())
        if self.single:
            return rows.select(self.key, F.col(self.days[day]).alias("__day"), *[self.parts[i] for i in idents])
        columns = []
        for ident, kind in idents.items():
            name = self.parts[ident]
            if kind == "spread":
                n, total = (F.col(self.parts[(k, *ident[1:])]) for k in ("known", "sum"))
                triples = F.collect_list(F.when(n > 0, F.struct(n.cast("double").alias("n"), (total / n).alias("mean"), F.col(name).alias("spread"))))
                whole = F.sum(n).cast("double")
                columns.append(F.coalesce(F.pow(_deviation(F.sort_array(triples)), F.lit(2.0)) * (whole - 1), F.lit(0.0)).alias(name))
            else:
                columns.append(self._merged(kind, ident).alias(name))
        return rows.groupBy(self.key, F.col(self.days[day]).alias("__day")).agg(*columns)

    def day_values(self, value: str, whens: Sequence[str | None], day: str) -> DataFrame:
        """One row per (key, ``__day``, ``__value``) and whether each condition of ``whens`` met it, as ``__w0`` and so on."""
        name = self.values[value]
        flags = [F.max(F.col(self.parts[("rows", None, w, None)]) > 0).alias(f"__w{i}") for i, w in enumerate(whens)]
        return self.table.where(F.col(name).isNotNull() & F.col(self.days[day]).isNotNull()).groupBy(
            self.key, F.col(self.days[day]).alias("__day"), F.col(name).alias("__value")
        ).agg(*flags)


def _windowed(spine, partials, specs, key, at, day, bin_days):
    parts = partials.parts
    oldest = max(f.oldest for f in specs)
    newest = min(f.newest for f in specs)
    pairs = range_join(spine.select(key, at), partials.daily(specs, day), key, at, "__day", oldest, newest, bin_days)
    age = F.col("age_days")
    outputs = []
    for f in specs:
        inside = F.lit(True)
        if f.oldest < oldest:
            inside = inside & (age <= f.oldest)
        if f.newest > newest:
            inside = inside & (age >= f.newest)
        if f.agg == "stddev":
            known = F.col(parts[_part_keys(f)["known"]])
            # a window holds calendar days, so the list is bounded
            outputs.append(F.sort_array(F.collect_list(F.when(inside & (known > 0), _moments(parts, f)))).alias(f"__m_{f.name}"))
            continue
        merged = {}
        for kind, ident in _part_keys(f).items():
            part = F.when(inside, F.col(parts[ident]))
            if f.agg == "days":
                merged[kind] = F.count(F.when(inside & (F.col(parts[ident]) > 0), 1))
            elif kind in ("rows", "sum", "known"):
                merged[kind] = F.sum(part)
            elif kind == "max":
                merged[kind] = F.max(part)
            elif kind == "min":
                merged[kind] = F.min(part)
            elif kind in ("last", "first"):
                known = F.when(part.isNotNull(), F.col("__day"))
                merged[kind] = (F.max_by if kind == "last" else F.min_by)(part, known)
        outputs.append(_finish(f, merged, at).alias(f.name))
    out = pairs.groupBy(key, at).agg(*outputs)
    return out.select(key, at, *[
        _filled(_deviation(F.col(f"__m_{f.name}")), f).alias(f.name) if f.agg == "stddev" else F.col(f.name) for f in specs
    ])


def _filled(out: Column, f: Feature) -> Column:
    return out if f.fill is None else F.coalesce(out, F.lit(f.fill))


def _history(spine, partials, specs, key, at, day):
    """The spine rows with the features of all history. They take part in the sorted scan themselves, so that no
    join brings the features back to them."""
    parts = partials.parts
    daily = partials.daily(specs, day)
    rest = [c for c in spine.columns if c not in (key, at)]
    points = spine.select(key, F.col(at).alias("__day"), *([F.struct(*rest).alias("__rest")] if rest else []))
    timeline = daily.withColumn("__point", F.lit(False)).unionByName(
        points.withColumn("__point", F.lit(True)), allowMissingColumns=True
    ).withColumn("__number", F.unix_date("__day"))
    columns = []
    for f in specs:
        if f.agg == "stddev":
            raise ValueError(f"{f.name}: a standard deviation needs a bounded window")
        window = (
            Window.partitionBy(key).orderBy("__number")
            .rangeBetween(Window.unboundedPreceding, -f.newest)
        )
        merged = {}
        for kind, ident in _part_keys(f).items():
            part = F.col(parts[ident])
            if f.agg == "days":
                merged[kind] = F.count(F.when(part > 0, 1)).over(window)
            elif kind in ("rows", "sum", "known"):
                merged[kind] = F.sum(part).over(window)
            elif kind == "max":
                merged[kind] = F.max(part).over(window)
            elif kind == "min":
                merged[kind] = F.min(part).over(window)
            elif kind == "last":
                merged[kind] = F.last(part, ignorenulls=True).over(window)
            elif kind == "first":
                merged[kind] = F.first(part, ignorenulls=True).over(window)
        columns.append(_finish(f, merged, "__day").alias(f.name))
    return (
        timeline.select(key, F.col("__day").alias(at), *[F.col(f"__rest.{c}") for c in rest], "__point", *columns)
        .where("__point").drop("__point")
    )


def _distinct(spine, partials, specs, key, at, day, bin_days):
    """Exact distinct counts: values are reduced per (key, day) first, then per spine row."""
    result = None
    by_value = defaultdict(list)
    for f in specs:
        by_value[f.value].append(f)
    for value, group in by_value.items():
        whens = list(dict.fromkeys(f.when for f in group))
        day_values = partials.day_values(value, whens, day)
        oldest, newest = max(f.oldest for f in group), min(f.newest for f in group)
        pairs = range_join(
            spine.select(key, at), day_values, key, at, "__day", oldest, newest, bin_days
        )
        age = F.col("age_days")
        per_value = pairs.groupBy(key, at, "__value").agg(*[
            F.max(F.col(f"__w{whens.index(f.when)}") & age.between(f.newest, f.oldest)).alias(f.name)
            for f in group
        ])
        counted = per_value.groupBy(key, at).agg(
            *[F.count(F.when(F.col(f.name), 1)).alias(f.name) for f in group]
        )
        result = counted if result is None else result.join(counted, [key, at], "full_outer")
    return result


def _passes(specs: Sequence[Feature], day: str) -> dict[tuple[str, str], list[Feature]]:
    groups: dict[tuple[str, str], list[Feature]] = defaultdict(list)
    for f in specs:
        kind = "distinct" if f.agg == "distinct" else "history" if f.oldest is None else "window"
        groups[(kind, f.day or day)].append(f)
    return groups


def window_features(
    spine: DataFrame,
    events: DataFrame,
    specs: Sequence[Feature],
    key: str = "model_id",
    at: str = "snapshot_date",
    day: str = "event_day",
    bin_days: int | None = None,
) -> DataFrame:
    """Every spine row with all features of ``specs`` computed from ``events``.

    Where several passes are needed, the daily partials are stored once and all of them read those.
    """
    names = [f.name for f in specs]
    if len(set(names)) != len(names):
        raise ValueError("feature names must be unique")
    passes: list[DataFrame] = []
    out = spine
    groups = _passes(specs, day)
    partials = DailyPartials(events, specs, key, day, store=len(groups) > 1)
    for (kind, day_name), members in groups.items():
        if kind == "distinct":
            passes.append(_distinct(spine, partials, members, key, at, day_name, bin_days))
        elif kind == "history":
            out = _history(out, partials, members, key, at, day_name)
        else:
            passes.append(_windowed(spine, partials, members, key, at, day_name, bin_days))
    for part in passes:
        out = out.join(part, [key, at], "left")
    zero = {"count", "days", "distinct", "any", "sum"}
    filled = []
    for f in specs:
        default = f.fill if f.fill is not None else (0 if f.agg in zero else None)
        column = F.col(f.name)
        if default is not None:
            kind = out.schema[f.name].dataType
            column = F.coalesce(column, F.lit(default).cast(kind))
        filled.append(column.alias(f.name))
    return out.select(*spine.columns, *filled)


def latest_item_states(
    spine: DataFrame,
    events: DataFrame,
    item: str,
    columns: Sequence[str],
    order: Sequence[str],
    key: str = "model_id",
    at: str = "snapshot_date",
    day: str = "event_day",
) -> DataFrame:
    """One row per (spine row, item) with the state of the item's last event before it.

    Events shrink to the last one per (key, item, day); each state then holds until the
    next one, and is matched to the spine dates inside that interval, which travel as
    one bounded array per key. The output is the only thing that grows.
    """
    payload = F.struct(*[F.col(c) for c in columns])
    tie = F.struct(*[F.col(c) for c in order])
    daily = (
        events.where(F.col(key).isNotNull() & F.col(day).isNotNull())
        .groupBy(F.col(key), F.col(item), F.col(day).alias("__day"))
        .agg(F.max_by(payload, tie).alias("__state"))
    )
    chain = Window.partitionBy(key, item).orderBy("__day")
    held = daily.withColumn("__until", F.lead("__day").over(chain))
    dates = spine.groupBy(F.col(key).alias("__key")).agg(
        F.sort_array(F.collect_set(at)).alias("__dates")
    )
    inside = lambda d: (d > F.col("__day")) & (F.col("__until").isNull() | (d <= F.col("__until")))
    return (
        held.join(dates, F.col(key) == F.col("__key"), "inner")
        .select(
            key, item, F.col("__day").alias("state_day"), "__state",
            F.explode(F.filter("__dates", inside)).alias(at),
        )
        .select(key, at, item, "state_day", "__state.*")
    )


def interval_features(
    windows: DataFrame,
    events: DataFrame,
    specs: Sequence[Feature],
    key: str,
    start: str,
    end: str,
    day: str = "event_day",
    bin_days: int = 30,
) -> DataFrame:
    """Every window row with the features of events in its own ``[start, end]`` days.

    Equal (key, start, end) windows are computed once. The ages of the specs are not
    used; a recency counts back from ``end``.
    """
    base = windows.select(key, start, end).distinct()
    plain = [f for f in specs if f.agg != "distinct"]
    partials = DailyPartials(events, plain, key, day, store=False)
    parts = partials.parts
    pairs = interval_join(base, partials.daily(plain, day), key, start, end, "__day", bin_days)
    outputs = []
    for f in plain:
        if f.agg == "stddev":
            known = F.col(parts[_part_keys(f)["known"]])
            outputs.append(_filled(_deviation(F.sort_array(F.collect_list(F.when(known > 0, _moments(parts, f))))), f).alias(f.name))
            continue
        merged = {}
        for kind, ident in _part_keys(f).items():
            part = F.col(parts[ident])
            if f.agg == "days":
                merged[kind] = F.count(F.when(part > 0, 1))
            elif kind in ("rows", "sum", "known"):
                merged[kind] = F.sum(part)
            elif kind in ("max", "min"):
                merged[kind] = (F.max if kind == "max" else F.min)(part)
            elif kind in ("last", "first"):
                known = F.when(part.isNotNull(), F.col("__day"))
                merged[kind] = (F.max_by if kind == "last" else F.min_by)(part, known)
        outputs.append(_finish(f, merged, end).alias(f.name))
    out = pairs.groupBy(key, start, end).agg(*outputs)
    for f in (f for f in specs if f.agg == "distinct"):
        kept = events.where(F.expr(f.when)) if f.when else events
        values = (
            kept.select(key, F.col(day).alias("__day"), F.expr(f.value).alias("__value"))
            .where(F.col("__value").isNotNull() & (F.col("__value").cast("string") != ""))
            .distinct()
        )
        counted = (
            interval_join(base, values, key, start, end, "__day", bin_days)
            .select(key, start, end, "__value").distinct()
            .groupBy(key, start, end).agg(F.count(F.lit(1)).alias(f.name))
        )
        out = out.join(counted, [key, start, end], "left")
    joined = windows.join(out, [key, start, end], "left")
    zero = {"count", "days", "distinct", "any", "sum"}
    columns = []
    for f in specs:
        default = f.fill if f.fill is not None else (0 if f.agg in zero else None)
        column = F.col(f.name)
        if default is not None:
            column = F.coalesce(column, F.lit(default).cast(joined.schema[f.name].dataType))
        columns.append(column.alias(f.name))
    return joined.select(*windows.columns, *columns)


def grouped_features(
    events: DataFrame, specs: Sequence[Feature], keys: Sequence[str], day: str = "event_day"
) -> DataFrame:
    """The same specs as one plain aggregation over groups that do not overlap."""
    outputs = []
    for f in specs:
        value = _guard(F.expr(f.value) if f.value else F.lit(1), f.when)
        if f.agg == "count":
            out = F.count(value if f.value is None else _guard(F.lit(1), f.when))
        elif f.agg == "sum":
            out = F.coalesce(F.sum(value.cast("double")), F.lit(0.0))
        elif f.agg == "mean":
            out = F.avg(value)
        elif f.agg == "stddev":
            out = F.stddev_samp(value)
        elif f.agg == "any":
            out = F.max(_guard(F.lit(1), f.when))
        elif f.agg == "days":
            out = F.count_distinct(_guard(F.col(day), f.when))
        elif f.agg == "distinct":
            out = F.count_distinct(F.when(value.cast("string") != "", value))
        elif f.agg in ("max", "min"):
            out = (F.max if f.agg == "max" else F.min)(value)
        else:
            raise ValueError(f"{f.agg} needs a spine")
        outputs.append(out.alias(f.name))
    return events.groupBy(*keys).agg(*outputs)
