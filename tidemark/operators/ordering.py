"""Row numbers, running sums and quantiles over groups of any size.

A plain window sorts a whole group inside one task. That is fine for groups whose
size the calendar bounds (days of one entity, anchors of one fold), and this package
uses plain windows there. A group of all scored entities has no such bound, so the
functions here sort by range across tasks and add per-piece offsets instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

_POSITION_BITS = 33  # layout of monotonically_increasing_id: partition, then position


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def ordered_scan(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    number: str = "row_number",
    size: str | None = None,
    running: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    few_groups: bool = False,
) -> DataFrame:
    """Number the rows of each group in a total order, for groups of any size.

    ``running`` adds inclusive running sums and ``totals`` whole-group sums. Rows are
    range-partitioned by (group, order), so a hot group spreads over many tasks. The
    placed rows are checkpointed because the offsets and the rows must agree on the
    placement; the offset table has one row per (group, partition). Where the configuration bounds the
    number of groups, ``few_groups`` sends that table to the rows instead of shuffling them once more.
    """
    running, totals = dict(running or {}), dict(totals or {})
    sort = [F.col(c).asc_nulls_first() for c in group] + list(order)
    values = {**running, **{f"__t_{k}": v for k, v in totals.items()}}
    placed = df.select(
        "*", *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(f"__v_{k}") for k, v in values.items()]
    )
    placed = (
        placed.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("__id", F.monotonically_increasing_id())
        .withColumn("__piece", F.shiftright("__id", _POSITION_BITS))
    )
    placed = cut_lineage(placed)
    pieces = placed.groupBy(*group, "__piece").agg(
        F.min("__id").alias("__first"),
        F.count(F.lit(1)).alias("__rows"),
        *[F.sum(f"__v_{k}").alias(f"__s_{k}") for k in values],
    )
    over = Window.partitionBy(*[F.col(c) for c in group]) if group else Window.partitionBy(F.lit(0))
    before = over.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        *group,
        "__piece",
        "__first",
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"),
        F.sum("__rows").over(over).alias("__size"),
        *[F.coalesce(F.sum(f"__s_{k}").over(before), F.lit(0.0)).alias(f"__o_{k}") for k in running],
        *[F.sum(f"__s___t_{k}").over(over).alias(f"__w_{k}") for k in totals],
    )
    renamed = pieces.select(*[F.col(c).alias(f"__p_{c}") for c in pieces.columns])
    match = F.col("__piece") == F.col("__p___piece")
    for name in group:
        match = match & F.col(name).eqNullSafe(F.col(f"__p_{name}"))
    joined = placed.join(F.broadcast(renamed) if few_groups else renamed, match, "inner")
    inside = (
        Window.partitionBy("__piece", *group)
        .orderBy("__id")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = [F.col(c) for c in df.columns]
    out.append((F.col("__id") - F.col("__p___first") + F.col("__p___offset") + 1).alias(number))
    if size:
        out.append(F.col("__p___size").alias(size))
    for name in running:
        out.append((F.sum(f"__v_{name}").over(inside) + F.col(f"__p___o_{name}")).alias(name))
    for name in totals:
        out.append(F.col(f"__p___w_{name}").alias(name))
    return joined.select(*out)


def rank_within(
    df: DataFrame,
    group: Sequence[str],
    score: str,
    tie: Sequence[str],
    rank: str = "rank",
    size: str = "group_size",
) -> DataFrame:
    """Rank by score descending, ties by ``tie`` ascending; adds the group size."""
    order = [F.col(score).desc_nulls_last(), *[F.col(c).asc() for c in tie]]
    return ordered_scan(df, group, order, number=rank, size=size)


def first_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], count: int = 1,
    number: str | None = None,
) -> DataFrame:
    """The first ``count`` rows of each group, ``count`` being a small constant.

    The planner limits each group inside every task before the shuffle, so a hot
    group sends at most ``count`` rows per task.
    """
    name = number or "__row"
    ranked = df.withColumn(
        name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    ).where(F.col(name) <= count)
    return ranked if number else ranked.drop(name)


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, probabilities: Mapping[str, float]
) -> DataFrame:
    """Linear-interpolated quantiles per group for groups of any size.

    Equal values are counted first, inside the map tasks, so a value that fills a third of
    the table is one row from there on. Only the rows that cover a quantile position reach
    the final aggregate.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    )
    scanned = ordered_scan(
        counted, group, [F.col("__value").asc()], number="__row",
        running={"__last": F.col("__n")}, totals={"__size": F.col("__n")},
    )
    outputs, keep = [], F.lit(False)
    covers = lambda place: (place < F.col("__last")) & (place >= F.col("__last") - F.col("__n"))
    for name, p in probabilities.items():
        place = (F.col("__size") - 1) * F.lit(float(p))
        low, high = F.floor(place), F.ceil(place)
        keep = keep | covers(low) | covers(high)
        low_value = F.max(F.when(covers(low), F.col("__value")))
        high_value = F.max(F.when(covers(high), F.col("__value")))
        outputs.append((low_value + (high_value - low_value) * F.max(place - low)).alias(name))
    picked = scanned.where(keep)
    return picked.groupBy(*group).agg(*outputs)


#: Cells of the histogram of one range.
CELLS = 2048


def values_at_ranks(df: DataFrame, ranks: Mapping[str, Sequence[int]], cells: int = CELLS) -> dict[tuple[str, int], tuple[float, int]]:
    """The value at each wanted 0-based rank of many double columns, and how many values are smaller. NULL and NaN do not count.

    Ranges are refined instead of sorting rows times columns. Each pass adds up, inside the map tasks, a histogram of
    every range that still holds a wanted rank, with the least and greatest value of each cell; the cell that holds
    the rank is the next range. A cell of one value is exact. Cells divide the doubles by their order and not by their
    size, so any 64-bit values are told apart after six passes or fewer. What is shuffled is columns times ``cells`` rows
    a task and what reaches the driver is one row a rank.
    """
    names = [c for c, r in ranks.items() if r]
    if not names:
        return {}
    ends = df.agg(*[f(F.when(~F.isnan(c), F.col(c))).alias(f"{n}{i}") for i, c in enumerate(names) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    open_ranges = {(c, r): (ends[f"lo{i}"], ends[f"hi{i}"], 0) for i, c in enumerate(names) for r in ranks[c] if ends[f"lo{i}"] is not None}
    found: dict[tuple[str, int], tuple[float, int]] = {}
    while True:
        found |= {k: (lo, before) for k, (lo, hi, before) in open_ranges.items() if lo == hi}
        open_ranges = {k: x for k, x in open_ranges.items() if x[0] != x[1]}
        if not open_ranges:
            return found
        spans = sorted({(c, lo, hi, before) for (c, _), (lo, hi, before) in open_ranges.items()})
        picked = _cells_of_ranks(df, names, spans, [(spans.index((c, *x)), c, r) for (c, r), x in open_ranges.items()], cells)
        open_ranges = {(c, r): picked[c, r] for c, r in open_ranges}


def _place(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles ``x``."""
    bits = x.view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _cells_of_ranks(df, names, spans, wanted, cells):
    """(least value, greatest value, smaller values) of the histogram cell with each wanted rank; one pass."""
    at = {c: i for i, c in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(spans), cells), dtype=np.int64)
        least, most = np.full((len(spans), cells), np.inf), np.full((len(spans), cells), -np.inf)
        for batch in batches:
            columns = {c: batch.column(at[c]).to_numpy(zero_copy_only=False).astype(np.float64) for c in {s[0] for s in spans}}
            for k, (c, lo, hi, _) in enumerate(spans):
                x = columns[c]
                x = x[(x >= lo) & (x <= hi)] + 0.0
                first, last = (int(v) for v in _place(np.array([lo, hi]) + 0.0))
                cell = ((_place(x) - np.uint64(first)) // np.uint64((last - first) // cells + 1)).astype(np.int64)
                np.add.at(count[k], cell, 1)
                np.minimum.at(least[k], cell, x)
                np.maximum.at(most[k], cell, x)
        k, cell = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (k, cell, count[k, cell], least[k, cell], most[k, cell])], ["span", "cell", "n", "lo", "hi"])

    partial = df.select(*names).mapInArrow(run, "span long, cell long, n long, lo double, hi double")
    merged = partial.groupBy("span", "cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    spark = df.sparkSession
    before = spark.createDataFrame([(i, int(s[3])) for i, s in enumerate(spans)], "span long, before long")
    asked = spark.createDataFrame([(int(i), c, int(r)) for i, c, r in wanted], "span long, name string, rank long")
    # a span has at most ``cells`` rows
    running = F.sum("n").over(Window.partitionBy("span").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = merged.withColumn("upto", running).join(F.broadcast(before), "span").withColumn("upto", F.col("upto") + F.col("before"))
    hit = placed.join(F.broadcast(asked), "span").where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    return {(r["name"], r["rank"]): (r["lo"], r["hi"], r["upto"] - r["n"]) for r in hit.collect()}


def column_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Mapping[str, float]) -> DataFrame:
    """Linear-interpolated quantiles of many double columns: ``feature`` and one column per probability."""
    counts = df.agg(*[F.count(F.when(~F.isnan(c), F.col(c))).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    places = {(c, name): (counts[f"n{i}"] - 1) * p for i, c in enumerate(columns) for name, p in probabilities.items() if counts[f"n{i}"]}
    ranks: dict[str, set[int]] = {}
    for (c, _), place in places.items():
        ranks.setdefault(c, set()).update((math.floor(place), math.ceil(place)))
    at = values_at_ranks(df, {c: sorted(r) for c, r in ranks.items()})

    def value(c: str, name: str) -> float | None:
        if (c, name) not in places:
            return None
        place = places[c, name]
        low, high = at[c, math.floor(place)][0], at[c, math.ceil(place)][0]
        return low + (high - low) * (place - math.floor(place))

    rows = [(c, *[value(c, name) for name in probabilities]) for c in columns]
    return df.sparkSession.createDataFrame(rows, "feature string, " + ", ".join(f"{n} double" for n in probabilities))
