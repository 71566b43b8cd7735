"""Evaluation of scores as distributed aggregates.

Ranking metrics use ``ordered_scan``, so a scored fleet of any size is ranked across
tasks. Metrics that depend on the score alone first collapse equal scores into one row.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import brier_term, clipped, log_loss_term, wilson_high, wilson_low
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tidemark.operators.ordering import exact_quantiles, first_per_group, ordered_scan, rank_within
from tidemark.session import cut_lineage

# ------------------------------------------------------------------ ranking


def ranked_fleet(
    df: DataFrame, group: Sequence[str], score: str, key: str = "machine_key",
    rates: Sequence[float] = (), counts: Sequence[int] = (), rank: str = "rank_within_anchor",
) -> DataFrame:
    """Rank, fleet size, top fraction, 0-100 rank scale and selection flags."""
    out = rank_within(df, group, score, [key], rank, "eligible_machines_at_anchor")
    r, n = F.col(rank), F.col("eligible_machines_at_anchor")
    flags = {f"selected_top_{round(v * 100)}pct": (r <= top_count(n, v)).cast("int") for v in rates}
    flags |= {f"selected_top_n_{c}": (r <= c).cast("int") for c in counts}
    return out.withColumns(
        {
            "score_top_fraction": r / n,
            "rank_scale_0_100": F.lit(100.0) * (n - r) / F.greatest(n - 1, F.lit(1)),
            "score_decile_from_top": decile_from_top(r, n),
            **flags,
        }
    )


def top_count(size: Column, rate: float) -> Column:
    """``ceil(size * rate)``, at least one."""
    return F.greatest(F.ceil(size * F.lit(float(rate))), F.lit(1))


def decile_from_top(rank: Column, size: Column) -> Column:
    """1 for the highest tenth of the ranks, 10 for the lowest."""
    return F.least(F.floor((rank - 1) * 10 / size) + 1, F.lit(10)).cast("int")


def decile_by_percent_rank(rank_ascending: Column, size: Column) -> Column:
    """10 for the highest scores: rounded-up tenth of the ascending percent rank."""
    return F.greatest(F.least(F.ceil(rank_ascending / size * F.lit(10)), F.lit(10)), F.lit(1)).cast("int")


def prediction_outcome(label: Column, predicted: Column) -> Column:
    """TP, FP, FN or TN."""
    return (
        F.when((label == 1) & (predicted == 1), "TP")
        .when((label == 0) & (predicted == 1), "FP")
        .when((label == 1) & (predicted == 0), "FN")
        .otherwise("TN")
    )


# ------------------------------------------------------------------ rates
def rate_columns(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Precision, recall, F1, F2 and flagged rate; zero where a denominator is zero."""
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    f_beta = lambda b2: safe((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp)
    return {
        "precision": safe(tp, tp + fp),
        "recall": safe(tp, tp + fn),
        "f1": f_beta(1.0),
        "f2": f_beta(4.0),
        "flagged_rate": safe(tp + fp, tp + fp + fn + tn),
    }


def threshold_metrics(
    df: DataFrame, group: Sequence[str], score: str, label: str, threshold: float | Column
) -> DataFrame:
    """Confusion counts and rates of ``score >= threshold`` per group."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit, pos = F.col(score) >= limit, F.col(label) == 1
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    counted = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"),
        total(pos).alias("positive_count"),
        total(hit & pos).alias("true_positive"),
        total(hit & ~pos).alias("false_positive"),
        total(~hit & ~pos).alias("true_negative"),
        total(~hit & pos).alias("false_negative"),
    )
    c = F.col
    return counted.withColumns(
        {
            "flagged_count": c("true_positive") + c("false_positive"),
            **rate_columns(c("true_positive"), c("false_positive"), c("false_negative"), c("true_negative")),
        }
    )


def score_counts(
    df: DataFrame, group: Sequence[str], score: str, label: str, weight: Column | None = None
) -> DataFrame:
    """Positives and rows per distinct score: columns ``pos`` and ``n``."""
    w = F.lit(1) if weight is None else weight
    return df.where(F.col(score).isNotNull()).groupBy(*group, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(F.lit(0))).alias("pos"), F.sum(w).alias("n")
    )


def _packed_runs(group: list[str]):
    """(group, pos, n, __piece) by falling score as one row with arrays for each group of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.zeros(batch.num_rows, dtype=np.int64)
            for g in group:
                more = batch.column(g).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                code = np.unique(code * (int(more.max()) + 1) + more, return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.diff(code[order], prepend=-1))
            ends = pa.array(np.append(first, batch.num_rows).astype(np.int32))
            pos, n = (batch.column(k).to_numpy()[order] for k in ("pos", "n"))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(g).take(pa.array(order[first])) for g in (*group, "__piece")],
                    *[pa.array(np.add.reduceat(v, first)) for v in (pos, n)],
                    *[pa.ListArray.from_arrays(ends, pa.array(v)) for v in (pos, n)],
                ],
                [*group, "__piece", "__pos", "__n", "__positives", "__rows"],
            )

    return run


def _run_sums(group: list[str]):
    """Sums of both ranking metrics over each packed row, given the positives and rows before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column("__rows").value_lengths().to_numpy().astype(np.int64)
            first = np.cumsum(sizes) - sizes

            def upto(values: np.ndarray, before: str) -> np.ndarray:
                """Running sums within each row, from its offset on."""
                total = np.cumsum(values)
                return total + np.repeat(batch.column(before).to_numpy() - (total[first] - values[first]), sizes)

            pos, n = (batch.column(k).flatten().to_numpy() for k in ("__positives", "__rows"))
            tp, seen = upto(pos, "__pos_before"), upto(n, "__n_before")
            part = np.divide(pos * tp, seen, out=np.zeros_like(pos), where=seen != 0)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(g) for g in (*group, "__pos", "__n")],
                    pa.array(np.add.reduceat((n - pos) * (tp - pos / 2), first)), pa.array(np.add.reduceat(part, first)),
                ],
                [*group, "__pos", "__n", "__auc", "__ap"],
            )

    return run


def auc_ap(
    df: DataFrame, group: Sequence[str], score: str, label: str, weight: Column | None = None
) -> DataFrame:
    """ROC AUC and average precision per group, ties counted as ties; NULL for one class.

    Distinct scores are sorted by range and stored as arrays, one row a group and batch. The rows' sums give
    the offsets, and a second pass over the arrays adds up both metrics.
    """
    counted = score_counts(df, group, score, label, weight)
    sort = [*[F.col(g).asc_nulls_first() for g in group], F.col("score").desc()]
    number = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0)).alias(name)
    # scores first: a sort by groups would compare whole rows
    placed = counted.repartitionByRange(*sort).sortWithinPartitions(F.col("score").desc(), *group).select(
        *group, number("pos"), number("n"), F.monotonically_increasing_id().alias("__piece")
    )
    kept = [placed.schema[g] for g in group]
    runs = StructType([
        *kept, StructField("__piece", LongType()), StructField("__pos", DoubleType()), StructField("__n", DoubleType()),
        StructField("__positives", ArrayType(DoubleType(), False)), StructField("__rows", ArrayType(DoubleType(), False)),
    ])
    # both passes must see the same pieces
    packed = cut_lineage(placed.mapInArrow(_packed_runs(list(group)), runs))
    over = Window.partitionBy(*[F.col(g) for g in group]) if group else Window.partitionBy(F.lit(0))
    before = over.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = packed.select("__piece", *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0.0)).alias(f"__{k}_before") for k in ("pos", "n")])
    added = StructType([*kept, *[StructField(k, DoubleType()) for k in ("__pos", "__n", "__auc", "__ap")]])
    c = F.col
    sums = packed.join(offsets, "__piece").mapInArrow(_run_sums(list(group)), added).groupBy(*group).agg(
        F.sum("__n").cast("long").alias("rows"), F.sum("__pos").cast("long").alias("positive_count"),
        F.sum("__auc").alias("__auc"), F.sum("__ap").alias("__ap"),
    )
    pos, neg = c("positive_count"), c("rows") - c("positive_count")
    both = (pos > 0) & (neg > 0)
    return sums.select(
        *group, "rows", "positive_count", (pos / c("rows")).alias("positive_rate"),
        F.when(both, c("__auc") / (pos * neg)).alias("roc_auc"),
        F.when(both, c("__ap") / pos).alias("average_precision"),
    )


# ------------------------------------------------------------------ top selections
def selections(rates: Sequence[float] = (), counts: Sequence[int] = ()) -> list[tuple[str, float]]:
    """Selection rules as (type, value) pairs."""
    return [("top_k_fraction", float(r)) for r in rates] + [("top_n", float(c)) for c in counts]


def selected_count(size: Column, kind: str, value: float) -> Column:
    return top_count(size, value) if kind == "top_k_fraction" else F.least(F.lit(int(value)), size)


def selection_metrics(
    ranked: DataFrame, group: Sequence[str], rules: Sequence[tuple[str, float]], label: str,
    score: str, rank: str = "rank_within_anchor", size: str = "eligible_machines_at_anchor",
) -> DataFrame:
    """Precision, recall, lift and smallest score of every top-k or top-n rule per group."""
    pos = F.col(label) == 1
    aggregates = []
    for i, (kind, value) in enumerate(rules):
        inside = F.col(rank) <= selected_count(F.col(size), kind, value)
        aggregates += [
            F.sum((inside & pos).cast("long")).alias(f"__tp{i}"),
            F.sum(inside.cast("long")).alias(f"__k{i}"),
            F.min(F.when(inside, F.col(score))).alias(f"__min{i}"),
        ]
    wide = ranked.groupBy(*group).agg(
        F.count(F.lit(1)).alias("eligible_machines"), F.sum(pos.cast("long")).alias("positive_machines"), *aggregates
    )
    rows = F.array(*[
        F.struct(
            F.lit(kind).alias("selection_type"), F.lit(value).alias("selection_value"),
            F.col(f"__k{i}").alias("selected_machines"), F.col(f"__tp{i}").alias("true_positive_machines"),
            F.col(f"__min{i}").alias("minimum_score_selected"),
        )
        for i, (kind, value) in enumerate(rules)
    ])
    long = wide.select(*group, "eligible_machines", "positive_machines", F.explode(rows).alias("__s")).select(
        *group, "eligible_machines", "positive_machines", "__s.*"
    )
    c = F.col
    precision = F.try_divide(c("true_positive_machines").cast("double"), c("selected_machines").cast("double"))
    base = F.try_divide(c("positive_machines").cast("double"), c("eligible_machines").cast("double"))
    return long.withColumns(
        {
            "false_positive_machines": c("selected_machines") - c("true_positive_machines"),
            "precision": precision,
            "recall": F.try_divide(c("true_positive_machines").cast("double"), c("positive_machines").cast("double")),
            "fleet_positive_rate": base,
            "lift_vs_fleet": F.try_divide(precision, base),
        }
    )


def anchor_selection_rows(
    ranked: DataFrame, group: Sequence[str], rules: Sequence[tuple[str, float]], label: str, score: str,
    calibrated: str, days: str, rank: str = "rank_within_anchor", size: str = "eligible_machines_at_anchor",
) -> DataFrame:
    """Selection metrics with Wilson intervals, calibrated mean and median, and days to event.

    Each selected row is listed once per rule that takes it, and the medians come from
    exact distributed quantiles over those lists.
    """
    base = selection_metrics(ranked, group, rules, label, score, rank, size)
    tagged = F.array(*[
        F.when(
            F.col(rank) <= selected_count(F.col(size), kind, value),
            F.struct(F.lit(kind).alias("selection_type"), F.lit(value).alias("selection_value")),
        )
        for kind, value in rules
    ])
    members = ranked.withColumn("__rule", F.explode(F.filter(tagged, lambda x: x.isNotNull()))).select(
        *group, "__rule.*", F.col(calibrated).alias("__p"),
        F.when(F.col(label) == 1, F.col(days)).alias("__d"),
    )
    keys = [*group, "selection_type", "selection_value"]
    means = members.groupBy(*keys).agg(F.avg("__p").alias("mean_calibrated_probability_selected"))
    p50 = exact_quantiles(members, keys, "__p", {"median_calibrated_probability_selected": 0.5})
    d50 = exact_quantiles(members, keys, "__d", {"median_days_to_failure_selected_positives": 0.5})
    tp, k, pos = F.col("true_positive_machines"), F.col("selected_machines"), F.col("positive_machines")
    return (
        base.join(means, keys, "left").join(p50, keys, "left").join(d50, keys, "left")
        .withColumns(
            {
                "precision_ci95_low": wilson_low(tp, k), "precision_ci95_high": wilson_high(tp, k),
                "recall_ci95_low": wilson_low(tp, pos), "recall_ci95_high": wilson_high(tp, pos),
            }
        )
    )


def anchor_evaluation(
    df: DataFrame, group: Sequence[str], score: str, calibrated: str, label: str, threshold: float
) -> DataFrame:
    """One row per anchor: ranking, probability and threshold quality."""
    y, p = F.col(label).cast("double"), F.col(calibrated)
    quality = df.groupBy(*group).agg(
        F.avg(brier_term(y, p)).alias("__brier"), F.avg(log_loss_term(y, p)).alias("__loss"),
        F.avg(p).alias("mean_calibrated_probability"),
    )
    at = threshold_metrics(df, group, calibrated, label, threshold).select(
        *group, F.col("flagged_count").alias("threshold_flagged_machines"),
        F.col("flagged_rate").alias("threshold_flagged_rate"),
        *[F.col(c).alias(f"threshold_{c}") for c in ("precision", "recall", "f1", "f2")],
    )
    out = auc_ap(df, group, score, label).join(quality, list(group)).join(at, list(group))
    both = F.col("roc_auc").isNotNull()
    return out.withColumns(
        {
            "negative_count": F.col("rows") - F.col("positive_count"),
            "brier_score": F.when(both, F.col("__brier")), "log_loss": F.when(both, F.col("__loss")),
        }
    ).drop("__brier", "__loss")


def pooled_selection(rows: DataFrame, group: Sequence[str], anchor: str = "anchor_id") -> DataFrame:
    """Pooled (micro) rates and the spread over anchors, per selection rule.

    A group here holds one row per anchor, so the built-in exact median is bounded.
    """
    c = F.col
    sums = rows.groupBy(*group).agg(
        F.count_distinct(anchor).alias("anchor_count"),
        F.sum("eligible_machines").alias("total_eligible"),
        F.sum("positive_machines").alias("total_positive"),
        F.sum("selected_machines").alias("total_selected"),
        F.sum("true_positive_machines").alias("total_true_positive"),
        F.avg("precision").alias("mean_anchor_precision"),
        F.expr("percentile(precision, 0.5)").alias("median_anchor_precision"),
        F.min("precision").alias("minimum_anchor_precision"),
        F.max("precision").alias("maximum_anchor_precision"),
        F.coalesce(F.stddev_samp("precision"), F.lit(0.0)).alias("std_anchor_precision"),
        F.avg("recall").alias("mean_anchor_recall"),
        F.avg("lift_vs_fleet").alias("mean_anchor_lift"),
    )
    div = lambda a, b: F.try_divide(c(a).cast("double"), c(b).cast("double"))
    precision = div("total_true_positive", "total_selected")
    base = div("total_positive", "total_eligible")
    return sums.withColumns(
        {
            "micro_precision": precision,
            "micro_precision_ci95_low": wilson_low(c("total_true_positive"), c("total_selected")),
            "micro_precision_ci95_high": wilson_high(c("total_true_positive"), c("total_selected")),
            "micro_recall": div("total_true_positive", "total_positive"),
            "natural_positive_rate": base,
            "micro_lift_vs_fleet": F.try_divide(precision, base),
        }
    )


# ------------------------------------------------------------------ deciles
def decile_table(
    ranked: DataFrame, group: Sequence[str], label: str, score: str,
    rank: str = "rank_within_anchor", size: str = "eligible_machines_at_anchor",
) -> DataFrame:
    """Rows, positives, rate, lift and score range per tenth from the top."""
    tenth = ranked.withColumn("score_decile_from_top", decile_from_top(F.col(rank), F.col(size)))
    return _lift_table(tenth, group, "score_decile_from_top", label, score)


def risk_decile_table(df: DataFrame, group: Sequence[str], score: str, label: str, key: str) -> DataFrame:
    """The same table with 10 as the highest tenth of the ascending percent rank."""
    scanned = ordered_scan(df, group, [F.col(score).asc(), F.col(key).asc()], "__rank", "__size")
    tenth = scanned.withColumn("risk_decile", decile_by_percent_rank(F.col("__rank"), F.col("__size")))
    return _lift_table(tenth, group, "risk_decile", label, score)


def _lift_table(tenth, group, name, label, score):
    y = F.col(label).cast("double")
    per = tenth.groupBy(*group, name).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col(label).cast("long")).alias("positive_rows"),
        F.avg(y).alias("positive_rate"), F.min(score).alias("min_score"), F.max(score).alias("max_score"),
    )
    # at most ten rows per group from here on
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    overall = F.sum("positive_rows").over(over) / F.sum("rows").over(over)
    return per.withColumn("overall_rate", overall).withColumn(
        "lift", F.try_divide(F.col("positive_rate"), F.col("overall_rate"))
    )


# ------------------------------------------------------------------ calibration
def bin_edges(bins: int) -> list[float]:
    """Equal-width edges as the doubles ``i * (1 / bins)``, the last exactly one."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def bin_number(value: Column, bins: int) -> Column:
    """1 to ``bins``: right-open bins, the last one closed."""
    inner = bin_edges(bins)[1:-1]
    return sum(((value >= F.lit(e)).cast("int") for e in inner), F.lit(1))


def calibration_bins(
    df: DataFrame, group: Sequence[str], label: str, probability: str, bins: int = 10
) -> DataFrame:
    """Rows, mean probability, observed rate and gap of every bin, empty bins included."""
    p = F.least(F.greatest(F.col(probability), F.lit(0.0)), F.lit(1.0))
    filled = df.select(*group, F.col(label).cast("double").alias("__y"), p.alias("__p")).withColumn(
        "bin_number", bin_number(F.col("__p"), bins)
    ).groupBy(*group, "bin_number").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("__p").alias("mean_probability"),
        F.avg("__y").alias("observed_positive_rate"),
    )
    edges = bin_edges(bins)
    listed = F.array(*[
        F.struct(F.lit(i + 1).alias("bin_number"), F.lit(edges[i]).alias("bin_lower"), F.lit(edges[i + 1]).alias("bin_upper"))
        for i in range(bins)
    ])
    groups = filled.select(*group).distinct() if group else filled.agg(F.lit(1).alias("__one"))
    frame = groups.select(*group, F.explode(listed).alias("__b")).select(*group, "__b.*")
    return frame.join(filled, [*group, "bin_number"], "left").withColumns(
        {
            "rows": F.coalesce(F.col("rows"), F.lit(0)),
            "absolute_calibration_gap": F.abs(F.col("mean_probability") - F.col("observed_positive_rate")),
        }
    )


def calibration_quality(
    df: DataFrame, group: Sequence[str], label: str, probability: str, bins: int = 10
) -> DataFrame:
    """Brier score, log loss, expected calibration error and means per group."""
    y, p = F.col(label).cast("double"), clipped(F.col(probability), 1e-12)
    base = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(brier_term(y, p)).alias("brier"),
        F.avg(log_loss_term(y, p, 1e-12)).alias("log_loss"), F.avg(p).alias("mean_probability"),
        F.avg(y).alias("observed_positive_rate"),
    )
    gaps = calibration_bins(df, group, label, probability, bins).groupBy(*group).agg(
        (F.sum(F.col("rows") * F.col("absolute_calibration_gap")) / F.sum("rows")).alias("ece")
    )
    return base.join(gaps, list(group)) if group else base.join(F.broadcast(gaps))


# ------------------------------------------------------------------ thresholds
def quantile_curve(df: DataFrame, group: Sequence[str], value: str, points: int) -> DataFrame:
    """Linear quantiles at ``points`` even levels per group: columns ``point``, ``quantile``."""
    # equal values are one row from here on
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    rows = ordered_scan(
        counted, group, [F.col("__v").asc()], "__row", running={"__last": F.col("__n")}, totals={"__size": F.col("__n")}
    ).withColumn("__before", F.col("__last") - F.col("__n"))
    # a value covers the ranks from __before to __last - 1, hence a stretch of neighbouring levels
    step = (F.col("__size") - 1) / F.lit(points - 1)
    first = F.when(step > 0, F.greatest(F.floor(F.col("__before") / step) - 1, F.lit(0))).otherwise(0).cast("int")
    last = F.when(step > 0, F.least(F.ceil(F.col("__last") / step) + 1, F.lit(points - 1))).otherwise(points - 1).cast("int")
    covered = lambda place: (place >= F.col("__before")) & (place < F.col("__last"))
    met = rows.withColumn("point", F.explode(F.sequence(first, last))).withColumn(
        "__at", (F.col("__size") - 1) * (F.col("point") / F.lit(points - 1))
    ).where(covered(F.floor("__at")) | covered(F.ceil("__at")))
    low = F.max(F.when(covered(F.floor("__at")), F.col("__v")))
    high = F.max(F.when(covered(F.ceil("__at")), F.col("__v")))
    return met.groupBy(*group, "point").agg((low + (high - low) * F.max(F.col("__at") - F.floor("__at"))).alias("quantile"))


def candidate_thresholds(
    df: DataFrame, group: Sequence[str], probability: str, grid: int = 1001, low: float = 0.0, high: float = 1.0
) -> DataFrame:
    """Distinct quantiles of the scores with both bounds, clipped to them."""
    curve = quantile_curve(df, group, probability, grid)
    value = F.least(F.greatest(F.col("quantile"), F.lit(low)), F.lit(high))
    bounds = curve.where("point = 0").select(*group, F.explode(F.array(F.lit(low), F.lit(high))).alias("threshold"))
    return curve.select(*group, value.alias("threshold")).unionByName(bounds).distinct()


def uniform_thresholds(df: DataFrame, group: Sequence[str], low: float, high: float, grid: int) -> DataFrame:
    """Evenly spaced thresholds for every group."""
    step = (high - low) / (grid - 1)
    values = F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: F.lit(low) + i * F.lit(step))
    groups = df.select(*group).distinct() if group else df.agg(F.lit(1).alias("__one"))
    return groups.select(*group, F.explode(values).alias("threshold"))


def threshold_curve(
    df: DataFrame, group: Sequence[str], probability: str, label: str, thresholds: DataFrame
) -> DataFrame:
    """Confusion counts and rates at every threshold from one sorted pass.

    Scores (one row per distinct value) and thresholds are sorted together; the running
    sums at a threshold are its true and false positives.
    """
    counts = score_counts(df, group, probability, label).select(
        *group, F.col("score").alias("__v"), F.lit(0).alias("__side"), "pos", "n"
    )
    marks = thresholds.select(
        *group, F.col("threshold").alias("__v"), F.lit(1).alias("__side"),
        F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"),
    )
    scanned = ordered_scan(
        counts.unionByName(marks), group, [F.col("__v").desc(), F.col("__side").asc()],
        running={"tp": F.col("pos"), "seen": F.col("n")},
        totals={"all_pos": F.col("pos"), "all_rows": F.col("n")},
    ).where("__side = 1")
    c = lambda n: F.col(n).cast("long")
    out = scanned.select(
        *group, F.col("__v").alias("threshold"), c("tp").alias("true_positive"),
        (c("seen") - c("tp")).alias("false_positive"),
        (c("all_pos") - c("tp")).alias("false_negative"),
        (c("all_rows") - c("all_pos") - c("seen") + c("tp")).alias("true_negative"),
    )
    return out.withColumns(
        {
            "flagged_rows": F.col("true_positive") + F.col("false_positive"),
            **rate_columns(*[F.col(n) for n in ("true_positive", "false_positive", "false_negative", "true_negative")]),
        }
    )


# Order of preference among equal metric values.
TIE_BREAKS = {
    "higher_precision": (("precision", False), ("recall", False), ("threshold", False)),
    "higher_recall": (("recall", False), ("precision", False), ("threshold", True)),
    "lower_threshold": (("threshold", True),),
    "higher_threshold": (("threshold", False),),
}


def best_threshold(
    curve: DataFrame, group: Sequence[str], metric: str = "f1", tie: str = "higher_precision"
) -> DataFrame:
    """The threshold with the best metric per group."""
    order = [F.col(metric).desc()] + [F.col(c).asc() if up else F.col(c).desc() for c, up in TIE_BREAKS[tie]]
    return _pick(curve, group, order)


def best_capped_threshold(
    curve: DataFrame, group: Sequence[str], max_flagged_rate: float | None, metric: str = "f2"
) -> DataFrame:
    """The best threshold within a flagged-rate limit; without one inside it, of all."""
    within = F.lit(True) if max_flagged_rate is None else F.col("flagged_rate") <= max_flagged_rate
    marked = curve.withColumn("within_max_flagged_rate", within)
    order = [
        F.col("within_max_flagged_rate").desc(), F.col(metric).desc(), F.col("recall").desc(),
        F.col("precision").desc(), F.col("flagged_rate").asc(), F.col("threshold").asc(),
    ]
    return _pick(marked, group, order)


def _pick(df, group, order):
    if group:
        return first_per_group(df, group, order)
    return df.orderBy(*order).limit(1)


def max_fpr_threshold(
    negatives: DataFrame, group: Sequence[str], score: str, targets: Sequence[float]
) -> DataFrame:
    """Smallest score whose share of negatives at or above it stays within each target.

    NULL ``threshold`` with ``above_all`` = 1 means that only a value above every
    negative score keeps the target.
    """
    counts = negatives.where(F.col(score).isNotNull()).groupBy(
        *group, F.col(score).cast("double").alias("__v")
    ).agg(F.count(F.lit(1)).alias("n"))
    scanned = ordered_scan(
        counts, group, [F.col("__v").desc()], running={"seen": F.col("n")}, totals={"all_rows": F.col("n")}
    )
    fpr = F.col("seen") / F.col("all_rows")
    best = scanned.groupBy(*group).agg(
        *[F.min(F.when(fpr <= F.lit(t + 1e-12), F.col("__v"))).alias(f"__t{i}") for i, t in enumerate(targets)],
        F.max("__v").alias("largest_negative_score"),
    )
    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("target_max_negative_fpr"), F.col(f"__t{i}").alias("threshold"))
        for i, t in enumerate(targets)
    ])
    return best.select(*group, "largest_negative_score", F.explode(rows).alias("__r")).select(
        *group, "__r.*", "largest_negative_score", F.col("__r.threshold").isNull().cast("int").alias("above_all")
    )


def ppv_from_rates(tpr: Column, fpr: Column, prevalence: float) -> Column:
    """Precision at an assumed prevalence; NULL without selections."""
    hit = F.lit(prevalence) * tpr
    return F.try_divide(hit, hit + F.lit(1.0 - prevalence) * fpr)


def separation_at_thresholds(
    df: DataFrame, group: Sequence[str], score: str, label: str, thresholds: DataFrame,
    prevalences: Sequence[float] = (0.01, 0.05), on: Sequence[str] = (),
) -> DataFrame:
    """True and false positive rates, likelihood ratio and assumed-prevalence precision.

    ``thresholds`` is a table with ``threshold`` and the columns ``on`` to match. Scores (one row per distinct
    value) and thresholds are sorted together; a row without a score is never captured.
    """
    groups = df.select(*group).distinct() if group else None
    listed = thresholds.select(*on, "threshold").distinct()
    marks = listed if groups is None else groups.join(listed, list(on)) if on else groups.crossJoin(listed)
    known = df.withColumn(score, F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))))
    curve = threshold_curve(known, group, score, label, marks.select(*group, "threshold"))
    out = curve.select(
        *group, "threshold", (F.col("true_positive") + F.col("false_negative")).alias("positive_rows"),
        (F.col("false_positive") + F.col("true_negative")).alias("negative_rows"),
        F.col("true_positive").alias("captured_positive_rows"), F.col("false_positive").alias("false_positive_rows"),
    )
    c = lambda n: F.col(n).cast("double")
    tpr = F.try_divide(c("captured_positive_rows"), c("positive_rows"))
    fpr = F.try_divide(c("false_positive_rows"), c("negative_rows"))
    return out.withColumns(
        {
            "tpr": tpr, "fpr": fpr,
            "sample_precision": F.try_divide(c("captured_positive_rows"), c("captured_positive_rows") + c("false_positive_rows")),
            "likelihood_ratio": F.try_divide(tpr, fpr),
            **{f"precision_at_prevalence_{str(p).replace('.', 'p')}": ppv_from_rates(tpr, fpr, p) for p in prevalences},
        }
    )


def validation_thresholds_on_splits(
    df: DataFrame, group: Sequence[str], score: str, label: str, targets: Sequence[float],
    split: str = "split", validation: str = "validation",
) -> DataFrame:
    """Thresholds chosen on validation negatives, applied unchanged to every split."""
    chosen = max_fpr_threshold(
        df.where((F.col(split) == validation) & (F.col(label) == 0)), group, score, targets
    ).where(F.col("threshold").isNotNull())
    rates = separation_at_thresholds(df, [*group, split], score, label, chosen, on=group)
    return chosen.select(*group, "target_max_negative_fpr", "threshold").join(rates, [*group, "threshold"])


# ------------------------------------------------------------------ distributions
def score_distribution(
    df: DataFrame, group: Sequence[str], score: str, key: str, thresholds: Sequence[float] = ()
) -> DataFrame:
    """Moments, exact quantiles and counts at or above review thresholds per group."""
    plain = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("unique_machines"),
        F.avg(score).alias("mean_score"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("std_score"),
        F.min(score).alias("minimum_score"), F.max(score).alias("maximum_score"),
        F.avg(F.col(score) * F.col(score)).alias("mean_squared_score_against_zero"),
        *[F.sum((F.col(score) >= t).cast("long")).alias(f"rows_score_ge_{str(t).replace('.', 'p')}") for t in thresholds],
    )
    levels = {"p01_score": 0.01, "p05_score": 0.05, "p10_score": 0.10, "p25_score": 0.25, "median_score": 0.5,
              "p75_score": 0.75, "p90_score": 0.90, "p95_score": 0.95, "p99_score": 0.99}
    return plain.join(exact_quantiles(df, group, score, levels), list(group))


def score_histogram(df: DataFrame, group: Sequence[str], score: str, bins: int = 20) -> DataFrame:
    """Rows and share per equal-width bin of [0, 1], empty bins included.

    Values outside [0, 1] fall in no bin but count in the denominator.
    """
    known = df.where(F.col(score).isNotNull())
    totals = known.groupBy(*group).agg(F.count(F.lit(1)).alias("__all"))
    filled = known.where(F.col(score).between(0.0, 1.0)).groupBy(*group, bin_number(F.col(score), bins).alias("bin_number")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    edges = bin_edges(bins)
    listed = F.array(*[
        F.struct(F.lit(i + 1).alias("bin_number"), F.lit(edges[i]).alias("score_bin_lower"), F.lit(edges[i + 1]).alias("score_bin_upper"))
        for i in range(bins)
    ])
    frame = totals.withColumn("__b", F.explode(listed)).select(*group, "__all", "__b.*")
    return frame.join(filled, [*group, "bin_number"], "left").select(
        *group, "bin_number", "score_bin_lower", "score_bin_upper",
        F.coalesce(F.col("rows"), F.lit(0)).alias("rows"),
        (F.coalesce(F.col("rows"), F.lit(0)) / F.col("__all")).alias("fraction_within_group"),
    )


def capture_by_threshold(
    positives: DataFrame, group: Sequence[str], score: str, days: str, thresholds: Sequence[float]
) -> DataFrame:
    """Captured and missed positives with the lead time of both, per review threshold."""
    spread = positives.withColumn("score_threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).withColumn(
        "__hit", F.col(score) >= F.col("score_threshold")
    )
    keys = [*group, "score_threshold"]
    hit = F.col("__hit")
    plain = spread.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("positive_rows"), F.sum(hit.cast("long")).alias("captured_positive_rows"),
        F.avg(hit.cast("double")).alias("positive_capture_rate"),
        F.avg(F.when(hit, F.col(days))).alias("mean_days_to_claim_captured"),
        F.avg(F.when(~hit, F.col(days))).alias("mean_days_to_claim_missed"),
    ).withColumn("missed_positive_rows", F.col("positive_rows") - F.col("captured_positive_rows"))
    medians = exact_quantiles(spread, [*keys, "__hit"], days, {"__m": 0.5}).groupBy(*keys).agg(
        F.max(F.when(hit, F.col("__m"))).alias("median_days_to_claim_captured"),
        F.max(F.when(~hit, F.col("__m"))).alias("median_days_to_claim_missed"),
    )
    return plain.join(medians, keys, "left")


def claim_timing(
    selected: DataFrame, group: Sequence[str], days: str, horizons: Sequence[int], horizon: int
) -> DataFrame:
    """Observed events, median days and counts within each horizon of selected rows."""
    d = F.col(days)
    plain = selected.groupBy(*group).agg(
        F.count(F.lit(1)).alias("flagged_count"), F.count(days).alias("future_claim_observed_count"),
        *[F.sum(F.coalesce(d.between(0, h), F.lit(False)).cast("long")).alias(f"claim_count_within_{h}d") for h in horizons],
    )
    for h in horizons:
        plain = plain.withColumn(f"claim_rate_within_{h}d", F.col(f"claim_count_within_{h}d") / F.col("flagged_count"))
    seen = exact_quantiles(selected, group, days, {"median_days_to_next_claim_all_observed": 0.5})
    near = exact_quantiles(
        selected.where(d.between(0, horizon)), group, days, {"median_days_to_next_claim_within_horizon": 0.5}
    )
    return plain.join(seen, list(group), "left").join(near, list(group), "left")


def horizon_outcomes(
    df: DataFrame, group: Sequence[str], days: str, score: str, horizons: Sequence[int]
) -> DataFrame:
    """Positives and the mean and median score of both outcomes per horizon."""
    spread = df.withColumn("evaluation_horizon_days", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn(
        "__y", F.coalesce(F.col(days).between(0, F.col("evaluation_horizon_days")), F.lit(False))
    )
    keys = [*group, "evaluation_horizon_days"]
    y = F.col("__y")
    plain = spread.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(y.cast("long")).alias("future_claim_positive_rows"),
        F.avg(y.cast("double")).alias("future_claim_positive_rate"),
        F.avg(F.when(y, F.col(score))).alias("mean_score_future_claim_positive"),
        F.avg(F.when(~y, F.col(score))).alias("mean_score_still_negative"),
    )
    medians = exact_quantiles(spread, [*keys, "__y"], score, {"__m": 0.5}).groupBy(*keys).agg(
        F.max(F.when(y, F.col("__m"))).alias("median_score_future_claim_positive"),
        F.max(F.when(~y, F.col("__m"))).alias("median_score_still_negative"),
    )
    return plain.join(medians, keys, "left")


def first_positive_horizon(days: Column, horizons: Sequence[int], inclusive: bool = True) -> Column:
    """The shortest horizon that counts the next event; NULL when none does."""
    ok = days >= 0 if inclusive else days > 0
    out = F.lit(None).cast("int")
    for h in sorted(horizons, reverse=True):
        out = F.when(ok & (days <= h), F.lit(h)).otherwise(out)
    return out


# ------------------------------------------------------------------ entities, groups, trends
def entity_collapse(
    df: DataFrame, key: str, score: str, label: str, day: str, score_by: str = "max", label_by: str = "max"
) -> DataFrame:
    """One row per entity: score by max, mean or latest; label by max or latest."""
    latest = lambda c: F.max_by(F.col(c), F.struct(F.col(day), F.col(c)))
    pick = {"max": F.max, "mean": F.avg, "latest": latest}
    known = df.where(F.col(key).isNotNull() & F.col(score).isNotNull())
    return known.groupBy(key).agg(
        F.count(F.lit(1)).alias("source_snapshot_count"),
        pick[score_by](score).alias("machine_probability"),
        (F.max(label) if label_by == "max" else latest(label)).cast("int").alias("machine_target"),
        F.min(day).alias("machine_first_snapshot_date"), F.max(day).alias("machine_last_snapshot_date"),
    )


def entity_top_k(
    df: DataFrame, key: str, score: str, label: str, day: str, rates: Sequence[float],
    score_by: str = "max", label_by: str = "max",
) -> DataFrame:
    """Top-k metrics after the collapse to entities."""
    entities = entity_collapse(df, key, score, label, day, score_by, label_by)
    ranked = rank_within(entities, [], "machine_probability", [key], "__rank", "__size")
    return selection_metrics(
        ranked, [], selections(rates), "machine_target", "machine_probability", "__rank", "__size"
    )


def entity_summary(
    df: DataFrame, group: Sequence[str], key: str, score: str, label: str, end: str
) -> DataFrame:
    """Scores of every entity: extremes, mean, latest window and top row."""
    top = F.max_by(F.struct(F.col(end).alias("e"), F.col(label).alias("y")), F.struct(F.col(score), F.col(end)))
    return df.groupBy(*group, key).agg(
        F.count(F.lit(1)).alias("window_rows"), F.sum(F.col(label).cast("long")).alias("positive_window_rows"),
        F.max(score).alias("max_score"), F.avg(score).alias("mean_score"), F.min(score).alias("min_score"),
        F.max(end).alias("latest_window_end"),
        F.max_by(F.col(score), F.struct(F.col(end), F.col(score))).alias("latest_window_score"),
        top.alias("__top"),
    ).select("*", F.col("__top.e").alias("top_score_window_end"), F.col("__top.y").alias("top_score_target")).drop("__top")


def group_ranks(df: DataFrame, group: str, score: str, label: str, key: str) -> DataFrame:
    """Rank of the best case inside its matched group and its margin over the best control.

    Aggregates only: the rank is one plus the rows ahead of the case, so a group needs no
    sort and may have any size.
    """
    case = F.col(label) == 1
    best = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("group_size"), F.sum(case.cast("long")).alias("case_count"),
        F.max(F.when(case, F.col(score))).alias("case_score"),
        F.min_by(F.when(case, F.col(key)), F.when(case, F.struct(-F.col(score), F.col(key)))).alias("case_key"),
        F.max(F.when(~case, F.col(score))).alias("max_control_score"),
    )
    ahead = (
        df.join(best.select(group, "case_score", "case_key"), group)
        .where((F.col(score) > F.col("case_score")) | ((F.col(score) == F.col("case_score")) & (F.col(key) < F.col("case_key"))))
        .groupBy(group).agg(F.count(F.lit(1)).alias("__ahead"))
    )
    rank = F.when(F.col("case_count") > 0, F.coalesce(F.col("__ahead"), F.lit(0)) + 1)
    return best.join(ahead, group, "left").select(
        group, "group_size", "case_count", (F.col("group_size") - F.col("case_count")).alias("control_count"),
        F.col("case_key").alias("case_machine_key"), "case_score", rank.alias("case_rank_within_group"),
        F.coalesce(rank == 1, F.lit(False)).cast("int").alias("case_is_top_score"),
        F.coalesce(rank <= 2, F.lit(False)).cast("int").alias("case_is_top_2"), "max_control_score",
        (F.col("case_score") - F.col("max_control_score")).alias("case_score_minus_max_control_score"),
    )


def group_rank_metrics(ranks: DataFrame) -> DataFrame:
    """Mean and median case rank, top-1 and top-2 rates, reciprocal rank and margin."""
    usable = ranks.where("case_count > 0")
    r = F.col("case_rank_within_group").cast("double")
    plain = usable.agg(
        F.count(F.lit(1)).alias("case_control_groups"), F.avg(r).alias("mean_case_rank_within_group"),
        F.avg("case_is_top_score").alias("case_top_score_rate"), F.avg("case_is_top_2").alias("case_top_2_rate"),
        F.avg(1.0 / r).alias("mean_reciprocal_case_rank"),
        F.avg("case_score_minus_max_control_score").alias("mean_case_score_minus_max_control_score"),
    )
    median = exact_quantiles(usable, [], "case_rank_within_group", {"median_case_rank_within_group": 0.5})
    return plain.join(F.broadcast(median))


def horizon_trends(
    rows: DataFrame, group: Sequence[str], horizon: str, columns: Sequence[str]
) -> DataFrame:
    """Previous horizon's value, the change from it, and the change from the shortest."""
    window = Window.partitionBy(*group).orderBy(horizon)
    out = {f"previous_{horizon}": F.lag(horizon).over(window)}
    for name in columns:
        out[f"previous_{name}"] = F.lag(name).over(window)
        out[f"change_from_previous_horizon_{name}"] = F.col(name) - F.lag(name).over(window)
        out[f"{name}_change_vs_shortest_horizon"] = F.col(name) - F.first(name).over(window)
    return rows.withColumns(out)


def review_table(
    rows: DataFrame, index: Sequence[str], label: str, labels: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Long rows turned into one wide row per index, one column per label and value."""
    return rows.groupBy(*index).agg(*[
        F.max(F.when(F.col(label) == name, F.col(v))).alias(f"{v}_{name}") for name in labels for v in values
    ])


def cohort_verification(
    predictions: DataFrame, group: Sequence[str], key: str, horizon: str, score: str, label: str,
    windows: Sequence[str],
) -> DataFrame:
    """Whether entities, windows and scores agree across horizons and positives never fall."""
    per_key = predictions.groupBy(*group, key).agg(
        F.count_distinct(horizon).alias("__h"),
        F.greatest(*[F.count_distinct(w) for w in windows], F.lit(0)).alias("__w"),
        (F.max(score) - F.min(score)).alias("__d"),
    )
    sums = per_key.groupBy(*group).agg(
        F.count(F.lit(1)).alias("machine_rows"), F.min("__h").alias("__min_h"), F.max("__w").alias("__max_w"),
        F.max("__d").alias("maximum_absolute_score_difference"),
    )
    per_horizon = predictions.groupBy(*group, horizon).agg(F.sum(F.col(label).cast("long")).alias("__p"))
    order = Window.partitionBy(*group).orderBy(horizon)
    steps = per_horizon.withColumn("__up", F.coalesce(F.col("__p") >= F.lag("__p").over(order), F.lit(True))).groupBy(
        *group
    ).agg(F.count(F.lit(1)).alias("horizons"), F.min("__up").alias("__mono"))
    return sums.join(steps, list(group)).select(
        *group, "machine_rows", "horizons",
        (F.col("__min_h") == F.col("horizons")).cast("int").alias("same_machine_ids_across_horizons"),
        (F.col("__max_w") <= 1).cast("int").alias("same_feature_windows_across_horizons"),
        "maximum_absolute_score_difference",
        (F.col("maximum_absolute_score_difference") <= 1e-12).cast("int").alias("same_scores_across_horizons"),
        F.col("__mono").cast("int").alias("positive_counts_nondecreasing"),
    )


def common_labeled(frames: Sequence[DataFrame], key: str, label: str) -> DataFrame:
    """Entities in every frame whose label is the same everywhere."""
    union = None
    for turn, df in enumerate(frames):
        part = df.select(key, label).distinct().withColumn("__frame", F.lit(turn))
        union = part if union is None else union.unionByName(part)
    return (
        union.groupBy(key)
        .agg(F.count_distinct("__frame").alias("__n"), F.count_distinct(label).alias("__l"), F.min(label).alias(label))
        .where((F.col("__n") == len(frames)) & (F.col("__l") == 1))
        .select(key, label)
    )


def output_checks(
    ranked: DataFrame, group: Sequence[str], key: str, score: str, probability: str, label: str, rank: str
) -> DataFrame:
    """Counts of broken rules in a ranked table (all zero when sound)."""
    pairs = ranked.groupBy(*group, key).agg(F.count(F.lit(1)).alias("__n"))
    ranks = ranked.groupBy(*group).agg(
        F.count(F.lit(1)).alias("__n"), F.min(rank).alias("__lo"), F.max(rank).alias("__hi"),
        F.count_distinct(rank).alias("__u"),
    )
    # neighbours by rank: an equi-join on rank + 1 needs no sort of a whole group
    nxt = ranked.select(*group, (F.col(rank) - 1).alias(rank), F.col(score).alias("__next"))
    falling = ranked.join(nxt, [*group, rank]).where(F.col("__next") > F.col(score)).agg(
        F.count(F.lit(1)).alias("scores_not_descending")
    )
    p, y = F.col(probability), F.col(label)
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return (
        ranked.agg(
            total(~F.coalesce(p.between(0.0, 1.0), F.lit(False))).alias("probability_out_of_range"),
            total(~F.coalesce(y.isin(0, 1), F.lit(False))).alias("label_not_binary"),
        )
        .join(F.broadcast(pairs.agg(total(F.col("__n") > 1).alias("duplicate_keys"))))
        .join(F.broadcast(ranks.agg(
            total((F.col("__lo") != 1) | (F.col("__hi") != F.col("__n")) | (F.col("__u") != F.col("__n"))).alias("ranks_not_contiguous")
        )))
        .join(F.broadcast(falling))
    )


def feature_score_ranks(df: DataFrame, columns: Mapping[str, str], key: str) -> DataFrame:
    """Min-method ranks of short score lists, largest first, missing last."""
    window = lambda c: Window.partitionBy(F.lit(0)).orderBy(F.col(c).desc_nulls_last())
    return df.select(key, *[F.rank().over(window(c)).alias(n) for n, c in columns.items()])
