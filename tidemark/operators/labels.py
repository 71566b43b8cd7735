"""Target events, claim episodes and future-event labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import lead_time_bucket
from tidemark.operators.features import Feature, window_features
from tidemark.operators.ordering import exact_quantiles, ordered_scan
from tidemark.operators.temporal import asof_join

# Claim types that are no failures, with the reason of the removal.
NON_FAILURE_CLAIM_TYPES = {
    "Inspection Claim KF": "inspection_or_check",
    "Policy Adjustment Claim": "policy_adjustment",
    "Commercial Adjustment Policy Claim": "commercial_adjustment",
    "Replacement Undercarriage": "routine_wear_component_replacement",
}

LEAD_DAYS = "days_to_next_claim_on_or_after_window_end"


def event_days(events: DataFrame, key: str, day: str, columns: Sequence[str] = (),
               order: Sequence[str] = ()) -> DataFrame:
    """One row per (key, day): the first row by ``order``; rows without key or day drop out."""
    valid = events.where(F.col(key).isNotNull() & F.col(day).isNotNull())
    if not columns:
        return valid.select(key, day).distinct()
    tie = F.struct(*[F.col(c) for c in (order or columns)])
    first = F.min_by(F.struct(*[F.col(c) for c in columns]), tie)
    return valid.groupBy(key, day).agg(first.alias("__row")).select(key, day, "__row.*")


def target_profile(events: DataFrame, key: str, day: str) -> DataFrame:
    """Row, usable row, entity-day and entity counts with the date range."""
    valid = F.col(key).isNotNull() & F.col(day).isNotNull()
    return events.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count(F.when(valid, 1)).alias("usable_rows"),
        F.count_distinct(F.when(valid, F.struct(key, day))).alias("entity_days"),
        F.count_distinct(F.when(valid, F.col(key))).alias("entities"),
        F.min(F.when(valid, F.col(day))).alias("first_day"),
        F.max(F.when(valid, F.col(day))).alias("last_day"),
    )


def claim_filter(
    claims: DataFrame, kind: str = "claim_type", excluded: Mapping[str, str] | None = None,
    valid_part: Column | None = None,
) -> DataFrame:
    """All claims with ``claim_keep`` (0/1) and ``claim_filter_reason``.

    ``excluded`` maps claim types to reasons; with ``valid_part`` the remaining claims
    without a valid part are removed too. Filter on ``claim_keep`` for the kept rows,
    or take the whole table as the audit.
    """
    text = F.lower(F.trim(F.coalesce(F.col(kind).cast("string"), F.lit(""))))
    reason = F.lit(None).cast("string")
    for name, why in (excluded or {}).items():
        reason = F.when(text == name.strip().lower(), F.lit(why)).otherwise(reason)
    if valid_part is not None:
        part = F.coalesce(valid_part, F.lit(False))
        reason = F.coalesce(reason, F.when(~part, F.lit("missing_or_invalid_critical_part")))
    return claims.withColumns(
        {
            "claim_keep": reason.isNull().cast("int"),
            "claim_filter_reason": F.coalesce(reason, F.lit("kept")),
        }
    )


def strict_claims(
    claims: DataFrame, types: Sequence[str], invalid_parts: Sequence[str] = (),
    minimum_meter: float = 25.0, kind: str = "claim_type", part: str = "critical_fail_part_number",
    meter: str = "failure_smr",
) -> DataFrame:
    """Claims of the listed types with a usable part number and a large enough meter."""
    number = F.coalesce(F.upper(F.trim(F.col(part).cast("string"))), F.lit(""))
    bad = number.rlike("^0+$")
    if invalid_parts:
        bad = bad | number.isin(*invalid_parts)
    return claims.where(
        F.col(kind).isin(*types) & ~bad & (F.col(meter).try_cast("double") >= minimum_meter)
    )


def claim_episodes(
    claims: DataFrame, gap_days: int = 30, key: str = "machine_key", day: str = "claim_date",
    number: str = "claim_number", kind: str = "claim_type", part: str = "critical_fail_part_number",
    meter: str = "failure_smr", attributes: Sequence[str] = (), valid_part: Column | None = None,
) -> DataFrame:
    """Runs of claims of one key whose gaps are at most ``gap_days``, numbered overall.

    ``attributes`` come from the episode's first claim (smallest number of its first day). With
    ``valid_part`` a flag says whether any claim of the episode fulfils it.

    Claims are reduced per (key, day) before the gap window, so a window holds days,
    not claims. The joined text columns hold every distinct value of the episode.
    """
    flag = "has_valid_critical_part_episode"
    items = {"claim_numbers": number, "claim_type_descriptions": kind, "critical_fail_part_numbers": part}
    daily = (
        claims.where(F.col(key).isNotNull() & F.col(day).isNotNull())
        .groupBy(key, day)
        .agg(
            F.count(F.lit(1)).alias("__rows"),
            *[F.collect_set(F.col(c).cast("string")).alias(n) for n, c in items.items()],
            F.min(F.col(meter).try_cast("double")).alias("__low"),
            F.max(F.col(meter).try_cast("double")).alias("__high"),
            *[F.min_by(c, number).alias(c) for c in attributes],
            *([] if valid_part is None else [F.bool_or(F.coalesce(valid_part, F.lit(False))).alias(flag)]),
        )
    )
    ordered = Window.partitionBy(key).orderBy(day)
    opened = F.coalesce((F.datediff(F.col(day), F.lag(day).over(ordered)) > gap_days).cast("int"), F.lit(1))
    numbered = daily.withColumn("__open", opened).withColumn(
        "__session", F.sum("__open").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    join = lambda c: F.array_join(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), ";"
    ).alias(c)
    episodes = numbered.groupBy(key, "__session").agg(
        F.min(day).alias(day),
        F.max(day).alias("episode_end_date"),
        F.sum("__rows").alias("claim_count_in_episode"),
        *[join(c) for c in items],
        F.min("__low").alias("min_failure_smr"),
        F.max("__high").alias("max_failure_smr"),
        *[F.min_by(c, day).alias(c) for c in attributes],
        *([] if valid_part is None else [F.bool_or(flag).alias(flag)]),
    ).drop("__session")
    placed = ordered_scan(episodes, [], [F.col(key).asc(), F.col(day).asc()], number="__number")
    return placed.select(
        F.format_string("E%07d", "__number").alias("claim_episode_id"), *episodes.columns
    )


def select_positives(
    episodes: DataFrame, mode: str = "first", lead_max: int = 90,
    key: str = "machine_key", day: str = "claim_date",
) -> DataFrame:
    """All episodes with order columns, the selection flag and its reason.

    ``first`` keeps the first episode of a key; ``multiple`` also keeps an episode at
    least ``lead_max`` days after the one before. Episodes of a key are at least a gap
    apart, so its window holds calendar-bounded rows.
    """
    if mode not in ("first", "multiple"):
        raise ValueError("mode must be 'first' or 'multiple'")
    ordered = Window.partitionBy(key).orderBy(day, "claim_episode_id")
    df = episodes.withColumns(
        {
            "claim_sequence_number": F.row_number().over(ordered),
            "machine_claim_event_count": F.count(F.lit(1)).over(Window.partitionBy(key)),
            "previous_claim_date_same_machine": F.lag(day).over(ordered),
        }
    ).withColumn(
        "days_since_previous_claim_same_machine",
        F.datediff(F.col(day), F.col("previous_claim_date_same_machine")),
    )
    first = F.col("claim_sequence_number") == 1
    far = F.coalesce(F.col("days_since_previous_claim_same_machine") >= lead_max, F.lit(False))
    if mode == "first":
        chosen = first
        reason = F.when(first, "first_claim_for_machine").otherwise("excluded_not_first_claim_for_machine")
    else:
        chosen = first | far
        reason = (
            F.when(first, "first_claim_for_machine")
            .when(far, "included_gap_from_previous_claim_ge_lead_max_days")
            .otherwise("excluded_gap_from_previous_claim_lt_lead_max_days")
        )
    return df.withColumns(
        {
            "is_first_claim_for_machine": first,
            "selected_as_positive_claim": chosen,
            "claim_selection_reason": reason,
        }
    )


def future_label(
    spine: DataFrame, events: DataFrame, horizon: int = 90, key: str = "model_id",
    at: str = "snapshot_date", day: str = "event_day", count: str = "future_event_count",
    label: str | None = None, sources: Mapping[str, str] | None = None,
) -> DataFrame:
    """Events in ``[t, t+horizon)``: their count, the 0/1 label, and labels per source.

    ``sources`` maps an output name to a condition over the event row.
    """
    label = label or f"claim_next_{horizon}d"
    specs = [Feature(count, "count", oldest=0, newest=1 - horizon)]
    specs += [Feature(n, "any", when=w, oldest=0, newest=1 - horizon) for n, w in (sources or {}).items()]
    out = window_features(spine, events, specs, key, at, day)
    return out.withColumn(label, (F.col(count) > 0).cast("int"))


def next_event(
    rows: DataFrame, events: DataFrame, key: str, at: str, day: str, inclusive: bool = True,
    horizons: Sequence[int] = (), columns: Sequence[str] = (),
) -> DataFrame:
    """First event on (or strictly after) ``at``: date, days, bucket and horizon labels."""
    found = asof_join(
        rows, events.withColumn("__next_day", F.col(day)), key, at, day, ["__next_day", *columns],
        direction="forward", inclusive=inclusive,
        prefix="__n_",
    )
    days = F.datediff(F.col("__n___next_day"), F.col(at))
    return found.select(
        *rows.columns,
        F.col("__n___next_day").alias("next_claim_date_on_or_after_window_end"),
        days.alias(LEAD_DAYS),
        F.col("__n___next_day").isNotNull().cast("int").alias("has_future_claim_on_or_after_window_end"),
        lead_time_bucket(days).alias("future_claim_lead_time_bucket"),
        *[
            F.coalesce((days <= h).cast("int"), F.lit(0)).alias(f"eval_target_claim_within_next_{h}d")
            for h in horizons
        ],
        *[F.col(f"__n_{c}").alias(f"next_{c}") for c in columns],
    )


def outcome_history(
    rows: DataFrame, days: DataFrame, horizon: int = 90, key: str = "machine_key",
    as_of: str = "period_end", day: str = "event_day",
) -> DataFrame:
    """Events up to and after the as-of day of a period.

    Prior counts use ``(as_of-d, as_of]``, the target ``(as_of, as_of+horizon]``. ``days``
    holds one row per (key, day). The last event day of all keys bounds completeness.
    """
    # events and periods of a key in one sorted scan: an event comes before a period of its own day
    rest = [c for c in rows.columns if c not in (key, as_of)]
    events = days.where(F.col(key).isNotNull() & F.col(day).isNotNull())
    timeline = events.select(key, F.col(day).alias("__event"), (F.unix_date(day) * 2).alias("__place")).unionByName(
        rows.select(
            key, F.col(as_of), (F.unix_date(as_of) * 2 + 1).alias("__place"), F.lit(True).alias("__period"),
            *([F.struct(*rest).alias("__rest")] if rest else []),
        ),
        allowMissingColumns=True,
    )
    scan = Window.partitionBy(key).orderBy("__place")

    def upto(ahead: int) -> Window:
        return scan.rangeBetween(Window.unboundedPreceding, 2 * ahead)

    # counts are differences of running counts, so no window is gone through again for each period
    ages = {"__ever": 0, "__ahead": horizon, **{f"__before_{d}": -d for d in (30, 90, 180, 365)}}
    found = timeline.select(
        "*", *[F.count("__event").over(upto(n)).alias(c) for c, n in ages.items()], F.max("__event").over(upto(0)).alias("__last"),
        F.expr(f"lead(__event) ignore nulls over (partition by `{key}` order by __place)").alias("__next"),
    ).where("__period")
    known = F.col(key).isNotNull() & F.col(as_of).isNotNull()
    counted = lambda a, b: F.when(known, F.col(a) - F.col(b))
    last = days.agg(F.max(day).alias("target_observation_end"))
    out = found.select(
        key, as_of, *[F.col(f"__rest.{c}") for c in rest],
        *[counted("__ever", f"__before_{d}").alias(f"prior_claim_count_{d}d") for d in (30, 90, 180, 365)],
        F.when(known, F.col("__ever")).alias("prior_claim_count_ever"),
        F.when(known, F.datediff(as_of, "__last")).alias("days_since_prior_claim"),
        counted("__ahead", "__ever").alias("target_claim_count_90d"),
        F.when(known & (F.col("__next") <= F.date_add(as_of, horizon)), F.col("__next")).alias("target_first_claim_date_90d"),
        F.when(known, F.col("__next")).alias("__next"),
    ).join(F.broadcast(last))
    return out.withColumns(
        {
            "target_90d": (F.col("target_claim_count_90d") > 0).cast("int"),
            "next_target_event_date": F.col("__next"),
            "days_to_next_target_event": F.datediff("__next", F.date_add(as_of, 1)),
            "target_window_start": F.date_add(as_of, 1),
            "target_window_end": F.date_add(as_of, horizon),
            "label_complete_90d": (F.date_add(as_of, horizon) <= F.col("target_observation_end")).cast("int"),
        }
    ).drop("__next")


def horizon_target(days: Column, horizon: int, inclusive: bool = True) -> Column:
    """0/1 target of one horizon from the stored number of days to the next event."""
    low = days >= 0 if inclusive else days > 0
    return F.coalesce((low & (days <= horizon)).cast("int"), F.lit(0))


def lead_time_summary(df: DataFrame, days: str = LEAD_DAYS) -> DataFrame:
    """Observed and missing rows with min, median, mean and p90 of the lead time."""
    plain = df.agg(
        F.count(days).alias("future_claim_observed_rows"),
        F.count(F.when(F.col(days).isNull(), 1)).alias("future_claim_never_observed_rows"),
        F.min(days).alias("future_claim_days_min"),
        F.avg(days).alias("future_claim_days_mean"),
    )
    quantiles = exact_quantiles(
        df, [], days, {"future_claim_days_median": 0.5, "future_claim_days_p90": 0.9}
    )
    return plain.join(F.broadcast(quantiles))


def horizon_label_summary(df: DataFrame, horizons: Sequence[int], days: str = LEAD_DAYS,
                          group: Sequence[str] = ()) -> DataFrame:
    """Rows, positives, negatives and rate per horizon, and whether positives never fall."""
    sums = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(horizon_target(F.col(days), h)).alias(f"__h{h}") for h in horizons],
    )
    long = sums.select(
        *group, "rows",
        F.explode(F.array(*[
            F.struct(F.lit(h).alias("horizon_days"), F.col(f"__h{h}").alias("positives")) for h in sorted(horizons)
        ])).alias("__h"),
    ).select(*group, "__h.horizon_days", "rows", "__h.positives")
    ordered = Window.partitionBy(*group).orderBy("horizon_days") if group else Window.partitionBy(F.lit(0)).orderBy("horizon_days")
    return long.withColumns(
        {
            "negatives": F.col("rows") - F.col("positives"),
            "positive_rate": F.col("positives") / F.col("rows"),
            "not_below_shorter_horizon": F.coalesce(
                F.col("positives") >= F.lag("positives").over(ordered), F.lit(True)
            ).cast("int"),
        }
    )
