"""Fixed periods and anchor windows: panels, segment aggregates and their merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import number, ratio_or_null, season_label
from tidemark.functions.keys import first_existing, safe_token, sql_text
from tidemark.operators.features import Feature, grouped_features, interval_features

KEY, START, END = "machine_key", "period_start", "period_end"

# Categories that get a count column, per source column.
FAULT_CATEGORIES = {
    ("event_action_level", "fault_action"): ("L00", "L01", "L02", "L03", "L04"),
    ("failure_code_evidence_strength_class", "fault_strength"): ("VERY_WEAK", "WEAK", "MEDIUM", "STRONG"),
    ("failure_code_evidence_group", "fault_group"): ("CONTEXT", "EVENT", "OTHER"),
    ("logical_name", "fault_logical"): ("MON", "ENG/M", "W/E", "HST", "P/T"),
    ("related_component", "fault_component"): (
        "Urea SCR System", "Engine", "Power Train System", "Work Equipment System",
        "Cooling System", "Control System",
    ),
}
MAINTENANCE_CATEGORIES = {
    ("maintenance_type", "maint_type"): ("Filter", "Oil", "Breather", "Cleaning", "Coolant"),
    ("related_component", "maint_component"): (
        "Engine", "Urea SCR System", "Transmission", "Final Drive", "Cooling System",
    ),
}
# Measures summed up per period.
SEGMENT_MEASURES = (
    "Ag_Silver_PPM", "Al_Aluminum_PPM", "Cr_Chromium_PPM", "Cu_Copper_PPM", "Fe_Iron_PPM",
    "K_Potassium_PPM", "Li_Lithium_PPM", "Na_Sodium_PPM", "Ni_Nickel_PPM", "Pb_Lead_PPM",
    "Si_Silicon_PPM", "Sn_Tin_PPM", "Soot_Soot_PERCENT", "Ti_Titanium_PPM", "V_Vanadium_PPM",
    "Water_Water_PERCENT",
)
OPERATION_SUMMED = (
    "smr_delta_clean_since_prev_obs_hours", "actual_working_hours_clean",
    "activity_fuel_consumption_value_raw", "engine_running_hours_clean",
    "engine_idling_hours_clean", "throttle_full_hours_clean", "traveling_hours_clean",
    "moving_back_forth_hours_clean", "steering_hours_clean", "working_hours_clean",
    "auto_quick_shift_hours_clean", "manual_variable_shift_hours_clean",
)
OPERATION_AVERAGED = (
    "engine_idle_share_daily", "throttle_full_engine_share_daily",
    "throttle_average_dial_position_clean", "days_since_last_actual_work_day_through_current_day",
)
OPERATION_FLAGGED = (
    "actual_work_day_flag", "inactive_actual_work_day_flag", "fuel_active_flag",
    "engine_running_day_flag", "high_throttle_day_flag", "long_engine_day_flag",
    "travel_day_flag", "movement_day_flag", "smr_missing_flag", "smr_decrease_flag",
    "smr_large_jump_flag", "actual_work_missing_flag", "engine_seconds_invalid_flag",
    "movement_invalid_flag", "travel_invalid_flag", "work_idle_sum_exceeds_engine_flag",
    "idle_exceeds_engine_flag", "throttle_full_exceeds_engine_flag",
)


def segment_of(day: Column, first: str, stride: int = 90) -> Column:
    """Start of the fixed period of a day; NULL before the first period."""
    origin = F.lit(first).cast("date")
    offset = F.datediff(day, origin)
    step = F.floor(offset / F.lit(stride)).cast("int") * stride
    return F.when(offset >= 0, F.date_add(origin, step))


def segment_grid(
    roster: DataFrame, first: str, last: str, stride: int = 90, length: int = 90
) -> DataFrame:
    """Every entity with every whole period between the bounds."""
    days = F.sequence(
        F.lit(first).cast("date"), F.date_sub(F.lit(last).cast("date"), length - 1),
        F.expr(f"interval {stride} day"),
    )
    return (
        roster.withColumn(START, F.explode(days))
        .withColumn(END, F.date_add(START, length - 1))
        .withColumn("segment_season", season_label(F.col(START)))
        .withColumn("segment_year", F.year(START))
    )


def anchor_plan(folds: Sequence[tuple[str, str, str, Sequence[str]]], lookback: int = 90) -> list[dict]:
    """Plain rows of (fold, sequence, id, anchor and window) from fold bounds and dates."""
    rows = []
    for fold, first, last, dates in folds:
        for turn, day in enumerate(sorted(dates), start=1):
            rows.append(
                {"fold": fold, "anchor_sequence": turn, "anchor_id": f"{fold}_A{turn:02d}",
                 "anchor_date": day, "validation_start": first, "validation_end_exclusive": last,
                 "lookback": lookback}
            )
    return rows


def anchor_grid(roster: DataFrame, plan: Sequence[dict]) -> DataFrame:
    """Every entity with every anchor of the plan (the plan is a short literal list)."""
    date = lambda v: F.lit(v).cast("date")
    anchors = F.array(*[
        F.struct(
            F.lit(p["fold"]).alias("fold"), F.lit(p["anchor_sequence"]).alias("anchor_sequence"),
            F.lit(p["anchor_id"]).alias("anchor_id"), date(p["anchor_date"]).alias("anchor_date"),
            date(p["validation_start"]).alias("validation_start"),
            date(p["validation_end_exclusive"]).alias("validation_end_exclusive"),
            F.date_sub(date(p["anchor_date"]), p["lookback"]).alias(START),
            F.date_sub(date(p["anchor_date"]), 1).alias(END),
        )
        for p in plan
    ])
    return (
        roster.withColumn("__anchor", F.explode(anchors)).select(*roster.columns, "__anchor.*")
        .withColumn("segment_season", season_label(F.col(START)))
        .withColumn("segment_year", F.year(START))
    )


def prepare_events(
    raw: DataFrame, key: Column, day: Column, first: str, last: str, stride: int = 90, length: int = 90
) -> DataFrame:
    """Keyed rows inside the bounds with their period and whether it is whole."""
    return (
        raw.withColumn(KEY, key).withColumn("event_day", day)
        .where(F.col(KEY).isNotNull() & F.col("event_day").between(first, last))
        .withColumn(START, segment_of(F.col("event_day"), first, stride))
        .withColumn(
            "in_whole_period",
            (F.col("event_day") <= F.date_add(START, length - 1))
            & (F.date_add(START, length - 1) <= F.lit(last).cast("date")),
        )
    )


def _category_features(df: DataFrame, categories: dict) -> list[Feature]:
    out = []
    for (column, prefix), values in categories.items():
        for value in values:
            when = f"upper(trim({column})) = {sql_text(value.upper())}" if column in df.columns else "false"
            out.append(Feature(f"{prefix}_{safe_token(value).lower()}_count", "count", when=when))
    return out


def _value(df: DataFrame, column: str) -> str:
    return f"try_cast({column} as double)" if column in df.columns else "cast(null as double)"


def _flag_value(df: DataFrame, column: str) -> str:
    """0/1 from true/false/yes/no/1/0, NULL otherwise."""
    if column not in df.columns:
        return "cast(null as double)"
    text = f"lower(trim(cast({column} as string)))"
    return f"case when {text} in ('true', '1', 'yes') then 1.0D when {text} in ('false', '0', 'no') then 0.0D end"


def fault_specs(df: DataFrame) -> list[Feature]:
    v = lambda c: _value(df, c)
    return [
        Feature("fault_event_count", "count"),
        Feature("fault_active_days", "days"),
        Feature("fault_unique_code_count", "distinct", "fault_code"),
        Feature("fault_occurrence_sum", "sum", v("occurrence_count")),
        Feature("fault_occurrence_max", "max", v("occurrence_count")),
        Feature("fault_log_occurrence_sum", "sum", v("log_occurrence_count")),
        Feature("fault_log_occurrence_mean", "mean", v("log_occurrence_count")),
        Feature("fault_engine_on_hours_sum", "sum", v("engine_on_hours")),
        Feature("fault_engine_on_hours_max", "max", v("engine_on_hours")),
        Feature("fault_smr_min", "min", v("smr_hours")),
        Feature("fault_smr_max", "max", v("smr_hours")),
        Feature("fault_mechanical_count", "sum", v("is_mechanical_failure_code")),
        Feature("fault_electrical_count", "sum", v("is_electrical_failure_code")),
        Feature("fault_action_level_mean", "mean", v("action_level_num")),
        Feature("fault_action_level_max", "max", v("action_level_num")),
        Feature("fault_evidence_score_sum", "sum", v("failure_code_evidence_score")),
        Feature("fault_evidence_score_mean", "mean", v("failure_code_evidence_score")),
        Feature("fault_evidence_score_max", "max", v("failure_code_evidence_score")),
        *_category_features(df, FAULT_CATEGORIES),
    ]


def fault_derived(df: DataFrame) -> DataFrame:
    c = F.col
    rows = c("fault_event_count")
    return df.withColumns(
        {
            "fault_smr_range": c("fault_smr_max") - c("fault_smr_min"),
            "fault_events_per_active_day": ratio_or_null(rows, c("fault_active_days")),
            "fault_strong_rate": ratio_or_null(c("fault_strength_strong_count"), rows),
            "fault_medium_or_strong_rate": ratio_or_null(
                c("fault_strength_medium_count") + c("fault_strength_strong_count"), rows
            ),
            "fault_action_ge3_rate": ratio_or_null(
                c("fault_action_l03_count") + c("fault_action_l04_count"), rows
            ),
        }
    )


def maintenance_specs(df: DataFrame) -> list[Feature]:
    v, f = (lambda c: _value(df, c)), (lambda c: _flag_value(df, c))
    return [
        Feature("maint_event_count", "count"),
        Feature("maint_active_days", "days"),
        Feature("maint_unique_event_count", "distinct", "EVENT_NAME_ID"),
        Feature("maint_monitor_reset_count", "sum", f("is_monitor_reset")),
        Feature("maint_overdue_count", "sum", f("is_overdue")),
        Feature("maint_due_now_count", "sum", f("is_due_now")),
        Feature("maint_notice_status_count", "sum", f("is_notice_or_status")),
        Feature("maint_unavailable_count", "count", when=f"({f('AVAILABLE')}) = 0"),
        Feature("maint_remaining_negative_count", "count", when=f"{v('remaining_hours')} < 0"),
        Feature("maint_remaining_zero_count", "count", when=f"{v('remaining_hours')} = 0"),
        *[Feature(f"maint_remaining_hours_{a}", a, v("remaining_hours")) for a in ("min", "mean", "max")],
        *[Feature(f"maint_interval_hours_{a}", a, v("INTERVAL_HOURS")) for a in ("min", "mean", "max")],
        Feature("maint_threshold_hours_mean", "mean", v("THRESHOLD_HOURS")),
        Feature("maint_smr_min", "min", v("smr_hours")),
        Feature("maint_smr_max", "max", v("smr_hours")),
        Feature("maint_previous_reset_smr_mean", "mean", v("previous_reset_smr_hours")),
        *_category_features(df, MAINTENANCE_CATEGORIES),
    ]


def maintenance_derived(df: DataFrame) -> DataFrame:
    c = F.col
    rows = c("maint_event_count")
    return df.withColumns(
        {
            "maint_smr_range": c("maint_smr_max") - c("maint_smr_min"),
            "maint_overdue_rate": ratio_or_null(c("maint_overdue_count"), rows),
            "maint_due_now_rate": ratio_or_null(c("maint_due_now_count"), rows),
            "maint_reset_rate": ratio_or_null(c("maint_monitor_reset_count"), rows),
        }
    )


def fluid_specs(df: DataFrame, measures: Sequence[str] = SEGMENT_MEASURES) -> list[Feature]:
    v = lambda c: _value(df, c)
    severity = v("sample_result_severity_order")
    out = [
        Feature("fluid_sample_count", "count"),
        Feature("fluid_active_days", "days"),
        Feature("fluid_telemetry_smr_min", "min", v("TELEMETRY_SMR_NUMERIC")),
        Feature("fluid_telemetry_smr_max", "max", v("TELEMETRY_SMR_NUMERIC")),
        *[Feature(f"fluid_severity_{n}_count", "count", when=f"{severity} = {n}") for n in range(6)],
    ]
    for name in measures:
        short = name.lower().replace("_", "")
        out.append(Feature(f"fluid_{short}_mean", "mean", v(name)))
        out.append(Feature(f"fluid_{short}_max", "max", v(name)))
    return out


def fluid_derived(df: DataFrame) -> DataFrame:
    severe = [F.col(f"fluid_severity_{n}_count") for n in range(5)]
    nonzero = severe[1] + severe[2] + severe[3] + severe[4]
    return df.withColumns(
        {
            "fluid_telemetry_smr_range": F.col("fluid_telemetry_smr_max") - F.col("fluid_telemetry_smr_min"),
            "fluid_rated_sample_count": severe[0] + nonzero,
            "fluid_nonzero_rated_count": nonzero,
            "fluid_nonzero_rated_rate": ratio_or_null(nonzero, severe[0] + nonzero),
        }
    )


def operation_specs(df: DataFrame) -> list[Feature]:
    v = lambda c: _value(df, c)
    out = [
        Feature("operation_day_count", "days"),
        Feature("operation_smr_min", "min", v("smr_hours")),
        Feature("operation_smr_max", "max", v("smr_hours")),
    ]
    for name in OPERATION_SUMMED:
        out += [Feature(f"operation_{name}_{a}", a, v(name)) for a in ("sum", "mean", "max")]
    for name in OPERATION_AVERAGED:
        out += [Feature(f"operation_{name}_{a}", a, v(name)) for a in ("mean", "max")]
    out += [Feature(f"operation_{name}_count", "sum", v(name)) for name in OPERATION_FLAGGED]
    return out


def operation_derived(df: DataFrame) -> DataFrame:
    c = lambda n: F.col(f"operation_{n}")
    days, engine = c("day_count"), c("engine_running_hours_clean_sum")
    return df.withColumns(
        {
            "operation_smr_range": c("smr_max") - c("smr_min"),
            "operation_work_day_rate": ratio_or_null(c("actual_work_day_flag_count"), days),
            "operation_inactive_day_rate": ratio_or_null(c("inactive_actual_work_day_flag_count"), days),
            "operation_engine_day_rate": ratio_or_null(c("engine_running_day_flag_count"), days),
            "operation_high_throttle_day_rate": ratio_or_null(c("high_throttle_day_flag_count"), days),
            "operation_long_engine_day_rate": ratio_or_null(c("long_engine_day_flag_count"), days),
            "operation_fuel_per_engine_hour": ratio_or_null(c("activity_fuel_consumption_value_raw_sum"), engine),
            "operation_idle_to_engine_ratio": ratio_or_null(c("engine_idling_hours_clean_sum"), engine),
            "operation_work_to_engine_ratio": ratio_or_null(c("actual_working_hours_clean_sum"), engine),
        }
    )


SOURCES = {
    "fault": (fault_specs, fault_derived),
    "maintenance": (maintenance_specs, maintenance_derived),
    "fluid": (fluid_specs, fluid_derived),
    "operation": (operation_specs, operation_derived),
}


def segment_features(prepared: DataFrame, source: str) -> DataFrame:
    """Aggregates of one source per entity and fixed period.

    An entity has few events in a period, so the partial aggregates of a map task would be wider than the events
    and as many. The events are dealt once by entity and period instead, and no aggregate is shuffled. Events pack
    far closer than aggregates, so the pieces are fixed and small: adaptive execution would merge them by their size.
    """
    specs, derived = SOURCES[source]
    pieces = 4 * int(prepared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fixed = prepared.where("in_whole_period").repartition(pieces, KEY, START)
    return derived(grouped_features(fixed, specs(prepared), [KEY, START]))


def anchor_features(grid: DataFrame, prepared: DataFrame, source: str) -> DataFrame:
    """The same aggregates over the anchor windows of a grid; only windows with events.

    Events of days that no window of the plan holds are left out before anything is shuffled.
    """
    specs, derived = SOURCES[source]
    windows = grid.select(KEY, START, END, "anchor_date").distinct()
    # one row per anchor of the plan
    spans = grid.select(F.col(START).alias("__from"), F.col(END).alias("__to")).distinct()
    inside = prepared.join(F.broadcast(spans), F.to_date("event_day").between(F.col("__from"), F.col("__to")), "left_semi")
    found = interval_features(windows, inside, specs(prepared), KEY, START, END)
    anchor = {"fault": "fault_event_count", "maintenance": "maint_event_count",
              "fluid": "fluid_sample_count", "operation": "operation_day_count"}[source]
    return derived(found.where(F.col(anchor) > 0)).drop(END)


def merge_source(base: DataFrame, features: DataFrame, source: str, keys: Sequence[str]) -> DataFrame:
    """Left join of one source's features with its ``has_<source>_data`` flag."""
    marked = features.withColumn("__present", F.lit(1))
    return (
        base.join(marked, list(keys), "left")
        .withColumn(f"has_{source}_data", F.coalesce(F.col("__present"), F.lit(0)))
        .drop("__present")
    )


def fill_count_like(df: DataFrame) -> DataFrame:
    """Counts, sums and has-flags become 0 when missing; infinite numbers become NULL."""
    out = []
    for field in df.schema.fields:
        column = F.col(field.name)
        kind = field.dataType.simpleString()
        if kind in ("double", "float"):
            column = F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)
        if field.name.endswith(("_count", "_sum")) or field.name.startswith("has_"):
            column = F.coalesce(column, F.lit(0).cast(field.dataType))
        out.append(column.alias(field.name))
    return df.select(*out)
