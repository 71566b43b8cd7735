"""Feature sets per source: basic, frozen and rolling-origin windows.

Each set is a list of ``Feature`` specs plus a few expressions over their results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import safe_token, sql_text
from tidemark.functions.scalars import COMPONENT_WORDS, MAINTENANCE_WORDS, clip, ratio
from tidemark.operators.features import Feature, counts, latest_item_states, window_features
from tidemark.operators.ordering import first_per_group
from tidemark.operators.temporal import asof_join, range_join, rows_on_days
from tidemark.sources.standardize import FLUID_MEASURES, severity_trend

KEY, AT, DAY = "model_id", "snapshot_date", "event_day"


def dominant(named_counts: Sequence[tuple[str, Column]], rows: Column) -> Column:
    """Name of the largest count, first in order on ties; 'none' or 'other' without one."""
    top = F.greatest(*[c for _, c in named_counts])
    label = F.when(rows == 0, F.lit("none")).when(top <= 0, F.lit("other"))
    for name, count in named_counts:
        label = label.when(count == top, F.lit(name))
    return label


def _component_counts(prefix: str, oldest: int) -> list[Feature]:
    return counts({f"{prefix}{c}": f"is_component_{c}" for c in COMPONENT_WORDS}, oldest)


# ---------------------------------------------------------------- faults
def fault_basic(spine: DataFrame, faults: DataFrame, lookback: int = 90) -> DataFrame:
    """Counts, levels, evidence, recency and dominant component of one window."""
    specs = [
        *counts(
            {
                "fault_count_window": None,
                "fault_l03plus_count_window": "action_level_num >= 3",
                "fault_l04plus_count_window": "action_level_num >= 4",
                "fault_mechanical_count_window": "is_mechanical = 1",
                "fault_electrical_count_window": "is_electrical = 1",
            },
            lookback,
        ),
        Feature("fault_unique_code_count_window", "distinct", "fault_code", oldest=lookback),
        Feature("fault_max_action_level_window", "max", "action_level_num", oldest=lookback),
        Feature("fault_max_evidence_score_window", "max", "evidence_score", oldest=lookback),
        Feature("fault_mean_evidence_score_window", "mean", "evidence_score", oldest=lookback),
        Feature("fault_max_log_occurrence_window", "max", "log_occurrence", oldest=lookback),
        Feature("fault_days_since_latest_in_window", "recency", "event_ceil", oldest=lookback),
        *_component_counts("__c_", lookback),
    ]
    out = window_features(spine, faults, specs)
    return out.withColumns(
        {
            "has_fault_window": (F.col("fault_count_window") > 0).cast("int"),
            "fault_dominant_component_window": dominant(
                [(c, F.col(f"__c_{c}")) for c in COMPONENT_WORDS], F.col("fault_count_window")
            ),
        }
    ).drop(*[f"__c_{c}" for c in COMPONENT_WORDS])


def fault_frozen(spine: DataFrame, faults: DataFrame) -> DataFrame:
    """The 7, 30 and 90-day fault set with growth, recency, evidence and meter rate."""
    parts = ("engine", "hydraulic", "powertrain", "scr", "workequipment", "cooling")
    specs = [
        Feature("fault_count_7d", "count", oldest=7),
        Feature("fault_count_30d", "count", oldest=30),
        Feature("fault_count_90d", "count", oldest=90),
        Feature("fault_count_previous_30d", "count", oldest=60, newest=31),
        Feature("days_since_last_fault", "recency", "event_ceil", oldest=None),
        Feature(
            "days_since_last_severe_fault", "recency", "event_ceil",
            when="action_level in ('L03', 'L04', 'L05')", oldest=None,
        ),
        Feature("smr_latest_before_snapshot", "max", "smr_hours", oldest=None),
        # the meter as of 90 days earlier counts an event at that very midnight
        Feature("__smr_then", "max", "smr_hours", oldest=None, newest=90, day="event_ceil"),
        Feature("unique_fault_code_count_90d", "distinct", "fault_code"),
        Feature("unique_component_count_90d", "distinct", "applicable_component"),
        *counts({"mechanical_fault_count_90d": "is_mechanical = 1",
                 "electrical_fault_count_90d": "is_electrical = 1"}, 90),
        *counts({"mechanical_fault_count_30d": "is_mechanical = 1",
                 "electrical_fault_count_30d": "is_electrical = 1"}, 30),
        *counts({f"action_{v}_count_90d": f"action_level = '{v}'" for v in ("L01", "L02", "L03", "L04")}, 90),
        Feature("max_action_level_90d", "max", "action_level_num"),
        Feature("sum_log_occurrence_90d", "sum", "log_occurrence"),
        Feature("max_log_occurrence_90d", "max", "log_occurrence"),
        Feature("occurrence_severity_score_90d", "sum", "occurrence_class"),
        *counts({"strong_fault_count_90d": "evidence_strength = 'STRONG'",
                 "moderate_fault_count_90d": "evidence_strength in ('MEDIUM', 'MODERATE')"}, 90),
        Feature("max_event_evidence_score_90d", "max", "evidence_score", "is_event_evidence"),
        Feature("avg_event_evidence_score_90d", "mean", "evidence_score", "is_event_evidence"),
        Feature("max_context_evidence_score_90d", "max", "evidence_score", "is_context_evidence"),
        *counts({f"{c}_fault_count_90d": f"is_component_{c}" for c in parts}, 90),
    ]
    out = window_features(spine, faults, specs)
    count = F.col("fault_count_90d")
    delta = F.greatest(F.col("smr_latest_before_snapshot") - F.col("__smr_then"), F.lit(0.0))
    delta = F.when(F.col("smr_latest_before_snapshot").isNotNull() & F.col("__smr_then").isNotNull(), delta)
    return out.withColumns(
        {
            "fault_growth_rate": F.col("fault_count_30d") - F.col("fault_count_previous_30d"),
            "fault_smr_delta_90d": delta,
            "faults_per_100_hours": ratio(
                count, F.greatest(F.coalesce(delta, F.lit(0.0)) / 100.0, F.lit(1.0))
            ),
            "repeat_fault_ratio_90d": ratio(
                count, F.greatest(F.col("unique_fault_code_count_90d"), F.lit(1))
            ),
            "top_component_fault_ratio_90d": ratio(
                F.greatest(*[F.col(f"{c}_fault_count_90d") for c in parts]), count
            ),
            "has_fault_90d": (count > 0).cast("int"),
        }
    ).drop("__smr_then")


def serious_fault_features(
    spine: DataFrame, faults: DataFrame, codes: Sequence[str] = (), lookback: int = 90,
    half_life: float = 30.0, key: str = "machine_key",
) -> DataFrame:
    """Rolling-origin fault set: weights, decay, systems, velocity and code pivots."""
    serious = "is_serious = 1"
    systems = {"eng": "ENG", "hst": "HST", "mon": "MON", "we": "WE|W/E"}
    specs = [
        Feature("fault_count_90d", "count", oldest=lookback),
        Feature("fault_count_7d", "count", oldest=7),
        *[
            Feature(n, "sum", v, oldest=lookback)
            for n, v in {
                "fault_log_occurrence_90d": "log_occ",
                "fault_serious_count_90d": "is_serious",
                "fault_serious_log_occurrence_90d": "serious_log_occ",
                "fault_severity_weighted_90d": "severity_weight",
                "fault_evidence_weighted_90d": "evidence_weight",
                "fault_l03_count_90d": "is_l03",
                "fault_l04_count_90d": "is_l04",
            }.items()
        ],
        Feature("fault_distinct_codes_90d", "distinct", "fault_code", oldest=lookback),
        Feature("fault_days_since_last", "recency", DAY, oldest=lookback, fill=lookback + 1),
        Feature("fault_serious_30d", "count", when=serious, oldest=30),
        Feature("__prior", "count", when=serious, oldest=lookback, newest=31),
        Feature("fault_days_since_last_serious", "recency", DAY, serious, lookback, fill=lookback + 1),
        Feature("fault_hst_serious_flag", "max", "is_hst", serious, lookback, fill=0),
        *counts(
            {f"fault_{n}_serious_count_90d": f"is_serious = 1 and system rlike '{p}'"
             for n, p in systems.items()},
            lookback,
        ),
        *counts(
            {f"fault_code_{safe_token(c)}_90d": f"is_serious = 1 and fault_code = {sql_text(c)}" for c in codes},
            lookback,
        ),
    ]
    out = window_features(spine, faults, specs, key=key)
    recent, prior = F.col("fault_serious_30d"), F.col("__prior")
    velocity = F.when(recent + prior == 0, F.lit(0.0)).otherwise(
        clip((recent + 1.0) / (prior / 2.0 + 1.0), 0.0, 20.0)
    )
    out = out.withColumns(
        {
            "fault_velocity_ratio": velocity,
            "has_accelerating_faults": (
                (recent >= 3) & (recent > F.lit(1.5) * (prior / 2.0 + 0.5))
            ).cast("int"),
        }
    ).drop("__prior")
    extra = decayed_severity(spine, faults, lookback, half_life, key).join(
        system_concentration(spine, faults, lookback, key), [key, AT], "full_outer"
    )
    out = out.join(extra, [key, AT], "left")
    fills = {
        "fault_severity_recency_90d": 0.0,
        "fault_distinct_serious_systems": 0,
        "fault_single_system_concentration": 0.0,
    }
    return out.fillna(fills)


def decayed_severity(
    spine: DataFrame, faults: DataFrame, lookback: int = 90, half_life: float = 30.0,
    key: str = "machine_key", name: str = "fault_severity_recency_90d",
) -> DataFrame:
    """Sum of severity times log occurrence, halved every ``half_life`` days of age."""
    daily = rows_on_days(
        faults.where("is_serious = 1"), key, DAY, {"__weight": F.sum(F.expr("severity * log_occ"))}
    )
    pairs = range_join(spine.select(key, AT), daily, key, AT, DAY, lookback)
    fade = F.pow(F.lit(0.5), F.col("age_days") / F.lit(half_life))
    return pairs.groupBy(key, AT).agg(F.sum(F.col("__weight") * fade).alias(name))


def system_concentration(
    spine: DataFrame, faults: DataFrame, lookback: int = 90, key: str = "machine_key"
) -> DataFrame:
    """Distinct systems of serious faults and the share of the most frequent one."""
    daily = (
        faults.where("is_serious = 1")
        .groupBy(key, DAY, "system").agg(F.count(F.lit(1)).alias("__rows"))
    )
    pairs = range_join(spine.select(key, AT), daily, key, AT, DAY, lookback)
    per_system = pairs.groupBy(key, AT, "system").agg(F.sum("__rows").alias("__rows"))
    return per_system.groupBy(key, AT).agg(
        F.count(F.lit(1)).alias("fault_distinct_serious_systems"),
        (F.max("__rows") / F.sum("__rows")).alias("fault_single_system_concentration"),
    )


def frequent_codes(faults: DataFrame, count: int) -> DataFrame:
    """The most frequent codes of serious faults (ties by code)."""
    return (
        faults.where("is_serious = 1 and fault_code is not null")
        .groupBy("fault_code").agg(F.count(F.lit(1)).alias("serious_rows"))
        .orderBy(F.desc("serious_rows"), "fault_code")
        .limit(count)
    )


def code_counts(
    spine: DataFrame, faults: DataFrame, codes: DataFrame, lookback: int = 90, key: str = "machine_key"
) -> DataFrame:
    """Long form of the code pivot: serious faults per spine row and chosen code."""
    daily = (
        faults.where("is_serious = 1").join(codes.select("fault_code"), "fault_code", "left_semi")
        .groupBy(key, DAY, "fault_code").agg(F.count(F.lit(1)).alias("__rows"))
    )
    pairs = range_join(spine.select(key, AT), daily, key, AT, DAY, lookback)
    return pairs.groupBy(key, AT, "fault_code").agg(F.sum("__rows").alias("code_rows"))


# ---------------------------------------------------------------- maintenance
def maintenance_basic(spine: DataFrame, events: DataFrame, lookback: int = 90) -> DataFrame:
    """Counts, smallest remaining hours, recency and dominant component of one window."""
    specs = [
        *counts(
            {
                "maintenance_event_count_window": None,
                "maintenance_monitor_reset_count_window": "is_reset",
                "maintenance_overdue_count_window": "is_overdue",
                "maintenance_due_now_count_window": "is_due_now",
            },
            lookback,
        ),
        Feature("maintenance_min_remaining_hours_window", "min", "remaining_hours", oldest=lookback),
        Feature("maintenance_days_since_latest_event_window", "recency", "event_ceil", oldest=lookback),
        *_component_counts("__c_", lookback),
    ]
    out = window_features(spine, events, specs)
    return out.withColumns(
        {
            "has_maintenance_window": (F.col("maintenance_event_count_window") > 0).cast("int"),
            "maintenance_dominant_component_window": dominant(
                [(c, F.col(f"__c_{c}")) for c in COMPONENT_WORDS],
                F.col("maintenance_event_count_window"),
            ),
        }
    ).drop(*[f"__c_{c}" for c in COMPONENT_WORDS])


# Component -> name used in the maintenance columns.
MAINTENANCE_COMPONENT_NAMES = {
    "engine": "engine",
    "powertrain": "transmission",
    "final_drive": "final_drive",
    "cooling": "cooling_system",
    "scr": "urea_scr_system",
}


def active_item_features(spine: DataFrame, events: DataFrame) -> DataFrame:
    """Active, overdue and due items from the latest state of every maintenance item."""
    names = MAINTENANCE_COMPONENT_NAMES
    states = latest_item_states(
        spine, events, "item",
        ["is_available", "is_overdue", "is_due_now", "remaining_hours",
         *[f"is_component_{c}" for c in names]],
        ["event_time", "remaining_hours"],
    ).where("is_available")
    tally = lambda c: F.coalesce(F.sum(F.expr(c).cast("long")), F.lit(0))
    out = states.groupBy(KEY, AT).agg(
        F.count(F.lit(1)).alias("active_maintenance_items"),
        F.greatest(tally("is_overdue"), tally("remaining_hours < 0")).alias("overdue_item_count"),
        F.greatest(tally("is_due_now"), tally("remaining_hours = 0")).alias("due_now_item_count"),
        F.avg("remaining_hours").alias("avg_remaining_hours"),
        F.min("remaining_hours").alias("min_remaining_hours"),
        *[tally(f"is_overdue and is_component_{c}").alias(f"{n}_overdue_item_count") for c, n in names.items()],
    )
    whole = [c for c in out.columns if c.endswith(("_items", "_count"))]
    out = spine.select(KEY, AT).join(out, [KEY, AT], "left").fillna(0, whole)
    return out.withColumn(
        "maintenance_due_or_overdue_ratio",
        ratio(F.col("due_now_item_count") + F.col("overdue_item_count"), F.col("active_maintenance_items")),
    )


def maintenance_frozen(spine: DataFrame, events: DataFrame) -> DataFrame:
    """The 90 and 180-day maintenance set with latest item states and reset recency."""
    reset = "is_reset"
    specs = [
        Feature("maintenance_events_180d", "count", oldest=180),
        Feature("monitor_reset_count_180d", "count", when=reset, oldest=180),
        Feature("maintenance_events_90d", "count", oldest=90),
        Feature("monitor_reset_count_90d", "count", when=reset, oldest=90),
        *counts({f"{n}_reset_count_180d": f"is_reset and is_component_{c}"
                 for c, n in MAINTENANCE_COMPONENT_NAMES.items()}, 180),
        *counts({f"{n}_reset_count_180d": f"is_reset and is_type_{n}" for n in MAINTENANCE_WORDS}, 180),
        Feature("unique_maintenance_type_count_180d", "distinct", "maintenance_type", reset, 180),
        Feature("days_since_last_reset", "recency", "event_ceil", reset, 180),
        Feature("days_since_last_oil_reset", "recency", "event_ceil", "is_reset and is_type_oil", 180),
        Feature("days_since_last_filter_reset", "recency", "event_ceil", "is_reset and is_type_filter", 180),
        Feature("__meter", "max", "smr_hours", oldest=None),
        # the last reset row decides even when its own meter is missing
        Feature(
            "__reset_meter", "latest", "coalesce(smr_hours, double('NaN'))", reset, 180,
            order="struct(event_time, smr_hours)",
        ),
    ]
    out = window_features(spine, events, specs)
    at_reset = F.when(~F.isnan("__reset_meter"), F.col("__reset_meter"))
    out = out.withColumns(
        {
            "maintenance_reset_ratio_180d": ratio(
                F.col("monitor_reset_count_180d"), F.col("maintenance_events_180d")
            ),
            "smr_since_last_reset": F.col("__meter") - at_reset,
            "has_maintenance_180d": (F.col("maintenance_events_180d") > 0).cast("int"),
        }
    ).drop("__meter", "__reset_meter")
    return out.join(active_item_features(spine, events), [KEY, AT], "left")


def reset_and_due_features(
    spine: DataFrame, events: DataFrame, lookback: int = 90, key: str = KEY
) -> DataFrame:
    """Days since the last reset (at most 1096) and distinct due, overdue and reset items."""
    specs = [
        Feature("pm_days_since_last_reset", "recency", DAY, "is_reset", None, fill=1096),
        Feature("pm_overdue_count_90d", "distinct", "item", "is_overdue", lookback),
        Feature("pm_due_count_90d", "distinct", "item", "is_due_now", lookback),
        Feature("pm_reset_count_90d", "distinct", "item", "is_reset", lookback),
        Feature("pm_record_count_90d", "count", oldest=lookback),
    ]
    out = window_features(spine, events, specs, key=key)
    return out.withColumn("pm_days_since_last_reset", clip(F.col("pm_days_since_last_reset"), 0, 1096))


# ---------------------------------------------------------------- operation
VALID_METER = "smr_valid_for_utilization_flag = 1 and smr_hours is not null"


def operation_basic(spine: DataFrame, days: DataFrame, lookback: int = 90) -> DataFrame:
    """Hours, idle share, meter progress and throttle days of one window."""
    specs = [
        Feature("__rows", "count", oldest=lookback),
        Feature("operation_day_count_window", "days", oldest=lookback),
        Feature("operation_working_hours_sum_window", "sum", "actual_working_hours_clean", oldest=lookback),
        Feature("operation_working_hours_mean_window", "mean", "actual_working_hours_clean", oldest=lookback),
        Feature("operation_working_hours_max_window", "max", "actual_working_hours_clean", oldest=lookback),
        Feature("operation_engine_running_hours_sum_window", "sum", "engine_running_hours_clean", oldest=lookback),
        Feature("operation_idle_hours_sum_window", "sum", "engine_idling_hours_clean", oldest=lookback),
        Feature("operation_latest_smr_window", "latest", "smr_hours", VALID_METER, lookback),
        Feature("__first_smr", "first", "smr_hours", VALID_METER, lookback),
        Feature("operation_high_throttle_day_count_window", "sum", "high_throttle_day_flag", oldest=lookback),
    ]
    out = window_features(spine, days, specs)
    return out.withColumns(
        {
            "has_operation_window": (F.col("__rows") > 0).cast("int"),
            "operation_idle_share_window": ratio(
                F.col("operation_idle_hours_sum_window"), F.col("operation_engine_running_hours_sum_window")
            ),
            # greatest() skips NULL, so a window without a valid meter needs the guard
            "operation_smr_delta_window": F.when(
                F.col("__first_smr").isNotNull(),
                F.greatest(F.col("operation_latest_smr_window") - F.col("__first_smr"), F.lit(0.0)),
            ),
        }
    ).drop("__rows", "__first_smr")


def operation_frozen(spine: DataFrame, days: DataFrame) -> DataFrame:
    """The 7, 30 and 90-day operation set with ratios, rate changes and latest row state."""
    work, engine = "actual_working_hours_clean", "engine_running_hours_clean"
    sums = {
        "smr_delta": ("smr_delta_clean_since_prev_obs_hours", (7, 30, 90)),
        "working_hours_sum": (work, (7, 30, 90)),
        "actual_work_day_count": ("actual_work_day_flag", (7, 30, 90)),
        "__work_valid": ("actual_work_valid_flag", (30, 90)),
        "actual_work_seconds_invalid_count": ("actual_work_seconds_invalid_flag", (90,)),
        "fuel_actual_work_conflict_count": ("fuel_actual_work_conflict_flag", (90,)),
        "engine_running_hours_sum": (engine, (7, 30, 90)),
        "engine_running_day_count": ("engine_running_day_flag", (30, 90)),
        "__engine_valid": ("engine_seconds_valid_flag", (30, 90)),
        "throttle_full_hours_sum": ("throttle_full_hours_clean", (30, 90)),
        "__idle": ("engine_idling_hours_clean", (90,)),
        "engine_observed_day_count": ("engine_seconds_observed_flag", (90,)),
        "throttle_observed_day_count": ("throttle_observed_flag", (90,)),
        "work_idle_sum_exceeds_engine_count": ("work_idle_sum_exceeds_engine_flag", (90,)),
        "high_throttle_day_count": ("high_throttle_day_flag", (90,)),
        "long_engine_day_count": ("long_engine_day_flag", (90,)),
        "travel_hours_sum": ("traveling_hours_clean", (30, 90)),
        "travel_day_count": ("travel_day_flag", (30, 90)),
        "__travel_usable": ("travel_usable_flag", (30, 90)),
        "moving_back_forth_hours_sum": ("moving_back_forth_hours_clean", (90,)),
        "steering_hours_sum": ("steering_hours_clean", (90,)),
        "auto_quick_shift_hours_sum": ("auto_quick_shift_hours_clean", (90,)),
        "manual_variable_shift_hours_sum": ("manual_variable_shift_hours_clean", (90,)),
    }
    ran, worked, traveled = "engine_running_day_flag = 1", "actual_work_day_flag = 1", "travel_day_flag = 1"
    dial = "throttle_average_dial_position_clean"
    specs = [
        *[Feature(f"{n}_{w}d", "sum", v, oldest=w) for n, (v, windows) in sums.items() for w in windows],
        Feature("__rows_30d", "count", oldest=30),
        Feature("__rows_90d", "count", oldest=90),
        Feature("max_working_hours_day_90d", "max", work),
        Feature("working_hours_stddev_actual_work_day_90d", "stddev", work, worked),
        Feature("engine_running_hours_max_day_90d", "max", engine),
        Feature("engine_running_hours_stddev_engine_day_90d", "stddev", engine, ran),
        Feature("avg_throttle_dial_position_active_30d", "mean", dial, ran, 30),
        Feature("avg_throttle_dial_position_active_90d", "mean", dial, ran, 90),
        Feature("smr_latest_hours", "latest", "smr_hours", VALID_METER, None),
        Feature("days_since_last_smr", "recency", DAY, VALID_METER, None),
        Feature("days_since_last_engine_running_day", "recency", DAY, ran, None),
        Feature("days_since_last_travel_day", "recency", DAY, traveled, None),
        Feature(
            "__latest", "latest",
            "struct(event_day, last_work_day, actual_work_streak_through_current_day as streak)", None, None,
            order="struct(last_work_day, actual_work_streak_through_current_day)",
        ),
    ]
    out = window_features(spine, days, specs)
    c = F.col
    rate = lambda name: c(f"{name}_30d") / 30.0 - c(f"{name}_90d") / 90.0
    usable = {w: F.when(c(f"__travel_usable_{w}d") != 0, c(f"__travel_usable_{w}d"))
              .otherwise(c(f"__rows_{w}d").cast("double")) for w in (30, 90)}
    work_ratio = {w: ratio(c(f"actual_work_day_count_{w}d"), c(f"__work_valid_{w}d")) for w in (30, 90)}
    throttle = {w: ratio(c(f"throttle_full_hours_sum_{w}d"), c(f"engine_running_hours_sum_{w}d")) for w in (30, 90)}
    derived = {
        "actual_work_day_ratio_30d": work_ratio[30],
        "actual_work_day_ratio_90d": work_ratio[90],
        "actual_work_day_ratio_change_30d_vs_90d": work_ratio[30] - work_ratio[90],
        "actual_work_valid_flag": c("__work_valid_90d"),
        "working_hours_rate_change_30d_vs_90d": rate("working_hours_sum"),
        "avg_working_hours_per_actual_work_day_30d": ratio(c("working_hours_sum_30d"), c("actual_work_day_count_30d")),
        "avg_working_hours_per_actual_work_day_90d": ratio(c("working_hours_sum_90d"), c("actual_work_day_count_90d")),
        "days_since_last_actual_work_day": F.datediff(c(AT), c("__latest.last_work_day")),
        "current_actual_work_streak_days": F.when(
            F.datediff(c(AT), c("__latest.event_day")) == 1, c("__latest.streak")
        ).otherwise(F.when(c("__latest").isNull() | (F.datediff(c(AT), c("__latest.event_day")) != 1), F.lit(0.0))),
        "engine_running_day_ratio_30d": ratio(c("engine_running_day_count_30d"), c("__engine_valid_30d")),
        "engine_running_day_ratio_90d": ratio(c("engine_running_day_count_90d"), c("__engine_valid_90d")),
        "engine_running_rate_change_30d_vs_90d": rate("engine_running_hours_sum"),
        "avg_engine_running_hours_per_engine_day_90d": ratio(
            c("engine_running_hours_sum_90d"), c("engine_running_day_count_90d")
        ),
        "engine_idling_share_90d": ratio(c("__idle_90d"), c("engine_running_hours_sum_90d")),
        "throttle_full_engine_share_30d": throttle[30],
        "throttle_full_engine_share_90d": throttle[90],
        "throttle_full_share_change_30d_vs_90d": throttle[30] - throttle[90],
        "avg_travel_hours_per_travel_day_30d": ratio(c("travel_hours_sum_30d"), c("travel_day_count_30d")),
        "avg_travel_hours_per_travel_day_90d": ratio(c("travel_hours_sum_90d"), c("travel_day_count_90d")),
        "moving_back_forth_to_travel_ratio_90d": ratio(c("moving_back_forth_hours_sum_90d"), c("travel_hours_sum_90d")),
        "travel_day_ratio_observed_30d": ratio(c("travel_day_count_30d"), usable[30]),
        "travel_day_ratio_observed_90d": ratio(c("travel_day_count_90d"), usable[90]),
        "travel_rate_change_30d_vs_90d": rate("travel_hours_sum"),
        "has_travel_data_90d": (usable[90] > 0).cast("int"),
        "travel_share_of_working_hours_90d": ratio(c("travel_hours_sum_90d"), c("working_hours_sum_90d")),
        "steering_to_travel_ratio_90d": ratio(c("steering_hours_sum_90d"), c("travel_hours_sum_90d")),
        "has_operation_90d": (c("__rows_90d") > 0).cast("int"),
    }
    hidden = [n for n in out.columns if n.startswith("__")] + ["throttle_full_hours_sum_30d"]
    return out.withColumns(derived).drop(*hidden)


def utilization_features(
    spine: DataFrame, days: DataFrame, key: str = KEY
) -> DataFrame:
    """30 and 90-day utilization, sensor staleness, history length and liveness."""
    sums = {
        "smr_delta": "smr_delta_clean_since_prev_obs_hours",
        "engine_hours": "engine_running_hours_clean",
        "work_hours": "actual_working_hours_clean",
        "active_days": "engine_running_day_flag",
        "travel_hours": "traveling_hours_clean",
    }
    means = {"idle_share_mean": "engine_idle_share_daily", "throttle_share_mean": "throttle_full_share_clean"}
    specs = [Feature("days_since_last_sensor_reading", "recency", DAY, oldest=None, fill=366)]
    for w in (30, 90):
        specs += [Feature(f"{n}_{w}d", "sum", v, oldest=w) for n, v in sums.items()]
        specs += [Feature(f"{n}_{w}d", "mean", v, oldest=w) for n, v in means.items()]
        specs.append(Feature(f"operation_records_{w}d", "count", oldest=w))
    out = window_features(spine, days, specs, key=key)
    first = rows_on_days(days, key, DAY, {"__n": F.count(F.lit(1))}).groupBy(key).agg(
        F.min(DAY).alias("__first")
    )
    stale = clip(F.col("days_since_last_sensor_reading"), 0, 366)
    return (
        out.join(first, key, "left")
        .withColumns(
            {
                "days_since_last_sensor_reading": stale,
                "operation_history_days": F.greatest(
                    F.coalesce(F.datediff(AT, "__first"), F.lit(0)), F.lit(0)
                ),
                "utilization_velocity_ratio": clip(
                    (F.col("engine_hours_30d") + 1) / (F.col("engine_hours_90d") / 3 + 1), 0.0, 10.0
                ),
                "is_recently_live": (stale <= 21).cast("int"),
            }
        )
        .drop("__first")
    )


# ---------------------------------------------------------------- fluid samples
def fluid_basic(spine: DataFrame, samples: DataFrame, lookback: int = 90) -> DataFrame:
    """Sample count, severities, recency and the largest value of five measures."""
    measures = {
        "fluid_max_cu_ppm_window": "Cu_Copper_PPM",
        "fluid_max_fe_ppm_window": "Fe_Iron_PPM",
        "fluid_max_pb_ppm_window": "Pb_Lead_PPM",
        "fluid_max_soot_percent_window": "Soot_Soot_PERCENT",
        "fluid_max_water_percent_window": "Water_Water_PERCENT",
    }
    specs = [
        Feature("fluid_sample_count_window", "count", oldest=lookback),
        Feature("fluid_max_severity_window", "max", "severity", oldest=lookback),
        # the greatest value of the latest day
        Feature("fluid_latest_severity_window", "latest", "severity", oldest=lookback),
        Feature("fluid_days_since_latest_sample_window", "recency", DAY, oldest=lookback),
        *[Feature(n, "max", v, oldest=lookback) for n, v in measures.items()],
    ]
    return window_features(spine, samples, specs).withColumn(
        "has_fluid_window", (F.col("fluid_sample_count_window") > 0).cast("int")
    )


def fluid_frozen(
    spine: DataFrame, samples: DataFrame, measures: Sequence[str] = FLUID_MEASURES, lookback: int = 365
) -> DataFrame:
    """Latest known value of every measure (largest of its day), count, recency, meter."""
    specs = [
        *[Feature(m, "latest", m, oldest=lookback) for m in measures],
        Feature(f"fluid_sample_count_{lookback}d", "count", oldest=lookback),
        Feature("days_since_last_fluid_sample", "recency", DAY, oldest=None),
        Feature(f"fluid_sample_severity_max_{lookback}d", "max", "severity", oldest=lookback),
        Feature("fluid_sample_latest_smr", "max", "smr_hours", oldest=None),
    ]
    return window_features(spine, samples, specs)


# Measures carried forward by the rolling-origin fluid features.
CARRIED_MEASURES = (
    "Water_Water_PERCENT", "Gly_Glycol_PERCENT", "EthyleneGlycol_Ethylene_Glycol_PERCENT",
    "Fuel_Fuel_PERCENT", "Si_Silicon_PPM", "Fe_Iron_PPM", "Cu_Copper_PPM",
)


def daily_samples(
    graded: DataFrame, order: str, key: str = KEY, measures: Sequence[str] = CARRIED_MEASURES
) -> DataFrame:
    """One sample per (key, day): the one with the greatest ``order`` value."""
    payload = F.struct("severity_known", "is_abnormal", "contaminant_flag", *measures)
    return graded.groupBy(key, DAY).agg(F.max_by(payload, F.col(order)).alias("__row")).select(
        key, DAY, "__row.*"
    )


def carried_fluid_features(
    spine: DataFrame, graded: DataFrame, order: str, lookback: int = 90, expiry: int = 365,
    key: str = KEY, measures: Sequence[str] = CARRIED_MEASURES,
) -> DataFrame:
    """Latest severity, trend, flag and measures, carried forward until they expire.

    ``order`` decides between samples of the same day.
    """
    known = severity_trend(graded, order, key).withColumn("known_day", F.col(DAY))
    latest = daily_samples(graded, order, key, measures).withColumn("sample_day", F.col(DAY))
    out = asof_join(
        spine, known, key, AT, DAY, ["severity_known", "severity_trend", "known_day"], inclusive=False,
        prefix="__k_",
    )
    out = asof_join(
        out, latest, key, AT, DAY, ["contaminant_flag", "sample_day", *measures], inclusive=False,
        prefix="__a_",
    )
    out = window_features(
        out, graded.where("severity_known is not null"),
        [Feature("fluid_recent_abnormal_count_90d", "count", when="is_abnormal = 1", oldest=lookback)], key=key,
    )
    known_age = F.datediff(F.col(AT), F.col("__k_known_day"))
    any_age = F.datediff(F.col(AT), F.col("__a_sample_day"))
    alive, any_alive = known_age <= expiry, any_age <= expiry
    zero = lambda cond, c: F.coalesce(F.when(cond, F.col(c)), F.lit(0.0))
    age = lambda c: F.coalesce(F.least(c, F.lit(expiry + 1)), F.lit(expiry + 1))
    return out.select(
        *spine.columns,
        zero(alive, "__k_severity_known").alias("fluid_current_severity"),
        zero(alive, "__k_severity_trend").alias("fluid_worsening_trend"),
        age(known_age).alias("fluid_sample_staleness_days"),
        "fluid_recent_abnormal_count_90d",
        zero(any_alive, "__a_contaminant_flag").cast("int").alias("fluid_contaminant_flag"),
        age(any_age).alias("fluid_any_sample_staleness_days"),
        F.coalesce(any_alive, F.lit(False)).cast("int").alias("fluid_sample_known_flag"),
        *[F.when(any_alive, F.col(f"__a_{m}")).alias(f"fluid_locf_{safe_token(m).lower()}") for m in measures],
    )


# ---------------------------------------------------------------- claims
def claim_basic(spine: DataFrame, claims: DataFrame, lookback: int = 90) -> DataFrame:
    """Claims before the window starts: count and recency."""
    return window_features(
        spine, claims,
        [
            Feature("prior_claim_count_before_window", "count", oldest=None, newest=lookback + 1),
            Feature("days_since_prior_claim_before_window", "recency", DAY, oldest=None, newest=lookback + 1),
        ],
    )


def claim_frozen(spine: DataFrame, claims: DataFrame) -> DataFrame:
    """Prior claims of 90, 180 and 365 days with amounts, types and recency."""
    out = window_features(
        spine, claims,
        [
            *[Feature(f"prior_claim_count_{w}d", "count", oldest=w) for w in (365, 180, 90)],
            Feature("days_since_last_claim", "recency", DAY, oldest=None),
            Feature("prior_claim_amount_sum_365d", "sum", "claim_amount", oldest=365),
            Feature("prior_claim_amount_max_365d", "max", "claim_amount", oldest=365),
            Feature("unique_claim_type_count_365d", "distinct", "claim_type", oldest=365),
        ],
    )
    return out.withColumn("has_prior_claim_365d", (F.col("prior_claim_count_365d") > 0).cast("int"))


def prior_event_features(spine: DataFrame, event_days: DataFrame, key: str = KEY) -> DataFrame:
    """Days since the prior target event (at most 1096) and counts of 90, 365 and 730 days."""
    out = window_features(
        spine, event_days,
        [
            Feature("days_since_prior_target_event", "recency", DAY, oldest=None, fill=1096),
            *[Feature(f"prior_target_event_count_{w}d", "count", oldest=w) for w in (90, 365, 730)],
        ],
        key=key,
    )
    return out.withColumn(
        "days_since_prior_target_event", clip(F.col("days_since_prior_target_event"), 0, 1096)
    )


def evidence_flags(df: DataFrame) -> DataFrame:
    """Flags for evidence per source and their count."""
    flags = {
        "has_fault_evidence_90d": F.col("fault_count_90d") > 0,
        "has_fluid_evidence_365d": F.col("fluid_sample_known_flag") > 0,
        "has_pm_evidence_90d": F.col("pm_record_count_90d") > 0,
        "has_operation_evidence_30d": F.col("operation_records_30d") > 0,
    }
    out = df.withColumns({n: c.cast("int") for n, c in flags.items()})
    total = F.lit(0)
    for name in flags:
        total = total + F.col(name)
    return out.withColumn("source_evidence_count", total)
