"""Snapshot feature queries: one per source and feature mode, and the unified table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import COMPONENT_WORDS, MAINTENANCE_WORDS
from tidemark.operators import source_features as sf
from tidemark.plans import roles
from tidemark.plans.registry import query, round_sql, rounded
from tidemark.sources import standardize as std

LATEST_MEASURES = std.FLUID_MEASURES


def like_any(text: str, words) -> str:
    hits = " OR ".join(f"contains(lower({text}), '{w}')" for w in words)
    return f"coalesce({hits}, FALSE)"


_CEIL = "CASE WHEN event_time > CAST(CAST(event_time AS DATE) AS TIMESTAMP) THEN CAST(event_time AS DATE) + 1 ELSE CAST(event_time AS DATE) END"
_FAULT_RELATED = "(related_component || ' ' || related_component_1 || ' ' || applicable_component)"
FAULT_SQL = f"""
SELECT full_model || ' ' || serial_number AS model_id, CAST(event_time AS DATE) AS event_day,
  {_CEIL} AS event_ceil, event_time, trim(fault_code) AS fault_code,
  upper(trim(event_action_level)) AS action_level,
  coalesce(CAST(action_level_num AS DOUBLE), CAST(nullif(regexp_extract(event_action_level, '([0-9]+)', 1), '') AS DOUBLE)) AS action_level_num,
  coalesce(CAST(log_occurrence_count AS DOUBLE), ln(1 + coalesce(occurrence_count, 1))) AS log_occurrence,
  CAST(occurrence_class AS DOUBLE) AS occurrence_class, CAST(smr_hours AS DOUBLE) AS smr_hours,
  CAST(failure_code_evidence_score AS DOUBLE) AS evidence_score,
  upper(failure_code_evidence_strength_class) AS evidence_strength, applicable_component,
  is_mechanical_failure_code AS is_mechanical, is_electrical_failure_code AS is_electrical,
  {', '.join(f"{like_any(_FAULT_RELATED, w)} AS is_component_{c}" for c, w in COMPONENT_WORDS.items())},
  coalesce(upper(failure_code_evidence_group) = 'EVENT', FALSE) OR coalesce(contains(lower(history_category), 'event'), FALSE) AS is_event_evidence,
  coalesce(upper(failure_code_evidence_group) = 'CONTEXT', FALSE) OR coalesce(contains(lower(history_category), 'context'), FALSE) AS is_context_evidence
FROM ({roles.RAW_FAULT_SQL}) AS raw"""

_PM_RELATED = "(related_component || ' ' || related_component_1 || ' ' || related_component_2)"
MAINTENANCE_SQL = f"""
SELECT machine_id AS model_id, CAST(event_time AS DATE) AS event_day, {_CEIL} AS event_ceil, event_time,
  EVENT_NAME_EN AS item, CAST(smr_hours AS DOUBLE) AS smr_hours, CAST(remaining_hours AS DOUBLE) AS remaining_hours,
  lower(is_monitor_reset) = 'true' AS is_reset, lower(is_overdue) = 'y' AS is_overdue,
  is_due_now = '1' AS is_due_now, AVAILABLE <> 'f' AS is_available, maintenance_type,
  {', '.join(f"{like_any(_PM_RELATED, w)} AS is_component_{c}" for c, w in COMPONENT_WORDS.items())},
  {', '.join(f"{like_any('maintenance_type', w)} AS is_type_{c}" for c, w in MAINTENANCE_WORDS.items())}
FROM ({roles.RAW_MAINTENANCE_SQL}) AS raw"""

OPERATION_SQL = f"""
SELECT * REPLACE (CASE WHEN smr_valid_for_utilization_flag = 'yes' THEN 1 ELSE 0 END AS smr_valid_for_utilization_flag,
                  CASE WHEN fuel_actual_work_conflict_flag = 't' THEN 1 ELSE 0 END AS fuel_actual_work_conflict_flag),
  machine_id AS model_id, LOCAL_DATE AS event_day, last_actual_work_date_through_current_day AS last_work_day
FROM ({roles.RAW_OPERATION_SQL}) AS raw"""

CLAIM_SQL = f"""
SELECT machine_id AS model_id, full_model, local_date AS event_day, claim_number,
  claim_type_description AS claim_type, coalesce(claim_amount, 0) AS claim_amount,
  critical_fail_part_number, failure_smr
FROM ({roles.RAW_CLAIM_SQL}) AS raw"""

FLUID_SQL = f"""
SELECT machine_id AS model_id, sample_drawn_date AS event_day, LABS_SAMPLE_NUMBER AS sample_id,
  CAST(sample_result_severity_order AS DOUBLE) AS severity, CAST(TELEMETRY_SMR_NUMERIC AS DOUBLE) AS smr_hours,
  * EXCLUDE (machine_id, sample_drawn_date, LABS_SAMPLE_NUMBER, sample_result_severity_order, TELEMETRY_SMR_NUMERIC)
FROM ({roles.RAW_FLUID_SQL}) AS raw"""


def age_sql(spine: str, events: str, extra: str = "") -> str:
    """CTEs ``spine``, ``events`` and ``pairs`` (every earlier event with its age)."""
    return f"""WITH spine AS ({spine}), events_std AS ({events}),
pairs AS (SELECT s.model_id AS mid, s.snapshot_date AS snap, date_diff('day', e.event_day, s.snapshot_date) AS age, e.*
          FROM spine s JOIN events_std e ON s.model_id = e.model_id AND e.event_day < s.snapshot_date){extra}"""


def spine_agg(spine: str, events: str, outputs: dict[str, str], derived: dict[str, str] | None = None,
              extra: str = "", joins: str = "") -> str:
    """Twin body: brute-force pairs, aggregates with filters, derived columns on top."""
    aggs = ", ".join(f"{e} AS {n}" for n, e in outputs.items())
    more = "".join(f", {e} AS {n}" for n, e in (derived or {}).items())
    return f"""{age_sql(spine, events, extra)},
agg AS (SELECT mid, snap, {aggs} FROM pairs GROUP BY mid, snap),
wide AS (SELECT s.model_id, s.snapshot_date, a.* EXCLUDE (mid, snap) FROM spine s
         LEFT JOIN agg a ON s.model_id = a.mid AND s.snapshot_date = a.snap)
SELECT wide.*{more} FROM wide {joins}"""


def w(n: int, cond: str | None = None, newest: int = 1) -> str:
    """FILTER clause of the window of the last ``n`` days."""
    extra = f" AND ({cond})" if cond else ""
    return f"FILTER (WHERE age BETWEEN {newest} AND {n}{extra})"


def n0(expr: str) -> str:
    return f"coalesce({expr}, 0)"


def count(n: int, cond: str | None = None, newest: int = 1) -> str:
    return f"count(*) {w(n, cond, newest)}"


def dominant_sql(names, rows: str) -> str:
    top = "greatest(" + ", ".join(names.values()) + ")"
    arms = " ".join(f"WHEN {c} = {top} THEN '{n}'" for n, c in names.items())
    return f"CASE WHEN coalesce({rows}, 0) = 0 THEN 'none' WHEN {top} <= 0 THEN 'other' {arms} END"


# ------------------------------------------------------------------ faults
_FB = {
    "fault_count_window": count(14),
    "fault_l03plus_count_window": count(14, "action_level_num >= 3"),
    "fault_l04plus_count_window": count(14, "action_level_num >= 4"),
    "fault_mechanical_count_window": count(14, "is_mechanical = 1"),
    "fault_electrical_count_window": count(14, "is_electrical = 1"),
    "fault_unique_code_count_window": f"count(DISTINCT nullif(fault_code, '')) {w(14)}",
    "fault_max_action_level_window": f"max(action_level_num) {w(14)}",
    "fault_max_evidence_score_window": f"max(evidence_score) {w(14)}",
    "fault_mean_evidence_score_window": f"avg(evidence_score) {w(14)}",
    "fault_max_log_occurrence_window": f"max(log_occurrence) {w(14)}",
    "fault_days_since_latest_in_window": f"floor(epoch(snap::TIMESTAMP - max(event_time) {w(14)}) / 86400)",
    **{f"c_{c}": count(14, f"is_component_{c}") for c in COMPONENT_WORDS},
}
_FB_COUNTS = [c for c in _FB if c.endswith("_count_window")]
_FAULT_BASIC_BODY = spine_agg(
    roles.EVENT_SPINE_SQL, FAULT_SQL, _FB,
    {"fault_dominant_component_window": dominant_sql({c: f"c_{c}" for c in COMPONENT_WORDS}, "fault_count_window")},
)
FAULT_BASIC_SQL = round_sql(
    _FAULT_BASIC_BODY,
    ["model_id", "snapshot_date", *[f"coalesce({c}, 0) AS {c}" for c in _FB_COUNTS],
     "CAST(coalesce(fault_count_window, 0) > 0 AS INT) AS has_fault_window", "fault_dominant_component_window",
     "CAST(fault_days_since_latest_in_window AS INT) AS fault_days_since_latest_in_window"],
    ["fault_max_action_level_window", "fault_max_evidence_score_window",
     "fault_mean_evidence_score_window", "fault_max_log_occurrence_window"],
)


@query("fault_window_basic", "E1 E2 D1 J3 J1", FAULT_BASIC_SQL)
def _(t):
    spine = roles.event_spine(t).drop("full_model")
    faults = std.keep_known(std.standard_faults(roles.raw_fault(t), spine), spine)
    return rounded(sf.fault_basic(spine, faults, 14))


_PARTS = ("engine", "hydraulic", "powertrain", "scr", "workequipment", "cooling")
_FF = {
    "fault_count_7d": count(7), "fault_count_30d": count(30), "fault_count_90d": count(90),
    "fault_count_previous_30d": count(60, newest=31),
    "days_since_last_fault": "floor(epoch(snap::TIMESTAMP - max(event_time)) / 86400)",
    "days_since_last_severe_fault": "floor(epoch(snap::TIMESTAMP - max(event_time) FILTER (WHERE action_level IN ('L03','L04','L05'))) / 86400)",
    "smr_latest_before_snapshot": "max(smr_hours)",
    "smr_then": "max(smr_hours) FILTER (WHERE event_time <= snap - INTERVAL 90 DAY)",
    "unique_fault_code_count_90d": f"count(DISTINCT nullif(fault_code, '')) {w(90)}",
    "unique_component_count_90d": f"count(DISTINCT nullif(applicable_component, '')) {w(90)}",
    "mechanical_fault_count_90d": count(90, "is_mechanical = 1"),
    "electrical_fault_count_90d": count(90, "is_electrical = 1"),
    "mechanical_fault_count_30d": count(30, "is_mechanical = 1"),
    "electrical_fault_count_30d": count(30, "is_electrical = 1"),
    **{f"action_{v}_count_90d": count(90, f"action_level = '{v}'") for v in ("L01", "L02", "L03", "L04")},
    "max_action_level_90d": f"max(action_level_num) {w(90)}",
    "sum_log_occurrence_90d": f"sum(log_occurrence) {w(90)}",
    "max_log_occurrence_90d": f"max(log_occurrence) {w(90)}",
    "occurrence_severity_score_90d": f"sum(occurrence_class) {w(90)}",
    "strong_fault_count_90d": count(90, "evidence_strength = 'STRONG'"),
    "moderate_fault_count_90d": count(90, "evidence_strength IN ('MEDIUM','MODERATE')"),
    "max_event_evidence_score_90d": f"max(evidence_score) {w(90, 'is_event_evidence')}",
    "avg_event_evidence_score_90d": f"avg(evidence_score) {w(90, 'is_event_evidence')}",
    "max_context_evidence_score_90d": f"max(evidence_score) {w(90, 'is_context_evidence')}",
    **{f"{c}_fault_count_90d": count(90, f"is_component_{c}") for c in _PARTS},
}
_FF_WHOLE = [c for c in _FF if c.startswith(("fault_count", "unique_", "mechanical", "electrical", "action_", "strong", "moderate")) or c.endswith("_fault_count_90d")]
_DELTA = "greatest(smr_latest_before_snapshot - smr_then, 0)"
FAULT_FROZEN_SQL = round_sql(
    spine_agg(
        roles.EVENT_SPINE_SQL, FAULT_SQL, _FF,
        {
            "fault_smr_delta_90d": f"CASE WHEN smr_latest_before_snapshot IS NULL OR smr_then IS NULL THEN NULL ELSE {_DELTA} END",
            "faults_per_100_hours": f"coalesce(fault_count_90d, 0) / greatest(coalesce(CASE WHEN smr_then IS NULL THEN NULL ELSE {_DELTA} END, 0) / 100.0, 1)",
            "repeat_fault_ratio_90d": "coalesce(fault_count_90d / greatest(unique_fault_code_count_90d, 1), 0)",
            "top_component_fault_ratio_90d": "coalesce(greatest(" + ", ".join(f"{c}_fault_count_90d" for c in _PARTS) + ") / nullif(fault_count_90d, 0), 0)",
        },
    ),
    ["model_id", "snapshot_date", *[f"coalesce({c}, 0) AS {c}" for c in _FF_WHOLE],
     "coalesce(fault_count_30d - fault_count_previous_30d, 0) AS fault_growth_rate",
     "CAST(coalesce(fault_count_90d, 0) > 0 AS INT) AS has_fault_90d",
     "CAST(days_since_last_fault AS INT) AS days_since_last_fault",
     "CAST(days_since_last_severe_fault AS INT) AS days_since_last_severe_fault",
     "round(coalesce(sum_log_occurrence_90d, 0), 9) AS sum_log_occurrence_90d",
     "round(coalesce(occurrence_severity_score_90d, 0), 9) AS occurrence_severity_score_90d"],
    ["smr_latest_before_snapshot", "max_action_level_90d", "max_log_occurrence_90d", "max_event_evidence_score_90d",
     "avg_event_evidence_score_90d", "max_context_evidence_score_90d", "fault_smr_delta_90d", "faults_per_100_hours",
     "repeat_fault_ratio_90d", "top_component_fault_ratio_90d"],
)


@query("fault_window_frozen", "E3 E4 B14", FAULT_FROZEN_SQL)
def _(t):
    # dates far enough from the first event that the meter of 90 days earlier exists
    spine = roles.event_spine(t).drop("full_model")
    faults = std.keep_known(std.standard_faults(roles.raw_fault(t), spine), spine)
    return rounded(sf.fault_frozen(spine, faults))


# ------------------------------------------------------------------ maintenance
_MB = {
    "maintenance_event_count_window": count(14),
    "maintenance_monitor_reset_count_window": count(14, "is_reset"),
    "maintenance_overdue_count_window": count(14, "is_overdue"),
    "maintenance_due_now_count_window": count(14, "is_due_now"),
    "maintenance_min_remaining_hours_window": f"min(remaining_hours) {w(14)}",
    "maintenance_days_since_latest_event_window": f"floor(epoch(snap::TIMESTAMP - max(event_time) {w(14)}) / 86400)",
    **{f"c_{c}": count(14, f"is_component_{c}") for c in COMPONENT_WORDS},
}
MAINTENANCE_BASIC_SQL = round_sql(
    spine_agg(
        roles.EVENT_SPINE_SQL, MAINTENANCE_SQL, _MB,
        {"maintenance_dominant_component_window": dominant_sql({c: f"c_{c}" for c in COMPONENT_WORDS}, "maintenance_event_count_window")},
    ),
    ["model_id", "snapshot_date", *[f"coalesce({c}, 0) AS {c}" for c in _MB if c.endswith("_count_window")],
     "CAST(coalesce(maintenance_event_count_window, 0) > 0 AS INT) AS has_maintenance_window",
     "maintenance_dominant_component_window",
     "CAST(maintenance_days_since_latest_event_window AS INT) AS maintenance_days_since_latest_event_window"],
    ["maintenance_min_remaining_hours_window"],
)


@query("maintenance_window_basic", "E5 E2 D2", MAINTENANCE_BASIC_SQL)
def _(t):
    spine = roles.event_spine(t).drop("full_model")
    events = std.keep_known(std.standard_maintenance(roles.raw_maintenance(t), spine), spine)
    return rounded(sf.maintenance_basic(spine, events, 14))


_NAMES = sf.MAINTENANCE_COMPONENT_NAMES
_LATEST_ITEM = """,
item_rows AS (SELECT *, row_number() OVER (PARTITION BY mid, snap, item ORDER BY event_time DESC, remaining_hours DESC NULLS LAST) AS rn FROM pairs),
items AS (SELECT mid, snap, count(*) AS active_maintenance_items,
  greatest(count(*) FILTER (WHERE is_overdue), count(*) FILTER (WHERE remaining_hours < 0)) AS overdue_item_count,
  greatest(count(*) FILTER (WHERE is_due_now), count(*) FILTER (WHERE remaining_hours = 0)) AS due_now_item_count,
  avg(remaining_hours) AS avg_remaining_hours, min(remaining_hours) AS min_remaining_hours,
  """ + ", ".join(f"count(*) FILTER (WHERE is_overdue AND is_component_{c}) AS {n}_overdue_item_count" for c, n in _NAMES.items()) + """
  FROM item_rows WHERE rn = 1 AND is_available GROUP BY mid, snap)"""
_MF = {
    "maintenance_events_180d": count(180), "monitor_reset_count_180d": count(180, "is_reset"),
    "maintenance_events_90d": count(90), "monitor_reset_count_90d": count(90, "is_reset"),
    **{f"{n}_reset_count_180d": count(180, f"is_reset AND is_component_{c}") for c, n in _NAMES.items()},
    **{f"{n}_reset_count_180d": count(180, f"is_reset AND is_type_{n}") for n in MAINTENANCE_WORDS},
    "unique_maintenance_type_count_180d": f"count(DISTINCT nullif(maintenance_type, '')) {w(180, 'is_reset')}",
    "days_since_last_reset": f"floor(epoch(snap::TIMESTAMP - max(event_time) {w(180, 'is_reset')}) / 86400)",
    "days_since_last_oil_reset": f"floor(epoch(snap::TIMESTAMP - max(event_time) {w(180, 'is_reset AND is_type_oil')}) / 86400)",
    "days_since_last_filter_reset": f"floor(epoch(snap::TIMESTAMP - max(event_time) {w(180, 'is_reset AND is_type_filter')}) / 86400)",
    "meter": "max(smr_hours)",
    "reset_meter": f"arg_max(struct_pack(v := smr_hours), event_time) {w(180, 'is_reset')}",
}
_MF_WHOLE = [c for c in _MF if "count" in c or "events" in c]
_ITEM_WHOLE = ["active_maintenance_items", "overdue_item_count", "due_now_item_count", *[f"{n}_overdue_item_count" for n in _NAMES.values()]]
MAINTENANCE_FROZEN_SQL = round_sql(
    spine_agg(
        roles.EVENT_SPINE_SQL, MAINTENANCE_SQL, _MF,
        {"maintenance_reset_ratio_180d": "coalesce(monitor_reset_count_180d / nullif(maintenance_events_180d, 0), 0)",
         "smr_since_last_reset": "meter - reset_meter.v",
         **{c: f"i.{c}" for c in _ITEM_WHOLE},
         "avg_remaining_hours": "i.avg_remaining_hours", "min_remaining_hours": "i.min_remaining_hours",
         "maintenance_due_or_overdue_ratio": "coalesce((i.due_now_item_count + i.overdue_item_count) / nullif(i.active_maintenance_items, 0), 0)"},
        extra=_LATEST_ITEM, joins="LEFT JOIN items i ON i.mid = wide.model_id AND i.snap = wide.snapshot_date",
    ),
    ["model_id", "snapshot_date", *[f"coalesce({c}, 0) AS {c}" for c in [*_MF_WHOLE, *_ITEM_WHOLE]],
     *[f"CAST({c} AS INT) AS {c}" for c in ("days_since_last_reset", "days_since_last_oil_reset", "days_since_last_filter_reset")],
     "CAST(coalesce(maintenance_events_180d, 0) > 0 AS INT) AS has_maintenance_180d"],
    ["maintenance_reset_ratio_180d", "smr_since_last_reset", "avg_remaining_hours", "min_remaining_hours", "maintenance_due_or_overdue_ratio"],
)


@query("maintenance_window_frozen", "E6 E7 E8", MAINTENANCE_FROZEN_SQL)
def _(t):
    spine = roles.event_spine(t).drop("full_model")
    events = std.keep_known(std.standard_maintenance(roles.raw_maintenance(t), spine), spine)
    return rounded(sf.maintenance_frozen(spine, events))


# ------------------------------------------------------------------ operation
_VALID = "smr_valid_for_utilization_flag = 1 AND smr_hours IS NOT NULL"
_OB = {
    "rows_window": count(90),
    "operation_day_count_window": f"count(DISTINCT event_day) {w(90)}",
    "operation_working_hours_sum_window": f"sum(actual_working_hours_clean) {w(90)}",
    "operation_working_hours_mean_window": f"avg(actual_working_hours_clean) {w(90)}",
    "operation_working_hours_max_window": f"max(actual_working_hours_clean) {w(90)}",
    "operation_engine_running_hours_sum_window": f"sum(engine_running_hours_clean) {w(90)}",
    "operation_idle_hours_sum_window": f"sum(engine_idling_hours_clean) {w(90)}",
    "operation_latest_smr_window": f"arg_max(smr_hours, struct_pack(d := event_day, v := smr_hours)) {w(90, _VALID)}",
    "first_smr": f"arg_min(smr_hours, struct_pack(d := event_day, v := smr_hours)) {w(90, _VALID)}",
    "operation_high_throttle_day_count_window": f"sum(high_throttle_day_flag) {w(90)}",
}
_OB_SUMS = ["operation_working_hours_sum_window", "operation_engine_running_hours_sum_window", "operation_idle_hours_sum_window", "operation_high_throttle_day_count_window"]
OPERATION_BASIC_SQL = round_sql(
    spine_agg(
        roles.ORDER_SPINE_SQL, OPERATION_SQL, _OB,
        {"operation_idle_share_window": "coalesce(operation_idle_hours_sum_window / nullif(operation_engine_running_hours_sum_window, 0), 0)",
         "operation_smr_delta_window": "CASE WHEN operation_latest_smr_window IS NULL THEN NULL ELSE greatest(operation_latest_smr_window - first_smr, 0) END"},
    ),
    ["model_id", "snapshot_date", "coalesce(operation_day_count_window, 0) AS operation_day_count_window",
     "CAST(coalesce(rows_window, 0) > 0 AS INT) AS has_operation_window",
     *[f"round(CAST(coalesce({c}, 0) AS DOUBLE), 9) AS {c}" for c in _OB_SUMS]],
    ["operation_working_hours_mean_window", "operation_working_hours_max_window", "operation_latest_smr_window",
     "operation_idle_share_window", "operation_smr_delta_window"],
)


@query("operation_window_basic", "E9 D3", OPERATION_BASIC_SQL)
def _(t):
    spine = roles.order_spine(t).drop("full_model")
    days = std.keep_known(std.standard_operation(roles.raw_operation(t), spine), spine)
    return rounded(sf.operation_basic(spine, days))


_OSUM = {
    "smr_delta": ("smr_delta_clean_since_prev_obs_hours", (7, 30, 90)),
    "working_hours_sum": ("actual_working_hours_clean", (7, 30, 90)),
    "actual_work_day_count": ("actual_work_day_flag", (7, 30, 90)),
    "work_valid": ("actual_work_valid_flag", (30, 90)),
    "actual_work_seconds_invalid_count": ("actual_work_seconds_invalid_flag", (90,)),
    "fuel_actual_work_conflict_count": ("fuel_actual_work_conflict_flag", (90,)),
    "engine_running_hours_sum": ("engine_running_hours_clean", (7, 30, 90)),
    "engine_running_day_count": ("engine_running_day_flag", (30, 90)),
    "engine_valid": ("engine_seconds_valid_flag", (30, 90)),
    "throttle_full_hours_sum": ("throttle_full_hours_clean", (30, 90)),
    "idle": ("engine_idling_hours_clean", (90,)),
    "engine_observed_day_count": ("engine_seconds_observed_flag", (90,)),
    "throttle_observed_day_count": ("throttle_observed_flag", (90,)),
    "work_idle_sum_exceeds_engine_count": ("work_idle_sum_exceeds_engine_flag", (90,)),
    "high_throttle_day_count": ("high_throttle_day_flag", (90,)),
    "long_engine_day_count": ("long_engine_day_flag", (90,)),
    "travel_hours_sum": ("traveling_hours_clean", (30, 90)),
    "travel_day_count": ("travel_day_flag", (30, 90)),
    "travel_usable": ("travel_usable_flag", (30, 90)),
    "moving_back_forth_hours_sum": ("moving_back_forth_hours_clean", (90,)),
    "steering_hours_sum": ("steering_hours_clean", (90,)),
    "auto_quick_shift_hours_sum": ("auto_quick_shift_hours_clean", (90,)),
    "manual_variable_shift_hours_sum": ("manual_variable_shift_hours_clean", (90,)),
}
_OSUM_COLS = {f"{n}_{d}d": f"coalesce(sum({v}) {w(d)}, 0)" for n, (v, ds) in _OSUM.items() for d in ds}
_RAN, _WORKED, _TRAVELED = "engine_running_day_flag = 1", "actual_work_day_flag = 1", "travel_day_flag = 1"
_OF = {
    **_OSUM_COLS,
    "rows_30d": count(30), "rows_90d": count(90),
    "max_working_hours_day_90d": f"max(actual_working_hours_clean) {w(90)}",
    "working_hours_stddev_actual_work_day_90d": f"stddev_samp(actual_working_hours_clean) {w(90, _WORKED)}",
    "engine_running_hours_max_day_90d": f"max(engine_running_hours_clean) {w(90)}",
    "engine_running_hours_stddev_engine_day_90d": f"stddev_samp(engine_running_hours_clean) {w(90, _RAN)}",
    "avg_throttle_dial_position_active_30d": f"avg(throttle_average_dial_position_clean) {w(30, _RAN)}",
    "avg_throttle_dial_position_active_90d": f"avg(throttle_average_dial_position_clean) {w(90, _RAN)}",
    "smr_latest_hours": f"arg_max(smr_hours, struct_pack(d := event_day, v := smr_hours)) FILTER (WHERE {_VALID})",
    "days_since_last_smr": f"min(age) FILTER (WHERE {_VALID})",
    "days_since_last_engine_running_day": f"min(age) FILTER (WHERE {_RAN})",
    "days_since_last_travel_day": f"min(age) FILTER (WHERE {_TRAVELED})",
    "latest": "max(struct_pack(d := event_day, l := last_work_day, s := actual_work_streak_through_current_day))",
}
_r = lambda a, b: f"coalesce({a} / nullif({b}, 0), 0)"
_use = {d: f"CASE WHEN travel_usable_{d}d <> 0 THEN travel_usable_{d}d ELSE rows_{d}d END" for d in (30, 90)}
_rate = lambda n: f"coalesce({n}_30d, 0) / 30.0 - coalesce({n}_90d, 0) / 90.0"
_ODERIVED = {
    "actual_work_day_ratio_30d": _r("actual_work_day_count_30d", "work_valid_30d"),
    "actual_work_day_ratio_90d": _r("actual_work_day_count_90d", "work_valid_90d"),
    "actual_work_day_ratio_change_30d_vs_90d": _r("actual_work_day_count_30d", "work_valid_30d") + " - " + _r("actual_work_day_count_90d", "work_valid_90d"),
    "actual_work_valid_flag": "coalesce(work_valid_90d, 0)",
    "working_hours_rate_change_30d_vs_90d": _rate("working_hours_sum"),
    "avg_working_hours_per_actual_work_day_30d": _r("working_hours_sum_30d", "actual_work_day_count_30d"),
    "avg_working_hours_per_actual_work_day_90d": _r("working_hours_sum_90d", "actual_work_day_count_90d"),
    "days_since_last_actual_work_day": "date_diff('day', latest.l, snapshot_date)",
    "current_actual_work_streak_days": "CASE WHEN date_diff('day', latest.d, snapshot_date) = 1 THEN latest.s ELSE 0 END",
    "engine_running_day_ratio_30d": _r("engine_running_day_count_30d", "engine_valid_30d"),
    "engine_running_day_ratio_90d": _r("engine_running_day_count_90d", "engine_valid_90d"),
    "engine_running_rate_change_30d_vs_90d": _rate("engine_running_hours_sum"),
    "avg_engine_running_hours_per_engine_day_90d": _r("engine_running_hours_sum_90d", "engine_running_day_count_90d"),
    "engine_idling_share_90d": _r("idle_90d", "engine_running_hours_sum_90d"),
    "throttle_full_engine_share_30d": _r("throttle_full_hours_sum_30d", "engine_running_hours_sum_30d"),
    "throttle_full_engine_share_90d": _r("throttle_full_hours_sum_90d", "engine_running_hours_sum_90d"),
    "throttle_full_share_change_30d_vs_90d": _r("throttle_full_hours_sum_30d", "engine_running_hours_sum_30d") + " - " + _r("throttle_full_hours_sum_90d", "engine_running_hours_sum_90d"),
    "avg_travel_hours_per_travel_day_30d": _r("travel_hours_sum_30d", "travel_day_count_30d"),
    "avg_travel_hours_per_travel_day_90d": _r("travel_hours_sum_90d", "travel_day_count_90d"),
    "moving_back_forth_to_travel_ratio_90d": _r("moving_back_forth_hours_sum_90d", "travel_hours_sum_90d"),
    "travel_day_ratio_observed_30d": _r("travel_day_count_30d", _use[30]),
    "travel_day_ratio_observed_90d": _r("travel_day_count_90d", _use[90]),
    "travel_rate_change_30d_vs_90d": _rate("travel_hours_sum"),
    "travel_share_of_working_hours_90d": _r("travel_hours_sum_90d", "working_hours_sum_90d"),
    "steering_to_travel_ratio_90d": _r("steering_hours_sum_90d", "travel_hours_sum_90d"),
}
_OF_PLAIN = [c for c in _OF if c not in ("latest", "rows_30d", "rows_90d", "throttle_full_hours_sum_30d", "days_since_last_smr", "days_since_last_engine_running_day", "days_since_last_travel_day") and not c.startswith(("work_valid", "engine_valid", "idle_", "travel_usable"))]
_OF_SUMS = [c for c in _OF_PLAIN if c in _OSUM_COLS]
OPERATION_FROZEN_SQL = round_sql(
    spine_agg(roles.ORDER_SPINE_SQL, OPERATION_SQL, _OF, _ODERIVED),
    ["model_id", "snapshot_date",
     *[f"round(CAST(coalesce({c}, 0) AS DOUBLE), 9) AS {c}" for c in _OF_SUMS],
     "days_since_last_smr", "days_since_last_engine_running_day", "days_since_last_travel_day", "days_since_last_actual_work_day",
     f"CAST(coalesce({_use[90]}, 0) > 0 AS INT) AS has_travel_data_90d", "CAST(coalesce(rows_90d, 0) > 0 AS INT) AS has_operation_90d"],
    [*[c for c in _OF_PLAIN if c not in _OSUM_COLS], *[c for c in _ODERIVED if c != "days_since_last_actual_work_day"]],
    9,
)


@query("operation_window_frozen", "E10 E11", OPERATION_FROZEN_SQL)
def _(t):
    spine = roles.order_spine(t).drop("full_model")
    days = std.keep_known(std.standard_operation(roles.raw_operation(t), spine), spine)
    return rounded(sf.operation_frozen(spine, days), 9)


# ------------------------------------------------------------------ fluid samples
_LB = {
    "fluid_sample_count_window": count(90),
    "fluid_max_severity_window": f"max(severity) {w(90)}",
    "fluid_latest_severity_window": f"max(struct_pack(d := event_day, v := severity)) {w(90, 'severity IS NOT NULL')}",
    "fluid_days_since_latest_sample_window": f"min(age) {w(90)}",
    "fluid_max_cu_ppm_window": f"max(Cu_Copper_PPM) {w(90)}",
    "fluid_max_fe_ppm_window": f"max(Fe_Iron_PPM) {w(90)}",
    "fluid_max_pb_ppm_window": f"max(Pb_Lead_PPM) {w(90)}",
    "fluid_max_soot_percent_window": f"max(Soot_Soot_PERCENT) {w(90)}",
    "fluid_max_water_percent_window": f"max(Water_Water_PERCENT) {w(90)}",
}
FLUID_BASIC_SQL = round_sql(
    spine_agg(roles.SAMPLE_SPINE_SQL, FLUID_SQL, _LB),
    ["model_id", "snapshot_date", "coalesce(fluid_sample_count_window, 0) AS fluid_sample_count_window",
     "CAST(coalesce(fluid_sample_count_window, 0) > 0 AS INT) AS has_fluid_window",
     "fluid_days_since_latest_sample_window", "round(fluid_latest_severity_window.v, 9) AS fluid_latest_severity_window"],
    [c for c in _LB if "_max_" in c],
)


@query("fluid_window_basic", "E12 D5", FLUID_BASIC_SQL)
def _(t):
    spine = roles.sample_spine(t)
    samples = std.keep_known(std.standard_fluids(roles.raw_fluid(t), spine), spine)
    return rounded(sf.fluid_basic(spine, samples))


_LF = {
    **{m: f"max(struct_pack(d := event_day, v := CAST({m} AS DOUBLE))) {w(365, f'{m} IS NOT NULL')}" for m in LATEST_MEASURES},
    "fluid_sample_count_365d": count(365),
    "days_since_last_fluid_sample": "min(age)",
    "fluid_sample_severity_max_365d": f"max(severity) {w(365)}",
    "fluid_sample_latest_smr": "max(smr_hours)",
}
FLUID_FROZEN_SQL = round_sql(
    spine_agg(roles.SAMPLE_SPINE_SQL, FLUID_SQL, _LF),
    ["model_id", "snapshot_date", "coalesce(fluid_sample_count_365d, 0) AS fluid_sample_count_365d", "days_since_last_fluid_sample",
     *[f"round({m}.v, 9) AS {m}" for m in LATEST_MEASURES]],
    ["fluid_sample_severity_max_365d", "fluid_sample_latest_smr"],
)


@query("fluid_latest_measures", "E13", FLUID_FROZEN_SQL)
def _(t):
    spine = roles.sample_spine(t)
    samples = std.keep_known(std.standard_fluids(roles.raw_fluid(t), spine), spine)
    return rounded(sf.fluid_frozen(spine, samples, LATEST_MEASURES))


# ------------------------------------------------------------------ claims
CLAIM_BASIC_SQL = spine_agg(
    roles.ORDER_SPINE_SQL, CLAIM_SQL,
    {"n": "count(*) FILTER (WHERE age > 90)", "d": "min(age) FILTER (WHERE age > 90)"},
)
CLAIM_BASIC_SQL = f"""SELECT model_id, snapshot_date, coalesce(n, 0) AS prior_claim_count_before_window,
d AS days_since_prior_claim_before_window FROM ({CLAIM_BASIC_SQL}) AS answer"""


@query("claim_history_basic", "E14", CLAIM_BASIC_SQL)
def _(t):
    spine = roles.order_spine(t).drop("full_model")
    return sf.claim_basic(spine, std.keep_known(std.standard_claims(roles.raw_claim(t), spine), spine))


CLAIM_FROZEN_SQL = round_sql(
    spine_agg(
        roles.ORDER_SPINE_SQL, CLAIM_SQL,
        {**{f"prior_claim_count_{n}d": count(n) for n in (365, 180, 90)},
         "days_since_last_claim": "min(age)",
         "prior_claim_amount_sum_365d": f"sum(claim_amount) {w(365)}",
         "prior_claim_amount_max_365d": f"max(claim_amount) {w(365)}",
         "unique_claim_type_count_365d": f"count(DISTINCT nullif(claim_type, '')) {w(365)}"},
    ),
    ["model_id", "snapshot_date", *[f"coalesce(prior_claim_count_{n}d, 0) AS prior_claim_count_{n}d" for n in (365, 180, 90)],
     "days_since_last_claim", "coalesce(unique_claim_type_count_365d, 0) AS unique_claim_type_count_365d",
     "CAST(coalesce(prior_claim_count_365d, 0) > 0 AS INT) AS has_prior_claim_365d",
     "round(coalesce(prior_claim_amount_sum_365d, 0), 4) AS prior_claim_amount_sum_365d"],
    ["prior_claim_amount_max_365d"], 4,
)


@query("claim_history_frozen", "E14 D4", CLAIM_FROZEN_SQL)
def _(t):
    spine = roles.order_spine(t).drop("full_model")
    return rounded(sf.claim_frozen(spine, std.keep_known(std.standard_claims(roles.raw_claim(t), spine), spine)), 4)
