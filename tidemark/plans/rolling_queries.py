"""Rolling-origin features, fixed segments, anchor windows and case-control windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import dash_key, pipe_key, safe_token
from tidemark.operators import segments as sg
from tidemark.operators import source_features as sf
from tidemark.operators import windows as cw
from tidemark.plans import roles
from tidemark.plans.registry import query, round_sql, rounded
from tidemark.plans.snapshot_queries import (
    CLAIM_FROZEN_SQL, CLAIM_SQL, FAULT_FROZEN_SQL, FLUID_FROZEN_SQL, FLUID_SQL, MAINTENANCE_FROZEN_SQL, MAINTENANCE_SQL,
    OPERATION_FROZEN_SQL, OPERATION_SQL, age_sql, count, n0, w,
)
from tidemark.sources import standardize as std

# ------------------------------------------------------------------ rolling faults
SERIOUS_SQL = f"""
SELECT *, CAST(severity >= 2 AND grp AS INT) AS is_serious, CAST(severity = 3 AS INT) AS is_l03,
       CAST(severity >= 4 AS INT) AS is_l04 FROM (
SELECT upper(full_model) || '-' || regexp_extract(serial_number, '([0-9]+)', 1) AS model_id, event_date AS event_day, fault_code,
  least(greatest(coalesce(action_level_num, CAST(nullif(regexp_extract(event_action_level, '([0-9]+)', 1), '') AS DOUBLE), 0), 0), 4) AS severity,
  least(greatest(coalesce(log_occurrence_count, ln(1 + coalesce(occurrence_count, 1))), 0), 10) AS log_occ,
  least(greatest(coalesce(failure_code_evidence_score, 0), 0), 2) AS evidence,
  coalesce(upper(failure_code_evidence_group) = 'EVENT', FALSE) AS grp,
  coalesce(upper(coalesce(applicable_component, logical_name)), 'UNKNOWN') AS system, logical_name
FROM ({roles.RAW_FAULT_SQL}) AS raw) AS graded"""
ROLL_SPINE_SQL = f"SELECT replace(model_id, ' ', '-') AS model_id, snapshot_date FROM ({roles.EVENT_SPINE_SQL}) AS s"
_S = "is_serious = 1"
_CODES = ("C10", "C20", "C31")
_RF = {
    "fault_count_90d": count(14), "fault_count_7d": count(7),
    "fault_log_occurrence_90d": f"sum(log_occ) {w(14)}",
    "fault_serious_count_90d": f"CAST(sum(is_serious) {w(14)} AS DOUBLE)",
    "fault_serious_log_occurrence_90d": f"sum(is_serious * log_occ) {w(14)}",
    "fault_severity_weighted_90d": f"sum(is_serious * severity * log_occ) {w(14)}",
    "fault_evidence_weighted_90d": f"sum(is_serious * evidence * log_occ) {w(14)}",
    "fault_l03_count_90d": f"CAST(sum(is_l03) {w(14)} AS DOUBLE)",
    "fault_l04_count_90d": f"CAST(sum(is_l04) {w(14)} AS DOUBLE)",
    "fault_distinct_codes_90d": f"count(DISTINCT nullif(fault_code, '')) {w(14)}",
    "fault_days_since_last": f"min(age) {w(14)}",
    "fault_serious_30d": count(30, _S), "prior60": count(14, _S, 31),
    "fault_days_since_last_serious": f"min(age) {w(14, _S)}",
    "fault_hst_serious_flag": f"max(CAST(contains(system, 'HST') OR logical_name = 'HST' AS INT)) {w(14, _S)}",
    **{f"fault_{n}_serious_count_90d": count(14, f"{_S} AND regexp_matches(system, '{p}')")
       for n, p in {"eng": "ENG", "hst": "HST", "mon": "MON", "we": "WE|W/E"}.items()},
    **{f"fault_code_{c}_90d": count(14, f"{_S} AND fault_code = '{c}'") for c in _CODES},
    "fault_severity_recency_90d": f"sum(severity * log_occ * power(0.5, age / 30.0)) {w(14, _S)}",
}
_RF_WHOLE = [c for c in _RF if c.endswith(("_count_90d", "_7d")) and "sum(" not in _RF[c]] + [
    "fault_distinct_codes_90d", "fault_serious_30d", *[f"fault_code_{c}_90d" for c in _CODES]]
_RF_DOUBLE = [c for c in _RF if "sum(" in _RF[c]]
_VEL = "CASE WHEN coalesce(fault_serious_30d, 0) + coalesce(prior60, 0) = 0 THEN 0 ELSE least(greatest((fault_serious_30d + 1.0) / (prior60 / 2.0 + 1.0), 0), 20) END"
ROLLING_FAULT_SQL = f"""{age_sql(ROLL_SPINE_SQL, SERIOUS_SQL)},
agg AS (SELECT mid, snap, {', '.join(f'{e} AS {n}' for n, e in _RF.items())} FROM pairs GROUP BY mid, snap),
sys AS (SELECT mid, snap, count(*) AS systems, max(n) / sum(n) AS share FROM
  (SELECT mid, snap, system, count(*) AS n FROM pairs WHERE age BETWEEN 1 AND 14 AND is_serious = 1 GROUP BY 1, 2, 3) AS q GROUP BY 1, 2),
wide AS (SELECT s.model_id, s.snapshot_date, a.* EXCLUDE (mid, snap), sys.systems, sys.share FROM spine s
  LEFT JOIN agg a ON a.mid = s.model_id AND a.snap = s.snapshot_date
  LEFT JOIN sys ON sys.mid = s.model_id AND sys.snap = s.snapshot_date)
SELECT model_id AS machine_key, snapshot_date, {', '.join(f'coalesce({c}, 0) AS {c}' for c in dict.fromkeys(_RF_WHOLE))},
  {', '.join(f'round(CAST(coalesce({c}, 0) AS DOUBLE), 9) AS {c}' for c in _RF_DOUBLE)},
  coalesce(fault_days_since_last, 15) AS fault_days_since_last,
  coalesce(fault_days_since_last_serious, 15) AS fault_days_since_last_serious,
  coalesce(fault_hst_serious_flag, 0) AS fault_hst_serious_flag,
  coalesce(systems, 0) AS fault_distinct_serious_systems, round(coalesce(share, 0), 9) AS fault_single_system_concentration,
  round(CAST({_VEL} AS DOUBLE), 9) AS fault_velocity_ratio,
  CAST(coalesce(fault_serious_30d >= 3 AND fault_serious_30d > 1.5 * (prior60 / 2.0 + 0.5), FALSE) AS INT) AS has_accelerating_faults
FROM wide"""


def _roll_spine(t):
    return roles.event_spine(t).select(F.translate("model_id", " ", "-").alias("machine_key"), "snapshot_date")


def _serious(t):
    return std.serious_faults(roles.raw_fault(t), dash_key(F.col("full_model"), F.col("serial_number")))


@query("rolling_fault_features", "E15 E16 E17 E18 B1 B11", ROLLING_FAULT_SQL)
def _(t):
    return rounded(sf.serious_fault_features(_roll_spine(t), _serious(t), _CODES, lookback=14))


@query(
    "rolling_code_counts", "E19",
    f"""{age_sql(ROLL_SPINE_SQL, SERIOUS_SQL)},
top AS (SELECT fault_code FROM events_std WHERE is_serious = 1 AND fault_code IS NOT NULL
        GROUP BY fault_code ORDER BY count(*) DESC, fault_code LIMIT 15)
SELECT mid AS machine_key, snap AS snapshot_date, fault_code, count(*) AS code_rows FROM pairs
WHERE is_serious = 1 AND age BETWEEN 1 AND 14 AND fault_code IN (SELECT fault_code FROM top) GROUP BY 1, 2, 3""",
)
def _(t):
    faults = _serious(t)
    return sf.code_counts(_roll_spine(t), faults, sf.frequent_codes(faults, 15), 14)


# ------------------------------------------------------------------ carried fluid values
_GRADED = f"""SELECT *, severity_known IS NOT NULL AND severity_known >= 2 AS abnormal FROM (
SELECT *, CASE WHEN severity BETWEEN 0 AND 4 THEN severity END AS severity_known FROM ({FLUID_SQL}) AS f) AS g"""
_CARRIED = [m for m in sf.CARRIED_MEASURES if m != "EthyleneGlycol_Ethylene_Glycol_PERCENT"]
_CONT = "CAST(abnormal AND (coalesce(Water_Water_PERCENT > 0.10, FALSE) OR coalesce(Fuel_Fuel_PERCENT > 2.0, FALSE) OR coalesce(Si_Silicon_PPM > 100.0, FALSE) OR coalesce(Gly_Glycol_PERCENT < 40 OR Gly_Glycol_PERCENT > 60, FALSE)) AS INT)"
ROLLING_FLUID_SQL = f"""WITH spine AS ({roles.SAMPLE_SPINE_SQL}), graded AS ({_GRADED}),
known AS (SELECT *, least(greatest(coalesce(severity_known - lag(severity_known) OVER (PARTITION BY model_id ORDER BY event_day, sample_id), 0), -4), 4) AS trend
          FROM graded WHERE severity_known IS NOT NULL),
k AS (SELECT s.model_id, s.snapshot_date, max(struct_pack(d := event_day, o := sample_id, v := severity_known, t := trend)) AS r,
        count(*) FILTER (WHERE abnormal AND date_diff('day', event_day, snapshot_date) <= 90) AS ab
      FROM spine s JOIN known n ON s.model_id = n.model_id AND n.event_day < s.snapshot_date GROUP BY 1, 2),
a AS (SELECT s.model_id, s.snapshot_date, max(struct_pack(d := event_day, o := sample_id, c := {_CONT},
        {', '.join(f'{m} := CAST({m} AS DOUBLE)' for m in _CARRIED)})) AS r
      FROM spine s JOIN graded n ON s.model_id = n.model_id AND n.event_day < s.snapshot_date GROUP BY 1, 2),
j AS (SELECT s.*, k.r AS kr, a.r AS ar, k.ab, date_diff('day', k.r.d, s.snapshot_date) AS kage, date_diff('day', a.r.d, s.snapshot_date) AS aage
      FROM spine s LEFT JOIN k USING (model_id, snapshot_date) LEFT JOIN a USING (model_id, snapshot_date))
SELECT model_id, snapshot_date, CASE WHEN kage <= 365 THEN kr.v ELSE 0 END AS fluid_current_severity,
  CASE WHEN kage <= 365 THEN kr.t ELSE 0 END AS fluid_worsening_trend,
  coalesce(least(kage, 366), 366) AS fluid_sample_staleness_days, coalesce(ab, 0) AS fluid_recent_abnormal_count_90d,
  CASE WHEN aage <= 365 THEN ar.c ELSE 0 END AS fluid_contaminant_flag,
  coalesce(least(aage, 366), 366) AS fluid_any_sample_staleness_days,
  CAST(coalesce(aage <= 365, FALSE) AS INT) AS fluid_sample_known_flag,
  {', '.join(f"round(CASE WHEN aage <= 365 THEN ar.{m} END, 9) AS fluid_locf_{safe_token(m).lower()}" for m in _CARRIED)}
FROM j"""


@query("rolling_fluid_carried", "E20 E21 D6 J4", ROLLING_FLUID_SQL)
def _(t):
    spine = roles.sample_spine(t)
    samples = std.standard_fluids(roles.raw_fluid(t))
    return rounded(sf.carried_fluid_features(spine, std.graded_fluids(samples), "sample_number", measures=_CARRIED))


@query(
    "rolling_maintenance", "E22",
    f"""{age_sql(roles.EVENT_SPINE_SQL, MAINTENANCE_SQL)},
agg AS (SELECT mid, snap, min(age) FILTER (WHERE is_reset) AS r, count(DISTINCT item) {w(14, 'is_overdue')} AS o,
  count(DISTINCT item) {w(14, 'is_due_now')} AS d, count(DISTINCT item) {w(14, 'is_reset')} AS rc, {count(14)} AS n FROM pairs GROUP BY 1, 2)
SELECT s.model_id, s.snapshot_date, least(coalesce(r, 1096), 1096) AS pm_days_since_last_reset, coalesce(o, 0) AS pm_overdue_count_90d,
  coalesce(d, 0) AS pm_due_count_90d, coalesce(rc, 0) AS pm_reset_count_90d, coalesce(n, 0) AS pm_record_count_90d
FROM spine s LEFT JOIN agg ON mid = s.model_id AND snap = s.snapshot_date""",
)
def _(t):
    spine = roles.event_spine(t).drop("full_model")
    events = std.keep_known(std.standard_maintenance(roles.raw_maintenance(t), spine), spine)
    return sf.reset_and_due_features(spine, events, 14)


_RO_SUMS = {"smr_delta": "smr_delta_clean_since_prev_obs_hours", "engine_hours": "engine_running_hours_clean",
            "work_hours": "actual_working_hours_clean", "active_days": "engine_running_day_flag", "travel_hours": "traveling_hours_clean"}
_RO = {}
for _d in (30, 90):
    _RO.update({f"{n}_{_d}d": f"CAST(coalesce(sum({v}) {w(_d)}, 0) AS DOUBLE)" for n, v in _RO_SUMS.items()})
    _RO[f"idle_share_mean_{_d}d"] = f"avg(engine_idle_share_daily) {w(_d)}"
    _RO[f"throttle_share_mean_{_d}d"] = f"avg(throttle_full_share_clean) {w(_d)}"
    _RO[f"operation_records_{_d}d"] = count(_d)
_RO_DOUBLE = [c for c in _RO if "records" not in c]
ROLLING_OPERATION_SQL = f"""{age_sql(roles.ORDER_SPINE_SQL, OPERATION_SQL)},
agg AS (SELECT mid, snap, min(age) AS stale, {', '.join(f'{e} AS {n}' for n, e in _RO.items())} FROM pairs GROUP BY 1, 2),
firsts AS (SELECT model_id, min(event_day) AS fd FROM events_std GROUP BY 1)
SELECT s.model_id, s.snapshot_date, {', '.join(f'round({c if "mean" in c else n0(c)}, 9) AS {c}' for c in _RO_DOUBLE)},
  coalesce(operation_records_30d, 0) AS operation_records_30d, coalesce(operation_records_90d, 0) AS operation_records_90d,
  least(coalesce(stale, 366), 366) AS days_since_last_sensor_reading,
  greatest(coalesce(date_diff('day', fd, s.snapshot_date), 0), 0) AS operation_history_days,
  round(least(greatest((coalesce(engine_hours_30d, 0) + 1) / (coalesce(engine_hours_90d, 0) / 3 + 1), 0), 10), 9) AS utilization_velocity_ratio,
  CAST(coalesce(stale, 366) <= 21 AS INT) AS is_recently_live
FROM spine s LEFT JOIN agg ON mid = s.model_id AND snap = s.snapshot_date LEFT JOIN firsts f ON f.model_id = s.model_id"""


@query("rolling_operation", "E23", ROLLING_OPERATION_SQL)
def _(t):
    spine = roles.order_spine(t).drop("full_model")
    raw = roles.raw_operation(t)
    extra = ["engine_idle_share_daily", "throttle_full_share_clean"]
    days = std.standard_operation(raw, keep=extra)
    return rounded(sf.utilization_features(spine, days))


@query(
    "rolling_event_history", "E24",
    f"""{age_sql(roles.ORDER_SPINE_SQL, f"SELECT DISTINCT model_id, event_day FROM ({CLAIM_SQL}) AS c")},
agg AS (SELECT mid, snap, min(age) AS a, {count(90)} AS c90, {count(365)} AS c365, {count(730)} AS c730 FROM pairs GROUP BY 1, 2)
SELECT s.model_id, s.snapshot_date, least(coalesce(a, 1096), 1096) AS days_since_prior_target_event, coalesce(c90, 0) AS prior_target_event_count_90d,
  coalesce(c365, 0) AS prior_target_event_count_365d, coalesce(c730, 0) AS prior_target_event_count_730d
FROM spine s LEFT JOIN agg ON mid = s.model_id AND snap = s.snapshot_date""",
)
def _(t):
    spine = roles.order_spine(t).drop("full_model")
    days = std.standard_claims(roles.raw_claim(t)).select("model_id", "event_day").distinct()
    return sf.prior_event_features(spine, days)


# ------------------------------------------------------------------ fixed segments and anchors
_FIRST, _LAST = "1995-01-01", "2001-12-31"
_EFIRST, _ELAST = "2024-01-01", "2024-01-30"


def _period_sql(day: str, first: str, stride: int) -> str:
    return f"CAST(DATE '{first}' + CAST(floor(date_diff('day', DATE '{first}', {day}) / {stride}.0) AS INT) * {stride} AS DATE)"


def _segment_sql(raw: str, key: str, day: str, first: str, last: str, stride: int, aggs: dict[str, str], whole: list[str]) -> str:
    doubles = [c for c in aggs if c not in whole]
    return round_sql(
        f"""SELECT * FROM (SELECT machine_key, period_start, {', '.join(f'{e} AS {n}' for n, e in aggs.items())} FROM (
SELECT *, {key} AS machine_key, {day} AS event_day, {_period_sql(day, first, stride)} AS period_start FROM ({raw}) AS r
WHERE {day} BETWEEN DATE '{first}' AND DATE '{last}') AS p
WHERE period_start + {stride - 1} <= DATE '{last}' GROUP BY 1, 2) AS g""",
        ["machine_key", "period_start", *whole], doubles,
    )


def _cats(categories, raw_columns) -> dict[str, str]:
    out = {}
    for (column, prefix), values in categories.items():
        for v in values:
            name = f"{prefix}_{safe_token(v).lower()}_count"
            out[name] = f"count(*) FILTER (WHERE upper(trim({column})) = '{v.upper()}')" if column in raw_columns else "CAST(0 AS BIGINT)"
    return out


def _div(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


_FC = _cats(sg.FAULT_CATEGORIES, roles.RAW_FAULT)
_SF = {
    "fault_event_count": "count(*)", "fault_active_days": "count(DISTINCT event_day)",
    "fault_unique_code_count": "count(DISTINCT nullif(fault_code, ''))", **_FC,
    "fault_occurrence_sum": "coalesce(sum(occurrence_count), 0)", "fault_occurrence_max": "max(occurrence_count)",
    "fault_log_occurrence_sum": "coalesce(sum(log_occurrence_count), 0)", "fault_log_occurrence_mean": "avg(log_occurrence_count)",
    "fault_engine_on_hours_sum": "0.0", "fault_engine_on_hours_max": "NULL",
    "fault_smr_min": "min(smr_hours)", "fault_smr_max": "max(smr_hours)",
    "fault_mechanical_count": "sum(is_mechanical_failure_code)", "fault_electrical_count": "sum(is_electrical_failure_code)",
    "fault_action_level_mean": "avg(action_level_num)", "fault_action_level_max": "max(action_level_num)",
    "fault_evidence_score_sum": "coalesce(sum(failure_code_evidence_score), 0)",
    "fault_evidence_score_mean": "avg(failure_code_evidence_score)", "fault_evidence_score_max": "max(failure_code_evidence_score)",
    "fault_smr_range": "max(smr_hours) - min(smr_hours)",
    "fault_events_per_active_day": _div("count(*)", "count(DISTINCT event_day)"),
    "fault_strong_rate": _div(_FC["fault_strength_strong_count"], "count(*)"),
    "fault_medium_or_strong_rate": _div(f"{_FC['fault_strength_medium_count']} + {_FC['fault_strength_strong_count']}", "count(*)"),
    "fault_action_ge3_rate": _div(f"{_FC['fault_action_l03_count']} + {_FC['fault_action_l04_count']}", "count(*)"),
}
_PIPE = "upper(full_model) || '|' || serial_number"


@query("segment_faults", "E28 B15 C17", _segment_sql(
    roles.RAW_FAULT_SQL, _PIPE, "event_date", _EFIRST, _ELAST, 7, _SF,
    ["fault_event_count", "fault_active_days", "fault_unique_code_count", *_FC]))
def _(t):
    raw = roles.raw_fault(t)
    prepared = sg.prepare_events(
        raw, pipe_key(F.col("full_model"), F.col("serial_number")), F.col("event_date"), _EFIRST, _ELAST, 7, 7
    )
    return rounded(sg.segment_features(prepared, "fault"))


_MC = _cats(sg.MAINTENANCE_CATEGORIES, roles.RAW_MAINTENANCE)
_b = lambda c: f"CASE WHEN lower({c}) IN ('true','1','yes') THEN 1 WHEN lower({c}) IN ('false','0','no') THEN 0 END"
_SM = {
    "maint_event_count": "count(*)", "maint_active_days": "count(DISTINCT event_day)", "maint_unique_event_count": "count(DISTINCT EVENT_NAME_ID)",
    **_MC,
    "maint_unavailable_count": f"count(*) FILTER (WHERE ({_b('AVAILABLE')}) = 0)",
    "maint_remaining_negative_count": "count(*) FILTER (WHERE remaining_hours < 0)",
    "maint_remaining_zero_count": "count(*) FILTER (WHERE remaining_hours = 0)",
    "maint_monitor_reset_count": f"coalesce(sum({_b('is_monitor_reset')}), 0)", "maint_overdue_count": f"coalesce(sum({_b('is_overdue')}), 0)",
    "maint_due_now_count": f"coalesce(sum({_b('is_due_now')}), 0)", "maint_notice_status_count": "0.0",
    "maint_remaining_hours_min": "min(remaining_hours)", "maint_remaining_hours_mean": "avg(remaining_hours)", "maint_remaining_hours_max": "max(remaining_hours)",
    "maint_interval_hours_min": "NULL", "maint_interval_hours_mean": "NULL", "maint_interval_hours_max": "NULL", "maint_threshold_hours_mean": "NULL",
    "maint_smr_min": "min(smr_hours)", "maint_smr_max": "max(smr_hours)", "maint_previous_reset_smr_mean": "NULL",
    "maint_smr_range": "max(smr_hours) - min(smr_hours)",
    "maint_overdue_rate": _div(f"coalesce(sum({_b('is_overdue')}), 0)", "count(*)"),
    "maint_due_now_rate": _div(f"coalesce(sum({_b('is_due_now')}), 0)", "count(*)"),
    "maint_reset_rate": _div(f"coalesce(sum({_b('is_monitor_reset')}), 0)", "count(*)"),
}


@query("segment_maintenance", "E28", _segment_sql(
    roles.RAW_MAINTENANCE_SQL, "upper(full_model) || '|' || SERIAL", "event_date", _EFIRST, _ELAST, 7, _SM,
    ["maint_event_count", "maint_active_days", "maint_unique_event_count", *_MC, "maint_unavailable_count", "maint_remaining_negative_count", "maint_remaining_zero_count"]))
def _(t):
    prepared = sg.prepare_events(
        roles.raw_maintenance(t), pipe_key(F.col("full_model"), F.col("SERIAL")), F.col("event_date"), _EFIRST, _ELAST, 7, 7
    )
    return rounded(sg.segment_features(prepared, "maintenance"))


_SL = {"fluid_sample_count": "count(*)", "fluid_active_days": "count(DISTINCT event_day)",
       **{f"fluid_severity_{n}_count": f"count(*) FILTER (WHERE sample_result_severity_order = {n})" for n in range(6)}}
_SL["fluid_rated_sample_count"] = "count(*) FILTER (WHERE sample_result_severity_order BETWEEN 0 AND 4)"
_SL["fluid_nonzero_rated_count"] = "count(*) FILTER (WHERE sample_result_severity_order BETWEEN 1 AND 4)"
_SL_WHOLE = list(_SL)
_SL.update({"fluid_telemetry_smr_min": "min(TELEMETRY_SMR_NUMERIC)", "fluid_telemetry_smr_max": "max(TELEMETRY_SMR_NUMERIC)",
            "fluid_telemetry_smr_range": "max(TELEMETRY_SMR_NUMERIC) - min(TELEMETRY_SMR_NUMERIC)",
            "fluid_nonzero_rated_rate": _div(_SL["fluid_nonzero_rated_count"], _SL["fluid_rated_sample_count"])})
for _m in sg.SEGMENT_MEASURES:
    for _a in ("mean", "max"):
        _e = f"{'avg' if _a == 'mean' else 'max'}({_m})" if _m in roles.RAW_FLUID else "NULL"
        _SL[f"fluid_{_m.lower().replace('_', '')}_{_a}"] = _e


@query("segment_fluids", "E28", _segment_sql(
    roles.RAW_FLUID_SQL, "upper(FULL_MODEL) || '|' || SERIAL", "sample_drawn_date", _FIRST, _LAST, 90, _SL, _SL_WHOLE))
def _(t):
    prepared = sg.prepare_events(
        roles.raw_fluid(t), pipe_key(F.col("FULL_MODEL"), F.col("SERIAL")), F.col("sample_drawn_date"), _FIRST, _LAST
    )
    return rounded(sg.segment_features(prepared, "fluid"))


_YES = "CASE WHEN {c} = 'yes' THEN NULL END"


def _op_aggs() -> dict[str, str]:
    have = roles.RAW_OPERATION
    num = lambda c: c if c in have else "NULL"
    out = {"operation_smr_min": "min(smr_hours)", "operation_smr_max": "max(smr_hours)"}
    for c in sg.OPERATION_SUMMED:
        v = num(c)
        out[f"operation_{c}_sum"] = f"coalesce(sum({v}), 0)" if v != "NULL" else "0.0"
        out[f"operation_{c}_mean"] = f"avg({v})" if v != "NULL" else "NULL"
        out[f"operation_{c}_max"] = f"max({v})" if v != "NULL" else "NULL"
    for c in sg.OPERATION_AVERAGED:
        v = num(c)
        out[f"operation_{c}_mean"] = f"avg({v})" if v != "NULL" else "NULL"
        out[f"operation_{c}_max"] = f"max({v})" if v != "NULL" else "NULL"
    for c in sg.OPERATION_FLAGGED:
        v = num(c)
        out[f"operation_{c}_count"] = f"coalesce(sum(TRY_CAST({v} AS DOUBLE)), 0)" if v != "NULL" else "0.0"
    days = "count(DISTINCT event_day)"
    eng = "sum(engine_running_hours_clean)"
    flag = lambda c: out[f"operation_{c}_count"]
    out.update({
        "operation_smr_range": "max(smr_hours) - min(smr_hours)",
        "operation_work_day_rate": _div(flag("actual_work_day_flag"), days), "operation_inactive_day_rate": _div("0.0", days),
        "operation_engine_day_rate": _div(flag("engine_running_day_flag"), days),
        "operation_high_throttle_day_rate": _div(flag("high_throttle_day_flag"), days),
        "operation_long_engine_day_rate": _div(flag("long_engine_day_flag"), days),
        "operation_fuel_per_engine_hour": _div("0.0", eng),
        "operation_idle_to_engine_ratio": _div("coalesce(sum(engine_idling_hours_clean), 0)", eng),
        "operation_work_to_engine_ratio": _div("coalesce(sum(actual_working_hours_clean), 0)", eng),
    })
    return out


_SO = {"operation_day_count": "count(DISTINCT event_day)", **_op_aggs()}


@query("segment_operation", "E28", _segment_sql(
    roles.RAW_OPERATION_SQL, "upper(full_model) || '|' || SERIAL", "LOCAL_DATE", _FIRST, _LAST, 90, _SO, ["operation_day_count"]))
def _(t):
    prepared = sg.prepare_events(
        roles.raw_operation(t), pipe_key(F.col("full_model"), F.col("SERIAL")), F.col("LOCAL_DATE"), _FIRST, _LAST
    )
    return rounded(sg.segment_features(prepared, "operation"))


_FOLDS = [("F1", "1997-01-01", "1998-01-01", ["1997-03-01", "1997-04-15", "1997-09-01"]),
          ("F2", "1999-01-01", "2000-01-01", ["1999-02-01", "1999-03-01"])]
_PLAN_VALUES = ", ".join(
    f"('{p['anchor_id']}', DATE '{p['anchor_date']}')" for p in sg.anchor_plan(_FOLDS)
)
_SO_NAMES = [c for c in _SO if c != "operation_day_count"]


# source -> twin of the raw rows, raw rows, model, serial and day columns, aggregates and which of them are whole numbers
_FLEET = {
    "fault": (roles.FLEET_FAULT_SQL, roles.fleet_fault, "full_model", "serial_number", "event_date", _SF, ["fault_event_count", "fault_active_days", "fault_unique_code_count", *_FC]),
    "maintenance": (
        roles.FLEET_MAINTENANCE_SQL, roles.fleet_maintenance, "full_model", "SERIAL", "event_date", _SM,
        ["maint_event_count", "maint_active_days", "maint_unique_event_count", *_MC, "maint_unavailable_count", "maint_remaining_negative_count", "maint_remaining_zero_count"],
    ),
    "fluid": (roles.FLEET_FLUID_SQL, roles.fleet_fluid, "FULL_MODEL", "SERIAL", "sample_drawn_date", _SL, _SL_WHOLE),
    "operation": (roles.RAW_OPERATION_SQL, roles.raw_operation, "full_model", "SERIAL", "LOCAL_DATE", _SO, ["operation_day_count"]),
}


def _prepared(t, source: str):
    _, raw, model, serial, day, _, _ = _FLEET[source]
    return sg.prepare_events(raw(t), pipe_key(F.col(model), F.col(serial)), F.col(day), _FIRST, _LAST)


def _anchor_query(source: str) -> None:
    raw_sql, _, model, serial, day, aggs, whole = _FLEET[source]
    sql = round_sql(
        f"""SELECT machine_key, anchor_date, period_start, {', '.join(f'{e} AS {n}' for n, e in aggs.items())} FROM (
SELECT r.*, upper({model}) || '|' || {serial} AS machine_key, {day} AS event_day, p.anchor_date, CAST(p.anchor_date - 90 AS DATE) AS period_start
FROM ({raw_sql}) AS r JOIN (VALUES {_PLAN_VALUES}) AS p(anchor_id, anchor_date) ON {day} BETWEEN p.anchor_date - 90 AND p.anchor_date - 1) AS q GROUP BY 1, 2, 3""",
        ["machine_key", "anchor_date", "period_start", *whole], [c for c in aggs if c not in whole],
    )

    @query(f"anchor_{source}", "E29 C18", sql)
    def _(t):
        prepared = _prepared(t, source)
        roster = prepared.select("machine_key").distinct()
        return rounded(sg.anchor_features(sg.anchor_grid(roster, sg.anchor_plan(_FOLDS)), prepared, source))


for _source in _FLEET:
    _anchor_query(_source)


def _panel_sql() -> str:
    def part(source: str) -> str:
        raw_sql, _, model, serial, day, aggs, whole = _FLEET[source]
        return _segment_sql(raw_sql, f"upper({model}) || '|' || {serial}", day, _FIRST, _LAST, 90, aggs, whole)

    keys = " UNION ".join(
        f"SELECT upper({model}) || '|' || {serial} AS machine_key FROM ({raw}) AS r WHERE {day} BETWEEN DATE '{_FIRST}' AND DATE '{_LAST}'"
        for raw, _, model, serial, day, _, _ in _FLEET.values()
    )
    filled = lambda c: f"coalesce({c}, 0) AS {c}" if c.endswith(("_count", "_sum")) else c
    columns = [filled(c) for *_, aggs, _ in _FLEET.values() for c in aggs]
    flags = [f"CAST({s}_part.machine_key IS NOT NULL AS INT) AS has_{s}_data" for s in _FLEET]
    return f"""WITH grid AS (SELECT machine_key, CAST(g.p AS DATE) AS period_start FROM ({keys}) AS m, generate_series(TIMESTAMP '{_FIRST}', TIMESTAMP '{_LAST}' - INTERVAL 89 DAY, INTERVAL 90 DAY) AS g(p))
SELECT grid.machine_key, grid.period_start, CAST(grid.period_start + 89 AS DATE) AS period_end, 'Q' || quarter(grid.period_start) AS segment_season, CAST(year(grid.period_start) AS INT) AS segment_year, {', '.join([*columns, *flags])}
FROM grid {' '.join(f'LEFT JOIN ({part(s)}) AS {s}_part ON {s}_part.machine_key = grid.machine_key AND {s}_part.period_start = grid.period_start' for s in _FLEET)}"""


@query("segment_panel", "E30 C16 C17 J2", _panel_sql())
def _(t):
    prepared = {s: _prepared(t, s) for s in _FLEET}
    roster = reduce(DataFrame.unionByName, [p.select("machine_key") for p in prepared.values()]).distinct()
    panel = sg.segment_grid(roster, _FIRST, _LAST)
    for source, rows in prepared.items():
        panel = sg.merge_source(panel, sg.segment_features(rows, source), source, ["machine_key", "period_start"])
    return rounded(sg.fill_count_like(panel))


# ------------------------------------------------------------------ case-control windows
# each order date closes a window of 60 days that ends 15 days before it
_WINDOWS_SQL = f"""SELECT DISTINCT {roles._C_ID} AS machine_key, CAST(CAST(o_orderdate AS DATE) - 75 AS DATE) AS window_start,
 CAST(CAST(o_orderdate AS DATE) - 15 AS DATE) AS window_end FROM orders"""


def _windows(t):
    return t("orders").selectExpr(
        f"{roles._C_ID} as machine_key", "date_sub(cast(o_orderdate as date), 75) as window_start",
        "date_sub(cast(o_orderdate as date), 15) as window_end",
    ).distinct()


_CO = {
    "has_operation_window": "1", "operation_day_count_window": "count(*)",
    "operation_working_hours_sum_window": "sum(working_hours_clean)",
    "operation_working_hours_mean_window": "avg(working_hours_clean)", "operation_working_hours_max_window": "max(working_hours_clean)",
    "operation_engine_running_hours_sum_window": "sum(engine_running_hours_clean)", "operation_idle_hours_sum_window": "sum(engine_idling_hours_clean)",
    "operation_high_throttle_day_count_window": "sum(high_throttle_day_flag)",
    "operation_latest_smr_window": "max(struct_pack(d := event_day, o := working_hours_clean, v := smr_hours)).v",
    "first_smr": "min(struct_pack(d := event_day, o := working_hours_clean, v := smr_hours)).v",
}
_CO_SUMS = [c for c in _CO if c.endswith(("_sum_window", "_throttle_day_count_window", "mean_window", "max_window"))]


@query(
    "case_window_operation", "E26 J3",
    round_sql(f"""WITH win AS ({_WINDOWS_SQL}), op AS ({OPERATION_SQL}),
agg AS (SELECT w.machine_key, w.window_start, w.window_end, {', '.join(f'{e} AS {n}' for n, e in _CO.items())}
 FROM win w JOIN op ON op.model_id = w.machine_key AND op.event_day BETWEEN w.window_start AND w.window_end GROUP BY 1, 2, 3)
SELECT machine_key, window_start, window_end, coalesce(has_operation_window, 0) AS has_operation_window, coalesce(operation_day_count_window, 0) AS operation_day_count_window,
 {', '.join(f'coalesce({c}, 0) AS {c}' for c in _CO_SUMS)},
 CASE WHEN operation_engine_running_hours_sum_window > 0 THEN operation_idle_hours_sum_window / operation_engine_running_hours_sum_window END AS operation_idle_share_window,
 operation_latest_smr_window, operation_latest_smr_window - first_smr AS operation_smr_delta_window
FROM win LEFT JOIN agg USING (machine_key, window_start, window_end)""",
        ["machine_key", "window_start", "window_end", "has_operation_window", "operation_day_count_window"],
        [*_CO_SUMS, "operation_idle_share_window", "operation_latest_smr_window", "operation_smr_delta_window"]),
)
def _(t):
    days = std.standard_operation(roles.raw_operation(t)).withColumnRenamed("model_id", "machine_key")
    return rounded(cw.operation_window(_windows(t), days, "struct(working_hours_clean, smr_hours)"))


_EV_WINDOWS_SQL = f"""SELECT DISTINCT {roles._MODEL} || ' ' || {roles._SERIAL} AS machine_key, CAST(CAST(ts AS DATE) - 7 - CAST(user_id % 3 AS INT) AS DATE) AS window_start,
 CAST(CAST(ts AS DATE) - 2 AS DATE) AS window_end FROM events"""


def _event_windows(t):
    return t("events").selectExpr(
        f"{roles._MODEL} || ' ' || {roles._SERIAL} as machine_key",
        "date_sub(cast(ts as date), cast(7 + user_id % 3 as int)) as window_start", "date_sub(cast(ts as date), 2) as window_end",
    ).distinct()


_CF = {
    "has_fault_window": "1", "fault_count_window": "count(*)", "fault_unique_code_count_window": "count(DISTINCT nullif(fault_code, ''))",
    "fault_l03plus_count_window": "count(*) FILTER (WHERE action_level_num >= 3)",
    "fault_l04plus_count_window": "count(*) FILTER (WHERE action_level_num >= 4)",
    "fault_max_action_level_window": "max(coalesce(action_level_num, 0))", "fault_max_evidence_score_window": "max(coalesce(failure_code_evidence_score, 0))",
    "fault_mean_evidence_score_window": "avg(coalesce(failure_code_evidence_score, 0))", "fault_max_log_occurrence_window": "max(coalesce(log_occurrence_count, 0))",
    "fault_days_since_latest_in_window": "date_diff('day', max(event_date), window_end)",
    "fault_mechanical_count_window": "sum(is_mechanical_failure_code)", "fault_electrical_count_window": "sum(is_electrical_failure_code)",
}
_CF_WHOLE = ["has_fault_window", "fault_count_window", "fault_unique_code_count_window", "fault_l03plus_count_window", "fault_l04plus_count_window"]
_CF_DOUBLE = [c for c in _CF if c not in _CF_WHOLE and "days_since" not in c]


@query(
    "case_window_faults", "E26",
    round_sql(f"""WITH win AS ({_EV_WINDOWS_SQL}), f AS (SELECT *, full_model || ' ' || serial_number AS mk FROM ({roles.RAW_FAULT_SQL}) AS r),
agg AS (SELECT w.machine_key, w.window_start, w.window_end, {', '.join(f'{e} AS {n}' for n, e in _CF.items())}
 FROM win w JOIN f ON f.mk = w.machine_key AND f.event_date BETWEEN w.window_start AND w.window_end GROUP BY 1, 2, 3)
SELECT * FROM win LEFT JOIN agg USING (machine_key, window_start, window_end)""",
        ["machine_key", "window_start", "window_end", *[f"coalesce({c}, 0) AS {c}" for c in _CF_WHOLE], "fault_days_since_latest_in_window",
         *[f"round(CAST(coalesce({c}, 0) AS DOUBLE), 9) AS {c}" for c in _CF_DOUBLE]], []).replace(", ,", ","),
)
def _(t):
    faults = roles.raw_fault(t).withColumn("machine_key", F.concat_ws(" ", "full_model", "serial_number")).withColumnRenamed("event_date", "event_day")
    return rounded(cw.fault_window(_event_windows(t), faults))


_CM = {
    "has_maintenance_window": "1", "maintenance_event_count_window": "count(*)", "maintenance_monitor_reset_count_window": "count(*) FILTER (WHERE is_reset)",
    "maintenance_overdue_count_window": "count(*) FILTER (WHERE is_overdue)", "maintenance_due_now_count_window": "count(*) FILTER (WHERE is_due_now)",
    "maintenance_min_remaining_hours_window": "min(remaining_hours)",
    "maintenance_days_since_latest_event_window": "date_diff('day', max(event_day), window_end)",
}


@query(
    "case_window_maintenance", "E26",
    round_sql(f"""WITH win AS ({_EV_WINDOWS_SQL}), f AS ({MAINTENANCE_SQL}),
agg AS (SELECT w.machine_key, w.window_start, w.window_end, {', '.join(f'{e} AS {n}' for n, e in _CM.items())}
 FROM win w JOIN f ON f.model_id = w.machine_key AND f.event_day BETWEEN w.window_start AND w.window_end GROUP BY 1, 2, 3)
SELECT * FROM win LEFT JOIN agg USING (machine_key, window_start, window_end)""",
        ["machine_key", "window_start", "window_end", *[f"coalesce({c}, 0) AS {c}" for c in list(_CM)[:5]], "maintenance_days_since_latest_event_window"],
        ["maintenance_min_remaining_hours_window"]),
)
def _(t):
    events = std.standard_maintenance(roles.raw_maintenance(t)).withColumnRenamed("model_id", "machine_key")
    return rounded(cw.maintenance_window(_event_windows(t), events))


_SAMPLE_WINDOWS_SQL = f"""SELECT model_id AS machine_key, CAST(snapshot_date - 30 AS DATE) AS window_start, snapshot_date AS window_end FROM ({roles.SAMPLE_SPINE_SQL}) AS s"""
_CL = {
    "fluid_max_cu_ppm_window": "Cu_Copper_PPM", "fluid_max_fe_ppm_window": "Fe_Iron_PPM", "fluid_max_pb_ppm_window": "Pb_Lead_PPM",
    "fluid_max_soot_percent_window": "Soot_Soot_PERCENT", "fluid_max_water_percent_window": "Water_Water_PERCENT",
}


@query(
    "case_window_fluids", "E26",
    round_sql(f"""WITH win AS ({_SAMPLE_WINDOWS_SQL}), f AS ({FLUID_SQL}),
agg AS (SELECT w.machine_key, w.window_start, w.window_end, count(*) AS n, max(severity) AS sm, max(event_day) AS ld,
 max(struct_pack(d := event_day, o := sample_id, v := severity)).v AS ls, {', '.join(f'max({v}) AS {n}' for n, v in _CL.items())}
 FROM win w JOIN f ON f.model_id = w.machine_key AND f.event_day BETWEEN w.window_start AND w.window_end GROUP BY 1, 2, 3)
SELECT machine_key, window_start, window_end, CAST(n IS NOT NULL AS INT) AS has_fluid_window, coalesce(n, 0) AS fluid_sample_count_window,
 date_diff('day', ld, window_end) AS fluid_days_since_latest_sample_window, coalesce(sm, 0) AS fluid_max_severity_window,
 coalesce(ls, 0) AS fluid_latest_severity_window, {', '.join(f'coalesce({n}, 0) AS {n}' for n in _CL)}
FROM win LEFT JOIN agg USING (machine_key, window_start, window_end)""",
        ["machine_key", "window_start", "window_end", "has_fluid_window", "fluid_sample_count_window", "fluid_days_since_latest_sample_window"],
        ["fluid_max_severity_window", "fluid_latest_severity_window", *_CL]),
)
def _(t):
    windows = roles.sample_spine(t).selectExpr(
        "model_id as machine_key", "date_sub(snapshot_date, 30) as window_start", "snapshot_date as window_end"
    )
    samples = std.standard_fluids(roles.raw_fluid(t)).withColumnRenamed("model_id", "machine_key")
    return rounded(cw.fluid_window(windows, samples, "sample_number"))


_WINDOW_SPINE = f"SELECT DISTINCT machine_key AS model_id, window_end AS snapshot_date FROM ({_WINDOWS_SQL}) AS w"
_FROZEN = {
    "f": FAULT_FROZEN_SQL.replace(roles.EVENT_SPINE_SQL, _WINDOW_SPINE).replace(roles.RAW_FAULT_SQL, roles.FLEET_FAULT_SQL),
    "m": MAINTENANCE_FROZEN_SQL.replace(roles.EVENT_SPINE_SQL, _WINDOW_SPINE).replace(roles.RAW_MAINTENANCE_SQL, roles.FLEET_MAINTENANCE_SQL),
    "o": OPERATION_FROZEN_SQL.replace(roles.ORDER_SPINE_SQL, _WINDOW_SPINE),
    "l": FLUID_FROZEN_SQL.replace(roles.SAMPLE_SPINE_SQL, _WINDOW_SPINE).replace(roles.RAW_FLUID_SQL, roles.FLEET_FLUID_SQL),
    "c": CLAIM_FROZEN_SQL.replace(roles.ORDER_SPINE_SQL, _WINDOW_SPINE),
}


@query(
    "frozen_case_windows", "E27",
    f"""SELECT w.machine_key, w.window_start, w.window_end, {', '.join(f'{n}.* EXCLUDE (model_id, snapshot_date)' for n in _FROZEN)} FROM ({_WINDOWS_SQL}) AS w
{' '.join(f'JOIN ({sql}) AS {n} ON {n}.model_id = w.machine_key AND {n}.snapshot_date = w.window_end' for n, sql in _FROZEN.items())}""",
)
def _(t):
    windows = _windows(t)
    known = windows.select(F.col("machine_key").alias("model_id")).distinct()
    faults = std.keep_known(std.standard_faults(roles.fleet_fault(t), known), known)
    maintenance = std.standard_maintenance(roles.fleet_maintenance(t))
    days, samples, claims = std.standard_operation(roles.raw_operation(t)), std.standard_fluids(roles.fleet_fluid(t)), std.standard_claims(roles.raw_claim(t))
    nine = lambda build: lambda spine: rounded(build(spine))
    return cw.frozen_window_features(windows, [
        nine(lambda spine: sf.fault_frozen(spine, faults)), nine(lambda spine: sf.maintenance_frozen(spine, maintenance)),
        nine(lambda spine: sf.operation_frozen(spine, days)), nine(lambda spine: sf.fluid_frozen(spine, samples)),
        lambda spine: rounded(sf.claim_frozen(spine, claims), 4),
    ])
