"""The driver tables in the roles of the raw sources.

Each role is a list of SQL expressions over one table (or join) that both Spark and
the SQL twins evaluate, so the twins start from the same raw columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.sources.standardize import FLUID_MEASURES

_K_SPARK = "cast(get_json_object(props, '$.k') as bigint)"
_K_SQL = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

_MODEL = "'MX-' || cast(user_id % 5 as string)"
_SERIAL = "cast(70000 + user_id as string)"

RAW_FAULT = {
    "machine_id": f"case when user_id % 7 = 0 then {_MODEL} || '-' || {_SERIAL} else {_MODEL} || ' ' || {_SERIAL} end",
    "full_model": _MODEL,
    "serial_number": _SERIAL,
    "event_time": "ts",
    "event_date": "cast(ts as date)",
    "fault_code": "case when k % 11 = 0 then '' when k % 13 = 0 then null else 'C' || cast(k as string) end",
    "event_action_level": "case when event_type = 'error' then (case when k % 2 = 0 then 'l03' else 'L04 ' end) when event_type = 'click' then 'L02' else 'L01' end",
    "action_level_num": "case when k % 3 = 0 then null when event_type = 'error' then 3 + k % 2 when event_type = 'click' then 2 else 1 end",
    "occurrence_count": "case when k % 17 = 0 then null else k % 6 end",
    "log_occurrence_count": "case when k % 4 = 0 then null else value / 10 end",
    "occurrence_class": "k % 3",
    "smr_hours": "case when k % 5 = 0 then null else 24.0 * day(ts) + value / 100 end",
    "failure_code_evidence_score": "case when k % 9 = 0 then null else k / 37e0 end",
    "failure_code_evidence_strength_class": "case k % 4 when 0 then 'strong' when 1 then 'MEDIUM' when 2 then 'moderate' else 'weak' end",
    "failure_code_evidence_group": "case when event_type in ('error', 'purchase') then 'EVENT' when k % 2 = 0 then 'context' else null end",
    "history_category": "case when k % 10 = 0 then 'Past Event list' when k % 10 = 1 then null else 'other' end",
    "applicable_component": "case k % 6 when 0 then 'Engine' when 1 then 'HST' when 2 then 'Power Train' when 3 then 'Cooling fan' when 4 then '' else null end",
    "related_component": "case k % 5 when 0 then 'Hydraulic pump' when 1 then 'Urea SCR System' when 2 then 'Work Equipment' else '' end",
    "related_component_1": "case when k % 7 = 0 then 'Radiator' else '' end",
    "logical_name": "case k % 4 when 0 then 'ENG' when 1 then 'HST' when 2 then 'MON' else 'W/E' end",
    "is_mechanical_failure_code": "k % 2",
    "is_electrical_failure_code": "1 - k % 2",
}

RAW_MAINTENANCE = {
    "machine_id": f"{_MODEL} || ' ' || {_SERIAL}",
    "full_model": _MODEL,
    "SERIAL": _SERIAL,
    "EVENT_NAME_ID": "k % 20",
    "EVENT_NAME_EN": "case when k % 20 = 19 then null else 'item ' || cast(k % 20 as string) end",
    "event_time": "ts",
    "event_date": "cast(ts as date)",
    "smr_hours": "case when k % 6 = 0 then null else 24.0 * day(ts) + value / 100 end",
    "remaining_hours": "case when k % 8 = 0 then null when k % 8 = 1 then 0 else value - 30 end",
    "is_monitor_reset": "case when event_type in ('view', 'click') then 'True' when event_type = 'error' then 'no' else 'maybe' end",
    "is_overdue": "case when event_type = 'error' then 'Y' else '0' end",
    "is_due_now": "case when event_type = 'signup' then '1' else 'false' end",
    "AVAILABLE": "case when k % 12 = 0 then 'f' when k % 12 = 1 then '?' else 't' end",
    "maintenance_type": "case k % 5 when 0 then 'Engine oil' when 1 then 'Oil filter' when 2 then 'Breather' when 3 then '' else 'Coolant' end",
    "related_component": "case k % 6 when 0 then 'Engine' when 1 then 'Transmission' when 2 then 'Urea SCR System' when 3 then 'Cooling' when 4 then 'Final drive' else '' end",
    "related_component_1": "case when k % 9 = 0 then null else '' end",
    "related_component_2": "''",
}

_C_MODEL = "'CX-' || cast(o_custkey % 4 as string)"
_C_SERIAL = "cast(10000 + o_custkey as string)"
_C_ID = f"{_C_MODEL} || ' ' || {_C_SERIAL}"

RAW_OPERATION = {
    "machine_id": _C_ID,
    "full_model": _C_MODEL,
    "SERIAL": _C_SERIAL,
    "LOCAL_DATE": "cast(l_shipdate as date)",
    "smr_hours": "case when l_partkey % 5 = 0 then null else (year(l_shipdate) - 1995) * 1000.0 + month(l_shipdate) * 80 + l_quantity end",
    "smr_delta_clean_since_prev_obs_hours": "l_quantity * 0.2437e0",
    "actual_working_hours_clean": "case when l_partkey % 11 = 0 then null else l_quantity * 0.3313e0 end",
    "actual_work_streak_through_current_day": "l_linenumber",
    "engine_running_hours_clean": "l_quantity * 0.5171e0",
    "engine_idling_hours_clean": "l_quantity * l_discount * 0.9137e0",
    "throttle_full_hours_clean": "l_quantity * l_tax * 0.8713e0",
    "throttle_average_dial_position_clean": "case when l_partkey % 3 = 0 then null else l_tax * 100 end",
    "traveling_hours_clean": "l_quantity * l_discount * 0.4591e0",
    "moving_back_forth_hours_clean": "l_quantity * l_tax * 0.6133e0",
    "steering_hours_clean": "l_tax * 3.0171e0",
    "auto_quick_shift_hours_clean": "l_discount * 5",
    "manual_variable_shift_hours_clean": "l_discount * 7",
    "working_hours_clean": "l_quantity * 0.2911e0",
    "engine_idle_share_daily": "case when l_partkey % 7 = 0 then null else l_discount end",
    "throttle_full_share_clean": "l_tax",
    "smr_valid_for_utilization_flag": "case when l_partkey % 4 = 0 then 'false' else 'yes' end",
    "actual_work_day_flag": "case when l_returnflag = 'A' then 0 else 1 end",
    "actual_work_valid_flag": "case when l_partkey % 6 = 0 then 0 else 1 end",
    "actual_work_seconds_invalid_flag": "case when l_partkey % 6 = 0 then 1 else 0 end",
    "fuel_actual_work_conflict_flag": "case when l_partkey % 10 = 0 then 't' else 'f' end",
    "engine_running_day_flag": "case when l_returnflag = 'R' then 0 else 1 end",
    "engine_seconds_valid_flag": "1",
    "engine_seconds_observed_flag": "1",
    "throttle_observed_flag": "case when l_partkey % 3 = 0 then 0 else 1 end",
    "work_idle_sum_exceeds_engine_flag": "case when l_discount > 0.08 then 1 else 0 end",
    "high_throttle_day_flag": "case when l_tax > 0.06 then 1 else 0 end",
    "long_engine_day_flag": "case when l_quantity > 40 then 1 else 0 end",
    "travel_day_flag": "case when l_linestatus = 'F' then 1 else 0 end",
    "travel_usable_flag": "case when l_partkey % 2 = 0 then 1 else 0 end",
    "last_actual_work_date_through_current_day": "case when l_returnflag = 'A' then cast(o_orderdate as date) else cast(l_shipdate as date) end",
}

RAW_CLAIM = {
    "machine_id": _C_ID,
    "full_model": _C_MODEL,
    "serial": _C_SERIAL,
    "claim_number": "cast(o_orderkey as string)",
    "local_date": "cast(o_orderdate as date)",
    "claim_type_description": "case when o_orderkey % 29 = 0 then '' else o_orderpriority end",
    "claim_amount": "case when o_orderkey % 23 = 0 then null else o_totalprice end",
    "critical_fail_part_number": "case when o_orderkey % 5 = 0 then null when o_orderkey % 7 = 0 then '0000' else 'P' || cast(o_orderkey % 40 as string) end",
    "failure_smr": "o_totalprice / 1000",
}

RAW_FLUID = {
    "machine_id": "'SX-' || cast(l_suppkey % 3 as string) || ' ' || cast(500 + l_suppkey as string)",
    "FULL_MODEL": "'SX-' || cast(l_suppkey % 3 as string)",
    "SERIAL": "cast(500 + l_suppkey as string)",
    "sample_drawn_date": "cast(l_shipdate as date)",
    "LABS_SAMPLE_NUMBER": "l_orderkey * 10000000 + l_partkey * 100 + l_linenumber",
    "sample_result_severity_order": "case when l_partkey % 7 = 0 then null else l_partkey % 6 end",
    "TELEMETRY_SMR_NUMERIC": "case when l_partkey % 4 = 0 then null else l_quantity * 10 end",
    "Cu_Copper_PPM": "case when l_partkey % 3 = 0 then null else l_quantity end",
    "Fe_Iron_PPM": "case when l_partkey % 3 = 1 then null else l_quantity * 2 end",
    "Pb_Lead_PPM": "case when l_partkey % 5 = 0 then l_tax * 100 else null end",
    "Si_Silicon_PPM": "case when l_partkey % 2 = 0 then l_quantity * 3 else null end",
    "Soot_Soot_PERCENT": "l_discount",
    "Water_Water_PERCENT": "case when l_partkey % 4 = 1 then l_tax * 2 else null end",
    "Gly_Glycol_PERCENT": "case when l_partkey % 9 = 0 then l_quantity + 20 else null end",
    "Fuel_Fuel_PERCENT": "case when l_partkey % 8 = 0 then l_tax * 40 else null end",
}
# the other measures, each known on another part of the samples
RAW_FLUID |= {m: f"case when l_partkey % {i + 2} = 0 then l_quantity * {i + 1} else null end" for i, m in enumerate(FLUID_MEASURES) if m not in RAW_FLUID}

# One fleet for all sources: events and samples of the order entities. The events are laid
# back over the years of the orders (``fleet_ts``).
_F_MODEL, _F_SERIAL = "'CX-' || cast(user_id % 4 as string)", "cast(10000 + user_id as string)"
FLEET_FAULT = RAW_FAULT | {
    "machine_id": f"case when user_id % 7 = 0 then {_F_MODEL} || '-' || {_F_SERIAL} else {_F_MODEL} || ' ' || {_F_SERIAL} end",
    "full_model": _F_MODEL, "serial_number": _F_SERIAL, "event_time": "fleet_ts", "event_date": "cast(fleet_ts as date)",
}
FLEET_MAINTENANCE = RAW_MAINTENANCE | {
    "machine_id": f"{_F_MODEL} || ' ' || {_F_SERIAL}", "full_model": _F_MODEL, "SERIAL": _F_SERIAL,
    "event_time": "fleet_ts", "event_date": "cast(fleet_ts as date)",
}
FLEET_FLUID = RAW_FLUID | {"machine_id": _C_ID, "FULL_MODEL": _C_MODEL, "SERIAL": _C_SERIAL}

_EVENT_ROW = "SELECT *, {k} AS k FROM events"
_ORDER_LINE = "SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _sql(role: dict[str, str], source: str) -> str:
    inner = ", ".join(f"{e} AS {n}" for n, e in role.items())
    return f"SELECT {inner} FROM ({source}) AS src"


def _frame(role: dict[str, str], df: DataFrame) -> DataFrame:
    return df.selectExpr(*[f"{e} as {n}" for n, e in role.items()])


_EVENTS_SQL = "SELECT *, " + _K_SQL + " AS k FROM events"
_FLEET_EVENTS_SQL = f"SELECT *, {_K_SQL} AS k, ts - to_days(CAST(8036 + event_id % 60 * 36 AS INTEGER)) AS fleet_ts FROM events"
RAW_FAULT_SQL = _sql(RAW_FAULT, _EVENTS_SQL)
RAW_MAINTENANCE_SQL = _sql(RAW_MAINTENANCE, _EVENTS_SQL)
RAW_OPERATION_SQL = _sql(RAW_OPERATION, _ORDER_LINE)
RAW_CLAIM_SQL = _sql(RAW_CLAIM, "SELECT * FROM orders")
RAW_FLUID_SQL = _sql(RAW_FLUID, "SELECT * FROM lineitem")
FLEET_FAULT_SQL = _sql(FLEET_FAULT, _FLEET_EVENTS_SQL)
FLEET_MAINTENANCE_SQL = _sql(FLEET_MAINTENANCE, _FLEET_EVENTS_SQL)
FLEET_FLUID_SQL = _sql(FLEET_FLUID, _ORDER_LINE)


def _events(t) -> DataFrame:
    return t("events").selectExpr("*", f"{_K_SPARK} as k")


def raw_fault(t) -> DataFrame:
    return _frame(RAW_FAULT, _events(t))


def raw_maintenance(t) -> DataFrame:
    return _frame(RAW_MAINTENANCE, _events(t))


def _order_lines(t) -> DataFrame:
    lines, orders = t("lineitem"), t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey)


def _fleet_events(t) -> DataFrame:
    return _events(t).selectExpr("*", "ts - make_dt_interval(cast(8036 + event_id % 60 * 36 as int)) as fleet_ts")


def fleet_fault(t) -> DataFrame:
    return _frame(FLEET_FAULT, _fleet_events(t))


def fleet_maintenance(t) -> DataFrame:
    return _frame(FLEET_MAINTENANCE, _fleet_events(t))


def fleet_fluid(t) -> DataFrame:
    return _frame(FLEET_FLUID, _order_lines(t))


def raw_operation(t) -> DataFrame:
    return _frame(RAW_OPERATION, _order_lines(t))


def raw_claim(t) -> DataFrame:
    return _frame(RAW_CLAIM, t("orders"))


def raw_fluid(t) -> DataFrame:
    return _frame(RAW_FLUID, t("lineitem"))


# Spines: events entities every third day of January 2024, order entities quarterly,
# sample entities half-yearly.
EVENT_SPINE_SQL = f"""
SELECT DISTINCT {_MODEL} || ' ' || {_SERIAL} AS model_id, {_MODEL} AS full_model,
       CAST(d AS DATE) AS snapshot_date
FROM (SELECT DISTINCT user_id FROM events) AS u,
     generate_series(TIMESTAMP '2024-01-08', TIMESTAMP '2024-02-10', INTERVAL 3 DAY) AS g(d)"""
ORDER_SPINE_SQL = f"""
SELECT DISTINCT {_C_ID} AS model_id, {_C_MODEL} AS full_model, CAST(d AS DATE) AS snapshot_date
FROM (SELECT DISTINCT o_custkey FROM orders) AS u,
     generate_series(TIMESTAMP '1995-04-01', TIMESTAMP '2001-12-31', INTERVAL 90 DAY) AS g(d)"""
SAMPLE_SPINE_SQL = """
SELECT DISTINCT 'SX-' || cast(l_suppkey % 3 as string) || ' ' || cast(500 + l_suppkey as string) AS model_id,
       CAST(d AS DATE) AS snapshot_date
FROM (SELECT DISTINCT l_suppkey FROM lineitem) AS u,
     generate_series(TIMESTAMP '1995-04-01', TIMESTAMP '2001-12-31', INTERVAL 45 DAY) AS g(d)"""


def _spine(entities: DataFrame, first: str, last: str, step: int) -> DataFrame:
    days = f"explode(sequence(date'{first}', date'{last}', interval {step} day)) as snapshot_date"
    return entities.distinct().selectExpr("*", days)


def event_spine(t) -> DataFrame:
    users = t("events").selectExpr(f"{_MODEL} || ' ' || {_SERIAL} as model_id", f"{_MODEL} as full_model")
    return _spine(users, "2024-01-08", "2024-02-10", 3)


def order_spine(t) -> DataFrame:
    users = t("orders").selectExpr(f"{_C_ID} as model_id", f"{_C_MODEL} as full_model")
    return _spine(users, "1995-04-01", "2001-12-31", 90)


def sample_spine(t) -> DataFrame:
    suppliers = t("lineitem").selectExpr(f"{RAW_FLUID['machine_id']} as model_id")
    return _spine(suppliers, "1995-04-01", "2001-12-31", 45)
