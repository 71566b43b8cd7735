"""Raw source tables to event tables with one key, one day and typed payload columns.

Every standardizer resolves renamed columns, fills missing ones with typed defaults
and leaves a row per raw event. ``event_day`` is the calendar day; ``event_ceil`` is the
first midnight at or after the event, so that ``datediff(snapshot, event_ceil)`` is the
rounded-down age of an event that carries a time of day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import (
    MODEL_COLUMNS,
    SERIAL_COLUMNS,
    first_existing,
    null_like_to_null,
    reconcile_key,
)
from tidemark.functions.scalars import (
    COMPONENT_WORDS,
    MAINTENANCE_WORDS,
    clip,
    contains_any,
    first_midnight_at_or_after,
    flag,
    level_number,
    log_occurrence,
    mixed_boolean,
    number,
    timestamp,
)
from tidemark.operators.ordering import first_per_group

# Alias columns of the entity key and of the dates, first match wins.
KEY_COLUMNS = ("model_id", "MODEL_ID", "machine_id", "MACHINE_ID")
EVENT_TIME_COLUMNS = ("event_time", "UPDATE_DATETIME", "update_datetime")
CLAIM_DATE_COLUMNS = (
    "local_date", "LOCAL_DATE", "ZZFAILDAT", "warranty_failure_date", "failure_date", "claim_date",
)
CLAIM_AMOUNT_COLUMNS = (
    "claim_amount", "CLAIM_AMOUNT", "total_claim_amount", "total_amount",
    "net_claim_amount", "paid_amount",
)
CLAIM_TYPE_COLUMNS = (
    "claim_type_description", "CLAIM_TYPE_DESCRIPTION", "claim_type", "claim_category",
    "warranty_claim_data_source",
)

# Daily operation measures with their default, and 0/1 day flags.
OPERATION_MEASURES = {
    "smr_hours": None,
    "smr_delta_clean_since_prev_obs_hours": 0.0,
    "actual_working_hours_clean": 0.0,
    "actual_work_streak_through_current_day": 0.0,
    "engine_running_hours_clean": 0.0,
    "engine_idling_hours_clean": 0.0,
    "throttle_full_hours_clean": 0.0,
    "throttle_average_dial_position_clean": None,
    "traveling_hours_clean": 0.0,
    "moving_back_forth_hours_clean": 0.0,
    "steering_hours_clean": 0.0,
    "working_hours_clean": 0.0,
    "auto_quick_shift_hours_clean": 0.0,
    "manual_variable_shift_hours_clean": 0.0,
    "movement_observed_count": 0.0,
}
OPERATION_FLAGS = (
    "smr_valid_for_utilization_flag", "smr_present_flag", "actual_work_day_flag",
    "actual_work_valid_flag", "actual_work_seconds_invalid_flag",
    "fuel_actual_work_conflict_flag", "engine_running_day_flag", "engine_seconds_valid_flag",
    "engine_seconds_observed_flag", "throttle_observed_flag", "work_idle_sum_exceeds_engine_flag",
    "high_throttle_day_flag", "long_engine_day_flag", "travel_day_flag", "travel_usable_flag",
    "movement_day_flag", "travel_invalid_flag",
)

# Lab measures of a fluid sample.
FLUID_MEASURES = (
    "Ag_Silver_PPM", "Al_Aluminum_PPM", "Cr_Chromium_PPM", "Cu_Copper_PPM", "Fe_Iron_PPM",
    "Ni_Nickel_PPM", "Pb_Lead_PPM", "Sn_Tin_PPM", "Ti_Titanium_PPM", "V_Vanadium_PPM",
    "EthyleneGlycol_Ethylene_Glycol_PERCENT", "Fuel_Fuel_PERCENT", "Gly_Glycol_PERCENT",
    "K_Potassium_PPM", "Li_Lithium_PPM", "Na_Sodium_PPM",
    "PolypropyleneGlycol_Polypropylene_Glycol_PERCENT", "Sediment_Sediment_MG_PER_L",
    "Si_Silicon_PPM", "Solids_Solids_PERCENT", "Soot_Soot_Abs", "Soot_Soot_Abs_cm",
    "Soot_Soot_METHOD_DEPENDENT", "Soot_Soot_PERCENT", "Water_Water_PERCENT",
)

# Contaminant limits that apply to an abnormal sample.
CONTAMINANT_ABOVE = {
    "Water_Water_PERCENT": 0.10,
    "EthyleneGlycol_Ethylene_Glycol_PERCENT": 0.05,
    "Fuel_Fuel_PERCENT": 2.0,
    "Si_Silicon_PPM": 100.0,
}
GLYCOL_NORMAL_RANGE = (40.0, 60.0)
UNKNOWN_SEVERITY = (5,)
ABNORMAL_SEVERITY = 2
SERIOUS_LEVEL = 2
SERIOUS_GROUP = "EVENT"


def _text(df: DataFrame, names: Sequence[str], default: object = "") -> Column:
    return F.trim(first_existing(df, names, default).cast("string"))


def _with_entity(df: DataFrame, roster: DataFrame | None) -> DataFrame:
    """Add ``model_id``, ``full_model`` and ``key_reconciled``."""
    model = first_existing(df, MODEL_COLUMNS).cast("string")
    serial = first_existing(df, SERIAL_COLUMNS).cast("string")
    fallback = F.concat(F.trim(model), F.lit(" "), F.trim(serial))
    has_key = any(c in df.columns for c in KEY_COLUMNS)
    key = null_like_to_null(first_existing(df, KEY_COLUMNS) if has_key else fallback)
    out = df.withColumns({"model_id": key, "full_model": F.trim(model)})
    if roster is None:
        return out.withColumn("key_reconciled", F.lit(0))
    return reconcile_key(out, roster, "model_id", fallback)


def _with_days(df: DataFrame, instant: Column) -> DataFrame:
    return df.withColumn("__instant", instant).withColumns(
        {
            "event_day": F.to_date("__instant"),
            "event_ceil": first_midnight_at_or_after(F.col("__instant")),
        }
    )


def standard_faults(raw: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """Fault events: level, occurrence, evidence, component and context columns."""
    df = _with_entity(raw, roster)
    when = F.coalesce(
        timestamp(first_existing(df, EVENT_TIME_COLUMNS)),
        timestamp(first_existing(df, ("event_date", "LOCAL_DATE", "local_date"))),
    )
    df = _with_days(df, when)
    level = F.upper(_text(df, ("event_action_level", "Action_level", "ACTION_LEVEL", "action_level")))
    count = number(first_existing(df, ("occurrence_count", "OCCURRENCE_COUNT"), 1), 1.0)
    component = first_existing(df, ("applicable_component", "applicableComponent"), "").cast("string")
    # a missing part makes the joined component text missing, hence no component flag
    related = F.concat(
        first_existing(df, ("related_component",), "").cast("string"), F.lit(" "),
        first_existing(df, ("related_component_1",), "").cast("string"), F.lit(" "), component,
    )
    group = F.upper(_text(df, ("failure_code_evidence_group",)))
    history = F.lower(first_existing(df, ("history_category",), "").cast("string"))
    falsy = lambda c: F.coalesce(c, F.lit(False))
    return df.select(
        "model_id", "full_model", "key_reconciled", "event_day", "event_ceil",
        F.col("__instant").alias("event_time"),
        _text(df, ("fault_code", "EVENT_CODE", "event_code", "ERROR_CODE", "error_code")).alias("fault_code"),
        level.alias("action_level"),
        level_number(level, first_existing(df, ("action_level_num", "ACTION_LEVEL_NUM"))).alias("action_level_num"),
        count.alias("occurrence_count"),
        F.coalesce(number(first_existing(df, ("log_occurrence_count",))), F.log1p(count)).alias("log_occurrence"),
        number(first_existing(df, ("occurrence_class",), 0), 0.0).alias("occurrence_class"),
        number(first_existing(df, ("smr_hours", "SMR", "TELEMETRY_SMR", "telemetry_smr"))).alias("smr_hours"),
        number(first_existing(df, ("failure_code_evidence_score",))).alias("evidence_score"),
        F.upper(_text(df, ("failure_code_evidence_strength_class",))).alias("evidence_strength"),
        group.alias("evidence_group"),
        component.alias("applicable_component"),
        number(first_existing(df, ("is_mechanical_failure_code",), 0), 0.0).alias("is_mechanical"),
        number(first_existing(df, ("is_electrical_failure_code",), 0), 0.0).alias("is_electrical"),
        *[contains_any(related, words).alias(f"is_component_{name}") for name, words in COMPONENT_WORDS.items()],
        (falsy(group == "EVENT") | falsy(history.contains("event"))).alias("is_event_evidence"),
        (falsy(group == "CONTEXT") | falsy(history.contains("context"))).alias("is_context_evidence"),
    )


def serious_faults(raw: DataFrame, key: Column) -> DataFrame:
    """Fault events with clipped weights and the serious flag (level and evidence group)."""
    severity = clip(
        F.coalesce(
            level_number(
                first_existing(raw, ("event_action_level",)), first_existing(raw, ("action_level_num",))
            ),
            F.lit(0.0),
        ),
        0.0, 4.0,
    )
    log_occ = clip(
        log_occurrence(
            first_existing(raw, ("log_occurrence_count",)), first_existing(raw, ("occurrence_count",), 1)
        ),
        0.0, 10.0,
    )
    evidence = clip(number(first_existing(raw, ("failure_code_evidence_score",)), 0.0), 0.0, 2.0)
    serious = F.coalesce(
        (severity >= SERIOUS_LEVEL)
        & (F.upper(first_existing(raw, ("failure_code_evidence_group",)).cast("string")) == SERIOUS_GROUP),
        F.lit(False),
    ).cast("int")
    logical = first_existing(raw, ("logical_name",)).cast("string")
    system = F.coalesce(
        F.upper(F.coalesce(first_existing(raw, ("applicable_component",)).cast("string"), logical)),
        F.lit("UNKNOWN"),
    )
    base = raw.select(
        key.alias("machine_key"),
        F.to_date(first_existing(raw, ("event_date",))).alias("event_day"),
        first_existing(raw, ("fault_code",)).cast("string").alias("fault_code"),
        severity.alias("severity"), log_occ.alias("log_occ"), evidence.alias("evidence_score"),
        serious.alias("is_serious"), system.alias("system"),
        (system.contains("HST") | F.coalesce(F.upper(logical) == "HST", F.lit(False))).cast("int").alias("is_hst"),
    )
    return base.where("machine_key is not null and event_day is not null").withColumns(
        {
            "is_l03": F.expr("cast(severity = 3 as int)"),
            "is_l04": F.expr("cast(severity >= 4 as int)"),
            "serious_log_occ": F.expr("is_serious * log_occ"),
            "severity_weight": F.expr("is_serious * severity * log_occ"),
            "evidence_weight": F.expr("is_serious * evidence_score * log_occ"),
        }
    )


def standard_maintenance(raw: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """Maintenance monitor events: reset, overdue and due flags, remaining hours, item."""
    df = _with_entity(raw, roster)
    when = F.coalesce(
        timestamp(first_existing(df, EVENT_TIME_COLUMNS)),
        timestamp(first_existing(df, ("event_date", "date", "LOCAL_DATE", "local_date"))),
    )
    df = _with_days(df, when)
    kind = first_existing(df, ("maintenance_type", "service_types", "SERVICE_TYPES"), "").cast("string")
    related = F.concat(
        first_existing(df, ("related_component",), "").cast("string"), F.lit(" "),
        first_existing(df, ("related_component_1",), "").cast("string"), F.lit(" "),
        first_existing(df, ("related_component_2",), "").cast("string"),
    )
    return df.select(
        "model_id", "full_model", "key_reconciled", "event_day", "event_ceil",
        F.col("__instant").alias("event_time"),
        first_existing(df, ("EVENT_NAME_EN",)).cast("string").alias("item"),
        number(first_existing(df, ("smr_hours", "SMR", "TELEMETRY_SMR", "telemetry_smr"))).alias("smr_hours"),
        number(first_existing(df, ("remaining_hours", "REMAINING_HOURS"))).alias("remaining_hours"),
        mixed_boolean(first_existing(df, ("is_monitor_reset",), False)).alias("is_reset"),
        mixed_boolean(first_existing(df, ("is_overdue",), False)).alias("is_overdue"),
        mixed_boolean(first_existing(df, ("is_due_now",), False)).alias("is_due_now"),
        mixed_boolean(first_existing(df, ("AVAILABLE", "available"), True), True).alias("is_available"),
        kind.alias("maintenance_type"),
        *[contains_any(related, words).alias(f"is_component_{name}") for name, words in COMPONENT_WORDS.items()],
        *[contains_any(kind, words).alias(f"is_type_{name}") for name, words in MAINTENANCE_WORDS.items()],
    )


def standard_operation(
    raw: DataFrame, roster: DataFrame | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Daily operation rows: local day first, numeric defaults, 0/1 flags.

    ``keep`` names further numeric columns to carry along.
    """
    df = _with_entity(raw, roster)
    when = F.coalesce(
        timestamp(first_existing(df, ("LOCAL_DATE", "local_date", "event_date", "date"))),
        timestamp(first_existing(df, ("update_datetime_ts", "UPDATE_DATETIME", "event_time"))),
    )
    day = F.to_date(when)
    return df.select(
        "model_id", "full_model", "key_reconciled", day.alias("event_day"), day.alias("event_ceil"),
        *[number(first_existing(df, (c,), d), d).alias(c) if d is None
          else number(first_existing(df, (c,), d)).alias(c) for c, d in OPERATION_MEASURES.items()],
        *[flag(first_existing(df, (c,), 0)).alias(c) for c in OPERATION_FLAGS],
        F.to_date(timestamp(first_existing(df, ("last_actual_work_date_through_current_day",)))).alias("last_work_day"),
        *[number(first_existing(df, (c,))).alias(c) for c in keep],
    )


def standard_claims(raw: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """Claims: day, number, type and amount."""
    df = _with_entity(raw, roster)
    day = F.to_date(timestamp(first_existing(df, CLAIM_DATE_COLUMNS)))
    return df.select(
        "model_id", "full_model", "key_reconciled", day.alias("event_day"), day.alias("event_ceil"),
        _text(df, ("claim_number", "CLMNO", "claim_id")).alias("claim_number"),
        _text(df, CLAIM_TYPE_COLUMNS).alias("claim_type"),
        number(first_existing(df, CLAIM_AMOUNT_COLUMNS, 0), 0.0).alias("claim_amount"),
        *[F.col(c) for c in ("critical_fail_part_number", "failure_smr") if c in raw.columns],
    )


def standard_fluids(raw: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """Lab samples: day, severity order, meter and the lab measures."""
    df = _with_entity(raw, roster)
    day = F.to_date(
        timestamp(
            first_existing(
                df,
                ("sample_drawn_date", "SAMPLE_DRAWN_DATE", "local_date", "LOCAL_DATE", "event_date", "date"),
            )
        )
    )
    return df.select(
        "model_id", "full_model", "key_reconciled", day.alias("event_day"), day.alias("event_ceil"),
        number(
            first_existing(df, ("sample_result_severity_order", "severity_order", "result_severity_order"))
        ).alias("severity"),
        number(
            first_existing(df, ("TELEMETRY_SMR_NUMERIC", "telemetry_smr_numeric", "smr_hours", "SMR_HOURS"))
        ).alias("smr_hours"),
        first_existing(df, ("LABS_SAMPLE_NUMBER",)).alias("sample_number"),
        *[number(first_existing(df, (c,))).alias(c) for c in FLUID_MEASURES],
    )


def graded_fluids(samples: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Samples with known severity, abnormal flag and contaminant flag; ``first`` and ``last`` bound their days if given."""
    day = F.col("event_day")
    inside = (day >= F.lit(first).cast("date") if first else F.lit(True)) & (day <= F.lit(last).cast("date") if last else F.lit(True))
    raw = F.col("severity")
    known = F.when(raw.between(0, 4) & ~raw.isin(*UNKNOWN_SEVERITY), raw)
    abnormal = F.coalesce(known >= ABNORMAL_SEVERITY, F.lit(False))
    hit = F.lit(False)
    for name, limit in CONTAMINANT_ABOVE.items():
        hit = hit | F.coalesce(F.col(name) > limit, F.lit(False))
    low, high = GLYCOL_NORMAL_RANGE
    glycol = F.col("Gly_Glycol_PERCENT")
    hit = hit | F.coalesce((glycol < low) | (glycol > high), F.lit(False))
    return samples.where(day.isNotNull() & inside).withColumns(
        {
            "severity_known": known,
            "is_abnormal": abnormal.cast("int"),
            "contaminant_flag": (abnormal & hit).cast("int"),
        }
    )


def severity_trend(
    samples: DataFrame, order: str, key: str = "model_id", day: str = "event_day",
    value: str = "severity_known",
) -> DataFrame:
    """Last known sample of every (key, day) with its change against the sample before.

    The change is kept within -4 and 4 and is 0 for the first sample. Only the last two
    samples of a day can matter, so the window of a key holds at most two rows per day.
    """
    known = samples.where(F.col(value).isNotNull())
    last_two = first_per_group(known, [key, day], [F.col(order).desc()], 2, number="__from_last")
    previous = F.lag(value).over(Window.partitionBy(key).orderBy(day, order))
    return (
        last_two.withColumn(
            "severity_trend", clip(F.coalesce(F.col(value) - previous, F.lit(0.0)), -4.0, 4.0)
        )
        .where("__from_last = 1")
        .drop("__from_last")
    )


def keep_known(events: DataFrame, roster: DataFrame, key: str = "model_id") -> DataFrame:
    """Events with a key of the roster and a usable day."""
    allowed = roster.select(F.col(key)).where(F.col(key).isNotNull()).distinct()
    return events.where(F.col(key).isNotNull() & F.col("event_day").isNotNull()).join(
        allowed, key, "left_semi"
    )


def standardization_audit(
    events: DataFrame, roster: DataFrame, source: str, key: str = "model_id"
) -> DataFrame:
    """One row of input, missing-key, missing-day, unknown-entity and kept counts."""
    allowed = roster.select(F.col(key).alias("__known")).where("__known is not null").distinct()
    joined = events.join(allowed, F.col(key) == F.col("__known"), "left")
    has_key, has_day = F.col(key).isNotNull(), F.col("event_day").isNotNull()
    known = F.col("__known").isNotNull()
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    kept = has_key & has_day & known
    return joined.agg(
        F.count(F.lit(1)).alias("input_rows"),
        total(F.col("key_reconciled") == 1).alias("reconciled_rows"),
        total(~has_key).alias("missing_key_rows"),
        total(~has_day).alias("missing_day_rows"),
        total(has_key & ~known).alias("not_in_roster_rows"),
        total(kept).alias("kept_rows"),
        F.count_distinct(F.when(kept, F.col(key))).alias("kept_entities"),
    ).select(F.lit(source).alias("source"), "*")


def dated_rows(
    df: DataFrame, key: str, day: str, first: str | None = None, last: str | None = None
) -> DataFrame:
    """Rows with a non-empty key and a day inside the inclusive bounds."""
    out = df.where(F.col(key).isNotNull() & (F.col(key) != "") & F.col(day).isNotNull())
    if first is not None:
        out = out.where(F.col(day) >= F.lit(first).cast("date"))
    if last is not None:
        out = out.where(F.col(day) <= F.lit(last).cast("date"))
    return out
