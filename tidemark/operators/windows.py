"""Compact features of case-control windows with both ends included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.features import Feature, interval_features
from tidemark.operators.source_features import claim_basic

KEY, START, END = "machine_key", "window_start", "window_end"


def fault_window(rows: DataFrame, faults: DataFrame) -> DataFrame:
    """Fault counts, levels, evidence and recency inside each window."""
    zero = lambda c: f"coalesce(try_cast({c} as double), 0.0D)"
    return interval_features(
        rows, faults,
        [
            Feature("has_fault_window", "any"),
            Feature("fault_count_window", "count"),
            Feature("fault_unique_code_count_window", "distinct", "fault_code"),
            Feature("fault_l03plus_count_window", "count", when="action_level_num >= 3"),
            Feature("fault_l04plus_count_window", "count", when="action_level_num >= 4"),
            Feature("fault_max_action_level_window", "max", zero("action_level_num"), fill=0.0),
            Feature("fault_max_evidence_score_window", "max", zero("failure_code_evidence_score"), fill=0.0),
            Feature("fault_mean_evidence_score_window", "mean", zero("failure_code_evidence_score"), fill=0.0),
            Feature("fault_max_log_occurrence_window", "max", zero("log_occurrence_count"), fill=0.0),
            Feature("fault_days_since_latest_in_window", "recency", "event_day"),
            Feature("fault_mechanical_count_window", "sum", zero("is_mechanical_failure_code")),
            Feature("fault_electrical_count_window", "sum", zero("is_electrical_failure_code")),
        ],
        KEY, START, END,
    )


def maintenance_window(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Maintenance counts, smallest remaining hours and recency inside each window."""
    return interval_features(
        rows, events,
        [
            Feature("has_maintenance_window", "any"),
            Feature("maintenance_event_count_window", "count"),
            Feature("maintenance_monitor_reset_count_window", "count", when="is_reset"),
            Feature("maintenance_overdue_count_window", "count", when="is_overdue"),
            Feature("maintenance_due_now_count_window", "count", when="is_due_now"),
            Feature("maintenance_min_remaining_hours_window", "min", "remaining_hours"),
            Feature("maintenance_days_since_latest_event_window", "recency", "event_day"),
        ],
        KEY, START, END,
    )


def fluid_window(rows: DataFrame, samples: DataFrame, order: str) -> DataFrame:
    """Sample counts, severities and largest measures inside each window."""
    measures = {
        "fluid_max_cu_ppm_window": "Cu_Copper_PPM",
        "fluid_max_fe_ppm_window": "Fe_Iron_PPM",
        "fluid_max_pb_ppm_window": "Pb_Lead_PPM",
        "fluid_max_soot_percent_window": "Soot_Soot_PERCENT",
        "fluid_max_water_percent_window": "Water_Water_PERCENT",
    }
    out = interval_features(
        rows, samples,
        [
            Feature("has_fluid_window", "any"),
            Feature("fluid_sample_count_window", "count"),
            Feature("fluid_max_severity_window", "max", "severity", fill=0.0),
            # the last sample decides even when its severity is missing
            Feature("__latest", "latest", "struct(severity)", order=order),
            Feature("fluid_days_since_latest_sample_window", "recency", "event_day"),
            *[Feature(n, "max", v, fill=0.0) for n, v in measures.items()],
        ],
        KEY, START, END,
    )
    return out.withColumn(
        "fluid_latest_severity_window", F.coalesce(F.col("__latest.severity"), F.lit(0.0))
    ).drop("__latest")


def operation_window(rows: DataFrame, days: DataFrame, order: str) -> DataFrame:
    """Hours, idle share and meter progress inside each window."""
    hours = "working_hours_clean"
    out = interval_features(
        rows, days,
        [
            Feature("has_operation_window", "any"),
            Feature("operation_day_count_window", "count"),
            Feature("operation_working_hours_sum_window", "sum", hours),
            Feature("operation_working_hours_mean_window", "mean", hours, fill=0.0),
            Feature("operation_working_hours_max_window", "max", hours, fill=0.0),
            Feature("operation_engine_running_hours_sum_window", "sum", "engine_running_hours_clean"),
            Feature("operation_idle_hours_sum_window", "sum", "engine_idling_hours_clean"),
            Feature("operation_high_throttle_day_count_window", "sum", "high_throttle_day_flag"),
            Feature("__first", "first", "struct(smr_hours)", order=order),
            Feature("__last", "latest", "struct(smr_hours)", order=order),
        ],
        KEY, START, END,
    )
    engine = F.col("operation_engine_running_hours_sum_window")
    return out.withColumns(
        {
            "operation_idle_share_window": F.when(
                engine > 0, F.col("operation_idle_hours_sum_window") / engine
            ),
            "operation_latest_smr_window": F.col("__last.smr_hours"),
            "operation_smr_delta_window": F.col("__last.smr_hours") - F.col("__first.smr_hours"),
        }
    ).drop("__first", "__last")


def with_source_totals(df: DataFrame) -> DataFrame:
    """Record count over all sources and whether there is any record."""
    names = ("fault_count_window", "fluid_sample_count_window",
             "maintenance_event_count_window", "operation_day_count_window")
    total = F.lit(0)
    for name in names:
        if name in df.columns:
            total = total + F.coalesce(F.col(name), F.lit(0))
    return df.withColumn("source_record_count_window", total).withColumn(
        "has_any_source_window", (F.col("source_record_count_window") > 0).cast("int")
    )


def frozen_window_features(rows: DataFrame, builders, key: str = KEY, end: str = END) -> DataFrame:
    """Snapshot features for windows: built once per distinct (key, end), joined back.

    ``builders`` are functions from a spine (``model_id``, ``snapshot_date``) to features.
    """
    pairs = rows.select(
        F.col(key).alias("model_id"), F.col(end).alias("snapshot_date")
    ).distinct()
    out = rows
    for build in builders:
        part = build(pairs).withColumnsRenamed({"model_id": key, "snapshot_date": end})
        out = out.join(part, [key, end], "left")
    return out
