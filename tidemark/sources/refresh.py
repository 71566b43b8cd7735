"""Incremental refresh: merge of history and incoming rows, gates and source profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.readers import dated_scan

# Days of history kept per source when scoring; None keeps everything.
HISTORY_DAYS = {
    "fault": 90, "maintenance": 1096, "fluid": None, "operation": None, "target": None,
}


def key_digest(columns: Sequence[str]) -> Column:
    """Composite key as text; a missing part counts as the text ``<NA>``."""
    return F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("<NA>")) for c in columns]))


def unseen_rows(history: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key history lacks; duplicates within incoming are kept."""
    known = history.select(key_digest(keys).alias("__key")).distinct()
    return incoming.withColumn("__key", key_digest(keys)).join(known, "__key", "left_anti").drop("__key")


def merge_refresh(history: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """History with its own duplicates plus incoming rows whose key history lacks.

    Only the distinct keys of history take part in the anti join.
    """
    return history.unionByName(unseen_rows(history, incoming, keys), allowMissingColumns=True)


def retained_history(df: DataFrame, day: str, score_date: str, days: int | None) -> DataFrame:
    """Rows before the score date that are not older than the retention of the source."""
    first = None if days is None else F.date_sub(F.lit(score_date).cast("date"), days)
    return dated_scan(df, day, first, score_date)


def replay_window(df: DataFrame, day: str, score_date: str, days: int) -> DataFrame:
    """The slice ``[score_date - days, score_date)`` used to replay an arrival."""
    return retained_history(df, day, score_date, days)


def replay_manifest(slices: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows and date range of every replayed slice."""
    out = None
    for name, (df, day) in slices.items():
        part = df.agg(
            F.count(F.lit(1)).alias("rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day")
        ).select(F.lit(name).alias("source"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def refresh_gate(
    operation: DataFrame, others: Sequence[DataFrame], key: str, day: str, score_date: str,
    lookback: int = 90,
) -> DataFrame:
    """One row telling whether the history is long and fresh enough and knows all entities."""
    score = F.lit(score_date).cast("date")
    bounds = operation.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    seen = operation.select(key).distinct()
    elsewhere = None
    for df in others:
        part = df.select(key).where(F.col(key).isNotNull())
        elsewhere = part if elsewhere is None else elsewhere.unionByName(part)
    unknown = elsewhere.distinct().join(seen, key, "left_anti").agg(
        F.count(F.lit(1)).alias("entities_missing_in_operation")
    )
    return bounds.join(F.broadcast(unknown)).select(
        "first_day", "last_day", "entities_missing_in_operation",
        (F.col("first_day") <= F.date_sub(score, lookback)).cast("int").alias("history_long_enough"),
        (F.col("last_day") >= F.date_sub(score, 1)).cast("int").alias("history_fresh_enough"),
        (F.col("entities_missing_in_operation") == 0).cast("int").alias("entities_complete"),
    )


def source_profile(sources: Mapping[str, tuple[DataFrame, str]], key: str, target: str) -> DataFrame:
    """Rows, entities, dates per source and how many entities the target source shares."""
    target_keys = sources[target][0].select(F.col(key).alias("__t")).where("__t is not null").distinct()
    out = None
    for name, (df, day) in sources.items():
        per_key = df.groupBy(key).agg(
            F.count(F.lit(1)).alias("__rows"), F.min(day).alias("__first"), F.max(day).alias("__last")
        )
        part = per_key.join(target_keys, F.col(key) == F.col("__t"), "left").agg(
            F.sum("__rows").alias("rows"), F.count(key).alias("entities"),
            F.min("__first").alias("first_day"), F.max("__last").alias("last_day"),
            F.count("__t").alias("entities_shared_with_target"),
        ).select(F.lit(name).alias("source"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def score_date(operation: DataFrame, day: str, override: str | None = None) -> DataFrame:
    """One row: the given score date, else the latest operation day."""
    latest = F.max(F.to_date(F.col(day)))
    value = latest if override is None else F.lit(override).cast("date")
    return operation.agg(value.alias("score_date"))
