"""Light cleaning and column profiles of raw tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import NULL_LIKE, null_like_to_null
from tidemark.operators.ordering import first_per_group


def unique_column_names(columns: Sequence[object]) -> list[str]:
    """Trimmed names; repeats get ``_duplicate_2`` and so on."""
    seen: dict[str, int] = {}
    out = []
    for column in columns:
        name = str(column).strip() or "unnamed_column"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_duplicate_{seen[name]}")
    return out


def _text_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t == "string"]


def blank_to_null(df: DataFrame) -> DataFrame:
    """Clean column names, trim text, and turn null-like text into NULL."""
    named = df.toDF(*unique_column_names(df.columns))
    return named.withColumns({c: null_like_to_null(F.col(f"`{c}`")) for c in _text_columns(named)})


def empty_columns(df: DataFrame) -> list[str]:
    """Columns without any value: one aggregate pass over the table."""
    found = df.agg(*[F.max(F.col(f"`{c}`").isNotNull()).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return [c for c, any_value in zip(df.columns, found) if not any_value]


def clean(df: DataFrame) -> DataFrame:
    """Null-like text to NULL, then columns and rows without any value dropped."""
    named = blank_to_null(df)
    return named.drop(*empty_columns(named)).dropna(how="all")


def profile(df: DataFrame, name: str, stage: str, examples: int = 3) -> DataFrame:
    """Per column: type, rows, missing, blank-like text, distinct values and examples.

    One pass counts everything but the distinct values, which are counted exactly over
    (column, value) pairs reduced in the map tasks. ``example_values`` are the ``examples`` smallest values as
    text; every task keeps no more of a column than those.
    """
    types = dict(df.dtypes)
    entry = lambda c: F.struct(
        F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"),
        F.col(f"`{c}`").cast("string").alias("value"),
        F.lit(types[c] == "string").alias("is_text"),
    )
    long = df.select(F.explode(F.array(*[entry(c) for c in df.columns])).alias("e")).select("e.*")
    values = long.groupBy("column", "dtype", "is_text", "value").agg(F.count(F.lit(1)).alias("n"))
    blank = F.col("is_text") & F.lower(F.trim("value")).isin(*NULL_LIKE)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    known = F.col("value").isNotNull()
    out = values.groupBy("column", "dtype").agg(
        F.sum("n").alias("row_count"),
        total(~known).alias("missing_count"),
        total(F.coalesce(blank, F.lit(False))).alias("blank_or_null_string_count"),
        total(known).alias("non_missing_count"),
        F.count(F.when(known, 1)).alias("unique_non_missing_count"),
        F.min("value").alias("smallest_value"),
        F.max("value").alias("largest_value"),
    )
    shown = first_per_group(values.where(known).select("column", "value"), ["column"], [F.col("value").asc()], max(examples, 1))
    shown = shown.groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("value")), " | ").alias("example_values"))
    out = out.join(shown, "column", "left").withColumn("example_values", F.coalesce("example_values", F.lit("")) if examples else F.lit(""))
    return out.select(
        F.lit(name).alias("dataset"), F.lit(stage).alias("stage"), "*",
        F.round(F.col("missing_count") / F.col("row_count") * 100, 4).alias("missing_pct"),
    )


def cleaning_summary(df: DataFrame, name: str) -> DataFrame:
    """One row: rows, columns and missing cells before and after light cleaning."""
    cleaned = blank_to_null(df)
    before = df.toDF(*cleaned.columns)
    raw = {c: F.count(F.when(before[f"`{c}`"].isNull(), 1)) for c in before.columns}
    width = len(cleaned.columns)
    row_empty = F.lit(True)
    for c in cleaned.columns:
        row_empty = row_empty & F.col(f"`{c}`").isNull()
    first = before.agg(
        F.count(F.lit(1)).alias("rows_before"),
        sum(raw.values(), F.lit(0)).alias("missing_cells_raw"),
    )
    second = cleaned.agg(
        F.count(F.when(~row_empty, 1)).alias("rows_after"),
        sum((F.max(F.col(f"`{c}`").isNotNull()).cast("int") for c in cleaned.columns), F.lit(0)).alias("__kept"),
        # cells of dropped columns and rows are not counted
        sum((F.count(F.when(~row_empty & F.col(f"`{c}`").isNull(), 1)) *
             F.max(F.col(f"`{c}`").isNotNull()).cast("int") for c in cleaned.columns), F.lit(0)).alias("missing_cells_cleaned"),
    )
    return first.join(F.broadcast(second)).select(
        F.lit(name).alias("dataset"), "rows_before", "rows_after",
        (F.col("rows_before") - F.col("rows_after")).alias("rows_dropped"),
        F.lit(width).alias("columns_before"), F.col("__kept").alias("columns_after"),
        (F.lit(width) - F.col("__kept")).alias("columns_dropped"),
        "missing_cells_raw", "missing_cells_cleaned",
    )
