"""Readers and writers: column-pruned scans, aliases, schema checks, sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import timestamp

FORMATS = {"csv": "csv", "gz": "csv", "parquet": "parquet", "json": "json", "orc": "orc"}


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on its Hadoop file system."""
    hadoop, fs = _hadoop_path(spark, path)
    return fs.exists(hadoop)


def first_existing_path(spark: SparkSession, folder: str, names: Sequence[str]) -> str:
    """First of the file names that exists in a folder of any Hadoop file system."""
    for name in names:
        path = f"{folder.rstrip('/')}/{name}"
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {list(names)} exists in {folder}")


def read_any(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Read by file ending; CSV text stays text unless a schema is given."""
    kind = FORMATS.get(path.rstrip("/").rsplit(".", 1)[-1].lower())
    if kind is None:
        raise ValueError(f"no reader for {path}")
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True).option("multiLine", False)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def select_existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the wanted columns that the table has; the scan reads no others."""
    have = set(df.columns)
    return df.select(*[c for c in columns if c in have])


def require_columns(df: DataFrame, required: Sequence[str], optional: Sequence[str] = (),
                    name: str = "table") -> DataFrame:
    """Required and present optional columns; an error names all missing ones."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{name} is missing required columns: {missing}")
    return select_existing(df, [*required, *optional])


def read_snapshot(spark: SparkSession, path: str, day: str) -> DataFrame:
    """A snapshot table whose date column must parse in every row.

    A bad date fails the job when the rows are read; no separate pass is made.
    """
    return parsed_day(read_any(spark, path), day)


def parsed_day(df: DataFrame, day: str) -> DataFrame:
    """The date column as a date; raises on a missing or unreadable one."""
    parsed = F.to_date(timestamp(F.col(day)))
    bad = F.raise_error(F.concat(F.lit(f"{day} has an unreadable date: "), F.coalesce(F.col(day).cast("string"), F.lit("NULL"))))
    return df.withColumn(day, F.when(parsed.isNotNull(), parsed).otherwise(bad.cast("date")))


def dated_scan(df: DataFrame, day: str, first: str | Column | None, last: str | Column) -> DataFrame:
    """Rows with ``first <= day < last`` and the day in canonical form.

    On a typed date or timestamp column the bounds are plain comparisons that reach the
    file scan; text columns are parsed first.
    """
    bound = lambda v: v if isinstance(v, Column) else F.lit(v)
    kind = dict(df.dtypes)[day]
    if kind == "string":
        df = df.withColumn(day, F.to_date(timestamp(F.col(day))))
        kind = "date"
    target = "date" if kind == "date" else kind
    value = F.col(day)
    out = df.where(value < bound(last).cast(target))
    if first is not None:
        out = out.where(value >= bound(first).cast(target))
    return out if kind == "date" else out.withColumn(day, F.to_date(value))


def drop_blank_dates(df: DataFrame, day: str) -> DataFrame:
    """Rows whose date text is not blank."""
    return df.where(F.col(day).isNotNull() & (F.trim(F.col(day).cast("string")) != ""))


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite",
                by: Sequence[str] = (), options: Mapping[str, str] | None = None) -> None:
    """Write in parallel as parquet, orc, json, csv or csv.gz, split by columns if given."""
    writer = df.write.mode(mode).options(**(options or {}))
    if by:
        writer = writer.partitionBy(*by)
    if kind in ("csv", "csv.gz"):
        writer = writer.option("header", True)
        if kind == "csv.gz":
            writer = writer.option("compression", "gzip")
        writer.csv(path)
    else:
        writer.format(kind).save(path)
