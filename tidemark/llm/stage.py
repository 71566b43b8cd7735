"""Tables written between two jobs, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tidemark.session import ensure_checkpoint_dir


def stored(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """``df`` written once below ``spark.checkpoint.dir`` and read back.

    Later passes read the written rows, so they neither repeat the work before nor depend on any
    executor that did it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=partition)
    return spark.read.schema(df.schema).parquet(path)
