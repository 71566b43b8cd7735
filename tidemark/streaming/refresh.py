"""The incremental refresh merge for arrivals that come as a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.session import cut_lineage
from tidemark.sources.readers import path_exists
from tidemark.sources.refresh import key_digest, unseen_rows

#: Folders of a history; a key always falls into the same one.
FOLDERS = 256
FOLDER, BATCH = "key_folder", "batch_id"


def known_rows(batch: DataFrame, history: str, batch_id: int) -> DataFrame | None:
    """Stored rows of the folders that the keys of a batch fall into, less those of the batch itself.

    ``batch`` has its rows' folder numbers. Only these folders are listed and read, so a batch costs what its keys
    touch and not the whole history.
    """
    spark = batch.sparkSession
    touched = [r[FOLDER] for r in batch.select(FOLDER).distinct().collect()]  # at most one row a folder
    paths = [p for n in sorted(touched) if path_exists(spark, p := f"{history.rstrip('/')}/{FOLDER}={n}")]
    if not paths:
        return None
    return spark.read.option("basePath", history).parquet(*paths).where(F.col(BATCH) != batch_id)


def refresh_batch(history: str, keys: Sequence[str], folders: int = FOLDERS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds the unseen rows of a batch to a parquet history.

    The history is laid out by key folder and batch. Every batch owns its ``batch_id`` folders and ignores them when
    it looks for known keys, so a batch that is run again after a failure writes the same rows again; rows that
    arrive late or twice meet their key's folder whatever batch wrote it.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        placed = cut_lineage(batch.withColumn(FOLDER, F.pmod(F.xxhash64(key_digest(keys)), F.lit(folders)).cast("int")))
        known = known_rows(placed, history, batch_id)
        fresh = placed if known is None else unseen_rows(known, placed, keys)
        fresh.withColumn(BATCH, F.lit(batch_id).cast("int")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(FOLDER, BATCH).parquet(history)

    return run


def start_refresh(stream: DataFrame, history: str, keys: Sequence[str], checkpoint: str, folders: int = FOLDERS) -> StreamingQuery:
    """Merge everything that has arrived so far and stop; the checkpoint keeps the place."""
    return (
        stream.writeStream.foreachBatch(refresh_batch(history, keys, folders))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
