"""Session settings, table loading and lineage cuts."""

from __future__ import annotations

import re
import tempfile
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # stage tables are removed once nothing refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    app: str = "tidemark",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **settings: str,
) -> SparkSession:
    """A session with UTC time, adaptive execution and skew-join splitting on.

    Leave ``master`` and ``shuffle_partitions`` unset on a cluster: both then come
    from the submit command, and adaptive execution coalesces small partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SESSION_SETTINGS, **settings}.items():
        builder = builder.config(name, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


#: Shuffled bytes, as compressed, up to which adaptive execution puts partitions together.
PARTITION_BYTES = 16 << 20


def _bytes(size: str) -> int:
    """Bytes of a Spark size such as ``64MB``, ``8m`` or ``67108864b``."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << (10 * " kmgtp".index(unit or " "))


def _beside(spark: SparkSession) -> SparkSession:
    """A new session with the settings of ``spark``."""
    session = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if session.conf.get(name, None) != value and spark.conf.isModifiable(name):
            session.conf.set(name, value)
    return session


def brief_shuffles(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` with its settings, where shuffled rows are removed when the job that wrote them ends.

    Otherwise they stay on disk until the driver happens to collect their handles. For operators that store
    the result of every step; the caller's session keeps its setting.
    """
    session = _beside(spark)
    session.conf.set(_BRIEF, "true")
    return session


_BRIEF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PLANNING = Lock()


def _briefly(df: DataFrame) -> DataFrame:
    """The same rows, planned so that the shuffled rows of its job are removed when that job ends."""
    conf = df.sparkSession.conf
    with _PLANNING:
        before = conf.get(_BRIEF)
        conf.set(_BRIEF, "true")
        try:
            # the setting counts when a plan is made, so that other plans of the session keep theirs
            return df.select("*")
        finally:
            conf.set(_BRIEF, before)


def measured_joins(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` with its settings, where joins broadcast by measured sizes only.

    Estimates come from compressed files and do not know what an explode makes of a row: the dates of a spine,
    guessed at a few MB, were 2 GB in one broadcast. Adaptive execution measures a side before it broadcasts it.
    The caller's session keeps its settings; a threshold that the caller switched off stays off.
    Shuffled partitions are put together up to ``PARTITION_BYTES`` only: sorted calendars compress some 20 to 40 times,
    so that Spark's 64 MB are gigabytes in one task.
    """
    session, own = _beside(spark), "spark.sql.autoBroadcastJoinThreshold"
    if spark.conf.get("spark.sql.adaptive.enabled") == "true":
        measured = "spark.sql.adaptive.autoBroadcastJoinThreshold"
        session.conf.set(measured, spark.conf.get(measured, None) or spark.conf.get(own))
        session.conf.set(own, "-1")
        advised = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
        if _bytes(spark.conf.get(advised)) > PARTITION_BYTES:
            session.conf.set(advised, str(PARTITION_BYTES))
    return session


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session: the one that ``spark.checkpoint.dir`` names.

    In local mode, as in tests, a temporary folder is set where none is named. On a cluster that would
    be a folder that executors do not share, so it fails there.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return the stored copy.

    Used where two later passes must see exactly the same rows and row placement,
    and in loops whose plan would otherwise grow with every turn. The stored copy
    survives the loss of executors, and the shuffled rows that it was made from are removed.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return _briefly(df).checkpoint(eager=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
