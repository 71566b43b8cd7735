"""Stage tables leave no shuffled rows behind."""

import os

from pyspark.sql import functions as F

from tidemark import session


def _shuffle_bytes(spark):
    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return sum(
        os.path.getsize(os.path.join(at, name)) for folder in folders for at, _, names in os.walk(folder) for name in names
        if name.startswith("shuffle_") and name.endswith(".data")
    )


def test_shuffles_of_a_stored_table_are_removed(spark):
    before, setting = _shuffle_bytes(spark), spark.conf.get(session._BRIEF)
    rows = spark.range(300000).groupBy((F.col("id") % 200000).alias("k")).agg(F.max(F.md5(F.col("id").cast("string"))).alias("v"))
    kept = session.cut_lineage(rows)
    assert _shuffle_bytes(spark) - before < 100000  # (F8)
    assert kept.count() == kept.distinct().count() == 200000 and spark.conf.get(session._BRIEF) == setting
    # frames that the caller runs keep their shuffled rows and can be run again
    assert len(rows.limit(5).collect()) == 5 and rows.count() == rows.count() == 200000
