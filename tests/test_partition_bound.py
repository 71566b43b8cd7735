"""Shuffled partitions are put together up to a bound."""

from tidemark.session import PARTITION_BYTES, _bytes, measured_joins


def test_partitions_are_put_together_up_to_a_bound(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    assert _bytes("64MB") == 64 << 20 and _bytes("8m") == 8 << 20 and _bytes("67108864b") == 64 << 20 and _bytes("7") == 7
    before = spark.conf.get(name)
    assert _bytes(measured_joins(spark).conf.get(name)) <= PARTITION_BYTES  # (F32)
    small = spark.newSession()
    small.conf.set(name, "1m")
    assert _bytes(measured_joins(small).conf.get(name)) == 1 << 20
    assert spark.conf.get(name) == before
