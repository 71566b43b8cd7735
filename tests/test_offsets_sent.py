"""Offsets of few groups are sent to the rows."""

from pyspark.sql import functions as F

from tidemark.operators import screening as sc


def test_ranked_bins_send_their_offsets_to_the_rows(spark, monkeypatch):
    rows = spark.range(200).selectExpr("id", "id % 30 as x", "id % 2 as y")
    hints, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: hints.append(df.columns) or broadcast(df))
    sc.mutual_information(rows, ["x"], "y", ["id"]).collect()
    assert any("__p___offset" in c for c in hints)  # (F34)
