"""Permutation importance and ranking sums beside plain Python."""

from hashlib import md5

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics as m
from tidemark.operators import modeling as ml


def test_values_move_in_hash_order(spark, monkeypatch):
    monkeypatch.setattr(ml, "SHUFFLE_RANGE", 16)
    monkeypatch.setattr(ml, "SHUFFLE_BLOCK", 7)
    rows = [(f"k{i:03d}", i, None if i == 5 else i * 0.5, i % 2) for i in range(100)]
    text = F.concat("k", F.lit("|"), F.col("n").cast("string"), F.lit("|"))
    placed = spark.createDataFrame(rows, "k string, n int, x double, y int").select("x", "y", F.col("n").cast("long").alias("__row"), text.alias("__text")).repartition(3)
    got = {}
    for r in ml._shuffled(placed, 100, ["x", "y"], "x", 3, 7).collect():
        got.setdefault(r["__turn"], []).append((r["y"], r["x"]))
    for turn in range(3):
        order = sorted(rows, key=lambda r: md5(f"7|x|{turn}|{r[0]}|{r[1]}|".encode()).hexdigest()[:16])
        expected = sorted((row[3], -1.0 if value[2] is None else value[2]) for row, value in zip(rows, order))
        assert sorted((y, -1.0 if x != x else x) for y, x in got[turn]) == expected


def test_rows_are_numbered_once_for_all_features(spark, monkeypatch):
    rows = spark.range(400).select("id", ((F.col("id") * 7919) % 100 / 100).alias("x"), ((F.col("id") * 104729) % 97 / 97).alias("z")).withColumn("y", (F.col("x") > 0.7).cast("int"))
    model, scans, plain = ml.fit(rows, ["x", "z"], "y"), [], ml.ordered_scan
    monkeypatch.setattr(ml, "ordered_scan", lambda *a, **k: scans.append(a) or plain(*a, **k))
    drops = {r["feature"]: r for r in ml.permutation_importance(model, rows, ["x", "z"], "y", ["id"], repeats=3).collect()}
    assert len(scans) == 1  # (F3)
    assert drops["x"]["importance_mean"] > drops["z"]["importance_mean"] + 0.1
    empty = ml.permutation_importance(model, rows.where("id < 0"), ["x", "z"], "y", ["id"], repeats=3).collect()
    assert [r["importance_mean"] for r in empty] == [None, None]


def test_ranking_sums_over_many_pieces(spark):
    rows = [(None if g == 2 else f"g{g}", (i * 37 % 50) / 7, i * g % 3 == 0) for g in range(1, 4) for i in range(120)] + [("one", 0.5, True)]
    df = spark.createDataFrame(rows, "g string, s double, y boolean").withColumn("y", F.col("y").cast("int"))
    small = spark.newSession()
    small.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    again = small.createDataFrame(rows, "g string, s double, y boolean").withColumn("y", F.col("y").cast("int"))
    for frame in (df, again):
        for r in m.auc_ap(frame, ["g"], "s", "y").collect():
            mine = [(s, y) for g, s, y in rows if g == r["g"]]
            pos, neg = [s for s, y in mine if y], [s for s, y in mine if not y]
            assert (r["rows"], r["positive_count"]) == (len(mine), len(pos))
            if not neg:
                assert r["roc_auc"] is None and r["average_precision"] is None
                continue
            assert r["roc_auc"] == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))
            parts = [sum(q >= p for q in pos) / sum(s >= p for s, _ in mine) for p in pos]
            assert r["average_precision"] == pytest.approx(sum(parts) / len(pos))
    assert m.auc_ap(df.where("s < 0"), [], "s", "y").first()["roc_auc"] is None
