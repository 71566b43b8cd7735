"""Bounded rounds of the exclusive pool are played in one task."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cohorts as ch

BASE = dt.date(2020, 1, 1)


def day(offset):
    return BASE + dt.timedelta(days=offset)


@pytest.fixture(scope="module")
def pool(spark):
    model = lambda i: "AB"[i % 2]
    master = spark.createDataFrame(
        [(f"m{i}", model(i), "test", day(0), day(900)) for i in range(90)], "machine_key string, full_model string, split string, first_source_date date, last_source_date date"
    )
    claims = spark.createDataFrame([(f"m{i}", day(500 + i % 50)) for i in range(0, 90, 2)] + [("m1", day(505)), ("m3", None)], "machine_key string, claim_date date")
    cases = spark.createDataFrame(
        [(f"g{i}", f"m{i}", model(i), "test", day(430 + i % 50), day(480 + i % 50)) for i in range(60)] + [(None, "m70", "A", "test", day(430), day(480))],
        "case_control_group_id string, machine_key string, full_model string, split string, window_start date, window_end date",
    )
    end = spark.createDataFrame([(day(900),)], "label_end date")
    return lambda **more: ch.controlled_ratio_pool(cases, master, claims, end, 2, **more)


def test_one_task_plays_the_same_rounds(pool, monkeypatch):
    near, far = [], []
    got = sorted(tuple(r) for r in pool(rounds=near).collect())
    monkeypatch.setattr(ch, "LOCAL_ROWS", -1)
    assert got and got == sorted(tuple(r) for r in pool(rounds=far).collect())
    assert near == far and near[-1] == 0 and len(near) > 2


def test_short_blocks_and_small_arrays_change_nothing(pool, monkeypatch):
    got = sorted(tuple(r) for r in pool().collect())
    monkeypatch.setattr(ch, "LOCAL_CELLS", 8)
    assert got == sorted(tuple(r) for r in pool().collect())


def test_small_pools_store_few_tables(pool, monkeypatch):
    stored, plain = [], ch.cut_lineage
    monkeypatch.setattr(ch, "cut_lineage", lambda df: stored.append(df.columns) or plain(df))
    assert pool().agg(F.count("target")).first()[0] > 0
    assert len(stored) <= 6  # (F4)
