"""A sample of the named queries beside their SQL twins, and the shape of the catalogue."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tidemark.plans.catalog import QUERIES
from tools.check import canonical

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "unified_snapshot", "fault_window_frozen", "maintenance_window_frozen", "rolling_fluid_carried", "segment_operation",
    "case_window_operation", "incremental_merge", "column_profile", "rebuilt_spine", "anti_range_windows", "claim_episodes",
    "outcome_history", "matched_controls", "random_ratio_pool", "chosen_anchor", "auc_and_average_precision", "threshold_curve",
    "anchor_precision_bootstrap", "tier_policy", "correlation_prune", "mutual_information",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_twin(spark, db, name):
    mine = queries()[name](spark, FOLDER).toPandas()
    theirs = db.execute(oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert canonical(mine) == canonical(theirs)


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1


def test_catalogue():
    assert set(oracle_sql()) <= set(queries())
    assert all(q.covers for q in QUERIES.values())
