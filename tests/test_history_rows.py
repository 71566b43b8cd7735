"""Histories are returned by the sorted scan itself."""

import datetime as dt

from tidemark.operators import source_features as sf



T = dt.date(2023, 6, 1)


def day(n):
    return T + dt.timedelta(days=n)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_history_returns_the_spine_rows(spark):
    spine = spark.createDataFrame(
        [("a", T, 1), ("a", T, 1), ("a", T, 2), ("b", T, 3), (None, T, 4), ("a", None, 5), ("a", day(200), 6)], "model_id string, snapshot_date date, tag int"
    )
    claims = spark.createDataFrame([("a", day(-91)), ("a", day(-90)), ("a", day(-200)), ("a", day(-200)), (None, day(-300)), ("a", None)], "model_id string, event_day date")
    out = sf.claim_basic(spine, claims)
    assert out.columns == ["model_id", "snapshot_date", "tag", "prior_claim_count_before_window", "days_since_prior_claim_before_window"]
    found = sorted((r.tag, *r[3:]) for r in out.collect())
    assert found == [(1, 3, 91), (1, 3, 91), (2, 3, 91), (3, 0, None), (4, 0, None), (5, 0, None), (6, 4, 290)]
    assert "Join" not in plan(out)  # the spine is sorted once and not joined to its own features (F27, F28)
