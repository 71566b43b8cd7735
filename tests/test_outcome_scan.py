"""Outcomes come from one sorted scan."""

import datetime as dt
import random

from tidemark.operators import labels as lb



T = dt.date(2023, 6, 1)


def day(n):
    return T + dt.timedelta(days=n)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_outcomes_of_one_scan(spark):
    draw = random.Random(5)
    events = sorted({(k, day(draw.randrange(-400, 200))) for k in ("a", "b") for _ in range(40)})
    periods = [(k, day(n), n) for k in ("a", "b", "c") for n in (-400, -30, 0, 0, 1, 29, 90, 199)]
    days = spark.createDataFrame([*events, (None, T), ("a", None)], "machine_key string, event_day date")
    rows = spark.createDataFrame([*periods, (None, T, 7), ("a", None, 8)], "machine_key string, period_end date, tag int")
    out = lb.outcome_history(rows, days)
    assert plan(out).count("Join") == 1  # only the one row with the last day (F35)
    found, end = sorted(out.collect(), key=lambda r: str((r[0], r[1], r[2]))), max(d for _, d in events)
    assert len(found) == len(periods) + 2
    for r in found:
        if r.machine_key is None or r.period_end is None:
            assert r.prior_claim_count_30d is None and r.target_90d is None and r.next_target_event_date is None
            continue
        age = [(r.period_end - d).days for k, d in events if k == r.machine_key]
        for n in (30, 90, 180, 365):
            assert r[f"prior_claim_count_{n}d"] == sum(0 <= x < n for x in age)
        assert r.prior_claim_count_ever == sum(x >= 0 for x in age)
        assert r.days_since_prior_claim == min((x for x in age if x >= 0), default=None)
        assert r.target_claim_count_90d == sum(-90 <= x < 0 for x in age)
        after = max((x for x in age if x < 0), default=None)
        follows = None if after is None else r.period_end - dt.timedelta(days=after)
        assert r.next_target_event_date == follows
        assert r.target_first_claim_date_90d == (follows if after is not None and after >= -90 else None)
        assert r.label_complete_90d == int(r.period_end + dt.timedelta(days=90) <= end)
