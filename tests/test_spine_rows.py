"""Spines with columns come from rows that hold until the next one."""

import datetime as dt
import random

import pytest

from tidemark.operators.spine import rebuild_spine



T = dt.date(2023, 6, 1)


def day(n):
    return T + dt.timedelta(days=n)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("columns", [["x"], ["x", "y"]])
@pytest.mark.parametrize("scope, anchor", [("per_key", None), ("global", None), ("per_key", "2023-05-20"), ("global", "2023-06-25"), ("per_key", "2024-01-01")])
def test_spine_rows_hold_until_the_next(spark, scope, anchor, columns):
    draw = random.Random(3)
    rows = [(k, day(draw.randrange(90)), draw.choice([None, *range(9)]), draw.randrange(3)) for k in ("a", "b", None) for _ in range(9)]
    rows += [("c", day(4), 1, 1), ("c", None, 7, 7), ("d", None, 1, 1), rows[0]]
    backbone = spark.createDataFrame(rows, "k string, at date, x int, y int")
    out = rebuild_spine(backbone, "k", "at", 7, scope, anchor, columns)
    origin, expected = min(r[1] for r in rows if r[1]), []
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key and r[1]), key=lambda r: r[1])
        if not mine:
            continue
        first, last = mine[0][1], mine[-1][1]
        begin = dt.date.fromisoformat(anchor) if anchor else origin if scope == "global" else first
        while begin < first:
            begin += dt.timedelta(days=7)
        while begin <= last:
            upto = [r for r in mine if r[1] <= begin]
            best = max((r for r in upto if r[1] == upto[-1][1]), key=lambda r: (-1 if r[2] is None else r[2], r[3]))
            expected.append((key, begin, *([None] * len(columns) if key is None else best[2 : 2 + len(columns)])))
            begin += dt.timedelta(days=7)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(expected, key=str)
    if scope == "per_key":
        assert "Join" not in plan(out)  # calendar days are never shuffled (F24)
