import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewell.llm import runs

BOOL = "sid bigint, clock bigint, value boolean, quality int, seq bigint"


def brute(data, pause, key=lambda v: v):
    cur = {}
    for s, c, v, _, q in data:
        if s is not None and c is not None and v is not None and q >= cur.get((s, c), (-1, 0))[0]:
            cur[s, c] = (q, key(v))
    out, run = [], None
    for s, c in sorted(cur):
        v = cur[s, c][1]
        if run and run[0] == s and run[4] == v and c - run[2] <= pause:
            run = (s, run[1], c, run[3] + 1, v)
        else:
            out.append(run)
            run = (s, c, c, 1, v)
    return sorted(r[:4] for r in [*out, run] if r and r[3] > 1)


@pytest.mark.parametrize("target", [10**6, 40, 3])
def test_against_brute_force(spark, points, target):
    rnd = random.Random(target)
    data, c = [], 0
    for i in range(700):
        c += rnd.choice([1, 2, 50])
        data.append((rnd.choice([1, 1, 1, 2]), rnd.choice([c, c - 1]), rnd.choice([True, True, True, False, None]), i % 3, i))
    want = brute(data, 30)
    data += rnd.sample(data, 50)
    got = rows(runs.collapse_runs(points(data, BOOL), pause=30, target_rows=target), "sid", "start_clock", "end_clock", "n_points")
    assert got == want


@pytest.mark.parametrize("target", [10**6, 25])
def test_near_identical_events(spark, points, target):
    rnd = random.Random(1)
    data = [(1, i, rnd.choice([1.01, 0.99, 2.0, 3.04]), 0, i) for i in range(300)]
    got = rows(runs.collapse_runs(points(data), F.round("value", 0), 10**6, target), "sid", "start_clock", "end_clock", "n_points")
    assert got == brute(data, 10**6, lambda v: round(v))


@pytest.mark.parametrize("target", [10**6, 10])
def test_one_long_run_and_dirty_rows(spark, points, target):
    data = [(1, i, True, None, None) for i in range(100)] + [(None, 1, True, 0, 1), (2, None, True, 0, 1), (2, 1, None, 0, 1), (3, 1, True, 0, 1)]
    df = points(data, BOOL).selectExpr("*", "1 event", "2 opens", "3 closes", "'x' lane")
    assert rows(runs.collapse_runs(df, pause=5, target_rows=target), "sid", "start_clock", "end_clock", "n_points", "duration") == [(1, 0, 99, 100, 99)]
    assert rows(runs.collapse_runs(points([], BOOL))) == []


def test_too_many_kinds():
    import numpy as np

    n = runs.LAST_SYMBOL - runs.FIRST_SYMBOL
    with pytest.raises(ValueError):
        runs.symbols(np.zeros(n, int), np.arange(n), np.arange(n), 5)
