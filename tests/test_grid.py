import random

import pytest

from tests.conftest import rows
from tidewell.operators import grid

INF, NAN = float("inf"), float("nan")


def registry(spark, steps):
    return spark.createDataFrame([(s, t) for s, t in steps], "sid bigint, step_ticks bigint")


def brute(data, steps, limit):
    cur = {}
    for sid, clock, value, _, seq in data:
        if sid is None or clock is None or value is None or value != value:
            continue
        if (sid, clock) not in cur or seq >= cur[sid, clock]:
            cur[sid, clock] = seq
    out = set()
    for sid, step in steps.items():
        slots = sorted({c - c % step for s, c in cur if s == sid})
        for a, b in zip(slots, slots[1:]):
            if b - a <= limit:
                out |= {(sid, x) for x in range(a + step, b, step)}
    return out


@pytest.mark.parametrize("target", [10**6, 20])
def test_empty_slots_against_brute_force(spark, points, target):
    rnd = random.Random(4)
    data = [(rnd.choice([1, 1, 1, 2, 3]), rnd.randint(0, 3000), rnd.choice([1.0, 2.5, NAN, None, INF]), 0, i) for i in range(250)]
    got = rows(grid.empty_slots(points(data), registry(spark, [(1, 10), (1, 10), (2, 7), (9, 5), (3, None)]), gap_limit=200, target_rows=target))
    assert len(got) == len(set(got)) and set(got) == brute(data, {1: 10, 2: 7}, 200)


def test_values_and_states(spark, points):
    data = [(1, 5, 10.0, 0, 1), (1, 35, 40.0, 0, 2), (1, 35, 30.0, 0, 1), (1, 200, 7.0, 0, 3)]
    got = rows(grid.regular_grid(points(data), registry(spark, [(1, 10)]), gap_limit=100))
    assert got == sorted([(1, 0, 1, 10.0, "reading"), (1, 10, 1, 15.0, "filled"), (1, 20, 1, 25.0, "filled"), (1, 30, 1, 35.0, "reading"), (1, 40, 16, None, "silence"), (1, 200, 1, 7.0, "reading")])


def test_split_grid_equals_whole(spark, points):
    rnd = random.Random(9)
    data = [(rnd.choice([1, 1, 2]), rnd.randint(0, 5000), round(rnd.gauss(0, 5), 3), 0, i) for i in range(300)]
    reg = registry(spark, [(1, 13), (2, 9)])
    a, b = (rows(grid.regular_grid(points(data), reg, gap_limit=60, target_rows=t)) for t in (10**6, 15))
    assert [r[:3] + r[4:] for r in a] == [r[:3] + r[4:] for r in b]
    assert all((x[3] is None) == (y[3] is None) and (x[3] is None or abs(x[3] - y[3]) < 1e-9) for x, y in zip(a, b))


def test_dirty_rows(spark, points):
    data = [(None, 1, 1.0, 0, 1), (1, None, 1.0, 0, 1), (1, 4, None, None, 1), (1, 4, NAN, 0, 9), (1, 3, INF, None, None), (1, 33, 1.0, None, 2), (1, 33, 1.0, None, 2)]
    df = points(data).selectExpr("*", "'a' step_ticks", "1 lane", "'b' state")
    got = rows(grid.regular_grid(df, registry(spark, [(1, 10), (None, 5), (2, 0)])))
    assert [r[1:] for r in got] == [(0, 1, INF, "reading"), (10, 1, None, "filled"), (20, 1, None, "filled"), (30, 1, 1.0, "reading")]
    assert rows(grid.regular_grid(points([]), registry(spark, [(1, 10)]))) == []
    assert rows(grid.regular_grid(points(data), registry(spark, []))) == []
