import random

import pytest

from tests.conftest import rows
from tidewell.operators import rolling

DAY = rolling.DAY_TICKS
REG = "sid bigint, meas string, phys_lo double, phys_hi double"


def brute(data, limits):
    cur = {}
    for sid, clock, value, _, seq in data:
        if sid in limits and clock is not None and value is not None and value == value and (cur.get((sid, clock), (-1,))[0] <= seq):
            cur[sid, clock] = (seq, value)
    daily = {}
    for (sid, clock), (_, v) in cur.items():
        lo, hi = limits[sid]
        if lo <= v <= hi:
            t, n = daily.get((sid, clock // DAY), (0.0, 0))
            daily[sid, clock // DAY] = (t + v, n + 1)
    out = {}
    for sid in limits:
        days = [d for s, d in daily if s == sid]
        for d in range(min(days), max(days) + 1) if days else ():
            out[sid, d] = tuple(sum(daily.get((sid, x), (0, 0))[0] for x in range(d - p + 1, d + 1)) for p in (7, 30)) + (sum((sid, x) in daily for x in range(d - 29, d + 1)),)
    return out


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_against_brute_force(spark, points, broadcast_rows):
    rnd = random.Random(2)
    data = [(rnd.choice([1, 2, 3, None]), rnd.randint(0, 70) * DAY + rnd.randint(0, 3), rnd.choice([1.0, 5.0, 200.0, -3.0, None, float("nan"), float("inf")]), 0, i) for i in range(400)]
    reg = spark.createDataFrame([(1, "meter", 0.0, 100.0), (1, "meter", 0.0, 100.0), (2, "meter", 0.0, 300.0), (3, "gauge", 0.0, 100.0), (4, "meter", None, 5.0), (None, "meter", 0.0, 1.0)], REG)
    limits = rolling.meter_limits(reg)
    got = rolling.rolling_totals(rolling.daily_totals(points(data), limits, broadcast_rows)).collect()
    want = brute(data, {1: (0, 100), 2: (0, 300)})
    assert {(r.sid, r.day_no) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        a, b, n = want[r.sid, r.day_no]
        assert abs(r.total_7 - a) < 1e-9 and abs(r.total_30 - b) < 1e-9 and r.days_30 == n
        assert abs(r.avg_7 - a / 7) < 1e-9 and abs(r.avg_30 - b / 30) < 1e-9
    found = {(r.sid, r.day_no) for r in rolling.rising_days(points(data), reg, least_days=5, broadcast_rows=broadcast_rows).collect()}
    assert found == {k for k, (a, b, n) in want.items() if a / 7 > 2 * b / 30 and n >= 5}


def test_empty_and_clashing(spark, points):
    reg = spark.createDataFrame([(1, "meter", 0.0, 10.0)], REG)
    assert rows(rolling.rising_days(points([]), reg)) == []
    df = points([(1, DAY * 3, 4.0, None, None), (1, DAY * 5, 4.0, None, None)]).selectExpr("*", "1 phys_lo", "2 lo", "3 n", "4 total", "5 _salt")
    got = rows(rolling.rolling_totals(rolling.daily_totals(df, rolling.meter_limits(reg))), "sid", "day_no", "total_7")
    assert got == [(1, 3, 4.0), (1, 4, 4.0), (1, 5, 8.0)]
