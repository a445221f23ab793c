import random

import numpy as np
import pytest

from tests.conftest import rows
from tidewell.operators import lanes, spikes

REG = "sid bigint, meas string, phys_lo double, phys_hi double"


def series(n=400, seed=0, level=50.0):
    rnd = random.Random(seed)
    return [level + rnd.gauss(0, 1) for _ in range(n)]


def found(spark, points, series_by_sid, registry, **kw):
    data = [(sid, i * 10, v, 0, i) for sid, vs in series_by_sid.items() for i, v in enumerate(vs)]
    got = spikes.implausible(points(data), spark.createDataFrame(registry, REG), **kw).collect()
    return {sid: {r.clock // 10: r.reason for r in got if r.sid == sid} for sid in series_by_sid}


@pytest.mark.parametrize("target", [10**6, 90])
def test_planted_cases(spark, points, target):
    one = series()
    for i in (30, 100, 101, 200, 201, 202):
        one[i] += 60  # spikes of one, two and three readings
    one[300:] = [v + 80 for v in one[300:]]  # a lasting change of level
    for i in (240, 241, 242, 243):
        one[i] += 60  # four readings are no spike
    one[150:160] = [one[150]] * 10  # stuck
    one[270:274] = [one[270]] * 4  # too short
    one[50] = 1000.0  # limit
    meter = [abs(v) for v in series(seed=1)]
    meter[100:140] = [0.0] * 40  # at rest
    meter[120] = 90.0  # between two rests
    meter[125:131] = [33.0] * 6  # so is this
    meter[200] = 0.0  # a short rest
    whole = [round(v) + 0.0 for v in series(seed=2)]  # neighbours often agree
    whole[100:108] = [50.0] * 8
    setpoint = [20.0] * 200 + [45.0] * 2 + [20.0] * 198
    got = found(spark, points, {1: one, 2: meter, 3: whole, 4: setpoint, 5: one}, [(1, "gauge", 0.0, 500.0), (2, "meter", 0.0, 500.0), (3, "gauge", None, None), (4, "setpoint", 0.0, 100.0)], target_rows=target)
    assert {i: r for i, r in got[1].items()} == {30: "spike", 100: "spike", 101: "spike", 200: "spike", 201: "spike", 202: "spike", 50: "limit+spike"} | dict.fromkeys(range(150, 160), "stuck")
    assert got[2] == {} and got[3] == {} and got[4] == {} and got[5] == {}


def test_split_equals_whole(spark, points):
    rnd = random.Random(6)
    vs = series(1500, 5)
    for _ in range(40):
        vs[rnd.randrange(1500)] += rnd.choice([-70, 70, 200])
    for _ in range(6):
        i = rnd.randrange(1480)
        vs[i : i + 9] = [vs[i]] * 9
    reg = [(1, "gauge", 0.0, 120.0)]
    a, b = (found(spark, points, {1: vs}, reg, target_rows=t)[1] for t in (10**6, 61))
    assert a == b and len(a) > 60


@pytest.mark.parametrize("rest", [0.0, 0.01])
def test_split_equals_whole_where_noise_changes(spark, points, rest):
    """rest: of the readings at night; like ones are then common in some lanes and rare in the others."""
    rnd = np.random.default_rng(11)
    vs = (50 + rnd.normal(0, 1, 1800) * np.where(np.arange(1800) < 720, 0.01, 1.0)).round(3)
    if rest:
        vs[:720] = (50 + rnd.normal(0, 1, 720)).round(3)  # no quiet part: runs are stuck in both
    for i in range(800, 1800, 90):
        vs[i : i + 7] = vs[i]
    reg = [(1, "gauge", None, None)]
    a, b = (found(spark, points, {1: vs.tolist()}, reg, target_rows=t)[1] for t in (10**6, 250))
    assert a == b and ("stuck" in a.values()) == (rest > 0)


def test_a_plateau_longer_than_the_halo(spark, points):
    """Between two zeros of a meter it is no case, without the zeros it is stuck, wherever lanes are cut."""
    vs = [abs(v) for v in series(3000, 4)]
    vs[200:500] = [0.0] + [33.0] * 298 + [0.0]
    vs[700:1000] = [33.0] * 300
    reg = [(1, "meter", None, None)]
    a, b = (found(spark, points, {1: vs}, reg, target_rows=t)[1] for t in (10**6, 200))
    assert a == b == dict.fromkeys(range(700, 1000), "stuck")


@pytest.mark.parametrize("seed", range(3))
def test_split_stats_are_those_of_the_series(spark, points, seed):
    rnd = np.random.default_rng(seed)
    series = {1: rnd.normal(0, 1, 401 + seed), 2: rnd.integers(0, 3, 402) * 1.0, 3: np.where(rnd.random(400) < 0.1, np.inf, rnd.random(400)), 4: np.zeros(300), 5: rnd.random(300).cumsum()}
    series[5][50:250] = series[5][50]  # a run over several lanes
    df = points([(sid, i, float(v), 0, i) for sid, vs in series.items() for i, v in enumerate(vs)])
    plan = lanes.LanePlan.of(df, 60)
    got = spikes.split_stats(lanes.reading_rows(df, plan), plan).groupBy("sid").agg({"median": "max", "agreement": "max"})
    got = {r.sid: (r["max(median)"], r["max(agreement)"]) for r in got.collect()}
    for sid, v in series.items():
        n = len(v)
        x = lanes.Block(np.zeros(n, int), np.full(n, sid), np.arange(n), v, np.zeros(n, bool), np.full((1, 6), np.nan), np.array([sid]), np.zeros(1, int))
        left, d = spikes.changes(x)
        m = spikes.group_median(x.g, d, 1)
        many, runs = spikes.agreement(x, left, d, np.nan_to_num(m))
        assert got[sid] == (m[0], many[0] / runs[0] if runs[0] else None)


def test_dirty(spark, points):
    inf, nan = float("inf"), float("nan")
    data = [(1, c, 1.0 + c % 3, None, None) for c in range(20)] + [(1, 20, inf, None, 1), (1, 21, nan, None, 1), (1, 22, None, None, 1), (None, 1, 99.0, 0, 1), (1, None, 99.0, 0, 1), (1, 5, 1.0, 0, 7), (1, 5, 1.0, 0, 7)]
    df = points(data).selectExpr("*", "'x' phys_lo", "'y' reason", "0 lane")
    reg = spark.createDataFrame([(1, None, None, 50.0), (1, None, None, 50.0), (None, "meter", 0.0, 1.0)], REG)
    assert rows(spikes.implausible(df, reg), "clock", "reason") == [(20, "limit")]
    assert rows(spikes.implausible(points([]), reg)) == []
    assert rows(spikes.implausible(df, spark.createDataFrame([], REG))) == []


def test_chart_marks_every_planted_spike_and_follows_levels():
    vs = series(1000, 8)
    for i in range(50, 1000, 50):
        vs[i] += 30 * (-1) ** i
    suspect, level = spikes.chart(vs, [True] + [False] * 999, [1.0] * 1000)
    assert all(suspect[i] for i in range(50, 1000, 50))
    assert suspect.mean() < 0.2 and abs(np.median(level[100:]) - 50) < 1
    shifted = [0.0] * 50 + [100.0] * 50
    _, level = spikes.chart([v + 0.1 * (i % 2) for i, v in enumerate(shifted)], [True] + [False] * 99, [0.1] * 100)
    assert abs(level[60] - 100) < 1


def test_median_and_runs():
    g = np.array([0, 0, 0, 1, 1, 2])
    m = spikes.group_median(g, np.array([np.nan, 3.0, 5.0, np.nan, 7.0, np.nan]), 3)
    assert m[:2].tolist() == [4.0, 7.0] and np.isnan(m[2])
    run, n = spikes.run_lengths(np.array([False, True, False, True, True]))
    assert run.tolist() == [0, 0, 1, 1, 1] and n.tolist() == [2, 3]
    assert lanes.group_index(np.array([], int))[1].tolist() == []


def test_a_sound_reading_between_spikes_is_none():
    rnd = random.Random(3)
    vs = np.array([100 + rnd.gauss(0, 1) for _ in range(200)])
    vs[[50, 52]] = 30.0  # two spikes
    vs[[120, 122, 124]] = [190.0, 188.0, 185.0]  # three
    vs[160:163] = [30.0, 31.0, 29.0]
    x = lanes.Block(np.zeros(200, int), np.ones(200, int), np.arange(200), vs, np.zeros(200, bool), np.full((1, 5), np.nan), np.ones(1, int), np.zeros(1, int))
    assert np.flatnonzero(spikes.judge(x, np.ones(1, bool)) & 2).tolist() == [50, 52, 120, 122, 124, 160, 161, 162]
    x.value[:] = np.where(np.isclose(vs, 30.0), np.inf, vs)
    assert {50, 52} <= set(np.flatnonzero(spikes.judge(x, np.ones(1, bool)) & 2).tolist())


@pytest.mark.parametrize("count", [0, 1])
def test_the_chart_decides(spark, points, monkeypatch, count):
    """Without its marks, and with every reading marked, the spikes are gone."""
    vs = series(300, 9)
    for i in (40, 90, 91, 200):
        vs[i] += 60
    reg = [(1, "gauge", None, None)]
    assert set(found(spark, points, {1: vs}, reg)[1]) == {40, 90, 91, 200}

    def none_or_all(b):
        return np.full(len(b.g), count, np.int8), np.zeros(len(b.g))

    x = lanes.Block(np.zeros(300, int), np.ones(300, int), np.arange(300), np.array(vs), np.zeros(300, bool), np.full((1, spikes.SETTINGS), np.nan), np.ones(1, int), np.zeros(1, int))
    assert np.flatnonzero(spikes.judge(x, np.ones(1, bool)) & 2).tolist() == [40, 90, 91, 200]
    monkeypatch.setattr(spikes, "chart", lambda *a: none_or_all(x))
    assert not (spikes.judge(x, np.ones(1, bool)) & 2).any()


def test_chart_of_a_part_equals_that_of_the_whole():
    """From any place on, once it is run in: what a lane and the readings before it give is what the series gives."""
    rnd = np.random.default_rng(3)
    v = np.cumsum(rnd.normal(0, 0.3, 3000)) + rnd.normal(0, 1, 3000)
    v[rnd.integers(0, 3000, 80)] += 40
    v[[700, 1500]] = np.inf
    counter, level = spikes.chart(v, np.arange(3000) == 0, np.ones(3000))
    for cut in (400, 1023, 1024, 1800):
        a = cut - spikes.BEFORE_LANE
        got, at = spikes.chart(v[a:], np.arange(3000 - a) == 0, np.ones(3000 - a), np.arange(a, 3000))
        assert (got[cut - a :] == counter[cut:]).all() and np.array_equal(at[cut - a :], level[cut:], equal_nan=True)


def test_rows_do_not_depend_on_lanes_with_long_series(spark, points):
    rnd = np.random.default_rng(12)
    v = np.cumsum(rnd.normal(0, 0.2, 3000)) + rnd.normal(0, 1, 3000)
    v[rnd.integers(0, 3000, 60)] += 50
    reg = [(1, "gauge", None, None)]
    a, b = (found(spark, points, {1: v.tolist()}, reg, target_rows=t)[1] for t in (10**9, 500))
    assert a == b and len(a) > 40
