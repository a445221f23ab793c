import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from tidewell.operators import lanes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=80), st.integers(1, 9), st.integers(1, 30))
def test_blocks_keep_groups_whole(keys, size, least):
    keys = sorted(keys)
    at = pa.RecordBatch.from_pydict({"k": pa.array(keys, pa.int64()), "n": pa.array(range(len(keys)), pa.int64())})
    batches = [at.slice(i, size) for i in range(0, len(keys), size)]
    out = list(lanes.blocks(iter(batches), ("k",), least))
    assert np.concatenate([b["n"] for b in out]).tolist() == list(range(len(keys)))
    ends = [(set(a["k"]), set(b["k"])) for a, b in zip(out, out[1:])]
    assert all(not (a & b) for a, b in ends)


def test_plan_splits_only_long_series(points):
    df = points([(1, i, 1.0, 0, i) for i in range(100)] + [(2, 5, 1.0, 0, 1), (None, 1, 1.0, 0, 1), (3, None, 1.0, 0, 2)])
    plan = lanes.LanePlan.of(df, 30)
    assert plan.heavy == [1] and plan.starts == {1: [0, 25, 50, 75]}
    got = plan.with_lane(lanes.live(df)).groupBy("sid", "lane").count().collect()
    assert {(r.sid, r.lane): r["count"] for r in got} == {(1, 0): 25, (1, 25): 25, (1, 50): 25, (1, 75): 25, (2, 0): 1}
    assert lanes.LanePlan.of(points([]), 30).heavy == []


def test_same_clock_cannot_be_split(points):
    df = points([(1, 7, float(i), 0, i) for i in range(100)])
    plan = lanes.LanePlan.of(df, 10)
    assert len({r.lane for r in plan.with_lane(df).select("lane").collect()}) == 1


def test_crowded_slices_are_cut_again(points):
    clocks = [*range(0, 10**12, 10**10), *range(5 * 10**11 + 7, 5 * 10**11 + 907)]  # nine tenths within 900 ticks
    df = points([(1, c, 1.0, 0, i) for i, c in enumerate(clocks)] + [(2, 1, 1.0, 0, 1)])
    plan = lanes.LanePlan.of(df, 50)
    got = plan.with_lane(df).groupBy("sid", "lane").agg({"clock": "min", "*": "count"}).orderBy("lane").collect()
    one = [r for r in got if r.sid == 1]
    assert max(r["count(1)"] for r in one) <= 100 and len(one) < 60
    firsts = [r["min(clock)"] for r in one]
    assert firsts == sorted(firsts) and {r.lane for r in one} <= set(plan.starts[1]) and len(set(plan.starts[1])) == len(plan.starts[1])
    assert plan.every_lane(df.select("sid").distinct()).count() == len(plan.starts[1]) + 1


def test_extreme_clocks(points):
    df = points([(1, c, 1.0, 0, i) for i, c in enumerate([-(2**62), 2**62 + 5, 2**63 - 1, *range(40)])])
    plan = lanes.LanePlan.of(df, 10)
    assert plan.with_lane(df).groupBy("lane").count().agg({"count": "max"}).first()[0] <= 20


@pytest.mark.parametrize("k", [1, 3])
def test_edges_reach_over_empty_lanes(points, k):
    clocks = [*range(0, 20), *range(500, 520)]  # the lanes between hold nothing
    df = points([(1, c, float(c), 0, c) for c in clocks])
    plan = lanes.LanePlan.of(df, 5)
    got = rows(lanes.lane_edges(lanes.reading_rows(df, plan), plan, k), "lane", "clock")
    where = {c: r.lane for r in plan.with_lane(df).collect() for c in [r.clock]}
    want = set()
    for lane in plan.starts[1]:
        before = [c for c in clocks if where[c] < lane]
        after = [c for c in clocks if where[c] > lane]
        want |= {(lane, c) for c in before[-k:] + after[:k]}
    assert set(got) == want


def test_clashing_columns_are_ignored(points, spark):
    df = points([(1, c, 1.0, 0, c) for c in range(50)]).selectExpr("*", "'x' lane", "1 _lo", "2 _width", "3 _lanes", "4 tag")
    plan = lanes.LanePlan.of(df, 10)
    assert lanes.reading_rows(df, plan).count() == 50
