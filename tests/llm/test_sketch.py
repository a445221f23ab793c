import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from tidewell.llm import sketch
from tidewell.operators import lanes


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=50))
def test_codes_keep_order(values):
    v = np.array(sorted(values))
    code = sketch.encode(v)
    assert (np.diff(code.astype(np.int64)) >= 0).all()
    back = sketch.decode(code)
    ok = np.isfinite(v) & (np.abs(v) > 1e-300)
    assert np.allclose(back[ok], v[ok], rtol=2**-23)
    assert (back[v == np.inf] == np.inf).all()


def rank_error(values, p, got):
    v = np.sort(values)
    near = abs(got) * 1e-6 + 1e-12
    lo, hi = np.searchsorted(v, got - near, "left"), np.searchsorted(v, got + near, "right")
    want = p / 100 * len(v)
    return max(0, lo - want, want - hi) / len(v)


@pytest.mark.parametrize("n", [1, 7, 70, 900, 8500, 300_000])
def test_rank_error_is_bounded(n):
    rng = np.random.default_rng(n)
    for values in (np.round(rng.normal(50, 10, n), 3), rng.lognormal(0, 3, n), np.round(rng.normal(0, 2, n))):
        s = sketch.DyadicSketch().update(values)
        for p, q in zip((1, 50, 90, 99), s.percentiles((1, 50, 90, 99)), strict=True):
            assert rank_error(values, p, q) <= max(0.002, 1.01 / n)


def test_merge_fold_delete_and_bytes():
    rng = np.random.default_rng(1)
    days = [np.round(rng.normal(i, 5, 2000), 3) for i in range(5)]
    whole = sketch.DyadicSketch(12).update(np.concatenate(days))
    parts = [sketch.DyadicSketch(12).update(d) for d in days]
    total = parts[0]
    for p in parts[1:]:
        total = total.merge(p)
    assert (total.cells == whole.cells).all() and (total.top == whole.top).all()
    again = sketch.DyadicSketch.from_bytes(total.to_bytes())
    assert (again.cells == total.cells).all() and (again.top == total.top).all()
    less = whole.update(days[4], -1)
    four = sketch.DyadicSketch(12).update(np.concatenate(days[:4]))
    assert (less.cells == four.cells).all() and less.n == 8000
    narrow = sketch.DyadicSketch(10).update(days[0])
    assert (parts[0].fold(10).cells == narrow.cells).all()
    assert (parts[0].merge(narrow).cells == 2 * narrow.cells).all()
    assert np.isnan(sketch.DyadicSketch(6).percentiles((50,))).all()
    assert sketch.DyadicSketch(6).update(np.array([np.nan, 3.0])).n == 1


def test_block_equals_single_sketches():
    rng = np.random.default_rng(2)
    g = np.repeat(np.arange(4), [5, 100, 3000, 1])
    v = np.round(rng.normal(0, 100, len(g)), 2)
    got = sketch.block_percentiles(g, v, 4, (50, 99))
    for i in range(4):
        for p, q in zip((50, 99), got[i], strict=True):
            assert rank_error(v[g == i], p, q) <= max(0.002, 1.01 / (g == i).sum())


@pytest.mark.parametrize("target", [10**6, 150])
def test_percentiles_of_dirty_points(spark, points, target):
    rnd = random.Random(3)
    data = [(rnd.choice([1, 1, 1, 2, None]), rnd.choice([rnd.randint(0, 10**6), None]), rnd.choice([round(rnd.gauss(0, 9), 2), None, float("nan"), float("inf"), -float("inf")]), None, i) for i in range(2500)]
    data += data[:100] + [(7, 1, 5.0, None, None), (7, 1, 5.0, None, None), (8, 1, None, 0, 1)]
    cur = {}
    for s, c, v, _, q in data:
        if s is not None and c is not None and v is not None and v == v and (q or 0) >= cur.get((s, c), (-1, 0))[0]:
            cur[s, c] = (q or 0, v)
    df = points(data).selectExpr("*", "'x' pct", "'y' sketch", "0 lane")
    got = {(r.sid, r.pct): r.value for r in sketch.percentiles(df, (50, 90, 99), target).collect()}
    assert {s for s, _ in got} == {1, 2, 7}
    for (s, p), q in got.items():
        values = np.array([v for (a, _), (_, v) in cur.items() if a == s])
        finite = np.clip(values, -1e300, 1e300)
        assert rank_error(finite, p, np.clip(q, -1e300, 1e300)) <= max(0.003, 1.01 / len(values))
    assert rows(sketch.percentiles(points([]))) == []


def test_days_merge_to_the_whole(spark, points):
    rnd = random.Random(5)
    day = 864_000_000_000
    data = [(s, d * day + rnd.randint(0, day - 1), round(rnd.gauss(s, 4), 3), 0, i) for i, (s, d) in enumerate((s, d) for s in (1, 2) for d in range(6) for _ in range(200))]
    kept = sketch.daily_sketches(points(data), width_bits=12)
    assert kept.count() == 12
    got = {(r.sid, r.pct): r.value for r in sketch.merge_daily(kept).collect()}
    for (s, p), q in got.items():
        assert rank_error(np.array([v for a, _, v, _, _ in data if a == s]), p, q) <= 0.003


def test_limits(spark, points):
    reg = spark.createDataFrame([(1, 4.0, None, float("nan")), (1, 4.0, None, float("nan")), (2, 9.0, 1.0, 1.0), (None, 0.0, 0.0, 0.0)], "sid bigint, p50_limit double, p90_limit double, p99_limit double")
    df = points([(s, i, float(i % 11), 0, i) for s in (1, 2, 3) for i in range(110)])
    assert rows(sketch.above_limit(df, reg)) == [(1, 50), (2, 90), (2, 99)]


def test_blocks_of_lanes_do_not_matter(spark, points, monkeypatch):
    df = points([(s, i, float((i * s) % 97), 0, i) for s in range(1, 9) for i in range(100)])
    a = rows(sketch.percentiles(df))
    monkeypatch.setattr(lanes, "BLOCK_ROWS", 150)
    assert rows(sketch.percentiles(df)) == a


def test_many_tiny_series_need_little_memory():
    import tracemalloc

    g = np.arange(60_000)
    v = np.random.default_rng(0).normal(size=60_000)
    tracemalloc.start()
    got = sketch.block_percentiles(g, v, 60_000, (50, 99))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    right = np.isclose(got, v[:, None], rtol=2**-23)
    assert right.mean() > 0.999 and peak < 150e6


@pytest.mark.parametrize("target", [10**6, 150])
def test_days_at_the_default_width(spark, points, target):
    """Small days are kept as counted codes, a large one as cells, and a long series in several rows a day."""
    rng = np.random.default_rng(8)
    day = sketch.DAY_TICKS
    data = [(s, d * day + int(c), float(v), 0, i) for s in (1, 2) for d in range(4) for i, (c, v) in enumerate(zip(rng.choice(day, 150, replace=False), np.round(rng.normal(s, 4, 150), 2), strict=True))]
    kept = sketch.daily_sketches(points([*data, data[0], (1, 5, float("nan"), 0, 9), (None, 5, 1.0, 0, 9)]), target_rows=target)
    assert kept.filter("cells is not null").count() == 0 and kept.select("sid", "day_no").distinct().count() == 8
    got = {(r.sid, r.pct): r.value for r in sketch.merge_daily(kept).collect()}
    assert set(got) == {(s, p) for s in (1, 2) for p in (50, 90, 99)}
    for (s, p), q in got.items():
        assert rank_error(np.array([v for a, _, v, _, _ in data if a == s]), p, q) <= 0.003
    assert sketch.merge_daily(kept.limit(0)).collect() == []


def test_codes_become_cells_when_they_are_many(monkeypatch):
    rng = np.random.default_rng(4)
    a, b = (np.round(rng.normal(k, 5, 3000), 3) for k in (0, 4))
    _, code, n = sketch.counted(np.zeros(3000, np.int64), sketch.encode(a).astype(np.int64))
    parts = [sketch.code_rows(np.array([7]), None, np.array([len(code)]), code, n), sketch.cell_rows(7, sketch.DyadicSketch(12).update(b)), sketch.code_rows(np.array([8]), None, np.array([1]), code[:1], n[:1])]
    whole = sketch.DyadicSketch(12).update(np.r_[a, b])
    for limit in (10**9, 100):
        monkeypatch.setattr(sketch, "most_codes", lambda w, limit=limit: limit)
        summed = list(sketch.added(iter(parts), 12))
        assert (sketch.DyadicSketch.from_bytes(summed[0].column("cells")[0].as_py()).cells == whole.cells).all()
        got = {(r["sid"], r["pct"]): r["value"] for x in sketch.added(iter(summed), 12, (50, 90)) for r in x.to_pylist()}
        assert got[7, 50] == whole.percentiles((50, 90))[0] and np.isclose(got[8, 90], a.min(), rtol=1e-6)


def test_rank_errors_are_measured(spark, points):
    df = points([(s, i, float(i % 97), 0, i) for s in (1, 2) for i in range(500)])
    good = sketch.percentiles(df)
    assert rows(sketch.rank_errors(df, good), "pct", "n_sids", "n_within") == [(50, 2, 2), (90, 2, 2), (99, 2, 2)]
    assert {r.n_within for r in sketch.rank_errors(df, good.withColumn("value", good.value - 20)).collect()} == {0}
