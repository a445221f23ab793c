import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from tidewell.operators import changefeed
from tidewell.sources.deltas import DeltaTable

FEED = "seq bigint, kind string, sid bigint, clock bigint, value double, quality int, min_clock bigint, max_clock bigint"
DAY = changefeed.BUCKET_TICKS


def brute(feed):
    store, seen = {}, set()
    for seq, kind, sid, clock, value, _, lo, hi in sorted((f for f in feed if f[0] is not None and f[2] is not None), key=lambda f: f[0]):
        if seq in seen:
            continue
        seen.add(seq)
        kind = (kind or "").strip().lower()
        if kind == "write" and clock is not None and value is not None and value == value:
            store[sid, clock] = seq
        elif kind == "delete":
            store = {k: v for k, v in store.items() if k[0] != sid}
        elif kind == "delete_range":
            store = {k: v for k, v in store.items() if k[0] != sid or (lo is not None and k[1] < lo) or (hi is not None and k[1] > hi)}
    return {(s, c, q) for (s, c), q in store.items()}


@pytest.mark.parametrize("bucket", [DAY, 1000, 7])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, bucket):
    rnd = random.Random(seed)
    span = 40 * (bucket if bucket < DAY else DAY)
    feed = []
    for seq in range(700):
        sid, kind = rnd.choice([1, 1, 1, 2, 3]), rnd.choice(["write"] * 8 + [" Write\t", "delete_range", "DELETE_RANGE ", "delete_range"] + ["delete"] * (seq % 40 == 0))
        lo = rnd.choice([None, rnd.randint(0, span), rnd.randint(0, 40) * bucket])
        hi = rnd.choice([None, rnd.randint(0, span), rnd.randint(0, 40) * bucket + bucket - 1]) if rnd.random() < 0.3 else (lo or 0) + rnd.randint(-5, span // 6)
        if kind.strip().lower() == "write":
            feed.append((seq, kind, sid, rnd.choice([rnd.randint(0, span), rnd.randint(0, 40) * bucket]), rnd.choice([1.0, 2.0, None, float("nan"), float("inf")]), 0, None, None))
        else:
            feed.append((seq, kind, sid, None, None, None, lo, hi))
    want = brute(feed)
    feed += rnd.sample(feed, 60)
    rnd.shuffle(feed)
    got = rows(changefeed.apply_changes(spark.createDataFrame(feed, FEED), bucket))
    assert len(got) == len(set(got)) and set(got) == want


def test_defined_cases(spark):
    feed = [
        (1, "write", 1, 10, 1.0, 0, None, None), (2, "delete_range", 1, None, None, None, 20, 5), (3, "write", 1, -5, 1.0, 0, None, None), (None, "write", 1, 11, 1.0, 0, None, None),
        (4, None, 1, 12, 1.0, 0, None, None), (5, "write", None, 12, 1.0, 0, None, None), (6, "write", 1, None, 1.0, 0, None, None), (7, "delete_range", 2, None, None, None, None, None),
        (8, "write", 2, 3, 1.0, 0, None, None), (9, "delete_range", 1, None, None, None, None, -1), (10, "write", 3, 2**62, 5.0, None, None, None),
    ]
    df = spark.createDataFrame(feed, FEED).selectExpr("*", "1 lo", "2 bucket", "3 level", "4 node")
    assert rows(changefeed.apply_changes(df)) == [(1, 10, 1), (2, 3, 8), (3, 2**62, 10)]
    assert rows(changefeed.current_table(df)) == [(1, 10, 1.0, 0, 1), (2, 3, 1.0, 0, 8), (3, 2**62, 5.0, None, 10)]
    assert rows(changefeed.apply_changes(spark.createDataFrame([], FEED))) == []


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 60), st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(-9, 99)), max_size=30))
def test_latest_cover(n, spans):
    spans = [(min(a, n), min(b, n), q) for a, b, q in spans]
    want = [max([q for a, b, q in spans if a <= i < b], default=np.iinfo(np.int64).min) for i in range(n)]
    a, b, q = (np.array([s[k] for s in spans], np.int64) for k in range(3))
    assert changefeed.latest_cover(a, b, q, n).tolist() == want


def test_node_count_is_bounded(spark):
    d = spark.createDataFrame([(1, 5, DAY * 100000 + 7, 1), (1, None, None, 2)], "sid bigint, lo bigint, hi bigint, seq bigint")
    nodes, parts = changefeed.delete_keys(d)
    assert nodes.count() <= 2 * changefeed.LEVELS + 1 and parts.count() == 2


def test_table_of_insert_and_delete_files(spark, tmp_path):
    rnd = random.Random(5)
    feed = []
    for seq in range(300):
        if rnd.random() < 0.8:
            feed.append((seq, "write", rnd.choice([1, 2]), rnd.randint(0, 90), float(seq), 0, None, None))
        else:
            lo = rnd.randint(0, 90)
            feed.append((seq, rnd.choice(["delete_range", "delete_range", "delete"]) if seq % 50 == 0 else "delete_range", 1, None, None, None, lo, lo + rnd.randint(0, 30)))
    table = DeltaTable(spark, str(tmp_path / "t"), 16)
    assert rows(table.read()) == []
    late = [*feed[200:], *feed[:120], *feed[100:200]]  # out of order, some twice
    for part in (late[:150], late[150:], late[:20]):
        table.append(spark.createDataFrame(part, FEED))
    want = brute(feed)
    assert set(rows(table.read(), "sid", "clock", "seq")) == want
    table.compact()
    assert set(rows(table.read(), "sid", "clock", "seq")) == want
    table.append(spark.createDataFrame([(999, "delete", 1, None, None, None, None, None)], FEED))
    assert {r[0] for r in rows(table.read(), "sid")} == {2}


@pytest.mark.parametrize("bucket", [DAY, 1000])
def test_dense_buckets_are_cut_finer(spark, bucket):
    """A third of the rows and of the deletes in one bucket of one sid."""
    rnd = random.Random(9)
    feed = []
    for seq in range(900):
        sid = rnd.choice([1, 1, 2, 3])
        lo = rnd.randint(0, 300) if seq % 3 else rnd.randint(0, 5 * bucket)
        if rnd.random() < 0.75:
            feed.append((seq, "write", sid, lo, float(seq), seq % 3, None, None))
        else:
            feed.append((seq, "delete_range", sid, None, None, None, rnd.choice([lo, lo, lo, None]), lo + rnd.choice([0, 5, 40, bucket])))
    df = spark.createDataFrame(rnd.sample(feed, len(feed)), FEED)
    for target in (400, 60):
        assert set(rows(changefeed.apply_changes(df, bucket, target_rows=target))) == brute(feed)
    assert set(rows(changefeed.current_table(df, bucket, target_rows=60), "sid", "clock", "seq")) == brute(feed)


def test_a_repeated_seq_with_two_values(spark):
    df = spark.createDataFrame([(1, "write", 1, 5, v, q, None, None) for v, q in ((2.0, 1), (7.0, None), (7.0, 3), (1.0, 9))], FEED)
    assert rows(changefeed.current_table(df)) == [(1, 5, 7.0, 3, 1)]
