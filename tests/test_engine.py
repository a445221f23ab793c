"""Contract of the historian: clocks, model, merging, shards, measures, schemes, codecs and plans."""

import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewell.functions import clock, codecs, codes
from tidewell.operators import blocks, measures, merge, model, schemes, shards
from tidewell.plans import compaction

DAY = clock.TICKS_PER_DAY


# ---- clocks and codes
def test_clock_round_trip(spark):
    df = spark.sql("select timestamp_ntz'2019-08-23 16:10:00' a, timestamp'9999-12-31 23:59:59.999999' b, timestamp'0001-01-01 00:00:00' c")
    r = df.select(*[clock.clock_of(c).alias(c) for c in "abc"]).first()
    assert (r.a, r.b, r.c) == (637_021_734_000_000_000, 3_155_378_975_999_999_990, 0)
    assert clock.clock_literal("2019-08-23T16:10:00") == r.a
    back = spark.createDataFrame([(r.a + 9,)], "clock bigint").select(clock.point_text("clock", "clock").alias("t")).first()
    assert back.t == f"2019-08-23 16:10:00.000 {r.a + 9}"


def test_codes(spark):
    xs = [0, 1, -1, 5, -700, 2**62, -(2**62), 127, 128, 16383, 16384]
    df = spark.createDataFrame([(x,) for x in xs], "x bigint").select("x", codes.zigzag(F.col("x")).alias("z"), codes.leading_zeros(F.col("x")).alias("l"), codes.trailing_zeros(F.col("x")).alias("t"), codes.varint_size(F.col("x")).alias("v"))
    for r in df.withColumn("b", codes.unzigzag(F.col("z"))).collect():
        u = r.x & (2**64 - 1)
        assert r.b == r.x and r.z & (2**64 - 1) == codecs._zigzag(r.x)
        assert r.l == 64 - u.bit_length() and r.t == (64 if not u else (u & -u).bit_length() - 1)
        assert r.v == len(codecs.put_varint(u))


def test_varint_of_a_cube(spark):
    """Cubes beyond 64 bits too, at both sides of every step in size."""
    near = {round(2 ** (7 * n / 3)) + k for n in range(1, 15) for k in (-1, 0, 1)}
    xs = sorted(x for x in near | {0, 2**21 - 1, 2**21, 5_999_999, 2**42, 2**63 - 1})
    got = spark.createDataFrame([(x,) for x in [*xs, None]], "x bigint").select("x", codes.varint_size_of_cube(F.col("x")).alias("v")).collect()
    assert {r.x: r.v for r in got} == {x: len(codecs.put_varint(x**3)) for x in xs} | {None: None}


# ---- model
def test_quarantine(spark):
    df = spark.createDataFrame([(1, 5, 1.0), (1, 6, float("nan")), (1, 7, None), (None, 8, 1.0), (1, None, 1.0), (1, -1, 1.0), (1, 9, float("inf"))], "sid bigint, clock bigint, value double")
    good, bad = model.validate(model.points_of(df))
    assert rows(good, "clock") == [(5,), (9,)]
    assert sorted(r.fault for r in bad.collect()) == ["clock", "clock", "nan", "no sid", "no value"]
    with pytest.raises(TypeError):
        model.points_of(spark.sql("select 1L sid, 2L clock, array(1) value"))


def test_types_and_bytes(spark):
    one = lambda v: model.points_of(spark.sql(f"select 1L sid, 2L clock, {v} value"))
    for value, tag in (("1.5", 0), ("1.5f", 0), ("2", 1), ("2L", 1), ("2S", 1), ("true", 2), ("'x'", 3), ("timestamp'2020-01-01'", 3)):
        assert one(value).first().dtype == tag
    with pytest.raises(TypeError):
        one("2Y")
    df = one("'温度'").unionByName(one("true").withColumn("sid", F.lit(2).cast("long"))).unionByName(one("1.5").withColumn("sid", F.lit(3).cast("long")))
    assert dict(rows(measures.series_bytes(df))) == {1: 18, 2: 13, 3: 20}
    mixed = one("1.5").unionByName(one("true"))
    assert rows(model.mixed_series(mixed)) == [(1,)] and rows(model.mixed_series(df)) == []
    assert model.typed_view(df, model.STRING).first().value == "温度"


# ---- merging
def test_overwrite_subset_and_unsorted_batches(points):
    a = points([(1, 10, 1.0, 0, 1), (1, 20, 2.0, 0, 2)])
    assert rows(merge.upsert(a, points([(1, 10, 3.0, 7, 1)])), "clock", "value", "quality") == [(10, 3.0, 7), (20, 2.0, 0)]
    b = points([(1, 30, 1.0, 0, 1), (1, 10, 2.0, 0, 2), (1, 10, 3.0, 0, 3)])
    assert rows(merge.last_write_wins(b), "clock", "value") == [(10, 3.0), (30, 1.0)]


def test_inclusive_bounds_and_empty_ranges(points):
    p = points([(1, c, 1.0, 0, c) for c in (10, 20, 30)])
    assert merge.read_range(p, [1], 10, 30).count() == 3
    assert merge.read_range(p, [1], 11, 29).count() == 1
    assert merge.read_range(p, [1], 40, 50).count() == 0
    assert merge.read_range(p, [], 0, 50).count() == 0
    assert rows(merge.exclude(p, 10, 20), "clock") == [(30,)] and rows(merge.include(p, 20, 99), "clock") == [(20,), (30,)]
    assert rows(merge.delete_range(p, [1], 10, 20), "clock") == [(30,)]
    assert rows(merge.of_sids(p, range(5000)), "clock") == [(10,), (20,), (30,)]


def test_tombstones_hide_earlier_writes_only(spark, points):
    p = points([(1, 15, 1.0, 0, 1), (1, 15, 2.0, 0, 9), (1, 99, 1.0, 0, 1), (2, 15, 1.0, 0, 1)])
    t = spark.createDataFrame([(1, 10, 20, 5), (2, None, None, 5)], "sid bigint, min_clock bigint, max_clock bigint, seq bigint")
    assert rows(merge.apply_tombstones(p, t), "sid", "clock", "seq") == [(1, 15, 9), (1, 99, 1)]


def test_slices_and_predecessors(spark, points):
    p = points([(1, c, float(c), 0, c) for c in (30, 10, 20)] + [(2, 5, 5.0, 0, 1)])
    assert rows(merge.position_slice(p, 1, 1), "sid", "clock") == [(1, 20)]
    ask = spark.createDataFrame([(1, 9), (1, 10), (1, 29), (3, 1)], "sid bigint, clock bigint")
    assert rows(merge.predecessors(p, ask), "sid", "clock", "point_clock") == [(1, 9, None), (1, 10, 10), (1, 29, 20), (3, 1, None)]


# ---- shards
@pytest.mark.parametrize(("days", "seconds"), [(1, 3600), (2, 86400), (179, 86400), (180, 604800), (699, 604800), (700, 2628000)])
def test_shard_width(spark, days, seconds):
    assert shards.width_seconds(days) == seconds
    assert spark.range(1).select(F.lit(days).alias("rp_days")).select(shards.width_column().alias("w")).first().w == seconds * 10**7


def test_expiry_is_strict(points):
    now = 400 * DAY
    p = points([(1, now - 31 * DAY, 1.0, 0, 1), (1, now - 33 * DAY, 1.0, 0, 1)])
    assert rows(p.filter(~shards.expired("clock", 31, now)), "clock") == [(now - 31 * DAY,)]
    assert rows(shards.expire_points(p, 31, now), "clock") == [(now - 31 * DAY,)]


def test_range_prunes_directories(spark, points, tmp_path):
    p = points([(1, 700_000 * DAY + d * DAY + 5, 1.0, 0, d) for d in range(30)])
    shards.route_to_shards(p, 31).write.partitionBy("shard_start").parquet(str(tmp_path / "p"))
    df = shards.pruned(spark.read.parquet(str(tmp_path / "p")), 31, 700_003 * DAY + 5, 700_005 * DAY + 4)
    assert rows(df, "seq") == [(3,), (4,)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    part = plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert "shard_start" in part and "GreaterThanOrEqual(clock" in plan


# ---- measures, schemes
def test_empty_series_and_blocks(spark, points):
    p = points([(1, c, 1.0, 0, c) for c in range(1001)] + [(2, c, 1.0, 0, c) for c in range(1000)])
    b = rows(measures.block_index(p))
    assert b == [(1, 0, 0, 999, 1000), (1, 1, 1000, 1000, 1), (2, 0, 0, 999, 1000)]
    reg = spark.createDataFrame([(1,), (3,), (3,)], "sid bigint")
    assert rows(measures.registered_bounds(p, reg)) == [(1, 0, 1000, 1001), (3, clock.MAX_CLOCK, 0, 0)]


@pytest.mark.parametrize(
    ("clocks", "scheme", "power"),
    [([5], "SIMPLE8B", 12), ([5, 9], "RLE", 0), ([0, 10**7, 2 * 10**7], "RLE", 7), ([0, 10**4, 3 * 10**4], "SIMPLE8B", 4), ([0, 1, 2**60 + 5], "RAW", 0), ([7, 7, 7], "RLE", 12)],
)
def test_clock_schemes(points, clocks, scheme, power):
    r = schemes.timestamp_schemes(points([(1, c, 1.0, 0, i) for i, c in enumerate(clocks)])).first()
    assert (r.scheme, r.divisor_power) == (scheme, power)
    data = codecs.encode_clocks(clocks)
    assert data[0] >> 4 == {"RAW": 0, "SIMPLE8B": 1, "RLE": 2}[scheme] and (scheme == "RAW" or data[0] & 15 == power)


# ---- codecs
longs = st.integers(-(2**63), 2**63 - 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, clock.MAX_CLOCK), max_size=60).map(sorted))
def test_clocks_round_trip(xs):
    data = codecs.encode_clocks(xs)
    assert codecs.decode_clocks(data) == xs and codecs.clock_count(data) == len(xs)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.lists(longs, max_size=60), st.lists(st.integers(-3, 3), max_size=300), st.integers(-5, 5).map(lambda x: list(range(0, x * 50, x or 1)))))
def test_integers_round_trip(xs):
    assert codecs.decode_integers(codecs.encode_integers(xs)) == xs


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.floats(allow_nan=False), st.sampled_from([0.0, -0.0, 1.0, float("inf")])), max_size=60))
def test_doubles_round_trip(xs):
    assert [struct.pack("d", x) for x in codecs.decode_doubles(codecs.encode_doubles(xs))] == [struct.pack("d", x) for x in xs]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.booleans(), max_size=60), st.lists(st.text(st.characters(codec="utf-8"), max_size=8), max_size=20))
def test_booleans_and_strings_round_trip(bs, ss):
    assert codecs.decode_booleans(codecs.encode_booleans(bs)) == bs
    assert codecs.decode_strings(codecs.encode_strings(ss)) == ss


def test_nan_and_large_values_are_refused():
    with pytest.raises(ValueError):
        codecs.encode_doubles([1.0, float("nan")])
    with pytest.raises(ValueError):
        codecs.pack([2**60])
    assert len(codecs.pack([1] * 240)) == 8 and len(codecs.pack([1] * 120)) == 8 and len(codecs.pack([1] * 60)) == 8


@pytest.mark.parametrize("target", [10**6, 300])
def test_blocks_of_a_table(spark, points, target):
    rnd = random.Random(1)
    data = [(s, c, round(rnd.gauss(0, 9), 2), c % 3, c) for s in (1, 2) for c in range(0, 900)]
    enc = blocks.encode_points(points(data + data[:9]), 100, target)
    assert all(codecs.block_count(r.block) == r.n_points <= 100 and r.crc == __import__("zlib").crc32(r.block) for r in enc.collect())
    assert rows(blocks.decode_points(enc, model.DOUBLE)) == sorted(r[:4] for r in data)
    assert rows(blocks.decode_points(enc, model.DOUBLE, 150, 251)) == sorted(r[:4] for r in data if 150 <= r[1] <= 251)
    text = spark.createDataFrame([(1, 5, "温度", 0, 1), (1, 6, "", 0, 1)], "sid bigint, clock bigint, value string, quality int, seq bigint")
    assert rows(blocks.decode_points(blocks.encode_points(text), model.STRING), "value") == [("",), ("温度",)]


# ---- compaction plans
FILES = "shard bigint, generation bigint, sequence int, n_bytes bigint, has_tombstone boolean, full_blocks boolean"


def files(spark, *gens):
    return spark.createDataFrame([(s, g, q, 10, t, f) for s, g, q, t, f in gens], FILES)


def test_level_plans(spark):
    ones = [(1, g, 1, False, False) for g in range(1, 20)]
    got = compaction.plan_level(files(spark, *ones), 1).collect()
    assert sorted(r.generations for r in got) == [list(range(1, 9)), list(range(9, 17))]
    assert compaction.plan_level(files(spark, *ones), 2).count() == 0
    marked = [*ones[:18], (1, 19, 1, True, False)]
    assert sorted(len(r.generations) for r in compaction.plan_level(files(spark, *marked), 1).collect()) == [3, 8, 8]
    assert compaction.plan_level(files(spark, (1, 1, 2, False, False)), 2).count() == 0
    split = [(1, g, 2 if g != 3 else 3, False, False) for g in range(1, 8)]
    assert [r.generations for r in compaction.plan_level(files(spark, *split), 2).collect()] == [[4, 5, 6, 7]]


def test_optimize_full_and_done(spark):
    fours = [(1, g, 5, False, False) for g in range(4)]
    assert [r.generations for r in compaction.plan_optimize(files(spark, *fours)).collect()] == [[0, 1, 2, 3]]
    big = spark.createDataFrame([(1, 1, 4, 3 * 10**9, False, True), (1, 2, 1, 10, False, False), (1, 3, 1, 10, False, False)], FILES)
    assert compaction.plan_full(big, 0, 0).count() == 0
    assert [r.generations for r in compaction.plan_full(big, 0, 0, force=True).collect()] == [[2, 3]]
    assert compaction.plan_full(big, compaction.COLD_TICKS + 1, 0).count() == 1
    assert rows(compaction.fully_compacted(files(spark, (1, 1, 4, False, True), (2, 1, 1, True, False)))) == [(1, True), (2, False)]


@pytest.mark.parametrize("target", [10**6, 40])
def test_positions_and_predecessors_of_split_series(spark, points, target, monkeypatch):
    from tidewell.operators import lanes

    monkeypatch.setattr(lanes, "TARGET_ROWS", target)
    rnd = random.Random(7)
    clocks = sorted(rnd.sample(range(0, 300), 90)) + sorted(rnd.sample(range(5000, 5300), 90))
    p = points([(1, c, float(c), 0, c) for c in clocks] + [(2, 3, 3.0, 0, 1)])
    got = rows(lanes.with_position(p, lanes.LanePlan.of(p, target)), "sid", "clock", "at")
    assert got == [(1, c, i) for i, c in enumerate(clocks)] + [(2, 3, 0)]
    ask = [rnd.randint(0, 6000) for _ in range(60)]
    asked = spark.createDataFrame([(1, a) for a in sorted(set(ask))] + [(3, 1)], "sid bigint, clock bigint")
    want = [(1, a, max((c for c in clocks if c <= a), default=None)) for a in sorted(set(ask))] + [(3, 1, None)]
    assert rows(merge.predecessors(p, asked, target), "sid", "clock", "point_clock") == want
    assert rows(merge.sorted_series(p), "sid", "clock") == [r[:2] for r in got]


def test_lists_by_position(spark, points):
    p = points([(1, c, float(c), 0, c) for c in (5, 7, 9, 11)] + [(2, 5, 1.0, 0, 1)])
    assert rows(merge.remove_positions(p, 1, 2), "sid", "clock") == [(1, 5), (1, 11), (2, 5)]
    assert rows(merge.remove_positions(p, 0), "sid", "clock") == [(1, 7), (1, 9), (1, 11)]
    asked = spark.createDataFrame([(1, 9), (1, 9), (1, 10), (3, 5)], "sid bigint, clock bigint")
    assert rows(merge.positions_of(p, asked)) == [(1, 9, 2), (1, 10, -1), (3, 5, -1)]
    assert rows(merge.contains_points(p, asked)) == [(1, 9, True), (1, 10, False), (3, 5, False)]
    assert rows(merge.remove_positions(p.limit(0), 0)) == [] and rows(merge.contains_points(p, asked.limit(0))) == []


def test_may_contain_tells_by_the_last_block(spark):
    blocks = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 40, 50), (2, 0, 5)], "sid bigint, min_clock bigint, max_clock bigint")
    asked = spark.createDataFrame([(1, 0), (1, 10), (1, 20), (1, 21), (1, 45), (1, 51), (2, 6), (3, 1), (1, 45)], "sid bigint, clock bigint")
    assert rows(measures.may_contain(blocks, asked)) == [(1, 0), (1, 10), (1, 20), (1, 45), (1, 45)]
    tombs = spark.createDataFrame([(1, 40, None), (2, 0, 9), (1, 0, 0)], "sid bigint, min_clock bigint, max_clock bigint")
    assert rows(measures.may_contain(blocks, asked, tombs)) == [(1, 10), (1, 20)]


def test_tombstones_keep_rows_without_keys(points):
    p = points([(1, 5, 1.0, 0, 1), (None, 5, 1.0, 0, 1), (1, None, 1.0, 0, 1), (1, 5, 2.0, 0, None), (1, 5, 1.0, 0, 1)]).selectExpr("*", "'x' row", "2 bucket", "3 lo")
    t = points([(1, 5, 1.0, 0, 9)]).selectExpr("sid", "clock min_clock", "clock max_clock", "seq")
    assert len(rows(merge.apply_tombstones(p, t), "sid", "clock", "seq")) == 3
    assert merge.apply_tombstones(p, t.limit(0)).count() == 5 and merge.apply_tombstones(p, t).columns == p.columns


def test_blocks_do_not_depend_on_lanes(points):
    rnd = random.Random(4)
    p = points([(s, rnd.randrange(10**6), rnd.gauss(0, 9), 0, c) for s in (1, 2) for c in range(2000)])
    a, b = (rows(blocks.encode_points(p, 100, t), "sid", "min_clock", "max_clock", "n_points", "crc") for t in (10**6, 250))
    assert a == b and all(r[3] == 100 for r in a if r != max(x for x in a if x[0] == r[0]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**60 - 1)), max_size=400))
def test_packed_words_take_as_many_values_as_they_can(xs):
    """Against a plain loop over the selectors."""
    words, i = [], 0
    while i < len(xs):
        for k, (n, b) in enumerate(zip(codecs.PER_WORD, codecs.BITS_EACH, strict=True)):
            part = xs[i : i + n]
            if len(part) == n and (all(v == 1 for v in part) if b == 0 else max(part) < 1 << b):
                words.append(k << 60 | sum(v << (j * b) for j, v in enumerate(part) if b))
                i += n
                break
    assert codecs.pack(xs) == struct.pack(f">{len(words)}Q", *words) and codecs.unpack(codecs.pack(xs)).tolist() == xs


def test_bits_that_round_up_to_a_power_of_two():
    import numpy as np

    x = [0, 1, 2**53 - 1, 2**53, 2**54 - 1, 2**60 - 1, 2**63 - 1, 2**63, 2**64 - 1]
    assert codecs.bit_lengths(np.array(x, np.uint64)).tolist() == [v.bit_length() for v in x]
