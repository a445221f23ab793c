"""Queries over whole tables reach every sid and row of them."""

import os
import zlib

import duckdb
import pytest

import __spark_entry__
from tidewell import engine_queries as engine

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

WHOLE = {"point_text_all": engine.events, "read_all_series": engine.events, "integer_points_all": engine.lines, "boolean_points_all": lambda s, d: engine.lanes.live(engine.table(s, d, "points_bool")), "string_points_all": engine.bodies}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_every_sid_comes_out(spark, name):
    source, got = WHOLE[name](spark, DATA), __spark_entry__.queries()[name](spark, DATA)
    want = source.select("sid", "seq" if name == "point_text_all" else "clock").distinct()
    assert got.select(want.columns).exceptAll(want).count() == 0 and want.exceptAll(got.select(want.columns)).count() == 0


def test_strings_are_the_texts_of_documents(spark):
    """Answers have no title: they take part by their text."""
    q = __spark_entry__.queries()
    text = {r.doc_id: r.text for r in engine.table(spark, DATA, "documents").select("doc_id", "text").collect()}
    crc = {r.doc_id: r.crc for r in q["checksums"](spark, DATA).collect()}
    assert crc == {k: None if t is None else zlib.crc32(t.encode()) for k, t in text.items()}
    body = engine.merge.last_write_wins(engine.bodies(spark, DATA)).collect()
    rate = next(r for r in q["compression_rates"](spark, DATA).collect() if r.kind == "string")
    assert rate.n_points == len(body) and rate.raw_bytes >= sum(len(r.value.encode()) for r in body)
    assert sum(r.n_points for r in q["text_sizes"](spark, DATA).collect()) == len(body)
    assert {r.sid for r in q["text_bytes"](spark, DATA).collect()} == {r.sid for r in body}


@pytest.mark.parametrize("name", ["maximum", "minimum", "first", "last"])
def test_infinite_readings_are_downsampled(spark, tmp_path, name):
    day, inf = 864_000_000_000, float("inf")
    data = [(1, 5, inf, 0, 1), (1, 6, 2.0, 0, 2), (1, 7, -inf, 0, 3), (1, day + 1, inf, 0, 4)]
    spark.createDataFrame(data, "sid bigint, clock bigint, value double, quality int, seq bigint").write.parquet(str(tmp_path / "points_double.parquet"))
    got = {r.interval_start: (r.value, r.n_points) for r in engine.QUERIES[f"ext_downsample_{name}_all"](spark, str(tmp_path)).collect()}
    assert got == {0: (inf if name in ("maximum", "first") else -inf, 3), day: (inf, 1)}


def test_varint_sizes_of_many_events(spark, tmp_path):
    """Ids whose cubes are no longs, as 6,000,000 events have; the SQL of varint_sizes reaches ids below 2,097,152."""
    ids = [None, -3, 0, 5, 6, 25, 26, 127, 128, 645, 646, 3250, 3251, 16383, 16384, 99_999, 2_097_151, 2_097_152, 5_999_999, 10**12]
    spark.createDataFrame([(x,) for x in ids], "event_id bigint").write.parquet(str(tmp_path / "events.parquet"))
    got = {n: {r.seq: r.n_bytes for r in engine.QUERIES[n](spark, str(tmp_path)).collect()} for n in ("varint_sizes", "varint_sizes_all")}
    db = duckdb.connect()
    rows = lambda name, where: dict(db.sql(engine.SQL[name].replace("from events", f"from (select * from '{tmp_path}/events.parquet/*.parquet' where {where})")).fetchall())
    low = rows("varint_sizes", "event_id is null or event_id < 2097152")
    assert got["varint_sizes"] == low | dict.fromkeys((2_097_152, 5_999_999, 10**12), 6)
    assert got["varint_sizes_all"] == rows("varint_sizes_all", "true")
    assert got["varint_sizes_all"][5_999_999] == 10
