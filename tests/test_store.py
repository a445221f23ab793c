"""Contract of the store, checked against a dictionary, and of streams into it."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import POINTS, rows
from tidewell.functions.clock import TICKS_PER_DAY as DAY
from tidewell.sources import simulate
from tidewell.sources.changelog import ChangeLog
from tidewell.sources.store import Store
from tidewell.streaming import ingest


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store")).open()


def values(df):
    return rows(df, "sid", "clock", "v_double", "quality")


def test_databases(store, points):
    assert store.databases() == ["default"]
    assert store.create_database("a") and not store.create_database("a") and not store.create_database("")
    assert not store.delete_database("default") and not store.rename_database("default", "x") and not store.rename_database("a", "default")
    store.add_sids([1], 31, "a")
    store.write(points([(1, DAY, 1.0, 0, 1)]), "a")
    assert store.rename_database("a", "b") and store.contains_database("b") and not store.contains_database("a")
    assert values(store.read([1])) == [(1, DAY, 1.0, 0)]
    store.close_database("b")
    assert values(store.read([1])) == []
    store.open_database("b")
    assert store.delete_database("b") and store.databases() == ["default"] and values(store.read([1])) == []
    with pytest.raises(KeyError):
        store.read([1], db="none")


def test_registry(store, points):
    assert store.add_sids([1, 2, 2], 31) == 2 and store.add_sids([2, 3], 31) == 1 and store.add_sids([1], 7) == 1
    assert store.write(points([(9, DAY, 1.0, 0, 1)])) == 0 and values(store.read([9])) == []
    assert store.write(points([(1, DAY, 1.0, 0, 1), (1, DAY, 2.0, 0, 2), (2, DAY, 3.0, 0, 1)])) == 5  # sid 1 goes to two periods
    assert values(store.read([1, 2, 3])) == [(1, DAY, 2.0, 0), (2, DAY, 3.0, 0)]
    assert store.remove_sids([1, 77]) == 2 and values(store.read([1])) == []
    store.compact(full=True)
    assert store.add_sids([1], 31) == 1 and values(store.read([1])) == []  # stays deleted
    assert rows(store.registry()) == [(31, 1), (31, 2), (31, 3)]


def test_writes_reads_and_persistence(spark, store, points):
    store.add_sids([1], 31)
    store.write(points([(1, DAY + 10, 1.0, 0, 1), (1, DAY + 20, 2.0, 0, 2)]))
    store.write(points([(1, DAY + 10, 3.0, 5, 1), (1, 3 * DAY, 4.0, 0, 2), (1, 3 * DAY + 1, float("nan"), 0, 3), (1, None, 1.0, 0, 4)]))
    want = [(1, DAY + 10, 3.0, 5), (1, DAY + 20, 2.0, 0), (1, 3 * DAY, 4.0, 0)]
    assert values(store.read([1])) == want and values(Store(spark, store.path).open().read_all([1])) == want
    assert values(store.read([1], DAY + 20, 3 * DAY)) == want[1:] and values(store.read([1], 5, 6)) == []
    assert store.shards() == [(31, DAY), (31, 3 * DAY)]
    plan = store.read([1], DAY + 20, 2 * DAY)._jdf.queryExecution().executedPlan().toString()
    assert "shard_start" in plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert not store.is_idle() and store.compact() == 1 and store.is_idle() and values(store.read([1])) == want
    assert store.disk_size() > 0 and store.last_modified() > 0
    store.close()
    with pytest.raises(RuntimeError):
        store.read([1])


def test_order_in_a_batch_is_checked(store, points):
    store.add_sids([1], 31)
    for seq in (-1, 2**36):
        with pytest.raises(Exception, match="seq has to be"):
            store.write(points([(1, DAY, 1.0, 0, seq)]))
    assert values(store.read([1])) == []
    assert store.write(points([(1, DAY, 1.0, 0, 2**36 - 1), (1, DAY, 2.0, 0, None)])) == 2 and values(store.read([1])) == [(1, DAY, 1.0, 0)]


def test_deletes(store, points):
    store.add_sids([1, 2], 31)
    store.write(points([(s, DAY + c, 1.0, 0, c) for s in (1, 2) for c in (10, 15, 20, 25)]))
    store.compact()
    store.delete_range([1], DAY + 10, DAY + 20)
    assert [r[1] - DAY for r in values(store.read([1]))] == [25]
    store.write(points([(1, DAY + 15, 9.0, 0, 1)]))
    assert values(store.read([1])) == [(1, DAY + 15, 9.0, 0), (1, DAY + 25, 1.0, 0)]
    before = values(store.read([1, 2]))
    store.compact(full=True)
    assert values(store.read([1, 2])) == before and store.tombstones().count() == 0


def test_expiry(store, points):
    store.add_sids([1], 2)
    now = 100 * DAY
    assert store.write(points([(1, now - 2 * DAY, 1.0, 0, 1), (1, now - 2 * DAY - 1, 1.0, 0, 2)]), now=now) == 1
    assert store.write(points([(1, now - 2 * DAY + 5, 1.0, 0, 1)]), now=now + DAY // 2) == 1  # expired, but its shard is there
    assert store.expire(now + DAY) == 0 and store.expire(now + DAY + 1) == 1 and values(store.read([1])) == []


def test_cut_off_writes_and_merges_are_not_seen(spark, store, points, monkeypatch):
    """Files without a version of the manifest that names them do not count, and their number is used again."""
    store.add_sids([1], 31)
    store.write(points([(1, DAY, 1.0, 0, 1)]))
    store.write(points([(1, DAY + 1, 2.0, 0, 1)]))
    want = [(1, DAY, 1.0, 0), (1, DAY + 1, 2.0, 0)]

    def cut_off(*_):
        raise OSError("cut off")

    for action in (lambda s: s.write(points([(1, DAY, 9.0, 0, 1)])), lambda s: s.compact(), lambda s: s.delete_range([1])):
        late = Store(spark, store.path).open()
        monkeypatch.setattr(late.manifest, "write", cut_off)
        with pytest.raises(OSError, match="cut off"):
            action(late)
        again = Store(spark, store.path).open()
        assert values(again.read([1])) == want
    assert again.compact() == 1 and values(again.read([1])) == want and again.write(points([(1, DAY, 3.0, 0, 1)])) == 1
    assert values(Store(spark, store.path).open().read([1])) == [(1, DAY, 3.0, 0), want[1]]


def test_readers_outlive_one_merge_and_a_second_writer_is_refused(spark, store, points):
    store.add_sids([1], 31)
    for c in range(3):
        store.write(points([(1, DAY + c, 1.0, 0, 1)]))
    planned = store.read([1])
    other = Store(spark, store.path).open()
    assert store.compact() == 1 and len(values(planned)) == 3
    with pytest.raises(OSError):
        other.write(points([(1, DAY, 5.0, 0, 1)]))
    assert len(values(store.read([1]))) == 3


def test_snapshots(store, points):
    store.add_sids([1], 31)
    store.write(points([(1, DAY, 1.0, 0, 1)]))
    store.write(points([(1, DAY, 2.0, 0, 1), (1, DAY + 1, 2.0, 0, 2)]))
    held = store.snapshot()
    store.write(points([(1, DAY, 3.0, 0, 1)]))
    assert values(held) == [(1, DAY, 2.0, 0), (1, DAY + 1, 2.0, 0)]
    with pytest.raises(RuntimeError):
        store.snapshot()
    assert store.clear_snapshot(False) == 0 and len(store.meta["databases"]["default"]["shards"]) == 3
    store.snapshot()
    store.write(points([(1, DAY + 2, 3.0, 0, 1)]))
    assert store.clear_snapshot(True) == 1
    assert sorted(s[1] for s in store.meta["databases"]["default"]["shards"]) == [1, 2]
    assert values(store.read([1])) == [(1, DAY, 3.0, 0), (1, DAY + 1, 2.0, 0), (1, DAY + 2, 3.0, 0)]


def test_the_planner_drives_the_merges(store, points):
    store.add_sids([1], 31)
    for c in range(9):
        store.write(points([(1, DAY + c, float(c), 0, 1), (1, DAY, float(c), 0, 2)]))
    before = values(store.read([1]))
    assert store.maintain(10, 10) == 1  # a chunk of eight generations; the ninth stays
    assert sorted(s[1] for s in store.meta["databases"]["default"]["shards"]) == [1, 2] and values(store.read([1])) == before
    assert store.maintain(10, 10) == 0
    assert store.maintain(10**12, 10) == 1 and store.is_idle() and values(store.read([1])) == before  # cold
    got = {(r.database, r.counter): r.value for r in store.statistics().collect()}
    assert got["default", "generations"] == 1 and got["default", "level_4_generations"] == 1 and got[None, "writes"] == 9


def test_many_deletes_of_one_series(spark, store, points):
    """A hundred thousand of them: more than any row should be held against."""
    store.add_sids([1, 2], 31)
    n = 100_000
    store.write(spark.range(n).selectExpr("1L sid", f"{DAY}L + id * 10 clock", "double(id) value", "id seq"))
    store.write(points([(2, DAY, 1.0, 0, 1)]))
    ranges = spark.range(n).selectExpr("1L sid", f"{DAY}L + id * 10 - 1 lo", f"{DAY}L + id * 10 + if(id % 1000 = 0, -1, 1) hi")
    assert store.delete_ranges(ranges) == n
    assert store.read([1]).count() == n // 1000 and values(store.read([2])) == [(2, DAY, 1.0, 0)]
    store.compact(full=True)
    assert store.read([1, 2]).count() == n // 1000 + 1 and store.tombstones().count() == 0


def test_backup(store, points, tmp_path):
    store.add_sids([1], 31)
    store.write(points([(1, DAY, 1.0, 0, 1)]))
    store.backup(str(tmp_path / "b"))
    assert store.restore(str(tmp_path / "b"), "copy") and not store.restore(str(tmp_path / "b"), "copy")
    assert values(store.read([1], db="copy")) == [(1, DAY, 1.0, 0)]


def test_all_types_and_quarantine(spark, store):
    store.add_sids([1, 2, 3], 31)
    for sid, v in ((1, "7L"), (2, "true"), (3, "'温度'")):
        assert store.write(spark.sql(f"select {sid}L sid, {DAY}L clock, {v} value")) == 1
    got = {r.sid: (r.dtype, r.v_long, r.v_bool, r.v_string) for r in store.read([1, 2, 3]).collect()}
    assert got == {1: (1, 7, None, None), 2: (2, None, True, None), 3: (3, None, None, "温度")}
    assert store.quarantine(spark.sql("select 1L sid, 2L clock, double('nan') value")).first().fault == "nan"


@pytest.mark.parametrize("seed", [1, 2])
def test_random_operations_against_a_dictionary(spark, tmp_path, points, seed):
    rnd = random.Random(seed)
    store = Store(spark, str(tmp_path / "s")).open()
    store.add_sids([1, 2, 3], 31)
    model = {}
    for step in range(12):
        op = rnd.choice(["write", "write", "write", "delete", "compact", "full"])
        if op == "write":
            batch = [(rnd.randint(1, 4), rnd.randint(1, 4) * DAY + rnd.randint(0, 9), float(step * 100 + i), i % 3, i) for i in range(25)]
            assert store.write(points(batch)) == sum(b[0] < 4 for b in batch)
            model |= {b[:2]: b[2:4] for b in batch if b[0] < 4}
        elif op == "delete":
            sid, lo = rnd.randint(1, 3), rnd.randint(1, 4) * DAY + rnd.randint(0, 9)
            hi = lo + rnd.choice([0, 4, DAY])
            store.delete_range([sid], lo, hi)
            model = {k: v for k, v in model.items() if not (k[0] == sid and lo <= k[1] <= hi)}
        else:
            store.compact(full=op == "full")
    assert values(store.read([1, 2, 3, 4])) == sorted((*k, *v) for k, v in model.items())


def test_change_log(spark, tmp_path, points):
    log = ChangeLog(spark, str(tmp_path / "log"))
    assert log.replay().count() == 0
    log.write(points([(1, 10, 1.0, 0, 1), (1, 20, 2.0, 0, 2), (2, 10, 1.0, 0, 3)]))
    log.delete([2], 4)
    log.delete_range([1], 15, None, 5)
    last = log.write(points([(1, 30, 5.0, 0, 6)]))
    assert rows(log.replay(), "sid", "clock", "seq") == [(1, 10, 1), (1, 30, 6)]
    assert len(log.segments()) == 4 and log.n_bytes() > 0
    log.remove([last])
    assert rows(log.replay(), "sid", "clock") == [(1, 10)]


def test_simulated_points(spark):
    df = simulate.simulate(spark, "double", 50, 3)
    assert df.count() == 150 and df.select("sid", "clock").distinct().count() == 150
    assert df.filter("value < 0 or value >= 1").count() == 0 and df.collect() == simulate.simulate(spark, "double", 50, 3).collect()
    assert simulate.simulate(spark, "constant", 5).filter("value").count() == 0
    assert simulate.simulate(spark, "integer", 50).filter("value < 0").count() == 0


# ---- streams
def stream(spark, tmp_path, batches):
    at = str(tmp_path / "in")
    for b in batches:
        spark.createDataFrame(b, POINTS).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).parquet(at)


def test_stream_upserts_once(spark, store, tmp_path):
    store.add_sids([1, 2], 31)
    src = stream(spark, tmp_path, [[(1, DAY, 1.0, 0, 1), (9, DAY, 1.0, 0, 1)], [(1, DAY, 2.0, 0, 1), (2, DAY, 3.0, 0, 2)]])
    progress = ingest.Progress()
    spark.streams.addListener(progress)
    ingest.upsert_stream(src, store, str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert {r[0] for r in values(store.read([1, 2, 9]))} == {1, 2} and store.counters["points_accepted"] == 3
    assert store.epoch_done("ingest", 1) and not store.epoch_done("ingest", 2)
    ingest.upsert_stream(src, store, str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert store.counters["points_accepted"] == 3
    spark.streams.removeListener(progress)


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_windows_drop_late_readings(spark, tmp_path):
    base, minute = 637_021_734_000_000_000, 600_000_000
    src = stream(spark, tmp_path, [[(1, base + i * minute, float(i), 0, i) for i in range(20)], [(1, base + 40 * minute, 0.0, 0, 51)], [(1, base + minute, 99.0, 0, 50), (1, base + 80 * minute, 0.0, 0, 52)]])
    got = run(ingest.windowed(src, "5 minutes", "10 minutes"), "w").orderBy("window_start").collect()
    assert [(r.average, r.maximum, r.n_points) for r in got][:2] == [(4.5, 9.0, 10), (14.5, 19.0, 10)]


def test_repeats_and_current_values(spark, tmp_path):
    at = DAY * 737_000
    src = stream(spark, tmp_path, [[(1, at, 1.0, 0, 1), (1, at, 1.0, 0, 1)], [(1, at, 1.0, 0, 1), (2, at, 5.0, 0, 2)]])
    assert run(ingest.distinct_changes(src, "1 hour"), "d").count() == 2
    got = run(ingest.current_values(src), "c", "update").groupBy("sid").agg(F.max_by("value", "seq").alias("value"))
    assert rows(got, "sid", "value") == [(1, 1.0), (2, 5.0)]
