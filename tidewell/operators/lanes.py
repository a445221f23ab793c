"""Splitting series into lanes so that no task holds an unbounded series.

A *lane* is what one sorted pass sees at a time: a whole series, or, of a series with more rows than
``target_rows``, one slice of its time span, cut again where rows crowd in it. ``LanePlan`` finds the long
series with aggregations that read two columns. A plan has at most ``MAX_HEAVY`` series, and about twice as many
lanes of them, since the row target grows with the table; it is therefore safe to hold on the driver and to
broadcast (some 40 bytes each).

Rows travel as ``(sid, lane, clock, seq, value, tag)``. Settings of a series go the same way, as rows with
the tag CONFIG, so neither a broadcast nor a second, skewed join on sid is needed.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.clock import MAX_CLOCK, MIN_CLOCK

READING, HALO, CONFIG = 0, 1, 2
#: Most settings of a lane.
SETTINGS = 16
CONFIG_CLOCK = -(2**63)
MAX_HEAVY = 500_000
TARGET_ROWS = 250_000
#: Rows of a task, and tasks of a shuffle from which tasks grow instead (each sorts on disk and is passed block by block).
ROWS_PER_TASK, MOST_TASKS = 1_500_000, 50_000
BLOCK_ROWS = 60_000
LANE_SCHEMA = "sid bigint, lane bigint, clock bigint, seq bigint, value double, tag tinyint"


def tasks(spark: SparkSession, rows: int) -> int:
    """Tasks of a shuffle of so many rows: what the session asks for, more where a task would hold too many."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-rows // ROWS_PER_TASK)))


def checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder the cluster names in spark.checkpoint.dir. Where none is named, a local session gets a folder
    of its own; on a cluster that is an error, since the executors share no other."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))


#: The folder of a local session that names none; deleted at the end of the program.
_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="tidewell-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return _own_folder[0]


def live(points: DataFrame, value: str = "value") -> DataFrame:
    """Rows that can be a current reading: sid and clock known, value neither null nor NaN (infinite ones stay)."""
    usable = F.col("sid").isNotNull() & F.col("clock").isNotNull() & F.col(value).isNotNull()
    if dict(points.dtypes)[value] in ("double", "float"):
        usable &= ~F.isnan(value)
    return points.filter(usable)


#: Clocks outside the valid domain lie in the first or last lane; so no span exceeds 64 bits.
CLAMPED = f"greatest({MIN_CLOCK}L, least({MAX_CLOCK}L, clock))"
#: Slices of time (some five days) that rows are counted in before series are cut; a slice itself is cut only if it is too dense.
SLICE_TICKS = 2**42
#: Lanes up to which a plan is written into the expressions of a query; a longer one is broadcast as a table.
WRITTEN_OUT = 100


@dataclass(frozen=True)
class LanePlan:
    """rows: rows of the table with sid and clock; heavy: the series that are split; levels: by round, (sid, lane, first
    clock, width, lanes) of each series or lane that is split in it; starts: of each split series its lanes in order;
    last: of each lane of a split series that has rows, its latest clock.

    A lane is named by the clock at which it starts, so lanes are in the order of time; that of other series is 0.
    """

    spark: SparkSession
    rows: int
    heavy: list[int] = field(default_factory=list)
    levels: list[list[tuple[int, int, int, int, int]]] = field(default_factory=list)
    starts: dict[int, list[int]] = field(default_factory=dict)
    last: dict[int, dict[int, int]] = field(default_factory=dict)

    @staticmethod
    def of(points: DataFrame, target_rows: int = TARGET_ROWS) -> LanePlan:
        """A series with more than target_rows rows is cut into slices of its time span, and slices in which rows
        crowd are cut again, until none has more than twice the target or a single clock.

        The table is read once, for a count by series and slice of time, which is kept (and recomputed if it is lost)
        until the plan is made. Only the rows of a slice that is too dense by itself are read again.
        """
        spark = points.sparkSession
        known = points.select("sid", "clock").filter(F.col("sid").isNotNull() & F.col("clock").isNotNull())
        raw = known.select("sid", "clock", F.lit(1).cast("long").alias("n"), F.expr(CLAMPED).alias("lo"), F.expr(CLAMPED).alias("hi"), F.col("clock").alias("last"))
        sizes = [F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("last").alias("last")]
        slices = raw.withColumn("clock", F.expr(f"lo div {SLICE_TICKS} * {SLICE_TICKS}")).groupBy("sid", "clock").agg(*sizes).persist()
        try:
            return LanePlan._cut(spark, raw, slices, sizes, target_rows)
        finally:
            slices.unpersist()

    @staticmethod
    def _cut(spark: SparkSession, raw: DataFrame, slices: DataFrame, sizes: list[Column], target_rows: int) -> LanePlan:
        rows = slices.agg(F.sum("n")).first()[0] or 0
        plan = LanePlan(spark, rows)
        target = max(target_rows, rows // MAX_HEAVY, 1)
        # at most MAX_HEAVY rows, by the choice of target
        found = slices.groupBy("sid").agg(*sizes).filter(F.col("n") > target).withColumn("lane", F.lit(0).cast("long")).toPandas()
        source, unit = slices, SLICE_TICKS
        while len(found):
            level = []
            for sid, lane, n, lo, hi in zip(*(found[c].tolist() for c in ("sid", "lane", "n", "lo", "hi")), strict=True):
                first, units = lo // unit * unit, hi // unit - lo // unit + 1
                if units > 1 and n > (2 * target if sid in plan.starts else target):
                    width = -(-units // min(units, -(-n // target)))
                    level.append((sid, lane, first, width * unit, -(-units // width)))
            if not level:
                if unit == 1:
                    break
                source, unit = raw, 1
                continue
            plan.levels.append(sorted(level))
            for sid, _, lo, width, parts in plan.levels[-1]:
                skip = 1 if sid in plan.starts else 0  # the first part of a lane keeps its name
                plan.starts.setdefault(sid, []).extend(lo + i * width for i in range(skip, parts))
            for s in plan.starts.values():
                s.sort()
            plan.heavy[:] = sorted(plan.starts)
            # a row for each lane of a split series: about twice MAX_HEAVY at most
            lanes = plan.with_lane(plan.only_heavy(source)).groupBy("sid", "lane").agg(*sizes).toPandas()
            plan.last.clear()
            for sid, lane, last in zip(*(lanes[c].tolist() for c in ("sid", "lane", "last")), strict=True):
                plan.last.setdefault(sid, {})[lane] = last
            whole = found[~found["sid"].isin(plan.heavy)]
            found = pd.concat([lanes, whole]) if len(whole) else lanes
        return plan

    def partitions(self) -> int:
        return tasks(self.spark, self.rows)

    def with_lane(self, df: DataFrame) -> DataFrame:
        """Adds ``lane`` to rows with sid and clock."""
        out = df.withColumn("lane", F.lit(0).cast("long"))
        for i, level in enumerate(self.levels):
            at = lambda lo, width, parts: f"least({parts} - 1, greatest(0L, ({CLAMPED} - {lo}) div {width}))"
            if len(level) <= WRITTEN_OUT:
                own = [f"when sid = {sid} and lane = {lane} {f'and {at(lo, width, parts)} > 0 ' if i else ''}then {lo} + {at(lo, width, parts)} * {width}" for sid, lane, lo, width, parts in level]
                out = out.withColumn("lane", F.expr(f"cast(case {' '.join(own)} else lane end as bigint)"))
                continue
            table = self.spark.createDataFrame(level, "sid bigint, lane bigint, _lo bigint, _width bigint, _lanes bigint")
            there = at("_lo", "_width", "_lanes")
            own = f"case when _lo is null then lane when {i} > 0 and {there} = 0 then lane else _lo + {there} * _width end"
            out = out.join(F.broadcast(table), ["sid", "lane"], "left").withColumn("lane", F.expr(own)).drop("_lo", "_width", "_lanes")
        return out

    def every_lane(self, df: DataFrame) -> DataFrame:
        """Repeats each row (keyed by sid) for every lane of its series."""
        if not self.heavy:
            return df.withColumn("lane", F.lit(0).cast("long"))
        if sum(map(len, self.starts.values())) <= WRITTEN_OUT:
            own = [f"when sid = {sid} then array({', '.join(f'{x}L' for x in starts)})" for sid, starts in self.starts.items()]
            return df.withColumn("lane", F.explode(F.expr(f"case {' '.join(own)} else array(0L) end")))
        table = self.spark.createDataFrame(list(self.starts.items()), "sid bigint, _starts array<bigint>")
        joined = df.join(F.broadcast(table), "sid", "left")
        return joined.withColumn("lane", F.explode(F.coalesce("_starts", F.array(F.lit(0).cast("long"))))).drop("_starts")

    def only_heavy(self, df: DataFrame) -> DataFrame:
        if len(self.heavy) <= WRITTEN_OUT:
            return df.filter(F.col("sid").isin(self.heavy))
        return df.join(F.broadcast(self.spark.createDataFrame([(s,) for s in self.heavy], "sid bigint")), "sid", "left_semi")

    def heavy_sids(self) -> set[int]:
        return set(self.heavy)


def with_position(points: DataFrame, plan: LanePlan | None = None, name: str = "at") -> DataFrame:
    """Adds the place of each row in its series, from 0 in the order of clock, without a task that holds a long series:
    rows are numbered in their lane, from the number of rows in the lanes before it."""
    plan = LanePlan.of(points) if plan is None else plan
    place = F.row_number().over(Window.partitionBy("sid", "lane").orderBy("clock")) - 1
    rows = plan.with_lane(points)
    if not plan.heavy:
        return rows.withColumn(name, place.cast("long")).drop("lane")
    sizes = plan.only_heavy(rows).groupBy("sid", "lane").count()
    before = F.sum("count").over(Window.partitionBy("sid").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("sid", "lane", F.coalesce(before, F.lit(0)).alias("_before"))
    # as many rows as there are lanes of split series: at most twice MAX_HEAVY
    return rows.join(F.broadcast(offsets), ["sid", "lane"], "left").withColumn(name, place + F.coalesce("_before", F.lit(0)).cast("long")).drop("lane", "_before")


def reading_rows(points: DataFrame, plan: LanePlan, value: Column | None = None) -> DataFrame:
    """Readings as lane rows. value: a number made from the columns of points; a null seq is below all others."""
    number = (F.col("value") if value is None else value).cast("double")
    # other columns are dropped first, so that their names cannot clash with those of the plan
    bare = live(points).select("sid", "clock", F.coalesce("seq", F.lit(CONFIG_CLOCK)).cast("long").alias("seq"), number.alias("value"))
    return plan.with_lane(live(bare)).select("sid", "lane", "clock", "seq", "value", F.lit(READING).cast("tinyint").alias("tag"))


def config_rows(settings: DataFrame, plan: LanePlan, columns: Iterable[str]) -> DataFrame:
    """One row for each lane of a sid and each of the columns that is not null; seq is the column's place."""
    entries = [F.struct(F.lit(i).cast("long").alias("seq"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)]
    long = settings.select("sid", F.explode(F.array(*entries)).alias("e")).select("sid", "e.seq", "e.value").filter("value is not null")
    return plan.every_lane(long).select("sid", "lane", F.lit(CONFIG_CLOCK).alias("clock"), "seq", "value", F.lit(CONFIG).cast("tinyint").alias("tag"))


def lane_pass(rows: DataFrame, plan: LanePlan, block: Callable[[dict[str, np.ndarray]], Iterator[pa.RecordBatch]], schema: str, order: tuple[str, ...] = ("clock", "seq", "value")) -> DataFrame:
    """One shuffle by (sid, lane), one sort, then ``block`` over blocks of whole lanes as numpy columns."""
    rows = rows.repartition(plan.partitions(), "sid", "lane").sortWithinPartitions("sid", "lane", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, ("sid", "lane")):
            yield from block(b)

    return rows.mapInArrow(run, schema)


def blocks(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], least: int = BLOCK_ROWS) -> Iterator[dict[str, np.ndarray]]:
    """Cuts a stream sorted by ``keys`` into blocks of whole groups with at least ``least`` rows each, as numpy columns."""
    return map(columns, groups(batches, keys, least))


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], least: int = BLOCK_ROWS) -> Iterator[list[pa.RecordBatch]]:
    """The blocks as batches."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < least:
            continue
        last = held[-1]
        tail = np.ones(last.num_rows, bool)
        for k in keys:
            tail &= last.column(k).to_numpy(zero_copy_only=False) == last.column(k)[last.num_rows - 1].as_py()
        cut = int(np.argmax(tail))
        if cut == 0:
            # the last group may begin in an earlier batch: cut at an earlier batch only if its end differs
            before = held[:-1]
            if before and any(before[-1].column(k)[before[-1].num_rows - 1].as_py() != last.column(k)[0].as_py() for k in keys):
                yield before
                held, n = [last], last.num_rows
            continue
        yield [*held[:-1], last.slice(0, cut)]
        held, n = [last.slice(cut)], last.num_rows - cut
    if held:
        yield held


def columns(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    t = pa.Table.from_batches(batches)
    return {c: t.column(c).to_numpy() for c in t.column_names}


def group_index(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: the group of each row, and the first row of each group."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new) - 1, np.flatnonzero(new)


def latest(g: np.ndarray, clock: np.ndarray) -> np.ndarray:
    """Mask of the last row of each (group, clock) in rows sorted by group, clock and seq: the current readings."""
    keep = np.ones(len(g), bool)
    keep[:-1] = (g[1:] != g[:-1]) | (clock[1:] != clock[:-1])
    return keep


@dataclass
class Block:
    """A block of lanes: the current readings (and halo rows) of each, and the settings by lane and column."""

    g: np.ndarray
    sid: np.ndarray
    clock: np.ndarray
    value: np.ndarray
    halo: np.ndarray
    config: np.ndarray
    lane_sid: np.ndarray
    lane: np.ndarray


def read_block(b: dict[str, np.ndarray], settings: int) -> Block:
    g, first = group_index(b["sid"], b["lane"])
    config = np.full((len(first), max(settings, 1)), np.nan)
    c = b["tag"] == CONFIG
    config[g[c], b["seq"][c]] = b["value"][c]
    r = np.flatnonzero(~c)
    r = r[latest(g[r], b["clock"][r])]
    return Block(g[r], b["sid"][r], b["clock"][r], b["value"][r], b["tag"][r] == HALO, config, b["sid"][first], b["lane"][first])


def batch(schema: pa.Schema, *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def lane_edges(rows: DataFrame, plan: LanePlan, before: int, after: int | None = None, together: bool = False) -> DataFrame:
    """HALO rows of the split series: for each lane the last readings before it and the first after it (as many as before).

    A pass over the split series alone keeps the first and last readings of each lane; a second one, over these, hands
    each lane its neighbours' (across as many empty or short lanes as it takes). It goes through the lanes of a series
    in order and holds no more of them than it still needs. together: rows are current readings in whole, sorted lanes.
    """
    after = before if after is None else after
    schema = pa.schema([("sid", pa.int64()), ("lane", pa.int64()), ("clock", pa.int64()), ("seq", pa.int64()), ("value", pa.float64()), ("tag", pa.int8())])

    def ends(b: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        x = read_block(b, SETTINGS)
        n = len(x.g)
        size = np.bincount(x.g, minlength=len(x.lane_sid))
        start = np.cumsum(size) - size
        place = np.arange(n) - start[x.g]
        keep = (place < after) | (place >= size[x.g] - before)
        yield batch(schema, x.sid[keep], x.lane[x.g[keep]], x.clock[keep], np.zeros(keep.sum(), np.int64), x.value[keep], np.full(keep.sum(), HALO, np.int8))

    starts = plan.starts

    def hand_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sid, done = None, 0
        held = {c: np.zeros(0) for c in ("lane", "clock", "value")}

        def give(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal done, held
            lane = held["lane"]
            while sid is not None and done < len(starts[sid]):
                at = starts[sid][done]
                p, q = np.searchsorted(lane, at, "left"), np.searchsorted(lane, at, "right")
                if not final and (q == len(lane) or len(lane) - q < after):
                    break
                take = np.r_[max(0, p - before) : p, q : min(len(lane), q + after)]
                if m := len(take):
                    yield batch(schema, np.full(m, sid), np.full(m, at), held["clock"][take], np.zeros(m, np.int64), held["value"][take], np.full(m, HALO, np.int8))
                done += 1
            if not final and done < len(starts[sid]):
                p = max(0, int(np.searchsorted(lane, starts[sid][done], "left")) - before)
                held = {c: v[p:] for c, v in held.items()}

        for b in batches:
            t = columns([b])
            _, first = group_index(t["sid"])
            for a, z in zip(first, np.r_[first[1:], b.num_rows], strict=True):
                if t["sid"][a] != sid:
                    yield from give(True)
                    sid, done, held = int(t["sid"][a]), 0, {c: t[c][:0] for c in held}
                held = {c: np.concatenate([v, t[c][a:z]]) for c, v in held.items()}
                yield from give(False)
        yield from give(True)

    if together:
        edges = rows.mapInArrow(lambda batches: (e for b in blocks(batches, ("sid", "lane")) for e in ends(b)), LANE_SCHEMA)
    else:
        edges = lane_pass(plan.only_heavy(rows), plan, ends, LANE_SCHEMA)
    return edges.repartition("sid").sortWithinPartitions("sid", "lane", "clock").mapInArrow(hand_over, LANE_SCHEMA)


def last_clocks(plan: LanePlan) -> DataFrame:
    """HALO rows of the split series: for each lane the latest clock before it, without its value. The plan must have
    been made of rows that can be current readings. At most as many rows as there are lanes."""
    out = []
    for sid, starts in plan.starts.items():
        seen = None
        for lane in starts:
            if seen is not None:
                out.append((sid, lane, seen, 0, 0.0, HALO))
            seen = plan.last[sid].get(lane, seen)
    return plan.spark.createDataFrame(out, LANE_SCHEMA)
