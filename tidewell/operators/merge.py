"""Merging and filtering points: unique on (sid, clock), where the write with the highest seq wins."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.clock import MAX_CLOCK, MIN_CLOCK
from tidewell.operators import changefeed, lanes

#: Sids of a list up to which it becomes a predicate that is pushed to the scan; a longer one becomes a semi join.
PUSHED_SIDS = 1000


def last_write_wins(points: DataFrame, order: Iterable[str | Column] = ("seq",)) -> DataFrame:
    """The last write of each (sid, clock), by ``order`` ascending. One shuffle by (sid, clock), which no hot series skews."""
    by = [(F.col(c) if isinstance(c, str) else c).desc() for c in order]
    w = Window.partitionBy("sid", "clock").orderBy(*by)
    return points.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def merge_layers(layers: list[DataFrame], order: Iterable[str] = ("seq",)) -> DataFrame:
    """Union of layers (files, cache, shards, databases); of equal (sid, clock) the last layer wins, in it the last write."""
    tagged = [d.withColumn("_layer", F.lit(i)) for i, d in enumerate(layers)]
    return last_write_wins(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged), ("_layer", *order)).drop("_layer")


def upsert(points: DataFrame, new: DataFrame) -> DataFrame:
    """Adds points; those that are there already are overwritten."""
    return merge_layers([points, new])


def append(points: DataFrame, new: DataFrame) -> DataFrame:
    """Adds points without a look at those that are there."""
    return points.unionByName(new)


def of_sids(df: DataFrame, sids: Iterable[int] | DataFrame) -> DataFrame:
    """Rows of the given sids. A short list is pushed to the scan; a long one, or a table, is a semi join."""
    if isinstance(sids, DataFrame):
        return df.join(sids.select("sid").distinct(), "sid", "left_semi")
    wanted = sorted(set(sids))
    if len(wanted) <= PUSHED_SIDS:
        return df.filter(F.col("sid").isin(wanted))
    return of_sids(df, df.sparkSession.createDataFrame([(s,) for s in wanted], "sid bigint"))


def registered(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of registered sids; others are ignored without a word."""
    return of_sids(df, registry.filter("sid is not null"))


def include(df: DataFrame, lo: int = MIN_CLOCK, hi: int = MAX_CLOCK) -> DataFrame:
    """Rows with lo <= clock <= hi."""
    return df.filter(F.col("clock").between(lo, hi))


def exclude(df: DataFrame, lo: int, hi: int) -> DataFrame:
    """Rows outside lo <= clock <= hi."""
    return df.filter(~F.col("clock").between(lo, hi))


def read_range(points: DataFrame, sids: Iterable[int] | DataFrame, lo: int = MIN_CLOCK, hi: int = MAX_CLOCK, order: Iterable[str] = ("seq",)) -> DataFrame:
    """Current points of some sids in an inclusive range of clocks. A range that meets no point gives an empty result."""
    return last_write_wins(include(of_sids(points, sids), lo, hi), order)


def apply_tombstones(points: DataFrame, tombs: DataFrame) -> DataFrame:
    """Points without those that a later tombstone (sid, min_clock, max_clock, seq) covers; null bounds are open.

    Tombstones become keys that rows are joined with by equality, so neither a hot series nor one with many tombstones
    is held against each of them. Points without sid, clock or seq are kept.
    """
    return changefeed.drop_deleted(points, tombs.select("sid", F.col("min_clock").alias("lo"), F.col("max_clock").alias("hi"), "seq"))


def delete_range(points: DataFrame, sids: Iterable[int], lo: int = MIN_CLOCK, hi: int = MAX_CLOCK) -> DataFrame:
    """Points that remain when those of the sids from lo to hi are deleted, at once and everywhere."""
    return points.filter(~(F.col("sid").isin(sorted(set(sids))) & F.col("clock").between(lo, hi)) | F.col("sid").isNull())


def position_slice(points: DataFrame, start: int, count: int) -> DataFrame:
    """Of each series the points at the places start, start + 1, ... (from 0), in clock order."""
    return lanes.with_position(points, name="_at").filter(F.col("_at").between(start, start + count - 1)).drop("_at")


def remove_positions(points: DataFrame, start: int, count: int = 1) -> DataFrame:
    """Each series without the points at the places start to start + count - 1 (from 0), in clock order."""
    return lanes.with_position(points, name="_at").filter(~F.col("_at").between(start, start + count - 1)).drop("_at")


def positions_of(points: DataFrame, asked: DataFrame) -> DataFrame:
    """For each distinct asked (sid, clock) the place of the first point there in its series, -1 if there is none."""
    placed = lanes.with_position(points.select("sid", "clock"), name="_at").groupBy("sid", "clock").agg(F.min("_at").alias("at"))
    return asked.select("sid", "clock").distinct().join(placed, ["sid", "clock"], "left").select("sid", "clock", F.coalesce("at", F.lit(-1)).cast("long").alias("at"))


def contains_points(points: DataFrame, asked: DataFrame) -> DataFrame:
    """For each distinct asked (sid, clock) whether there is a point."""
    there = points.select("sid", "clock").distinct().withColumn("found", F.lit(True))
    return asked.select("sid", "clock").distinct().join(there, ["sid", "clock"], "left").select("sid", "clock", F.coalesce("found", F.lit(False)).alias("found"))


def predecessors(points: DataFrame, asked: DataFrame, target_rows: int = lanes.TARGET_ROWS) -> DataFrame:
    """Extension: for each asked (sid, clock) the nearest point at or before it (point_clock, value), null if there is none.

    One sorted pass over both sides together, lane by lane; no range join. The last point of each lane of a split
    series is handed to the lanes behind it.
    """
    kind = f"struct<point_clock:bigint,value:{dict(points.dtypes)['value']}>"
    both = points.select("sid", "clock", F.struct(F.col("clock").alias("point_clock"), "value").alias("p"), F.lit(0).alias("_ask")).unionByName(
        asked.select("sid", "clock", F.lit(None).cast(kind).alias("p"), F.lit(1).alias("_ask"))
    )
    plan = lanes.LanePlan.of(both.select("sid", "clock"), target_rows)
    both = plan.with_lane(both)
    w = Window.partitionBy("sid", "lane").orderBy("clock", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("p", F.last("p", ignorenulls=True).over(w)).filter("_ask = 1")
    if plan.heavy:
        last = plan.only_heavy(both).groupBy("sid", "lane").agg(F.max(F.when(F.col("_ask") == 0, F.struct("clock", "p"))).alias("last"))
        earlier = Window.partitionBy("sid").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
        carried = last.select("sid", "lane", F.last("last.p", ignorenulls=True).over(earlier).alias("_carried"))
        # as many rows as there are lanes of split series
        found = found.join(F.broadcast(carried), ["sid", "lane"], "left").withColumn("p", F.coalesce("p", "_carried"))
    return found.select("sid", "clock", "p.point_clock", "p.value")


def sorted_series(points: DataFrame) -> DataFrame:
    """All points in the order of sid and clock, by ranges of both, so that a long series is spread over tasks."""
    return points.repartitionByRange("sid", "clock").sortWithinPartitions("sid", "clock")
