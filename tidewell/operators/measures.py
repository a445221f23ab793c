"""Measures of series, blocks, files and shards, and the calculators over fixed intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.clock import MAX_CLOCK, MIN_CLOCK, TICKS_PER_SECOND
from tidewell.operators import changefeed, lanes, merge, model

POINTS_PER_BLOCK = 1000


def series_stats(points: DataFrame) -> DataFrame:
    """(sid, min_clock, max_clock, n_points) of each series that has points."""
    return points.groupBy("sid").agg(F.min("clock").alias("min_clock"), F.max("clock").alias("max_clock"), F.count(F.lit(1)).alias("n_points"))


def registered_bounds(points: DataFrame, registry: DataFrame) -> DataFrame:
    """As series_stats for every registered sid; one without points has the bounds of an empty series (min above max)."""
    stats = registry.filter("sid is not null").select("sid").distinct().join(series_stats(points), "sid", "left")
    return stats.select("sid", F.coalesce("min_clock", F.lit(MAX_CLOCK)).alias("min_clock"), F.coalesce("max_clock", F.lit(MIN_CLOCK)).alias("max_clock"), F.coalesce("n_points", F.lit(0)).alias("n_points"))


def series_bytes(points: DataFrame) -> DataFrame:
    """(sid, n_bytes): bytes of the first point times the number of points."""
    return points.groupBy("sid").agg((F.min_by(model.point_bytes(), "clock") * F.count(F.lit(1))).cast("long").alias("n_bytes"))


def block_index(points: DataFrame, block: int = POINTS_PER_BLOCK) -> DataFrame:
    """(sid, block_no, min_clock, max_clock, n_points): each series cut into blocks of ``block`` points in clock order."""
    numbered = lanes.with_position(points.select("sid", "clock"))
    return numbered.groupBy("sid", F.expr(f"at div {block}").alias("block_no")).agg(F.min("clock").alias("min_clock"), F.max("clock").alias("max_clock"), F.count(F.lit(1)).alias("n_points"))


def may_contain(blocks: DataFrame, asked: DataFrame, tombs: DataFrame | None = None) -> DataFrame:
    """Of asked (sid, clock) those that lie within a block of their series and under no tombstone.

    The blocks of a series do not overlap but in their ends, so the last one that begins at or before a clock tells. It is
    found in one sorted pass, in which long series are cut; tombstones are applied as keys.
    """
    begins = blocks.select("sid", F.col("min_clock").alias("clock"), "max_clock").groupBy("sid", "clock").agg(F.max("max_clock").alias("value"))
    found = merge.predecessors(begins, asked.select("sid", "clock")).filter(F.col("value") >= F.col("clock")).select("sid", "clock")
    if tombs is not None:
        deletes = tombs.select("sid", F.col("min_clock").alias("lo"), F.col("max_clock").alias("hi"), F.lit(1).cast("long").alias("seq"))
        found = changefeed.drop_deleted(found.withColumn("seq", F.lit(0).cast("long")), deletes).select("sid", "clock")
    return found


def file_stats(points: DataFrame, file: str) -> DataFrame:
    """(file, min_clock, max_clock, min_sid, max_sid, n_points) by a column that names the file of a row."""
    return points.groupBy(F.col(file).alias("file")).agg(
        F.min("clock").alias("min_clock"), F.max("clock").alias("max_clock"), F.min("sid").alias("min_sid"), F.max("sid").alias("max_sid"), F.count(F.lit(1)).alias("n_points")
    )


def stored_file_stats(points: DataFrame) -> DataFrame:
    """file_stats with size and time of change of the files a table is read from."""
    meta = points.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"), F.col("_metadata.file_modification_time").alias("_changed"))
    size = meta.groupBy(F.col("_file").alias("file")).agg(F.max("_size").alias("n_bytes"), F.max("_changed").alias("changed"))
    return file_stats(meta, "_file").join(size, "file")


def downsample(points: DataFrame, seconds: int, calculator: str) -> DataFrame:
    """Extension: (sid, interval_start, value, n_points) of each interval with readings; calculator: average, maximum, minimum, sum, count, first or last."""
    w = seconds * TICKS_PER_SECOND
    make = {
        "average": F.avg("value"), "maximum": F.max("value"), "minimum": F.min("value"), "sum": F.sum("value"), "count": F.count("value").cast("double"),
        "first": F.min_by("value", "clock"), "last": F.max_by("value", "clock"),
    }
    return points.groupBy("sid", (F.col("clock") - F.pmod("clock", F.lit(w))).alias("interval_start")).agg(make[calculator].alias("value"), F.count(F.lit(1)).alias("n_points"))
