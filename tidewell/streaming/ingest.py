"""Structured Streaming: upserting streams of points, windowed calculators on late data, current values, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from tidewell.functions.clock import timestamp_of
from tidewell.sources.store import Store


def upsert_stream(points: DataFrame, store: Store, checkpoint: str, name: str = "ingest", db: str | None = None, now: int | None = None, available_now: bool = False) -> StreamingQuery:
    """Writes each micro-batch to the store. The number of the batch becomes visible in one step with its points, so a batch
    that was written before a restart, or before a crash at any place, is not written again."""

    def write(batch: DataFrame, epoch: int) -> None:
        if not store.epoch_done(name, epoch):
            store.write(batch, db, now, epoch=(name, epoch))

    out = points.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (out.trigger(availableNow=True) if available_now else out).start()


def windowed(points: DataFrame, late: str, width: str, slide: str | None = None) -> DataFrame:
    """(sid, window_start, window_end, average, maximum, n_points) of tumbling or sliding windows of a stream of points;
    readings later than ``late`` are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        points.withColumn("ts", timestamp_of("clock"))
        .withWatermark("ts", late)
        .groupBy("sid", w)
        .agg(F.avg("value").alias("average"), F.max("value").alias("maximum"), F.count(F.lit(1)).alias("n_points"))
        .select("sid", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "average", "maximum", "n_points")
    )


def distinct_changes(points: DataFrame, late: str) -> DataFrame:
    """A stream without the repeats of a change (same seq) that come within ``late``."""
    return points.withColumn("ts", timestamp_of("clock")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["seq"]).drop("ts")


def current_values(points: DataFrame) -> DataFrame:
    """(sid, clock, value, seq) of the newest reading of each series, whenever a batch has changed it (output mode update).
    Rows without clock, value or seq are set aside; of one clock the highest seq counts. The state is one row a series."""
    newest = F.max_by(F.struct("clock", "value", "seq"), F.struct("clock", "seq")).alias("newest")
    return points.filter("clock is not null and value is not null and seq is not null").groupBy("sid").agg(newest).select("sid", "newest.clock", F.col("newest.value").cast("double").alias("value"), "newest.seq")


class Progress(StreamingQueryListener):
    """Counts batches and rows of all queries of a session."""

    def __init__(self) -> None:
        self.counters = {"started": 0, "batches": 0, "rows": 0, "ended": 0}

    def onQueryStarted(self, event) -> None:
        self.counters["started"] += 1

    def onQueryProgress(self, event) -> None:
        self.counters["batches"] += 1
        self.counters["rows"] += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.counters["ended"] += 1
