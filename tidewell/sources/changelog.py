"""A log of changes in segments of Parquet: writes, deletes and range deletes, each with its sequence number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import changefeed
from tidewell.sources.files import Files

LOG_DDL = "seq bigint, kind string, sid bigint, clock bigint, value double, quality int, min_clock bigint, max_clock bigint"


class ChangeLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, Files(spark)

    def segments(self) -> list[str]:
        return [e.path for e in self.files.entries(self.path) if e.is_dir and e.name.startswith("segment-")]

    def append(self, changes: DataFrame) -> str:
        """Writes one closed segment; columns of LOG_DDL that are missing are null."""
        names = {c.split()[0]: c.split()[1] for c in LOG_DDL.split(", ")}
        full = changes.select(*[(F.col(c) if c in changes.columns else F.lit(None)).cast(t).alias(c) for c, t in names.items()])
        last = max((int(s.rsplit("-", 1)[1]) for s in self.segments()), default=0)
        at = f"{self.path}/segment-{last + 1:09d}"
        full.write.mode("errorifexists").parquet(at)
        return at

    def write(self, points: DataFrame) -> str:
        return self.append(points.withColumn("kind", F.lit("write")))

    def delete(self, sids: list[int], seq: int) -> str:
        return self.append(self.spark.createDataFrame([(seq, "delete", s) for s in sids], "seq bigint, kind string, sid bigint"))

    def delete_range(self, sids: list[int], lo: int | None, hi: int | None, seq: int) -> str:
        return self.append(self.spark.createDataFrame([(seq, "delete_range", s, lo, hi) for s in sids], "seq bigint, kind string, sid bigint, min_clock bigint, max_clock bigint"))

    def read(self) -> DataFrame:
        found = self.segments()
        return self.spark.read.schema(LOG_DDL).parquet(*found) if found else self.spark.createDataFrame([], LOG_DDL)

    def replay(self) -> DataFrame:
        """The table the log leads to: sid, clock, value, quality, seq."""
        return changefeed.current_table(self.read())

    def remove(self, segments: list[str]) -> None:
        for s in segments:
            self.files.delete(s)

    def n_bytes(self) -> int:
        return sum(e.n_bytes for e in self.files.walk(self.path) if e.name.endswith(".parquet"))
