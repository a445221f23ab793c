"""A table kept as insert files and equality-delete files, each row with its sequence number.

    <path>/_manifest/v-N.json                the commits that the table consists of
    <path>/commit=N/part=inserts/            sid, clock, value, quality, seq
    <path>/commit=N/part=nodes/              sid, level, node, seq: whole buckets of clocks, as dyadic nodes
    <path>/commit=N/part=ends/               sid, node (bucket), lo, hi, seq: ends of ranges within a bucket

Appending never reads; repeated and late changes are appended like any others. Readers drop the rows for which
a delete with a higher sequence number exists, and keep the latest insert of each (sid, clock). A commit is one write,
and is seen as a whole once the manifest names it; there is one writer at a time, which the manifest makes sure of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import changefeed
from tidewell.sources.files import Files, Manifest

INSERTS = ("sid", "clock", "value", "quality", "seq")
STORED = "sid bigint, clock bigint, value double, quality int, level int, node bigint, lo bigint, hi bigint, seq bigint, commit int, part string"


class DeltaTable:
    def __init__(self, spark: SparkSession, path: str, bucket_ticks: int = changefeed.BUCKET_TICKS):
        self.spark, self.path, self.bucket_ticks, self.files = spark, path.rstrip("/"), bucket_ticks, Files(spark)
        self.manifest = Manifest(self.files, self.path)

    def _state(self) -> dict:
        return self.manifest.read() or {"commits": [], "next": 1, "retired": []}

    def append(self, feed: DataFrame) -> int:
        """Adds changes (as changefeed.split_changes takes them) as one commit; its number."""
        state = self._state()
        inserts, deletes = changefeed.split_changes(feed)
        keys = changefeed.delete_entries(deletes, self.bucket_ticks).withColumn("part", F.expr("if(level >= 0, 'nodes', 'ends')"))
        rows = inserts.withColumn("part", F.lit("inserts")).unionByName(keys, allowMissingColumns=True)
        return self._commit(state, rows, state["commits"])

    def _commit(self, state: dict, rows: DataFrame, before: list[int]) -> int:
        n = state["next"]
        at = f"{self.path}/commit={n}"
        self.files.delete(at)  # of a commit that was cut off
        names = [c.split()[0] for c in STORED.split(", ")][:-2]
        full = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in names], "part")
        full.write.partitionBy("part").parquet(at)
        gone = [c for c in state["commits"] if c not in before]
        self.manifest.write({"commits": [*before, n], "next": n + 1, "retired": gone or state["retired"]})
        return n

    def _read(self, state: dict, part: str) -> DataFrame:
        there = [f"{self.path}/commit={c}" for c in state["commits"]]
        stored = self.spark.read.schema(STORED).option("basePath", self.path).parquet(*there) if there else self.spark.createDataFrame([], STORED)
        return stored.filter(F.col("part") == part)

    def read(self) -> DataFrame:
        """The current rows: sid, clock, value, quality, seq."""
        state = self._state()
        nodes = self._read(state, "nodes").groupBy("sid", "level", "node").agg(F.max("seq").alias("seq"))
        ends = self._read(state, "ends").select("sid", F.col("node").alias("bucket"), "lo", "hi", "seq")
        return changefeed.rows_not_deleted(self._read(state, "inserts").select(*INSERTS), nodes, ends, self.bucket_ticks, ties=("value", "quality"))

    def compact(self) -> None:
        """Replaces all commits by one with the current rows as inserts, and forgets the deletes.

        Only once no change with a lower sequence number can still arrive: a late write would not be hidden any more.
        What was replaced is deleted by the next compaction, so that readers that began before can end.
        """
        state = self._state()
        for old in state["retired"]:
            self.files.delete(f"{self.path}/commit={old}")
        self._commit(state | {"retired": []}, self.read().withColumn("part", F.lit("inserts")), [])
