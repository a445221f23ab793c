"""Which files to compact: a query over file metadata, one plan for each shard.

files: shard, generation, sequence, n_bytes, has_tombstone, full_blocks. Files of a generation count as one;
its level is its last sequence, at most 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP_LEVEL = 4
LARGEST_FILE = 2_147_483_648
#: Ticks without a write after which a shard is compacted in full.
COLD_TICKS = 4 * 3600 * 10_000_000


def generations(files: DataFrame) -> DataFrame:
    """(shard, generation, level, n_files, n_bytes, has_tombstone, full_blocks)."""
    return files.groupBy("shard", "generation").agg(
        F.least(F.lit(TOP_LEVEL), F.max("sequence")).cast("int").alias("level"),
        F.count(F.lit(1)).alias("n_files"),
        F.sum("n_bytes").alias("n_bytes"),
        F.max("has_tombstone").alias("has_tombstone"),
        F.min("full_blocks").alias("full_blocks"),
    )


def _groups(gens: DataFrame, level: int, chunk: int) -> DataFrame:
    """Runs of neighbouring generations of one level, in chunks; a chunk stays if it is full or has a tombstone."""
    w = Window.partitionBy("shard").orderBy("generation")
    shard = Window.partitionBy("shard")
    marked = gens.withColumns({"new": F.coalesce((F.col("level") != F.lag("level").over(w)).cast("int"), F.lit(1)), "all": F.count(F.lit(1)).over(shard), "tombs": F.max("has_tombstone").over(shard)})
    runs = marked.withColumn("run", F.sum("new").over(w)).filter((F.col("level") == level) & ((F.col("all") > 1) | F.col("tombs")))
    at = F.row_number().over(Window.partitionBy("shard", "run").orderBy("generation")) - 1
    chunks = runs.withColumn("chunk", F.floor(at / chunk).cast("int"))
    grouped = chunks.groupBy("shard", "run", "chunk").agg(
        F.array_sort(F.collect_list("generation")).alias("generations"), F.sum("n_bytes").alias("n_bytes"), F.max("has_tombstone").alias("has_tombstone")
    )
    return grouped.filter((F.size("generations") >= chunk) | F.col("has_tombstone")).select("shard", F.lit(level).alias("level"), "generations", "n_bytes")


def plan_level(files: DataFrame, level: int) -> DataFrame:
    """(shard, level, generations, n_bytes) of the groups of a level 1 to 3: chunks of 8 generations in level 1, else of 4."""
    return _groups(generations(files), level, 8 if level == 1 else 4)


def plan_optimize(files: DataFrame) -> DataFrame:
    """Groups of four neighbouring generations of the top level."""
    return _groups(generations(files), TOP_LEVEL, 4)


def plan_full(files: DataFrame, now: int, last_write: int, force: bool = False) -> DataFrame:
    """All generations of each shard as one group, if forced or no write came for COLD_TICKS; without those that are
    above LARGEST_FILE, have full blocks and no tombstone. A single compacted generation needs nothing."""
    gens = generations(files).filter(F.lit(force or now - last_write > COLD_TICKS))
    left = gens.filter(~((F.col("n_bytes") > LARGEST_FILE) & F.col("full_blocks") & ~F.col("has_tombstone")))
    grouped = left.groupBy("shard").agg(
        F.array_sort(F.collect_list("generation")).alias("generations"), F.sum("n_bytes").alias("n_bytes"), F.max("has_tombstone").alias("tombs"), F.sum("n_files").alias("files")
    )
    return grouped.filter("files > 1 or tombs").select("shard", F.lit(TOP_LEVEL).alias("level"), "generations", "n_bytes")


def fully_compacted(files: DataFrame) -> DataFrame:
    """(shard, done): at most one generation, and no tombstone."""
    return generations(files).groupBy("shard").agg(((F.count(F.lit(1)) <= 1) & ~F.max("has_tombstone")).alias("done"))
