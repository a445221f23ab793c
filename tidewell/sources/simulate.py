"""Generated points: one of each sid at one clock in each batch. Rows follow from the seed, in any number of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def simulate(spark: SparkSession, kind: str = "double", sids: int = 50_000, batches: int = 1, start: int = 637_021_734_000_000_000, step: int = 10_000_000, seed: int = 0) -> DataFrame:
    """(sid 1..sids, clock, value, quality 0, seq: the batch). kind: double in [0, 1), integer (not negative), boolean or constant (false)."""
    h = F.xxhash64(F.lit(seed), "id")
    value = {
        "double": F.shiftrightunsigned(h, 11) / F.lit(float(2**53)), "integer": F.pmod(h, F.lit(2**31)), "boolean": F.pmod(h, F.lit(2)) == 1, "constant": F.lit(False),
    }[kind]
    batch = F.expr(f"id div {sids}")
    return spark.range(sids * batches).select((F.pmod("id", F.lit(sids)) + 1).alias("sid"), (F.lit(start) + batch * step).alias("clock"), value.alias("value"), F.lit(0).alias("quality"), batch.alias("seq"))
