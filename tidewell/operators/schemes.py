"""How blocks of points would be encoded: the choice of scheme and the sizes that follow from it, as plain expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import codes
from tidewell.operators import lanes
from tidewell.operators.measures import POINTS_PER_BLOCK

LARGEST_PACKED = 2**60 - 1
#: Divisors of timestamp deltas that are tried, largest first.
DIVISOR_POWERS = tuple(range(12, -1, -1))


def blocked(points: DataFrame, value: str, block: int) -> DataFrame:
    """(sid, block_no, at, x, delta): values of each block in clock order, with the change from the one before it in the block."""
    at = lanes.with_position(points.select("sid", "clock", F.col(value).cast("long").alias("x")), name="n")
    inside = Window.partitionBy("sid", "block_no").orderBy("n")
    return at.select("sid", F.expr(f"n div {block}").alias("block_no"), "n", "x").withColumn("delta", F.col("x") - F.lag("x").over(inside))


def timestamp_schemes(points: DataFrame, block: int = POINTS_PER_BLOCK) -> DataFrame:
    """(sid, block_no, n_points, scheme, divisor_power) of the clocks of each block.

    Equal deltas (of two clocks or more): RLE. Else, a delta above 2**60 - 1: RAW. Else SIMPLE8B of the deltas,
    divided by the largest power of ten up to 10**12 that divides them all; a single clock has power 12.
    """
    # the power of ten that divides a delta; of 0 all do
    power = F.expr("case " + " ".join(f"when delta % {10**p}L = 0 then {p}" for p in DIVISOR_POWERS) + " end")
    b = blocked(points, "clock", block).groupBy("sid", "block_no").agg(
        F.count(F.lit(1)).alias("n_points"), F.min("delta").alias("lo"), F.max("delta").alias("hi"), F.min(F.when(F.col("delta").isNotNull(), power)).alias("p")
    )
    scheme = F.expr(f"case when n_points > 1 and lo = hi then 'RLE' when hi > {LARGEST_PACKED} then 'RAW' else 'SIMPLE8B' end")
    chosen = b.select("sid", "block_no", "n_points", scheme.alias("scheme"), F.coalesce("p", F.lit(12)).alias("p"))
    return chosen.select("sid", "block_no", "n_points", "scheme", F.expr("case when scheme = 'RAW' then 0 else p end").cast("int").alias("divisor_power"))


def integer_schemes(points: DataFrame, value: str = "value", block: int = POINTS_PER_BLOCK) -> DataFrame:
    """(sid, block_no, n_points, scheme) of whole numbers, by the zigzag codes of their deltas.

    Equal deltas of more than two values: RLE. Else, a code above 2**60 - 1: RAW. Else SIMPLE8B.
    """
    b = blocked(points, value, block).withColumn("z", codes.zigzag(F.col("delta"))).groupBy("sid", "block_no").agg(
        F.count(F.lit(1)).alias("n_points"), F.min("z").alias("lo"), F.max("z").alias("hi")
    )
    scheme = F.expr(f"case when n_points > 2 and lo = hi then 'RLE' when lo < 0 or hi > {LARGEST_PACKED} then 'RAW' else 'SIMPLE8B' end")
    return b.select("sid", "block_no", "n_points", scheme.alias("scheme"))


def boolean_sizes(points: DataFrame, block: int = POINTS_PER_BLOCK) -> DataFrame:
    """(sid, block_no, n_points, n_bytes): a byte, the count as a signed varint, and a bit for each value."""
    b = blocked(points, "clock", block).groupBy("sid", "block_no").agg(F.count(F.lit(1)).alias("n_points"))
    return b.withColumn("n_bytes", (1 + codes.signed_varint_size(F.col("n_points")) + F.ceil(F.col("n_points") / 8)).cast("long"))


def string_sizes(points: DataFrame, block: int = POINTS_PER_BLOCK) -> DataFrame:
    """(sid, block_no, n_points, n_bytes): of length-prefixed UTF-8 values, before compression."""
    one = F.octet_length("value").cast("long")
    at = lanes.with_position(points.select("sid", "clock", (one + codes.signed_varint_size(one)).alias("bytes")), name="n")
    return at.groupBy("sid", F.expr(f"n div {block}").alias("block_no")).agg(F.count(F.lit(1)).alias("n_points"), F.sum("bytes").alias("n_bytes"))
