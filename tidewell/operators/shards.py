"""Shards: slices of time whose width follows from the retention period, and the predicates that prune them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.clock import TICKS_PER_DAY, TICKS_PER_SECOND

#: Retention below so many days, and seconds of a shard; above the last, LONGEST.
WIDTHS = ((2, 3600), (180, 86400), (700, 604800))
LONGEST = 2_628_000


def width_seconds(days: int) -> int:
    return next((w for limit, w in WIDTHS if days < limit), LONGEST)


def width_column(days: str = "rp_days") -> Column:
    """Ticks of a shard by a column of retention days."""
    return F.expr("case " + " ".join(f"when {days} < {limit} then {w * TICKS_PER_SECOND}L" for limit, w in WIDTHS) + f" else {LONGEST * TICKS_PER_SECOND}L end")


def shard_start(days: int, clock: str = "clock") -> Column:
    """Start of the shard a clock lies in; shards are counted from tick 0, whatever their width."""
    w = width_seconds(days) * TICKS_PER_SECOND
    return F.col(clock) - F.pmod(F.col(clock), F.lit(w))


def route_to_shards(points: DataFrame, days: int) -> DataFrame:
    return points.withColumns({"rp_days": F.lit(days), "shard_start": shard_start(days)})


def pruned(points: DataFrame, days: int, lo: int, hi: int) -> DataFrame:
    """Rows with lo <= clock <= hi of a table partitioned by shard_start, whose directories are pruned by the range."""
    w = width_seconds(days) * TICKS_PER_SECOND
    return points.filter(F.col("shard_start").between(lo - lo % w, hi) & F.col("clock").between(lo, hi))


def shard_table(points: DataFrame, days: int) -> DataFrame:
    """(rp_days, shard_id, start, end, n_points): shards that hold points, numbered from 1 in the order of time."""
    w = width_seconds(days) * TICKS_PER_SECOND
    starts = points.groupBy(shard_start(days).alias("start")).agg(F.count(F.lit(1)).alias("n_points"))
    # a shard table is small: as many rows as there are slices of time
    number = F.expr("row_number() over (order by start)")
    return starts.select(F.lit(days).alias("rp_days"), number.cast("long").alias("shard_id"), "start", (F.col("start") + w).alias("end"), "n_points")


def overlaps(lo: int, hi: int, start: str = "min_clock", end: str = "max_clock") -> Column:
    """Whether an inclusive interval of a row meets [lo, hi]."""
    return (F.col(start) <= hi) & (F.col(end) >= lo)


def shards_in(shards: DataFrame, lo: int, hi: int) -> DataFrame:
    """Shards [start, end) that meet the inclusive range."""
    return shards.filter((F.col("start") <= hi) & (F.col("end") > lo))


def expired(clock: str, days: Column | int, now: int) -> Column:
    """Strictly later than its days after its clock; a point exactly that old is kept."""
    return F.lit(now) > F.col(clock) + (F.lit(days) if isinstance(days, int) else days) * TICKS_PER_DAY


def expire_points(points: DataFrame, days: int, now: int) -> DataFrame:
    """Points that are not expired, or whose shard is still there (its end is not expired)."""
    w = width_seconds(days) * TICKS_PER_SECOND
    kept = shard_start(days) + w + days * TICKS_PER_DAY >= F.lit(now)
    return points.filter(~expired("clock", days, now) | kept)


def expire_shards(shards: DataFrame, days: int, now: int) -> DataFrame:
    """Shards that are kept: those whose end is not expired."""
    return shards.filter(~expired("end", days, now))


def is_old(now: int) -> Column:
    """Whether a shard takes no more points: it has ended."""
    return F.col("end") <= now


def in_time_order(rows: DataFrame, name: str, start: str = "min_clock", end: str = "max_clock") -> DataFrame:
    """Adds ``place``: the number of a file, block or shard in the order of time, from 1; for listings, which are small."""
    return rows.withColumn("place", F.expr(f"row_number() over (order by {start}, {end}, {name})").cast("long"))
