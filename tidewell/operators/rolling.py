"""Rolling totals over trailing days: range frames over integer day numbers on sparse daily totals.

Inactive days come from calendar rows with a total of 0, so that a frame always covers the same number of
days and the denominators are fixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators import lanes

DAY_TICKS = 864_000_000_000
#: Rows of a lookup table up to which it is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def lookup(df: DataFrame, side: DataFrame, key: str, broadcast_rows: int = BROADCAST_ROWS, salts: int = 64) -> DataFrame:
    """Inner join with a table that has one row for each key.

    Broadcast if the table is counted to have at most broadcast_rows rows; else the rows are salted over
    ``salts`` copies of the table, so that a hot key is spread.
    """
    if side.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return df.join(F.broadcast(side), key)
    salted = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c, t in df.dtypes if t in ("bigint", "int")]), F.lit(salts)).cast("int")).join(salted, [key, "_salt"]).drop("_salt")


def meter_limits(registry: DataFrame, meas: str = "meter") -> DataFrame:
    """(sid, phys_lo, phys_hi) of the registered series of a kind; without both limits no reading is usable."""
    lo, hi = (F.nanvl(c, F.lit(None).cast("double")) for c in ("phys_lo", "phys_hi"))
    return registry.filter((F.col("meas") == meas) & F.col("sid").isNotNull()).groupBy("sid").agg(F.max(lo).alias("phys_lo"), F.min(hi).alias("phys_hi")).dropna()


def daily_totals(points: DataFrame, limits: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(sid, day_no, total, n) of the usable current readings: those with phys_lo <= value <= phys_hi.

    Null and NaN values and null sids or clocks are set aside; of repeated (sid, clock) the highest seq counts (a
    null seq is below all others; of equal seq either). Other columns are ignored; empty tables give no rows.
    """
    rows = lookup(lanes.live(points).select("sid", "clock", "value", F.coalesce("seq", F.lit(lanes.CONFIG_CLOCK)).alias("seq")), limits, "sid", broadcast_rows)
    # max_by keeps fixed-width buffers, so both steps combine before the shuffle and stay hash aggregates
    # (null: the last write is not usable)
    usable = rows.groupBy("sid", "clock").agg(F.max_by(F.expr("case when value between phys_lo and phys_hi then value end"), "seq").alias("value")).filter("value is not null")
    day = F.expr(f"(clock - pmod(clock, {DAY_TICKS})) div {DAY_TICKS}")
    return usable.groupBy("sid", day.alias("day_no")).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))


def rolling_totals(daily: DataFrame, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """For each sid and each calendar day from its first to its last active day: total_N, avg_N (total / N) and
    days_N (active days) over the N days up to and including it. Days without activity add 0.

    daily: sid, day_no, total, n, one row for each active day; an empty table gives no rows.
    """
    # each active day stands for itself and the inactive days up to the next one; the daily totals are read once
    until = F.coalesce(F.lead("day_no").over(Window.partitionBy("sid").orderBy("day_no")) - 1, F.col("day_no"))
    spans = daily.select("sid", F.col("day_no").alias("active"), "total", "n", until.alias("until"))
    days = spans.select("sid", "active", "total", "n", F.explode(F.sequence("active", F.greatest("active", "until"))).alias("day_no"))
    own = F.col("day_no") == F.col("active")
    out = days.select("sid", "day_no", F.when(own, F.col("total")).otherwise(0.0).alias("total"), F.when(own, F.col("n")).otherwise(0).alias("n"))
    for p in periods:
        frame = Window.partitionBy("sid").orderBy("day_no").rangeBetween(1 - p, 0)
        total = F.sum("total").over(frame)
        out = out.withColumns({f"total_{p}": total, f"avg_{p}": total / F.lit(float(p)), f"days_{p}": F.sum((F.col("n") > 0).cast("int")).over(frame)})
    return out.drop("total", "n")


def rising_days(points: DataFrame, registry: DataFrame, factor: float = 2.0, least_days: int = 20, **options) -> DataFrame:
    """(sid, day_no) of the days whose 7-day average is more than ``factor`` times that of 30 days, of which at
    least ``least_days`` have a usable reading."""
    rolled = rolling_totals(daily_totals(points, meter_limits(registry), **options))
    return rolled.filter((F.col("avg_7") > factor * F.col("avg_30")) & (F.col("days_30") >= least_days)).select("sid", "day_no")
