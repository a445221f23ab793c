"""Queries of the core operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import changefeed, grid, rolling, spikes
from tidewell.sources.deltas import DeltaTable
from tidewell.sources.files import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.empty_slots(table(spark, sf_dir, "points_double"), table(spark, sf_dir, "series_registry"))


def p2_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.regular_grid(table(spark, sf_dir, "points_double"), table(spark, sf_dir, "series_registry"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changefeed.apply_changes(table(spark, sf_dir, "wal_entries"))


def p3_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p3_found from insert and delete files, which take the feed in three commits that are out of order; the last is compacted with the rest."""
    feed, deltas = table(spark, sf_dir, "wal_entries"), DeltaTable(spark, scratch(spark))
    for part in (2, 0, 1):
        deltas.append(feed.filter(f"pmod(seq, 3) = {part}"))
    deltas.append(feed.filter("seq is null"))
    deltas.compact()
    return deltas.read().select("sid", "clock", "seq")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.implausible(table(spark, sf_dir, "points_double"), table(spark, sf_dir, "series_registry")).select("sid", "clock")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rising_days(table(spark, sf_dir, "points_double"), table(spark, sf_dir, "series_registry"))


def p6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, registry = table(spark, sf_dir, "points_double"), table(spark, sf_dir, "series_registry")
    t = rolling.rolling_totals(rolling.daily_totals(points, rolling.meter_limits(registry)))
    return t.select("sid", "day_no", *[F.round(c, 3).alias(c) for c in ("total_7", "total_30")], *[F.round(c, 6).alias(c) for c in ("avg_7", "avg_30")], "days_7", "days_30")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_grid": p2_grid,
    "p3_found": p3_found,
    "p3_files": p3_files,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_totals": p6_totals,
}

CURRENT = """select sid, clock, value, quality, seq from points_double
  where value is not null and not isnan(value)
  qualify row_number() over (partition by sid, clock order by seq desc) = 1"""

#: The definition of problem 5 without a chart: windows of up to three readings that leave and return. A reading between
#: two spikes fits the windows as well; it is told from them by having both its neighbours in windows.
IMPLAUSIBLE = f"""with cur as (
  {CURRENT}), reg as (select sid, max(phys_lo) lo, min(phys_hi) hi, coalesce(max(meas = 'meter'), false) meter from series_registry where sid is not null group by sid),
r as (select sid, clock, value, lo, hi, meter, row_number() over w n, lag(value) over w prev from cur join reg using (sid) window w as (partition by sid order by clock)),
m as (select sid, median(abs(value - prev)) filter (where prev is not null and not isnan(value - prev)) med from r group by sid),
s as (select r.*, value v0, coalesce(med, 0) med, coalesce(10 * med, 0) f, lead(value, 1) over w v1, lead(n, 1) over w n1, lead(value, 2) over w v2, lead(n, 2) over w n2, lead(value, 3) over w v3, lead(n, 3) over w n3, lead(value, 4) over w v4, lead(n, 4) over w n4 from r join m using (sid) window w as (partition by sid order by n)),
k as (select sid, n, case when f > 0 and v2 is not null and abs(v0 - v2) <= f and not (meter and v0 = 0 and v2 = 0) and (abs(v1 - v0) > f and not isnan(v1 - v0)) and (abs(v1 - v2) > f and not isnan(v1 - v2)) and not (meter and v1 = 0) then 1 else 0 end k1, case when f > 0 and v3 is not null and abs(v0 - v3) <= f and not (meter and v0 = 0 and v3 = 0) and (abs(v1 - v0) > f and not isnan(v1 - v0)) and (abs(v1 - v3) > f and not isnan(v1 - v3)) and not (meter and v1 = 0) and (abs(v2 - v0) > f and not isnan(v2 - v0)) and (abs(v2 - v3) > f and not isnan(v2 - v3)) and not (meter and v2 = 0) then 2 else 0 end k2, case when f > 0 and v4 is not null and abs(v0 - v4) <= f and not (meter and v0 = 0 and v4 = 0) and (abs(v1 - v0) > f and not isnan(v1 - v0)) and (abs(v1 - v4) > f and not isnan(v1 - v4)) and not (meter and v1 = 0) and (abs(v2 - v0) > f and not isnan(v2 - v0)) and (abs(v2 - v4) > f and not isnan(v2 - v4)) and not (meter and v2 = 0) and (abs(v3 - v0) > f and not isnan(v3 - v0)) and (abs(v3 - v4) > f and not isnan(v3 - v4)) and not (meter and v3 = 0) then 3 else 0 end k3 from s),
h as (select sid, n + unnest(range(1, k + 1)) n, n a, n + k + 1 z from (select sid, n, unnest([k1, k2, k3]) k from k) where k > 0),
hit as (select distinct sid, n from h),
spike as (select distinct sid, n from h where not (exists (select 1 from hit where hit.sid = h.sid and hit.n = h.a) and exists (select 1 from hit where hit.sid = h.sid and hit.n = h.z))),
l as (select *, case when prev is not null and abs(value - prev) <= 0.05 * med and med > 0 then 0 else 1 end opens from s),
g as (select *, sum(opens) over (partition by sid order by n rows unbounded preceding) run from l),
u as (select sid, run, min(n) a, max(n) z, count(*) c, arg_min(value, n) first, arg_min(prev, n) before, arg_max(v1, n) after, bool_or(meter) meter from g group by sid, run),
t as (select sid, count(*) filter (where first <> 0 and c > 1) / count(*) filter (where first <> 0) rate from u group by sid),
stuck as (select u.sid, unnest(range(a, z + 1)) n from u join t using (sid) where c >= 5 and rate <= 0.1 and not (meter and first = 0) and not (meter and coalesce(before, 1) = 0 and coalesce(after, 1) = 0))
select sid, clock from s where value < lo or value > hi
union select sid, clock from s join spike using (sid, n)
union select sid, clock from s join stuck using (sid, n)"""

CHANGES = """with w as (select seq,lower(trim(kind, ' ' || chr(9) || chr(10) || chr(13))) kind,sid,clock,value,min_clock,max_clock from wal_entries),
p as (select sid,clock,max(seq) seq from w where kind='write' and value is not null and not isnan(value) group by 1,2),
d as (select sid,seq,case when kind='delete' then null else min_clock end lo,case when kind='delete' then null else max_clock end hi from w where kind in('delete','delete_range'))
select sid,clock,seq from p where not exists (select 1 from d where d.sid=p.sid and d.seq>p.seq and (lo is null or lo<=clock) and (hi is null or clock<=hi))"""

SQL: dict[str, str] = {
    "p2_found": f"""with cur as (
  {CURRENT}), st as (select sid,min(step_ticks) step from series_registry where step_ticks>0 group by sid),
sl as (select distinct sid, clock - clock%step slot, step from cur join st using(sid)),
nx as (select *, lead(slot) over (partition by sid order by slot) nxt from sl)
select sid, unnest(range(slot+step,nxt,step)) slot_clock from nx where nxt-slot<=7*864000000000 and nxt>slot+step""",
    "p2_grid": f"""with cur as (
  {CURRENT}), st as (select sid, min(step_ticks) step from series_registry where step_ticks > 0 group by sid),
r as (select sid, clock, value, step, clock - clock % step slot, lag(clock) over w pc, lag(value) over w pv from cur join st using (sid) window w as (partition by sid order by clock)),
o as (select *, pc - pc % step pslot, (value - pv) / (clock - pc)::double slope from r),
f as (select * from o where pc is null or pslot <> slot),
reading as (select sid, slot slot_clock, 1::bigint n_slots, case when slot - pslot <= {grid.GAP_LIMIT} and isfinite(pv + slope * (slot - pc)) then pv + slope * (slot - pc) else value end as value, 'reading' state from f),
filled as (select sid, unnest(range(pslot + step, slot, step)) slot_clock, step, pc, pv, slope from f where slot - pslot <= {grid.GAP_LIMIT} and slot - pslot > step)
select * from reading
union all select sid, slot_clock, 1::bigint, case when isfinite(pv + slope * (slot_clock - pc)) then pv + slope * (slot_clock - pc) end, 'filled' from filled
union all select sid, pslot + step, (slot - pslot) // step - 1, null, 'silence' from f where slot - pslot > {grid.GAP_LIMIT}""",
    "p3_found": CHANGES,
    "p3_files": CHANGES,
    "p5_found": IMPLAUSIBLE,
    "p6_found": f"""with cur as (
  {CURRENT}), m as (select sid,max(phys_lo) lo,min(phys_hi) hi from series_registry where meas='meter' group by sid),
d as (select sid, clock//864000000000 day_no, sum(value) total from cur join m using(sid) where value>=lo and value<=hi group by 1,2),
sp as (select sid,min(day_no) a,max(day_no) z from d group by sid),
cal as (select sid,unnest(range(a,z+1)) day_no from sp),
f as (select cal.sid,cal.day_no,coalesce(total,0) total,(total is not null)::int act from cal left join d using(sid,day_no)),
r as (select sid,day_no,sum(total) over (partition by sid order by day_no range between 6 preceding and current row)/7 a7,sum(total) over (partition by sid order by day_no range between 29 preceding and current row)/30 a30,sum(act) over (partition by sid order by day_no range between 29 preceding and current row) n from f)
select sid,day_no from r where a7>2*a30 and n>=20""",
    "p6_totals": f"""with cur as (
  {CURRENT}), m as (select sid,max(phys_lo) lo,min(phys_hi) hi from series_registry where meas='meter' group by sid),
d as (select sid, clock//864000000000 day_no, sum(value) total from cur join m using(sid) where value>=lo and value<=hi group by 1,2),
sp as (select sid,min(day_no) a,max(day_no) z from d group by sid),
cal as (select sid,unnest(range(a,z+1)) day_no from sp),
f as (select cal.sid,cal.day_no,coalesce(total,0) total,(total is not null)::int act from cal left join d using(sid,day_no)),
w7 as (select *, sum(total) over w t7, sum(act) over w n7 from f window w as (partition by sid order by day_no range between 6 preceding and current row)),
w30 as (select *, sum(total) over w t30, sum(act) over w n30 from w7 window w as (partition by sid order by day_no range between 29 preceding and current row))
select sid, day_no, round(t7, 3) total_7, round(t30, 3) total_30, round(t7 / 7, 6) avg_7, round(t30 / 30, 6) avg_30, n7::bigint days_7, n30::bigint days_30 from w30""",
}
