"""Queries of the historian's own operators over the test tables, and the SQL that gives the same rows.

Points come from points_double, points_bool and, mapped to points, from events, lineitem and documents.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import codes
from tidewell.functions.clock import MAX_CLOCK, MIN_CLOCK, RETENTION_DAYS, clock_literal, clock_of, point_text
from tidewell.operators import blocks, changefeed, lanes, measures, merge, model, rolling, schemes, shards
from tidewell.plans import compaction
from tidewell.queries import CURRENT, table
from tidewell.sources import simulate
from tidewell.sources.changelog import ChangeLog
from tidewell.sources.files import scratch
from tidewell.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Fixtures: a range of clocks, some sids, the present.
LO, HI = clock_literal("2024-01-05"), clock_literal("2024-01-12T06:30:00")
LINE_LO, LINE_HI = clock_literal("1994-01-01"), clock_literal("1995-12-31")
NOW = clock_literal("2024-10-20T12:00:00")
SIDS = (0, 1, 2, 3, 17, 50, 149, 10**9)
EPOCH = "621355968000000000"

EVENTS = f"select user_id sid, {EPOCH} + epoch_us(ts) * 10 clock, value, 0 quality, event_id seq from events"
LINES = f"select l_suppkey sid, {EPOCH} + epoch_us(l_shipdate) * 10 clock, l_extendedprice value, l_linenumber quality, l_orderkey, l_partkey from lineitem"
LINE_ORDER = ("l_orderkey", "quality", "l_partkey", "value")
LINE_DESC = "l_orderkey desc, quality desc, l_partkey desc, value desc"
TYPES = f"select case event_type when 'click' then 1 when 'error' then 2 when 'purchase' then 3 when 'signup' then 4 else 5 end::bigint sid, {EPOCH} + epoch_us(ts) * 10 clock, value, event_id seq from events"
TEXTS = f"select author_id sid, {EPOCH} + epoch_us(created_at) * 10 clock, title value, doc_id seq from documents where title is not null and author_id is not null and created_at is not null"
BODIES = f"select author_id sid, {EPOCH} + epoch_us(created_at) * 10 clock, text value, doc_id seq from documents where text is not null and author_id is not null and created_at is not null"
REGISTERED = "select distinct sid from series_registry where sid is not null"


def events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("user_id").alias("sid"), clock_of("ts").alias("clock"), "value", F.lit(0).alias("quality"), F.col("event_id").alias("seq"))


def lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("sid"), clock_of("l_shipdate").alias("clock"), F.col("l_extendedprice").alias("value"), F.col("l_linenumber").alias("quality"), "l_orderkey", "l_partkey")


def by_type(s: SparkSession, d: str) -> DataFrame:
    code = F.expr("cast(case event_type when 'click' then 1 when 'error' then 2 when 'purchase' then 3 when 'signup' then 4 else 5 end as bigint)")
    return table(s, d, "events").select(code.alias("sid"), clock_of("ts").alias("clock"), "value", F.col("event_id").alias("seq"))


def texts(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").filter("title is not null and author_id is not null and created_at is not null")
    return t.select(F.col("author_id").alias("sid"), clock_of("created_at").alias("clock"), F.col("title").alias("value"), F.col("doc_id").alias("seq"))


def bodies(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").filter("text is not null and author_id is not null and created_at is not null")
    return t.select(F.col("author_id").alias("sid"), clock_of("created_at").alias("clock"), F.col("text").alias("value"), F.col("doc_id").alias("seq"))


def points(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "points_double")


def registry(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "series_registry")


def current(s: SparkSession, d: str) -> DataFrame:
    return merge.last_write_wins(lanes.live(points(s, d)))


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# ---- reads --------------------------------------------------------------------------------------------------------
@query("read_range", f"select sid, clock, value, quality from ({EVENTS}) where sid in {SIDS} and clock between {LO} and {HI}")
def _(s, d):
    return merge.read_range(events(s, d), SIDS, LO, HI).select("sid", "clock", "value", "quality")


@query("read_all", f"select sid, clock, value, quality from ({EVENTS}) where sid in {SIDS}")
def _(s, d):
    return merge.read_range(events(s, d), SIDS).select("sid", "clock", "value", "quality")


@query("read_empty_range", f"select sid, clock, value from ({EVENTS}) where clock between 5 and 9")
def _(s, d):
    return merge.read_range(events(s, d), SIDS, 5, 9).select("sid", "clock", "value")


@query("read_sid_table", f"select sid, clock, quality from points_double where sid in (select sid from series_registry where meas = 'setpoint') and clock <= {NOW} qualify row_number() over (partition by sid, clock order by seq desc) = 1")
def _(s, d):
    return merge.read_range(points(s, d), registry(s, d).filter("meas = 'setpoint'"), MIN_CLOCK, NOW).select("sid", "clock", "quality")


@query("string_points", f"select sid, clock, value from ({TEXTS}) where sid = 4242 qualify row_number() over (partition by sid, clock order by seq desc) = 1")
def _(s, d):
    return merge.read_range(texts(s, d), [4242]).select("sid", "clock", "value")


@query("integer_points", f"select sid, clock, quality::bigint as value from ({LINES}) where sid in {SIDS} qualify row_number() over (partition by sid, clock order by {LINE_DESC}) = 1")
def _(s, d):
    return merge.read_range(lines(s, d), SIDS, order=LINE_ORDER).select("sid", "clock", F.col("quality").cast("long").alias("value"))


@query("boolean_points", "select sid, clock, value, quality from points_bool where sid = 500023 and value is not null qualify row_number() over (partition by sid, clock order by seq desc) = 1")
def _(s, d):
    return merge.read_range(lanes.live(table(s, d, "points_bool")), [500023]).select("sid", "clock", "value", "quality")


@query("point_text", f"select sid, seq, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ' ' || (value > 50)::varchar as text from (select user_id sid, event_id seq, ts, value from events where user_id in {SIDS})")
def _(s, d):
    return merge.of_sids(events(s, d), SIDS).withColumn("over", F.col("value") > 50).select("sid", "seq", point_text("clock", "over").alias("text"))


# The same over whole tables: the sids asked for are all that the table has.
@query("read_all_series", f"select sid, clock, value, quality from ({EVENTS}) where sid is not null qualify row_number() over (partition by sid, clock order by seq desc) = 1")
def _(s, d):
    x = events(s, d)
    return merge.read_range(x, x.select("sid")).select("sid", "clock", "value", "quality")


@query("string_points_all", f"select sid, clock, value from ({BODIES}) qualify row_number() over (partition by sid, clock order by seq desc) = 1")
def _(s, d):
    x = bodies(s, d)
    return merge.read_range(x, x.select("sid")).select("sid", "clock", "value")


@query("integer_points_all", f"select sid, clock, quality::bigint as value from ({LINES}) where sid is not null qualify row_number() over (partition by sid, clock order by {LINE_DESC}) = 1")
def _(s, d):
    x = lines(s, d)
    return merge.read_range(x, x.select("sid"), order=LINE_ORDER).select("sid", "clock", F.col("quality").cast("long").alias("value"))


@query("boolean_points_all", "select sid, clock, value, quality from points_bool where sid is not null and clock is not null and value is not null qualify row_number() over (partition by sid, clock order by seq desc) = 1")
def _(s, d):
    x = lanes.live(table(s, d, "points_bool"))
    return merge.read_range(x, x.select("sid")).select("sid", "clock", "value", "quality")


@query("point_text_all", "select user_id sid, event_id seq, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ' ' || (value > 50)::varchar as text from events")
def _(s, d):
    return events(s, d).withColumn("over", F.col("value") > 50).select("sid", "seq", point_text("clock", "over").alias("text"))


# ---- merging ------------------------------------------------------------------------------------------------------
@query("last_write_wins", f"select sid, clock, value, quality from ({LINES}) qualify row_number() over (partition by sid, clock order by {LINE_DESC}) = 1")
def _(s, d):
    return merge.last_write_wins(lines(s, d), LINE_ORDER).select("sid", "clock", "value", "quality")


@query("current_readings", f"select sid, clock, value, seq from ({CURRENT})")
def _(s, d):
    return current(s, d).select("sid", "clock", "value", "seq")


HALVES = f"select *, 0 layer from ({LINES}) where l_orderkey % 2 = 1 union all select *, 1 layer from ({LINES}) where l_orderkey % 2 = 0"


@query("merge_layers", f"select sid, clock, value, quality from ({HALVES}) qualify row_number() over (partition by sid, clock order by layer desc, {LINE_DESC}) = 1")
def _(s, d):
    x = lines(s, d)
    return merge.merge_layers([x.filter("l_orderkey % 2 = 1"), x.filter("l_orderkey % 2 = 0")], LINE_ORDER).select("sid", "clock", "value", "quality")


@query("upsert_points", f"select sid, clock, seq, value from ({EVENTS}) where seq % 10 <> 0 union all select sid, clock, seq, -value from ({EVENTS}) where seq % 10 = 0")
def _(s, d):
    x = events(s, d)
    return merge.upsert(x, x.filter("seq % 10 = 0").withColumn("value", -F.col("value"))).select("sid", "clock", "seq", "value")


@query("append_points", f"select sid, count(*) n_points from (select sid from ({EVENTS}) union all select sid from ({LINES})) group by sid")
def _(s, d):
    return merge.append(events(s, d).select("sid"), lines(s, d).select("sid")).groupBy("sid").agg(F.count(F.lit(1)).alias("n_points"))


@query("registered_only", f"select sid, clock, seq from points_double where sid in ({REGISTERED})")
def _(s, d):
    return merge.registered(points(s, d), registry(s, d)).select("sid", "clock", "seq")


@query("accepted_counts", "select db_name, rp_days, count(*) n_accepted from points_double join (select distinct db_name, rp_days, sid from series_registry) using (sid) where value is not null and not isnan(value) group by all")
def _(s, d):
    routes = registry(s, d).select("db_name", "rp_days", "sid").distinct()
    return rolling.lookup(lanes.live(points(s, d)).select("sid", "clock"), routes, "sid").groupBy("db_name", "rp_days").agg(F.count(F.lit(1)).alias("n_accepted"))


@query("route_databases", "select distinct db_name, sid from points_double join series_registry using (sid)")
def _(s, d):
    sids = points(s, d).select("sid").distinct()
    return sids.join(registry(s, d).select("db_name", "sid").distinct(), "sid").select("db_name", "sid")


@query("delete_range", f"select sid, clock, seq from ({EVENTS}) where not (sid in {SIDS} and clock between {LO} and {HI})")
def _(s, d):
    return merge.delete_range(events(s, d), SIDS, LO, HI).select("sid", "clock", "seq")


@query("exclude_range", f"select sid, clock, seq from ({EVENTS}) where not clock between {LO} and {HI}")
def _(s, d):
    return merge.exclude(events(s, d), LO, HI).select("sid", "clock", "seq")


@query("include_range", f"select sid, clock, seq from ({EVENTS}) where clock between {LO} and {HI}")
def _(s, d):
    return merge.include(events(s, d), LO, HI).select("sid", "clock", "seq")


TOMBS = f"select c_custkey sid, {LO} + c_nationkey * 10000000000 min_clock, case when c_nationkey % 5 = 0 then null else {HI} + c_nationkey * 10000000000 end max_clock, c_custkey * 40 seq from customer where c_custkey % 3 = 0"


def tombs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").filter("c_custkey % 3 = 0").selectExpr("c_custkey sid", f"{LO} + c_nationkey * 10000000000 min_clock", f"case when c_nationkey % 5 = 0 then null else {HI} + c_nationkey * 10000000000 end max_clock", "c_custkey * 40 seq")


@query("apply_tombstones", f"select sid, clock, seq from ({EVENTS}) p where not exists (select 1 from ({TOMBS}) t where t.sid = p.sid and t.seq > p.seq and p.clock >= coalesce(t.min_clock, p.clock) and p.clock <= coalesce(t.max_clock, p.clock))")
def _(s, d):
    return merge.apply_tombstones(events(s, d), tombs(s, d)).select("sid", "clock", "seq")


@query("position_slice", f"select sid, clock, seq from (select *, row_number() over (partition by sid order by clock, seq) - 1 as nth from ({EVENTS})) where nth between 10 and 14")
def _(s, d):
    return merge.position_slice(events(s, d), 10, 5).select("sid", "clock", "seq")


@query("replayed_table", f"""with w as (select seq, lower(trim(kind, ' ' || chr(9) || chr(10) || chr(13))) kind, sid, clock, value, quality, min_clock, max_clock from wal_entries),
p as (select distinct sid, clock, value, quality, seq from w where kind = 'write' and value is not null and not isnan(value) qualify seq = max(seq) over (partition by sid, clock)),
d as (select sid, seq, case when kind = 'delete' then null else min_clock end lo, case when kind = 'delete' then null else max_clock end hi from w where kind in ('delete', 'delete_range'))
select sid, clock, value, quality, seq from p where not exists (select 1 from d where d.sid = p.sid and d.seq > p.seq and (lo is null or lo <= clock) and (hi is null or clock <= hi))""")
def _(s, d):
    return changefeed.current_table(table(s, d, "wal_entries"))


# ---- shards and retention -----------------------------------------------------------------------------------------
def width_sql(days: str) -> str:
    return f"(case when {days} < 2 then 3600 when {days} < 180 then 86400 when {days} < 700 then 604800 else 2628000 end * 10000000::bigint)"


@query("shard_widths", "select days::int as days, (case when days < 2 then 3600 when days < 180 then 86400 when days < 700 then 604800 else 2628000 end)::int as seconds from (values (1), (2), (7), (31), (179), (180), (366), (699), (700), (1096), (3650), (36500)) t(days)")
def _(s, d):
    days = sorted({1, 2, 179, 180, 699, 700, *RETENTION_DAYS.values()})
    return s.createDataFrame([(n, shards.width_seconds(n)) for n in days], "days int, seconds int")


@query("shard_assign", f"select sid, clock, rp_days, clock - clock % {width_sql('rp_days')} as shard_start from (select sid, clock, n_regionkey * 300 + 1 as rp_days from ({EVENTS}) join nation on n_nationkey = sid % 25)")
def _(s, d):
    x = events(s, d).join(table(s, d, "nation"), F.expr("n_nationkey = sid % 25")).withColumn("rp_days", F.expr("n_regionkey * 300 + 1"))
    return x.select("sid", "clock", "rp_days", (F.col("clock") - F.pmod("clock", shards.width_column())).alias("shard_start"))


SHARDS = "select 31 as rp_days, row_number() over (order by start) as shard_id, start, start + 864000000000 as \"end\", n_points from (select clock - clock % 864000000000 as start, count(*) n_points from points_double where sid is not null and clock is not null group by 1)"


def shard_rows(s: SparkSession, d: str) -> DataFrame:
    return shards.shard_table(points(s, d).filter("sid is not null and clock is not null"), 31)


@query("shard_counts", SHARDS)
def _(s, d):
    return shard_rows(s, d)


@query("shards_in_range", f"select shard_id, start from ({SHARDS}) where start <= {NOW} and \"end\" > {NOW} - 5 * 864000000000")
def _(s, d):
    return shards.shards_in(shard_rows(s, d), NOW - 5 * 864_000_000_000, NOW).select("shard_id", "start")


@query("shard_read", f"select sid, clock, seq from points_double where clock between {NOW} - 3 * 864000000000 and {NOW} and sid in {SIDS}")
def _(s, d):
    routed = shards.route_to_shards(merge.of_sids(points(s, d), SIDS), 31)
    return shards.pruned(routed, 31, NOW - 3 * 864_000_000_000, NOW).select("sid", "clock", "seq")


@query("expire_points", f"select sid, clock, seq from points_double where not ({NOW} > clock + 31 * 864000000000) or clock - clock % 864000000000 + 864000000000 + 31 * 864000000000 >= {NOW}")
def _(s, d):
    return shards.expire_points(points(s, d), 31, NOW).select("sid", "clock", "seq")


@query("expired_points", f"select sid, clock, rp_days from (select distinct rp_days, sid from series_registry) join points_double using (sid) where {NOW} > clock + rp_days * 864000000000")
def _(s, d):
    x = rolling.lookup(points(s, d), registry(s, d).select("rp_days", "sid").distinct(), "sid")
    return x.filter(shards.expired("clock", F.col("rp_days").cast("long"), NOW)).select("sid", "clock", "rp_days")


@query("expire_shards", f"select shard_id, start from ({SHARDS}) where not {NOW} > \"end\" + 31 * 864000000000")
def _(s, d):
    return shards.expire_shards(shard_rows(s, d), 31, NOW).select("shard_id", "start")


@query("old_shards", f"select shard_id, \"end\" <= {NOW} as is_old from ({SHARDS})")
def _(s, d):
    return shard_rows(s, d).select("shard_id", shards.is_old(NOW).alias("is_old"))


@query("last_shard_end", f"select max(\"end\") as last_end from ({SHARDS})")
def _(s, d):
    return shard_rows(s, d).agg(F.max("end").alias("last_end"))


# ---- measures -----------------------------------------------------------------------------------------------------
@query("series_stats", "select sid, min(clock) min_clock, max(clock) max_clock, count(*) n_points from points_double group by sid")
def _(s, d):
    return measures.series_stats(points(s, d))


@query("registered_bounds", f"select sid, coalesce(min(clock), {MAX_CLOCK}) min_clock, coalesce(max(clock), {MIN_CLOCK}) max_clock, count(clock) n_points from ({REGISTERED}) left join points_double using (sid) group by sid")
def _(s, d):
    return measures.registered_bounds(points(s, d), registry(s, d))


@query("distinct_sids", "select distinct sid from points_double order by sid")
def _(s, d):
    return points(s, d).select("sid").distinct().orderBy("sid")


@query("series_bytes", f"""select sid, 20 * count(*) as n_bytes from ({LINES}) group by sid
union all select sid + 1000000, (12 + arg_min(octet_length(encode(value)), (clock, seq))) * count(*) from ({TEXTS}) group by sid""")
def _(s, d):
    a = measures.series_bytes(model.points_of(lines(s, d)))
    t = model.points_of(texts(s, d))
    b = t.groupBy("sid").agg((F.min_by(model.point_bytes(), F.struct("clock", "seq")) * F.count(F.lit(1))).cast("long").alias("n_bytes"))
    return a.unionByName(b.select((F.col("sid") + 1_000_000).alias("sid"), "n_bytes"))


@query("text_bytes", f"select sid, (12 + arg_min(octet_length(encode(value)), (clock, seq))) * count(*) as n_bytes from ({BODIES}) group by sid")
def _(s, d):
    t = model.points_of(bodies(s, d))
    return t.groupBy("sid").agg((F.min_by(model.point_bytes(), F.struct("clock", "seq")) * F.count(F.lit(1))).cast("long").alias("n_bytes"))


def block_sql(source: str, block: int) -> str:
    return f"select sid, nth // {block} as block_no, min(clock) min_clock, max(clock) max_clock, count(*) n_points from (select sid, clock, row_number() over (partition by sid order by clock) - 1 as nth from ({source})) group by 1, 2"


@query("block_index", block_sql(TYPES, 1000))
def _(s, d):
    return measures.block_index(by_type(s, d))


@query("block_index_small", block_sql(CURRENT, 50))
def _(s, d):
    return measures.block_index(current(s, d), 50)


@query("blocks_in_range", f"select sid, block_no from ({block_sql(EVENTS, 10)}) where min_clock <= {HI} and max_clock >= {LO}")
def _(s, d):
    return measures.block_index(events(s, d), 10).filter(shards.overlaps(LO, HI)).select("sid", "block_no")


@query("block_counts", f"select sid, count(*) n_blocks from ({block_sql(EVENTS, 10)}) group by sid")
def _(s, d):
    return measures.block_index(events(s, d), 10).groupBy("sid").agg(F.count(F.lit(1)).alias("n_blocks"))


ASKED = f"select user_id sid, {EPOCH} + epoch_us(ts) * 10 + 36000000000 as clock from events where event_id % 7 = 0"


def asked(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).filter("seq % 7 = 0").select("sid", (F.col("clock") + 36_000_000_000).alias("clock"))


@query("may_contain", f"select sid, clock from ({ASKED}) a where exists (select 1 from ({block_sql(EVENTS, 10)}) b where a.sid = b.sid and a.clock between b.min_clock and b.max_clock) and not exists (select 1 from ({TOMBS}) t where t.sid = a.sid and a.clock between t.min_clock and coalesce(t.max_clock, a.clock))")
def _(s, d):
    return measures.may_contain(measures.block_index(events(s, d), 10), asked(s, d), tombs(s, d))


@query("contains_series", f"select sid, exists (select 1 from points_double p where p.sid = t.sid) as found from (values {', '.join(f'({x}::bigint)' for x in SIDS)}) t(sid)")
def _(s, d):
    have = merge.of_sids(points(s, d), SIDS).select("sid").distinct().withColumn("found", F.lit(True))
    return s.createDataFrame([(x,) for x in SIDS], "sid bigint").join(have, "sid", "left").select("sid", F.coalesce("found", F.lit(False)).alias("found"))


@query("type_of_series", "select sid, 0::tinyint as dtype from points_double group by sid union all select sid, 2::tinyint from points_bool group by sid")
def _(s, d):
    a, b = (model.points_of(table(s, d, t)) for t in ("points_double", "points_bool"))
    return model.type_of(a.unionByName(b))


@query("file_stats", f"select l_returnflag || l_linestatus as file, min(clock) min_clock, max(clock) max_clock, min(sid) min_sid, max(sid) max_sid, count(*) n_points from (select *, {EPOCH} + epoch_us(l_shipdate) * 10 clock, l_suppkey sid from lineitem) group by 1")
def _(s, d):
    x = table(s, d, "lineitem").select(F.col("l_suppkey").alias("sid"), clock_of("l_shipdate").alias("clock"), F.concat("l_returnflag", "l_linestatus").alias("file"))
    return measures.file_stats(x, "file")


@query("stored_file_stats")
def _(s, d):
    return measures.stored_file_stats(points(s, d)).drop("file", "changed")


@query("quarantine", "select case when value is null then 'no value' else 'nan' end as fault, count(*) n from points_double where value is null or isnan(value) group by 1")
def _(s, d):
    return model.validate(model.points_of(points(s, d)))[1].groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


@query("typed_views", "select 0 as dtype, count(*) n, count(distinct sid) n_sids from points_double where value is not null union all select 2, count(*), count(distinct sid) from points_bool where value is not null")
def _(s, d):
    both = model.points_of(points(s, d)).unionByName(model.points_of(table(s, d, "points_bool")))
    of = lambda t: model.typed_view(both, t).filter("value is not null").agg(F.lit(t).alias("dtype"), F.count(F.lit(1)).alias("n"), F.count_distinct("sid").alias("n_sids"))
    return of(model.DOUBLE).unionByName(of(model.BOOLEAN))


# ---- codes, schemes, blocks ---------------------------------------------------------------------------------------
@query("zigzag", f"select seq, x, case when x >= 0 then 2 * x else -2 * x - 1 end as code, x as back from (select event_id seq, event_id * 37 - user_id * 1000 as x from events)")
def _(s, d):
    x = table(s, d, "events").select(F.col("event_id").alias("seq"), F.expr("event_id * 37 - user_id * 1000").alias("x")).withColumn("code", codes.zigzag(F.col("x")))
    return x.withColumn("back", codes.unzigzag(F.col("code")))


@query("bit_scans", "select seq, (64 - length(ltrim(bin(x), '0')))::int as leading, (length(ltrim(bin(x), '0')) - length(rtrim(ltrim(bin(x), '0'), '0')))::int as trailing from (select event_id seq, event_id * event_id * 12 + 8 as x from events)")
def _(s, d):
    x = table(s, d, "events").select(F.col("event_id").alias("seq"), F.expr("event_id * event_id * 12 + 8").alias("x"))
    return x.select("seq", codes.leading_zeros(F.col("x")).alias("leading"), codes.trailing_zeros(F.col("x")).alias("trailing"))


@query("varint_sizes", "select seq, case when x < 128 then 1 when x < 16384 then 2 when x < 2097152 then 3 when x < 268435456 then 4 when x < 34359738368 then 5 else 6 end as n_bytes from (select event_id seq, event_id * event_id * event_id as x from events)")
def _(s, d):
    # the SQL ends at 6 bytes, which it also gives where there is no id
    size = codes.varint_size_of_cube(F.col("event_id"))
    return table(s, d, "events").select(F.col("event_id").alias("seq"), F.when(size < 6, size).otherwise(6).alias("n_bytes"))


@query("varint_sizes_all", f"select seq, case {' '.join(f'when x < {2 ** (7 * n)} then {n}' for n in range(1, 19))} when x is not null then 19 end as n_bytes from (select event_id seq, event_id::hugeint * event_id * event_id as x from events)")
def _(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("seq"), codes.varint_size_of_cube(F.col("event_id")).alias("n_bytes"))


@query("checksums")
def _(s, d):
    return table(s, d, "documents").select("doc_id", codes.checksum(F.col("text")).alias("crc"))


@query("clock_schemes", f"""with a as (select sid, clock, row_number() over (partition by sid order by clock) - 1 as n from ({CURRENT})),
b as (select sid, n // 50 as block_no, clock - lag(clock) over (partition by sid, n // 50 order by n) as delta from a),
c as (select sid, block_no, count(*) n_points, min(delta) lo, max(delta) hi, min(case when delta is not null then case {' '.join(f'when delta % {10**p} = 0 then {p}' for p in range(12, -1, -1))} end end) p from b group by 1, 2)
select sid, block_no, n_points, case when n_points > 1 and lo = hi then 'RLE' when hi > 1152921504606846975 then 'RAW' else 'SIMPLE8B' end as scheme, (case when not (n_points > 1 and lo = hi) and hi > 1152921504606846975 then 0 else coalesce(p, 12) end)::int as divisor_power from c""")
def _(s, d):
    return schemes.timestamp_schemes(current(s, d), 50)


@query("integer_schemes", f"""with l as (select sid, clock, quality from ({LINES}) qualify row_number() over (partition by sid, clock order by {LINE_DESC}) = 1),
a as (select sid, quality::bigint x, row_number() over (partition by sid order by clock) - 1 as n from l),
b as (select sid, n // 3 as block_no, x - lag(x) over (partition by sid, n // 3 order by n) as delta from a),
c as (select sid, block_no, count(*) n_points, min(case when delta >= 0 then 2 * delta else -2 * delta - 1 end) lo, max(case when delta >= 0 then 2 * delta else -2 * delta - 1 end) hi from b group by 1, 2)
select sid, block_no, n_points, case when n_points > 2 and lo = hi then 'RLE' when hi > 1152921504606846975 then 'RAW' else 'SIMPLE8B' end as scheme from c""")
def _(s, d):
    return schemes.integer_schemes(merge.last_write_wins(lines(s, d), LINE_ORDER), "quality", 3)


@query("boolean_sizes", "select sid, nth // 1000 as block_no, count(*) n_points, 1 + case when 2 * count(*) < 128 then 1 when 2 * count(*) < 16384 then 2 else 3 end + (count(*) + 7) // 8 as n_bytes from (select sid, row_number() over (partition by sid order by clock) - 1 as nth from (select sid, clock from points_bool where value is not null group by 1, 2)) group by 1, 2")
def _(s, d):
    return schemes.boolean_sizes(merge.last_write_wins(lanes.live(table(s, d, "points_bool"))))


@query("string_sizes", f"""select sid, nth // 100 as block_no, count(*) n_points, sum(b + case when 2 * b < 128 then 1 when 2 * b < 16384 then 2 else 3 end)::bigint as n_bytes
from (select sid, octet_length(encode(value)) b, row_number() over (partition by sid order by clock) - 1 as nth from (select * from ({TEXTS}) qualify row_number() over (partition by sid, clock order by seq desc) = 1)) group by 1, 2""")
def _(s, d):
    return schemes.string_sizes(merge.last_write_wins(texts(s, d)), 100)


@query("text_sizes", f"""select sid, nth // 100 as block_no, count(*) n_points, sum(b + case when 2 * b < 128 then 1 when 2 * b < 16384 then 2 when 2 * b < 2097152 then 3 else 4 end)::bigint as n_bytes
from (select sid, octet_length(encode(value)) b, row_number() over (partition by sid order by clock) - 1 as nth from (select * from ({BODIES}) qualify row_number() over (partition by sid, clock order by seq desc) = 1)) group by 1, 2""")
def _(s, d):
    return schemes.string_sizes(merge.last_write_wins(bodies(s, d)), 100)


@query("block_round_trip", f"select sid, clock, value, coalesce(quality, 0) as quality from ({CURRENT})")
def _(s, d):
    return blocks.decode_points(blocks.encode_points(points(s, d)), model.DOUBLE)


@query("block_range_read", "select sid, clock, value, coalesce(quality, 0) as quality from points_bool where value is not null and clock between 638620000000000000 and 638625000000000000 qualify row_number() over (partition by sid, clock order by seq desc) = 1")
def _(s, d):
    return blocks.decode_points(blocks.encode_points(table(s, d, "points_bool")), model.BOOLEAN, 638_620_000_000_000_000, 638_625_000_000_000_000)


@query("compression_rates")
def _(s, d):
    kinds = {"double": points(s, d), "boolean": table(s, d, "points_bool"), "integer": lines(s, d).selectExpr("sid", "clock", "cast(quality as bigint) value", "0 quality", "l_orderkey seq"), "string": bodies(s, d).withColumn("quality", F.lit(0))}
    out = None
    for name, p in kinds.items():
        one = blocks.encode_points(p).agg(F.lit(name).alias("kind"), F.sum("n_points").alias("n_points"), F.sum("raw_bytes").alias("raw_bytes"), F.sum(F.length("block")).alias("stored_bytes"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("rate", 1 - F.col("stored_bytes") / F.col("raw_bytes"))


# ---- compaction plans ---------------------------------------------------------------------------------------------
FILES = "select (c_nationkey % 2)::bigint as shard, c_custkey as generation, (case when c_custkey % 60 < 30 then 1 when c_custkey % 60 < 45 then 2 else 4 end)::int as sequence, (c_acctbal * 1000000)::bigint as n_bytes, c_custkey % 97 = 5 as has_tombstone, c_custkey % 2 = 0 as full_blocks from customer"


def file_rows(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").selectExpr(
        "cast(c_nationkey % 2 as bigint) shard", "c_custkey generation", "case when c_custkey % 60 < 30 then 1 when c_custkey % 60 < 45 then 2 else 4 end sequence",
        "cast(round(c_acctbal * 1000000) as bigint) n_bytes", "c_custkey % 97 = 5 has_tombstone", "c_custkey % 2 = 0 full_blocks",
    )


def plan_sql(level: int, chunk: int) -> str:
    return f"""with g as (select shard, generation, least(4, max(sequence)) lvl, bool_or(has_tombstone) t from ({FILES}) group by 1, 2),
m as (select *, case when lvl = lag(lvl) over (partition by shard order by generation) then 0 else 1 end b, count(*) over (partition by shard) c, bool_or(t) over (partition by shard) any_t from g),
r as (select *, sum(b) over (partition by shard order by generation rows unbounded preceding) run from m),
k as (select *, (row_number() over (partition by shard, run order by generation) - 1) // {chunk} ch from r where lvl = {level} and (c > 1 or any_t))
select shard, {level} as level, string_agg(generation::varchar, ',' order by generation) as generations from k group by shard, run, ch having count(*) >= {chunk} or bool_or(t)"""


def planned(plan: DataFrame) -> DataFrame:
    return plan.select("shard", "level", F.array_join(F.transform("generations", lambda x: x.cast("string")), ",").alias("generations"))


for _level in (1, 2):
    query(f"plan_level_{_level}", plan_sql(_level, 8 if _level == 1 else 4))(lambda s, d, level=_level: planned(compaction.plan_level(file_rows(s, d), level)))


@query("plan_optimize", plan_sql(4, 4))
def _(s, d):
    return planned(compaction.plan_optimize(file_rows(s, d)))


@query("plan_full", f"select shard, 4 as level, string_agg(generation::varchar, ',' order by generation) as generations from ({FILES}) where not (n_bytes > 2147483648 and full_blocks and not has_tombstone) group by shard having count(*) > 1 or bool_or(has_tombstone)")
def _(s, d):
    return planned(compaction.plan_full(file_rows(s, d), NOW, 0))


@query("generations", f"select shard, generation, least(4, max(sequence))::int as level, count(*) n_files, bool_or(has_tombstone) as has_tombstone from ({FILES}) group by 1, 2")
def _(s, d):
    return compaction.generations(file_rows(s, d)).drop("n_bytes", "full_blocks")


# ---- extensions ---------------------------------------------------------------------------------------------------
def down_sql(seconds: int, agg: str) -> str:
    return f"select sid, clock - clock % {seconds * 10**7} as interval_start, {agg} as value, count(*) n_points from ({CURRENT}) where not isinf(value) group by 1, 2"


def finite(s: SparkSession, d: str) -> DataFrame:
    return current(s, d).filter("abs(value) < double('infinity')")


@query("ext_downsample_average", down_sql(86400, "round(avg(value) * count(*), 3)"))
def _(s, d):
    # values have three decimals, so the average times the count has, too
    return measures.downsample(finite(s, d), 86400, "average").withColumn("value", F.round(F.col("value") * F.col("n_points"), 3))


for _name, _agg in (("maximum", "max(value)"), ("minimum", "min(value)"), ("first", "arg_min(value, clock)"), ("last", "arg_max(value, clock)")):
    query(f"ext_downsample_{_name}", down_sql(86400, _agg))(lambda s, d, name=_name: measures.downsample(finite(s, d), 86400, name))


# With infinite readings, which remain readings
for _name, _agg in (("maximum", "max(value)"), ("minimum", "min(value)"), ("first", "arg_min(value, clock)"), ("last", "arg_max(value, clock)")):
    query(f"ext_downsample_{_name}_all", down_sql(86400, _agg).replace(" where not isinf(value)", ""))(lambda s, d, name=_name: measures.downsample(current(s, d), 86400, name))


@query("ext_predecessor", f"select a.sid, a.clock, p.clock as point_clock, p.seq as value from (select distinct sid, clock from ({ASKED})) a asof left join ({EVENTS}) p on a.sid = p.sid and a.clock >= p.clock")
def _(s, d):
    return merge.predecessors(events(s, d).select("sid", "clock", F.col("seq").alias("value")), asked(s, d).distinct())


# ---- the store, and streams ---------------------------------------------------------------------------------------
def filled_store(s: SparkSession, d: str):
    store = Store(s, scratch(s)).open()
    store.add_sids(registry(s, d).filter("dtype = 0"), 31)
    return store


@query("store_read", f"select sid, clock, value, coalesce(quality, 0) as quality from points_double where value is not null and not isnan(value) and sid in (select sid from series_registry where dtype = 0) and clock between {NOW} - 20 * 864000000000 and {NOW} qualify row_number() over (partition by sid, clock order by seq desc) = 1")
def _(s, d):
    store = filled_store(s, d)
    store.write(points(s, d))
    store.compact()
    return store.read(registry(s, d).filter("dtype = 0"), NOW - 20 * 864_000_000_000, NOW).select("sid", "clock", F.col("v_double").alias("value"), "quality")


@query("stream_ingest", "select sid, clock, value, coalesce(quality, 0) as quality from points_double where value is not null and not isnan(value) and sid in (select sid from series_registry where dtype = 0) qualify row_number() over (partition by sid, clock order by seq desc) = 1")
def _(s, d):
    from tidewell.streaming import ingest

    store = filled_store(s, d)
    path = f"{d}/points_double.parquet"
    source = s.readStream.schema(points(s, d).schema)
    stream = source.parquet(path) if os.path.isdir(path) else source.option("pathGlobFilter", "points_double.parquet").parquet(d)
    ingest.upsert_stream(stream, store, f"{store.path}/checkpoint", available_now=True).awaitTermination()
    return store.read(registry(s, d).filter("dtype = 0")).select("sid", "clock", F.col("v_double").alias("value"), "quality")


# ---- the store: deletes, databases, snapshots, maintenance -----------------------------------------------------------
STORED = f"""select sid, clock, value, coalesce(quality, 0) quality, seq from ({CURRENT}) where sid in (select sid from series_registry where dtype = 0)"""
#: Every third sid loses the clocks of ten days; of these the readings with an even seq are written again.
GONE_LO, GONE_HI = NOW - 30 * 864_000_000_000, NOW - 20 * 864_000_000_000
STORE_SID = "sid in (select sid from series_registry where dtype = 0)"


@query("store_delete", f"""with w as (select sid, clock, value, coalesce(quality, 0) quality, seq from points_double where value is not null and not isnan(value) and clock is not null and {STORE_SID}),
gone as (select * from w where not (sid % 3 = 0 and clock between {GONE_LO} and {GONE_HI})), again as (select * from w where sid % 3 = 0 and clock between {GONE_LO} and {GONE_HI} and seq % 2 = 0)
select sid, clock, value, quality from (select * from gone union all select * from again) qualify row_number() over (partition by sid, clock order by seq desc) = 1""")
def _(s, d):
    store, x = filled_store(s, d), points(s, d)
    store.write(x)
    store.delete_range(registry(s, d).filter("sid % 3 = 0"), GONE_LO, GONE_HI)
    store.write(x.filter(f"sid % 3 = 0 and clock between {GONE_LO} and {GONE_HI} and seq % 2 = 0"))
    store.compact()
    return store.read(registry(s, d).filter("dtype = 0")).select("sid", "clock", F.col("v_double").alias("value"), "quality")


@query("store_delete_ranges", f"""with t as (select sid, min_clock lo, max_clock hi from wal_entries where lower(trim(kind, ' ' || chr(9) || chr(10) || chr(13))) = 'delete_range' and sid is not null)
select sid, clock, value from ({STORED}) p where not exists (select 1 from t where t.sid = p.sid and (lo is null or clock >= lo) and (hi is null or clock <= hi))""")
def _(s, d):
    store = filled_store(s, d)
    store.write(points(s, d))
    ranges = table(s, d, "wal_entries").filter(F.lower(F.expr(r"trim(both ' \t\r\n' from kind)")) == "delete_range")
    store.delete_ranges(ranges.select("sid", F.col("min_clock").alias("lo"), F.col("max_clock").alias("hi")))
    return store.read(registry(s, d).filter("dtype = 0")).select("sid", "clock", F.col("v_double").alias("value"))


@query("store_databases", """with w as (select sid, clock from points_double where value is not null and not isnan(value) and clock is not null group by all),
n as (select db_name, count(*) n_points from w join (select distinct db_name, sid from series_registry where dtype = 0 and db_name is not null and sid is not null) using (sid) group by 1)
select db_name || '-renamed' as database, n_points from n union all select 'default', 0""")
def _(s, d):
    """A database for each name of the registry, all written at once; one that was deleted holds nothing."""
    store, reg = Store(s, scratch(s)).open(), registry(s, d).filter("dtype = 0 and db_name is not null")
    names = sorted(r.db_name for r in reg.select("db_name").distinct().collect())
    for name in names:
        store.create_database(name)
        store.add_sids(reg.filter(F.col("db_name") == name), 31, name)
    store.write(points(s, d))
    for name in names:
        store.rename_database(name, f"{name}-renamed")
    store.create_database("gone")
    store.delete_database("gone")
    counts = [store.read(reg, db=name).agg(F.lit(name).alias("database"), F.count(F.lit(1)).alias("n_points")) for name in store.databases()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("store_backup", f"select sid, clock, value from ({STORED})")
def _(s, d):
    store = filled_store(s, d)
    store.write(points(s, d))
    store.backup(f"{store.path}-backup")
    store.restore(f"{store.path}-backup", "copy")
    return store.read(registry(s, d).filter("dtype = 0"), db="copy").select("sid", "clock", F.col("v_double").alias("value"))


@query("store_snapshot", f"""select sid, clock, value from (
  select * from points_double where value is not null and not isnan(value) and clock is not null and {STORE_SID} and seq % 2 = 1) qualify row_number() over (partition by sid, clock order by seq desc) = 1""")
def _(s, d):
    """What was written before the snapshot, not what came after it, also once that is merged."""
    store, x = filled_store(s, d), points(s, d)
    store.write(x.filter("seq % 2 = 1"))
    held = store.snapshot()
    store.write(x.filter("seq % 2 = 0"))
    store.clear_snapshot(True)
    return held.select("sid", "clock", F.col("v_double").alias("value"))


@query("store_flush", f"""select sid, clock, value, coalesce(quality, 0) quality from points_double where value is not null and not isnan(value) and clock is not null and {STORE_SID}
qualify row_number() over (partition by sid, clock order by seq % 3 desc, seq desc) = 1""")
def _(s, d):
    """Three writes in an order of their own, each merged with what is there; of equal (sid, clock) the last write wins."""
    store, x = filled_store(s, d), points(s, d)
    for part in range(3):
        store.write(x.filter(f"pmod(seq, 3) = {part}"))
        store.flush()
    return store.read(registry(s, d).filter("dtype = 0")).select("sid", "clock", F.col("v_double").alias("value"), "quality")


STORE_SHARDS = f"select count(distinct clock // 864000000000) from points_double where value is not null and not isnan(value) and clock is not null and {STORE_SID}"
STORE_WRITTEN = f"select count(*) from points_double where value is not null and not isnan(value) and clock is not null and {STORE_SID}"


@query("store_maintenance", f"""select * from (values ('idle before', 0::bigint), ('merged', 1::bigint), ('idle after', 1::bigint), ('bytes', 1::bigint), ('modified', 1::bigint)) t(item, value)
union all select 'shards', ({STORE_SHARDS}) union all select 'generations before', 9 * ({STORE_SHARDS}) union all select 'generations after', ({STORE_SHARDS})""")
def _(s, d):
    """Nine writes to every shard, merged by the planner: eight generations of a level, then all of a cold shard."""
    store, x = filled_store(s, d), points(s, d)
    for _ in range(9):
        store.write(x)
    n = len(store.shards())
    out = [("shards", n), ("idle before", int(store.is_idle())), ("generations before", store.generation_table().count())]
    out.append(("merged", int(store.maintain(NOW, NOW) == n)))
    store.maintain(NOW + 2 * compaction.COLD_TICKS, NOW)
    out += [("idle after", int(store.is_idle())), ("generations after", store.generation_table().count()), ("bytes", int(store.disk_size() == sum(e[3] for e in store.file_table()) + sum(e.n_bytes for e in store.files.walk(f"{store.path}/registry/commit={store.meta['databases']['default']['registry']}"))))]
    return s.createDataFrame([*out, ("modified", int(store.last_modified() > 0))], "item string, value bigint")


@query("store_counters", f"""select 'store' as module, 'writes' as counter, 2::bigint as value union all select 'store', 'points_accepted', 2 * ({STORE_WRITTEN}) union all select 'store', 'deletes', 1
union all select 'store', 'reads', 1 union all select 'shard', 'shards', ({STORE_SHARDS}) union all select 'engine', 'generations', 2 * ({STORE_SHARDS}) union all select 'cache', 'unmerged_generations', 2 * ({STORE_SHARDS})
union all select 'log', 'deletes', 1 union all select 'engine', 'level_1_generations', 2 * ({STORE_SHARDS}) union all select 'shard', 'retention_periods', 1""")
def _(s, d):
    store, x = filled_store(s, d), points(s, d)
    store.write(x)
    store.write(x)
    store.delete_range(registry(s, d), GONE_LO, GONE_HI)
    store.read([17])
    shown = F.col("counter").isin("writes", "points_accepted", "deletes", "reads", "shards", "generations", "unmerged_generations", "level_1_generations", "retention_periods")
    return store.statistics().filter(shown).select("module", "counter", "value")


@query("store_expire", f"select sid, clock, value from ({STORED}) where not {NOW} > clock - clock % 864000000000 + 32 * 864000000000")
def _(s, d):
    store = filled_store(s, d)
    store.write(points(s, d))
    store.expire(NOW)
    return store.read(registry(s, d).filter("dtype = 0")).select("sid", "clock", F.col("v_double").alias("value"))


# ---- the change log ----------------------------------------------------------------------------------------------------
def filled_log(s: SparkSession, d: str) -> ChangeLog:
    log, feed = ChangeLog(s, scratch(s)), table(s, d, "wal_entries")
    for part in (1, 2, 0):
        log.append(feed.filter(f"pmod(seq, 3) = {part}"))
    return log


@query("log_replay", SQL["replayed_table"])
def _(s, d):
    return filled_log(s, d).replay()


@query("log_entries", "select seq, coalesce(kind, '') kind, coalesce(sid, -1) sid, coalesce(clock, -1) clock, coalesce(min_clock, -1) min_clock, coalesce(max_clock, -1) max_clock from wal_entries where seq is not null")
def _(s, d):
    return filled_log(s, d).read().select("seq", F.coalesce("kind", F.lit("")).alias("kind"), *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("sid", "clock", "min_clock", "max_clock")])


@query("log_segments", "select ((seq % 3) + 2) % 3 + 1 as segment, count(*) as n from wal_entries where seq is not null and seq % 3 <> 0 group by 1")
def _(s, d):
    """Entries by segment; the last segment is removed."""
    log = filled_log(s, d)
    log.remove(log.segments()[2:])
    return log.read().groupBy(F.expr("int(regexp_extract(input_file_name(), 'segment-([0-9]+)', 1))").alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@query("log_deletes", f"select sid, clock, value from ({EVENTS}) where sid not in {SIDS[:4]} and not (sid in {SIDS[4:]} and clock >= {LO}) qualify row_number() over (partition by sid, clock order by seq desc) = 1")
def _(s, d):
    log = ChangeLog(s, scratch(s))
    log.write(events(s, d))
    log.delete(list(SIDS[:4]), 10**15)
    log.delete_range(list(SIDS[4:]), LO, None, 10**15 + 1)
    return log.replay().select("sid", "clock", "value")


# ---- orders and lists --------------------------------------------------------------------------------------------------
@query("sorted_points", f"select sid, clock, seq, true as in_order from ({EVENTS})")
def _(s, d):
    """Whether each point follows the one before it in its partition, and partitions follow each other."""
    from pyspark.sql import Window

    x = merge.sorted_series(events(s, d)).withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()})
    inside = Window.partitionBy("part").orderBy("row")
    x = x.withColumn("before", F.lag(F.struct("sid", "clock")).over(inside))
    ends = x.groupBy("part").agg(F.min(F.struct("sid", "clock")).alias("lo"), F.max(F.struct("sid", "clock")).alias("hi"))
    crossed = ends.alias("a").join(ends.alias("b"), F.expr("b.part = a.part + 1 and b.lo < a.hi"), "left_semi").select(F.col("a.part").alias("part"), F.lit(True).alias("crossed"))  # a row for each partition
    ok = (F.col("before").isNull() | (F.col("before") <= F.struct("sid", "clock"))) & F.col("crossed").isNull()
    return x.join(crossed, "part", "left").select("sid", "clock", "seq", ok.alias("in_order"))


@query("sorted_files", "select file, row_number() over (order by min_clock, max_clock, file) as place from (select l_returnflag || l_linestatus || l_linenumber::varchar as file, min(l_shipdate) min_clock, max(l_shipdate) max_clock from lineitem group by 1)")
def _(s, d):
    x = table(s, d, "lineitem").select(F.col("l_suppkey").alias("sid"), clock_of("l_shipdate").alias("clock"), F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("file"))
    return shards.in_time_order(measures.file_stats(x, "file"), "file").select("file", "place")


@query("remove_positions", f"select sid, clock, seq from (select *, row_number() over (partition by sid order by clock, seq) - 1 as nth from ({EVENTS})) where nth not between 3 and 7")
def _(s, d):
    return merge.remove_positions(events(s, d), 3, 5).select("sid", "clock", "seq")


LIST_ASKED = f"(select distinct sid, clock + (seq % 2) as clock from ({EVENTS}) where seq % 5 = 0)"


def list_asked(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).filter("seq % 5 = 0").select("sid", F.expr("clock + seq % 2").alias("clock"))


@query("positions_of", f"select a.sid, a.clock, coalesce(p.nth, -1) as at from {LIST_ASKED} a left join (select sid, clock, min(nth) nth from (select sid, clock, row_number() over (partition by sid order by clock) - 1 as nth from ({EVENTS})) group by 1, 2) p on a.sid = p.sid and a.clock = p.clock")
def _(s, d):
    return merge.positions_of(events(s, d), list_asked(s, d))


@query("contains_points", f"select a.sid, a.clock, exists (select 1 from ({EVENTS}) p where p.sid = a.sid and p.clock = a.clock) as found from {LIST_ASKED} a")
def _(s, d):
    return merge.contains_points(events(s, d), list_asked(s, d))


@query("simulated_points", "select i % 5000 + 1 as sid, 637021734000000000 + (i // 5000) * 10000000 as clock, 0 as quality, i // 5000 as seq, true as in_range from range(20000) t(i)")
def _(s, d):
    x = simulate.simulate(s, "double", 5000, 4)
    return x.select("sid", "clock", "quality", "seq", F.expr("value >= 0 and value < 1").alias("in_range"))


@query("stored_stats", "select min(clock) min_clock, max(clock) max_clock, min(sid) min_sid, max(sid) max_sid, count(*) n_points, true as has_bytes from points_double")
def _(s, d):
    """stored_file_stats of all files together."""
    x = measures.stored_file_stats(points(s, d))
    return x.agg(F.min("min_clock").alias("min_clock"), F.max("max_clock").alias("max_clock"), F.min("min_sid").alias("min_sid"), F.max("max_sid").alias("max_sid"), F.sum("n_points").alias("n_points"), (F.min("n_bytes") > 0).alias("has_bytes"))


@query("checksum_of_codes", """with t as (select list(c order by i) crc_of from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) c from range(256) r(i))),
b as (select distinct tags, list_transform(range(octet_length(encode(tags))), lambda i: ('0x' || substr(hex(encode(tags)), (2 * i + 1)::bigint, 2))::bigint) bytes from documents where tags is not null)
select tags, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda a, x: xor(a >> 8, crc_of[(xor(a, x) & 255) + 1])), 4294967295::bigint) crc from b, t""")
def _(s, d):
    return table(s, d, "documents").select("tags").filter("tags is not null").distinct().withColumn("crc", codes.checksum(F.col("tags")))
