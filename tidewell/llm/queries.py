"""Queries of the operators for training data, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import bpe, packing, reading, runs, sketch
from tidewell.queries import CURRENT, table
from tidewell.sources.files import scratch


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.above_limit(table(spark, sf_dir, "points_double"), table(spark, sf_dir, "series_registry"))


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.percentiles(table(spark, sf_dir, "points_double"))


def p1_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_found from sketches of single days, which are kept as a table and merged."""
    path = scratch(spark)
    sketch.daily_sketches(table(spark, sf_dir, "points_double")).write.parquet(path)
    return sketch.above(sketch.merge_daily(spark.read.parquet(path)), table(spark, sf_dir, "series_registry"))


def p1_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "points_double")
    return sketch.rank_errors(points, sketch.percentiles(points)).select("pct", "n_sids", "n_within")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.collapse_runs(table(spark, sf_dir, "points_bool")).select("sid", "start_clock", "end_clock", "n_points")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"))


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_check(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.demanding(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_samples"))


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.profile(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_samples"))


def p9_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.validation(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_samples"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_values": p1_values,
    "p1_daily": p1_daily,
    "p1_ranks": p1_ranks,
    "p4_found": p4_found,
    "p7_ids": p7_ids,
    "p7_round_trip": p7_round_trip,
    "p8_containers": p8_containers,
    "p8_check": p8_check,
    "p9_found": p9_found,
    "p9_profile": p9_profile,
    "p9_validation": p9_validation,
}

ABOVE = f"""with cur as (
  {CURRENT}), q as (select sid, quantile_disc(value,0.5) q50, quantile_disc(value,0.9) q90, quantile_disc(value,0.99) q99 from cur group by sid),
l as (select sid,max(p50_limit) l50,max(p90_limit) l90,max(p99_limit) l99 from series_registry group by sid), j as (select * from q join l using(sid))
select sid,50 pct from j where q50>l50 union all select sid,90 from j where q90>l90 union all select sid,99 from j where q99>l99"""

SQL: dict[str, str] = {
    "p1_found": ABOVE,
    "p1_daily": ABOVE,
    "p1_ranks": f"""with cur as (
  {CURRENT}), n as (select count(distinct sid) n from cur) select pct::int pct, n n_sids, n n_within from n, (values (50), (90), (99)) t(pct)""",
    "p7_round_trip": "select doc_id, true as same from documents",
    "p8_check": """select pack_id, (select count(distinct doc_id) from documents) documents, (select count(*) from documents) rows_of_documents, 0::bigint overfull, 0::bigint broken, true tight
from pack_sizes""",
    "p4_found": """with cur as (select sid,clock,value,seq from points_bool where value is not null qualify row_number() over (partition by sid,clock order by seq desc)=1),
f as (select *, case when value=lag(value) over w and clock-lag(clock) over w<=216000000000 then 0 else 1 end b from cur window w as (partition by sid order by clock)),
r as (select *, sum(b) over (partition by sid order by clock rows unbounded preceding) k from f)
select sid,min(clock) start_clock,max(clock) end_clock,count(*) n_points from r group by sid,k having count(*)>=2""",
}
