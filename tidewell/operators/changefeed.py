"""Applying a feed of writes, deletes and range deletes by equality-delete keys with sequence numbers.

Inserts and deletes are kept apart, each with the sequence number of its change; a reader drops the rows for
which a later delete key exists. A delete of a series is a range that is open on both sides. So that ranges
become keys that can be joined by equality, the clock is cut into buckets (a day by default): the whole
buckets a range covers are written as at most 2 * LEVELS dyadic nodes (sid, level, node), and its two ends
as parts of a bucket. No row is ever matched with every range of its series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import lanes

BUCKET_TICKS = 864_000_000_000
#: Buckets are counted from -2**25; with LEVELS levels every 64-bit clock has a bucket, for buckets of 2**39 ticks and more.
BUCKET_ZERO, LEVELS = 2**25, 27


def split_changes(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inserts (sid, clock, value, quality, seq) and deletes (sid, lo, hi, seq; null lo or hi: open).

    kind counts without case and padding (spaces, tabs, line ends); other kinds, null sids and null seq are set aside, as are writes with
    a null or NaN value or null clock, and inverted ranges.
    """
    kind = F.lower(F.expr(r"trim(both ' \t\r\n' from kind)"))
    known = feed.filter("sid is not null and seq is not null")
    inserts = lanes.live(known.filter(kind == "write")).select("sid", "clock", "value", "quality", "seq")
    ranged = kind == "delete_range"
    deletes = known.filter(ranged | (kind == "delete")).select(
        "sid", F.when(ranged, F.col("min_clock")).alias("lo"), F.when(ranged, F.col("max_clock")).alias("hi"), "seq"
    )
    return inserts, deletes.filter("lo is null or hi is null or lo <= hi")


def delete_entries(deletes: DataFrame, bucket_ticks: int = BUCKET_TICKS) -> DataFrame:
    """Each delete (sid, lo, hi, seq) as its keys, in one pass: (sid, level, node, lo, hi, seq).

    Level 0 and above: the whole buckets of a dyadic node. Level -1: from lo to hi of one bucket, whose number is node.
    """
    t, zero, last = bucket_ticks, BUCKET_ZERO, 2 ** (LEVELS - 1) - 1
    # integer floor division (clocks may be negative)
    floor = lambda c: f"(({c} - pmod({c}, {t})) div {t} + {zero})"
    start = lambda b: f"({b} - {zero}) * {t}"
    d = deletes.selectExpr(
        "sid", "seq", "cast(lo as bigint) lo", "cast(hi as bigint) hi",
        f"case when lo is null then 0 else {floor('lo')} end b_lo", f"case when hi is null then {last} else {floor('hi')} end b_hi",
        f"lo is null or pmod(lo, {t}) = 0 full_lo", f"hi is null or pmod(hi, {t}) = {t - 1} full_hi",
    ).withColumns({"a": F.expr("cast(if(full_lo, b_lo, b_lo + 1) as bigint)"), "z": F.expr("cast(if(full_hi, b_hi + 1, b_hi) as bigint)")})  # fmt: skip  whole buckets [a, z)
    # canonical nodes: the whole node lies inside [a, z) and that of its parent does not
    left = "(a + shiftleft(1L, level) - 1) div shiftleft(1L, level)"
    right = "(z div shiftleft(1L, level) - 1)"
    node = lambda n: f"struct(level, {n} as node, cast(null as bigint) as lo, cast(null as bigint) as hi)"
    part = lambda b, lo, hi: f"struct(-1 as level, cast({b} as bigint) as node, cast({lo} as bigint) as lo, cast({hi} as bigint) as hi)"
    nodes = f"""if(a < z, flatten(transform(sequence(0, {LEVELS - 1}), level -> array(
      if({left} % 2 = 1 and ({left} + 1) * shiftleft(1L, level) <= z, {node(left)}, null),
      if({right} % 2 = 0 and {right} * shiftleft(1L, level) >= a, {node(right)}, null)))), array())"""
    parts = f"""array(
      if(not full_lo, {part("b_lo", "lo", f"if(hi is null or b_hi > b_lo, {start('b_lo')} + {t - 1}, hi)")}, null),
      if(not full_hi and (b_hi > b_lo or full_lo), {part("b_hi", start("b_hi"), "hi")}, null))"""
    keys = d.withColumn("key", F.explode(F.expr(f"filter(concat({nodes}, {parts}), x -> x is not null)")))
    return keys.select("sid", "key.level", "key.node", "key.lo", "key.hi", "seq")


def split_entries(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (sid, level, node, seq: the latest) and parts (sid, bucket, lo, hi, seq)."""
    nodes = entries.filter("level >= 0").groupBy("sid", "level", "node").agg(F.max("seq").alias("seq"))
    return nodes, entries.filter("level < 0").select("sid", F.col("node").alias("bucket"), "lo", "hi", "seq")


def delete_keys(deletes: DataFrame, bucket_ticks: int = BUCKET_TICKS) -> tuple[DataFrame, DataFrame]:
    """Keys (sid, level, node, seq: the latest) for whole buckets, and parts (sid, bucket, lo, hi, seq) for the ends."""
    return split_entries(delete_entries(deletes, bucket_ticks))


def surviving_rows(inserts: DataFrame, deletes: DataFrame, bucket_ticks: int = BUCKET_TICKS, **options) -> DataFrame:
    """The rows that a reader still sees: the latest insert of each (sid, clock), unless a delete with a higher seq covers it."""
    lanes.checkpoint_dir(inserts.sparkSession)
    entries = delete_entries(deletes, bucket_ticks).checkpoint()  # read several times
    return rows_not_deleted(inserts, *split_entries(entries), bucket_ticks, **options)


def drop_deleted(rows: DataFrame, deletes: DataFrame, bucket_ticks: int = BUCKET_TICKS, **options) -> DataFrame:
    """All rows that no delete (sid, lo, hi, seq) with a higher seq covers, also several of one (sid, clock)."""
    return surviving_rows(rows, deletes.filter("sid is not null and seq is not null and (lo is null or hi is null or lo <= hi)"), bucket_ticks, latest=False, **options)


def rows_not_deleted(
    inserts: DataFrame, nodes: DataFrame, parts: DataFrame, bucket_ticks: int = BUCKET_TICKS, latest: bool = True, ties: tuple[str, ...] = (), target_rows: int = lanes.TARGET_ROWS
) -> DataFrame:
    """Rows of inserts (sid, clock, seq and any other columns) that no later delete covers, by the keys that delete_entries
    made, in any number of jobs. latest: of each (sid, clock) only the one with the highest seq, and of equal seq the one
    that is last by the columns ``ties``. Rows with a null sid, clock or seq are left out if latest, else kept.

    A bucket that holds more than twice target_rows rows (more where the table is so large that there would be
    more than MAX_HEAVY of them) is cut into finer ones by the span of its rows, for which the keys are made anew.
    """
    t = bucket_ticks
    spark = inserts.sparkSession
    schema = inserts.schema
    bare = inserts.columns == ["sid", "clock", "seq"]
    bucket = F.expr(f"(clock - pmod(clock, {t})) div {t} + {BUCKET_ZERO}")
    known = F.col("sid").isNotNull() & F.col("clock").isNotNull() & F.col("seq").isNotNull()
    lanes.checkpoint_dir(spark)
    sizes = inserts.filter(known).groupBy("sid", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("clock").alias("first"), F.max("clock").alias("last")).checkpoint()  # a row for each bucket
    rows = sizes.agg(F.sum("n")).first()[0] or 0
    levels = sorted(r.level for r in nodes.select("level").distinct().collect())
    ancestor = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("bucket", k).alias("node")) for k in levels])) if levels else F.lit(None)
    covers = spark.createDataFrame([], "sid bigint, bucket bigint, seq bigint")
    if levels:
        covers = sizes.select("sid", "bucket", ancestor.alias("a")).select("sid", "bucket", "a.level", "a.node").join(nodes, ["sid", "level", "node"]).groupBy("sid", "bucket").agg(F.max("seq").alias("seq"))
    target = max(target_rows, rows // lanes.MAX_HEAVY, 1)
    crowded = sizes.filter((F.col("n") > 2 * target) & (F.col("first") < F.col("last"))).collect()  # at most MAX_HEAVY / 2 rows, by the choice of target
    finer = None
    if crowded:
        most = max(r.n for r in crowded)
        span = max(r.last - r.first for r in crowded) + 1
        named = spark.createDataFrame([(r.sid, r.bucket, i, r.first, r.last) for i, r in enumerate(crowded)], "sid bigint, bucket bigint, name bigint, first bigint, last bigint")
        names = F.broadcast(named)
        tie = [f"_tie{i}" for i in range(len(ties))]
        dense = inserts.filter(known).select(F.struct(*inserts.columns).alias("row"), "sid", "seq", bucket.alias("bucket"), "clock", *[F.col(c).alias(k) for c, k in zip(ties, tie, strict=True)])
        dense = dense.join(names, ["sid", "bucket"]).select(F.col("name").alias("sid"), (F.col("clock") - F.col("first")).alias("clock"), "seq", "row", *tie).checkpoint()
        inner = parts.join(names, ["sid", "bucket"]).select("name", "first", "last", "lo", "hi", "seq")
        inner = inner.unionByName(covers.join(names, ["sid", "bucket"]).select("name", "first", "last", F.col("first").alias("lo"), F.col("last").alias("hi"), "seq"))
        # clocks count from the first row of the bucket; what a delete covers beyond its rows is of no account
        inner = inner.selectExpr("name sid", "greatest(lo, first) - first lo", "least(hi, last) - first hi", "seq").filter("lo <= hi")
        step = max(1, span // 2 ** (most // target).bit_length())
        finer = surviving_rows(dense, inner, step, latest=latest, ties=tuple(tie), target_rows=target).select("row.*")
        rest = lambda df: df.join(names, ["sid", "bucket"], "left_anti")
        covers, parts = rest(covers), rest(parts)
    off = lambda c: f"cast({c} - (bucket - {BUCKET_ZERO}) * {t} as bigint)"
    payload = F.lit(0).alias("row") if bare else F.struct(*inserts.columns).alias("row")
    none = "cast(null as int) row" if bare else f"cast(null as {schema.simpleString()}) row"
    stream = inserts.withColumn("row", payload).withColumn("bucket", bucket)
    stream = stream.select("row", F.col("sid").cast("long").alias("sid"), F.col("clock").cast("long").alias("clock"), F.col("seq").cast("long").alias("seq"), "bucket")
    if latest:
        stream = stream.filter(known)
    if crowded:
        stream = rest(stream)
    # rows without a key are dealt out, and kept: hi is -2
    has = "(sid is not null and clock is not null and seq is not null)"
    stream = (
        stream.selectExpr(
            f"if({has}, sid, coalesce(sid, clock, seq, 0)) sid", f"if({has}, bucket, -1L) bucket", f"if({has}, {off('clock')}, 0L) lo", f"if({has}, -1L, -2L) hi", "coalesce(seq, 0L) seq", "row"
        )
        .unionByName(parts.selectExpr("sid", "bucket", f"{off('lo')} lo", f"{off('hi')} hi", "seq", none))
        .unionByName(covers.selectExpr("sid", "bucket", "cast(0 as bigint) lo", f"cast({t - 1} as bigint) hi", "seq", none))
    )
    bits = int(t).bit_length()
    keys = pa.schema([("sid", pa.int64()), ("clock", pa.int64()), ("seq", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in lanes.groups(batches, ("sid", "bucket")):
            b = lanes.columns([x.select(["sid", "bucket", "lo", "hi", "seq"]) for x in held])
            g, _ = lanes.group_index(b["sid"], b["bucket"])
            at, seq = (g << bits) + b["lo"], b["seq"]
            r = np.flatnonzero(b["hi"] == -1)
            r = r[np.lexsort((seq[r], at[r]))]
            if latest and len(r):
                r = r[np.r_[at[r][1:] != at[r][:-1], True]]
            d = np.flatnonzero(b["hi"] >= 0)
            place = at[r]
            lo = np.searchsorted(place, at[d], "left")
            hi = np.searchsorted(place, (g[d] << bits) + b["hi"][d], "right")
            s = r[seq[r] > latest_cover(lo, hi, seq[d], len(r)) if len(d) else slice(None)]
            if bare:
                yield lanes.batch(keys, b["sid"][s], (b["bucket"][s] - BUCKET_ZERO) * t + b["lo"][s], seq[s])
                continue
            keep = b["hi"] == -2
            keep[s] = True
            done = 0
            for x in held:
                kept = x.column("row").filter(pa.array(keep[done : done + x.num_rows]))
                done += x.num_rows
                if len(kept):
                    yield pa.RecordBatch.from_arrays(kept.flatten(), names=schema.names)

    order = [F.col(f"row.{c}") for c in ties]
    return stream.repartition(lanes.tasks(spark, rows), "sid", "bucket").sortWithinPartitions("sid", "bucket", *order).mapInArrow(apply, schema).transform(lambda out: out if finer is None else out.unionByName(finer))


def latest_cover(lo: np.ndarray, hi: np.ndarray, seq: np.ndarray, n: int) -> np.ndarray:
    """For each of n positions the highest seq of the intervals [lo, hi) that hold it (the least int64 if none).

    Each interval is marked as two overlapping powers of two, which are then pushed down level by level.
    """
    least = np.iinfo(np.int64).min
    out = np.full(n, least)
    some = lo < hi
    lo, hi, seq = lo[some], hi[some], seq[some]
    if not len(lo):
        return out
    level = np.frexp((hi - lo).astype(float))[1] - 1
    higher = None
    for k in range(int(level.max()), -1, -1):
        w = 1 << k
        marks = np.full(n, least)
        if higher is not None:
            np.maximum(marks, higher, out=marks)
            np.maximum(marks[w:], higher[:-w], out=marks[w:])
        at = level == k
        np.maximum.at(marks, lo[at], seq[at])
        np.maximum.at(marks, hi[at] - w, seq[at])
        higher = marks
    return higher


def apply_changes(feed: DataFrame, bucket_ticks: int = BUCKET_TICKS, **options) -> DataFrame:
    """(sid, clock, seq) of the points that remain after all changes, in the order of seq; a repeated seq acts once.

    Of two different writes with one seq to one (sid, clock) either may stay; they give the same row here. An
    empty feed gives no rows; other columns are ignored.
    """
    inserts, deletes = split_changes(feed)
    return surviving_rows(inserts.select("sid", "clock", "seq"), deletes, bucket_ticks, **options)


def current_table(feed: DataFrame, bucket_ticks: int = BUCKET_TICKS, **options) -> DataFrame:
    """The rebuilt table: sid, clock, value, quality, seq; of two writes with one seq to one (sid, clock) the one with the
    higher value, then quality (null is lowest)."""
    inserts, deletes = split_changes(feed)
    return surviving_rows(inserts, deletes, bucket_ticks, ties=("value", "quality"), **options)
