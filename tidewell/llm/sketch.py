"""Percentiles of very large groups by dyadic Count-sketches.

A value is encoded as a 36-bit integer in the order of doubles (sign, exponent, 24 bits of mantissa, so values
are right to a relative 2**-24). For each binary resolution of that integer a signed Count-sketch keeps how
many values fall into each of its nodes; the coarsest, by sign and exponent, is exact. Sketches are merged by
adding their cells, a value is deleted by adding -1, and a sketch folds to half its width by adding the halves
of each row, so sketches of different widths can be merged. A percentile is found by descending the levels:
at each node, the estimated count of the left half decides on which side the wanted rank lies.

A sketch of few distinct codes is kept as these codes with their counts, as long as that is smaller than its cells; the
cells follow from them. Sketches are added up in each task, then over salts of a series, then by series.

Error: a node's count is off by about sqrt(F2 / width) per level (F2: sum of squared counts), median of DEPTH
rows. With a width of 4096 a rank is off by about 0.1 % of n for a thousand values and less for more.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import lanes, merge, rolling

BITS, LEVELS, DEPTH = 36, 24, 5
TOP = 1 << (BITS - LEVELS)
WIDTH_BITS, LEAST_WIDTH_BITS = 12, 6
#: Cells of a level that are held at once while a block of series is sketched.
MOST_CELLS = 1 << 19
#: Share of the readings of a sid by which a rank may be off.
LARGEST_ERROR = 0.002
_SIGN = np.uint64(1 << 63)
_random = np.random.default_rng(20190823)
#: Fixed by the seed, so that sketches of different jobs can be merged.
_MULTIPLY = _random.integers(1, 2**63, (LEVELS, DEPTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 2**63, (LEVELS, DEPTH), dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def encode(value: np.ndarray) -> np.ndarray:
    bits = (np.asarray(value, np.float64) + 0.0).view(np.uint64)
    ordered = np.where(bits & _SIGN, ~bits, bits | _SIGN)
    return ordered >> np.uint64(64 - BITS)


def decode(code: np.ndarray) -> np.ndarray:
    ordered = np.asarray(code, np.uint64) << np.uint64(64 - BITS)
    return np.where(ordered & _SIGN, ordered ^ _SIGN, ~(ordered | np.uint64((1 << (64 - BITS)) - 1))).view(np.float64)


def _hash(node: np.ndarray, level: int, row: int) -> np.ndarray:
    h = node * _MULTIPLY[level, row] + _ADD[level, row]
    h ^= h >> np.uint64(32)
    return h * _MIX


def _cells(code: np.ndarray, weight: np.ndarray | None, offset: np.ndarray, shift: np.ndarray, total: int, level: int) -> np.ndarray:
    """Cells (DEPTH, total) of one level; offset and shift: of each value, the first cell of its sketch, and 64 - width bits."""
    node = code >> np.uint64(level)
    out = np.empty((DEPTH, total))
    for r in range(DEPTH):
        h = _hash(node, level, r)
        sign = 1.0 - 2.0 * ((h >> np.uint64(7)) & np.uint64(1)).astype(np.float64)
        out[r] = np.bincount(offset + (h >> shift).astype(np.int64), weights=sign if weight is None else sign * weight, minlength=total)
    return out


def _descend(cells: Callable[[int], np.ndarray], top: tuple[np.ndarray, np.ndarray], offset: np.ndarray, shift: np.ndarray, percents: tuple[float, ...]) -> np.ndarray:
    """(sketches, percents): the value of each percentile; NaN for an empty sketch. top: the nodes of the exact level that
    occur, as sketch * TOP + node in ascending order, and their counts."""
    places, counts = top
    groups = len(offset)
    n = np.bincount(places // TOP, counts, groups)
    g = np.repeat(np.arange(groups), len(percents))
    if not len(places):
        return np.full((groups, len(percents)), np.nan)
    want = np.clip(np.ceil(n[g] * np.tile(np.array(percents) / 100.0, groups) - 1e-9), 1, np.maximum(n[g], 1))
    upto, base = np.cumsum(counts), np.cumsum(n) - n
    at = np.minimum(np.searchsorted(upto, base[g] + want), len(places) - 1)
    count = counts[at].astype(float)
    before = upto[at] - count - base[g]
    node = places[at] % TOP
    node = node.astype(np.uint64)
    for level in range(LEVELS - 1, -1, -1):
        c = cells(level)
        left = node << np.uint64(1)
        guess = []
        for child in (left, left + np.uint64(1)):
            rows = np.empty((DEPTH, len(g)))
            for r in range(DEPTH):
                h = _hash(child, level, r)
                sign = 1.0 - 2.0 * ((h >> np.uint64(7)) & np.uint64(1)).astype(np.float64)
                rows[r] = sign * c[r, offset[g] + (h >> shift[g]).astype(np.int64)]
            guess.append(np.median(rows, axis=0))
        here = np.clip((guess[0] + count - guess[1]) / 2, 0, count)
        right = before + here < want - 0.5
        node = left + right.astype(np.uint64)
        before = before + np.where(right, here, 0)
        count = np.where(right, count - here, here)
    out = decode(node)
    out[n[g] <= 0] = np.nan
    return out.reshape(groups, len(percents))


class DyadicSketch:
    """One mergeable sketch. update(values), update(values, -1) to delete; merge; percentiles; to_bytes, from_bytes."""

    def __init__(self, width_bits: int = WIDTH_BITS):
        self.width_bits = width_bits
        self.top = np.zeros(TOP, np.int64)
        self.cells = np.zeros((LEVELS, DEPTH, 1 << width_bits), np.int64)

    @property
    def n(self) -> int:
        return int(self.top.sum())

    def update(self, values: np.ndarray, weight: int | np.ndarray = 1) -> DyadicSketch:
        """NaN is left out."""
        values = np.asarray(values, np.float64)
        weights = np.broadcast_to(np.asarray(weight, np.float64), values.shape)
        ok = ~np.isnan(values)
        return self.add_codes(encode(values[ok]), weights[ok])

    def add_codes(self, code: np.ndarray, weights: np.ndarray) -> DyadicSketch:
        self.top += np.bincount((code >> np.uint64(LEVELS)).astype(np.int64), weights=weights, minlength=TOP).astype(np.int64)
        zero, shift = np.zeros(len(code), np.int64), np.full(len(code), 64 - self.width_bits, np.uint64)
        for level in range(LEVELS):
            self.cells[level] += _cells(code, weights, zero, shift, 1 << self.width_bits, level).astype(np.int64)
        return self

    def fold(self, width_bits: int) -> DyadicSketch:
        out = DyadicSketch(width_bits)
        out.top = self.top.copy()
        out.cells = self.cells.reshape(LEVELS, DEPTH, 1 << width_bits, -1).sum(axis=3)
        return out

    def merge(self, other: DyadicSketch) -> DyadicSketch:
        w = min(self.width_bits, other.width_bits)
        a, b = (s if s.width_bits == w else s.fold(w) for s in (self, other))
        out = DyadicSketch(w)
        out.top, out.cells = a.top + b.top, a.cells + b.cells
        return out

    def percentiles(self, percents: tuple[float, ...]) -> np.ndarray:
        there = np.flatnonzero(self.top)
        return _descend(lambda level: self.cells[level], (there, self.top[there]), np.zeros(1, np.int64), np.full(1, 64 - self.width_bits, np.uint64), percents)[0]

    def to_bytes(self) -> bytes:
        flat = np.concatenate([self.top, self.cells.ravel()])
        small = np.abs(flat).max(initial=0) < 2**31
        return bytes([self.width_bits, int(small)]) + zlib.compress(flat.astype("<i4" if small else "<i8").tobytes(), 1)

    @staticmethod
    def from_bytes(data: bytes) -> DyadicSketch:
        out = DyadicSketch(data[0])
        flat = np.frombuffer(zlib.decompress(data[2:]), "<i4" if data[1] else "<i8").astype(np.int64)
        out.top, out.cells = flat[:TOP].copy(), flat[TOP:].reshape(out.cells.shape).copy()
        return out


def block_percentiles(g: np.ndarray, value: np.ndarray, groups: int, percents: tuple[float, ...], weight: np.ndarray | None = None, coded: bool = False) -> np.ndarray:
    """Sketches the groups of a block side by side, and descends them together, one level at a time.

    g: group of each value, ascending; coded: values are codes, each counted by its weight. A group of n values gets a
    width of at least 16 n, from 2**LEAST_WIDTH_BITS up to 2**WIDTH_BITS.
    """
    code = value if coded else encode(value)
    n = np.bincount(g, minlength=groups)
    bits = np.clip(np.ceil(np.log2(np.maximum(n, 1) * 16.0)).astype(np.int64), LEAST_WIDTH_BITS, WIDTH_BITS)
    width = np.left_shift(1, bits)
    part = np.cumsum(width) // MOST_CELLS
    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, groups]
    rows = np.searchsorted(g, cuts)
    out = np.full((groups, len(percents)), np.nan)
    for a, z, i, j in zip(cuts, cuts[1:], rows, rows[1:]):
        if i == j:
            continue
        own, c = g[i:j] - a, code[i:j]
        offset = np.cumsum(width[a:z]) - width[a:z]
        shift = (64 - bits[a:z]).astype(np.uint64)
        w = None if weight is None else weight[i:j].astype(np.float64)
        nodes = own * TOP + (c >> np.uint64(LEVELS)).astype(np.int64)
        if w is None:
            top = np.unique(nodes, return_counts=True)
        else:
            places, at = np.unique(nodes, return_inverse=True)
            top = places, np.bincount(at, w).astype(np.int64)
        of, sh, total = offset[own], shift[own], int(width[a:z].sum())
        out[a:z] = _descend(lambda level, c=c, w=w, of=of, sh=sh, total=total: _cells(c, w, of, sh, total, level), top, offset, shift, percents)
    return out


#: A row is a percentile, or a sketch as counted codes or as cells.
SKETCH_SCHEMA = pa.schema(
    [("sid", pa.int64()), ("pct", pa.int32()), ("value", pa.float64()), ("day_no", pa.int64()), ("codes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("cells", pa.binary())]
)
SKETCH_DDL = "sid bigint, pct int, value double, day_no bigint, codes array<bigint>, counts array<bigint>, cells binary"
DAY_TICKS = 864_000_000_000


def most_codes(width_bits: int) -> int:
    """Distinct codes up to which they take less room than the cells, at 16 bytes a code and 4 a cell."""
    return (LEVELS * DEPTH << width_bits) // 4


def value_rows(sid: np.ndarray, percents: tuple[int, ...], values: np.ndarray) -> pa.RecordBatch:
    n = values.size
    return lanes.batch(SKETCH_SCHEMA, np.repeat(sid, len(percents)), np.tile(np.array(percents, np.int32), len(values)), values.ravel(), *[pa.nulls(n, SKETCH_SCHEMA.field(k).type) for k in range(3, 7)])


def code_rows(sid: np.ndarray, day: np.ndarray | None, ends: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Sketches as counted codes; ends: behind the last code of each."""
    n = len(sid)
    offsets = pa.array(np.r_[0, ends], pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int64())) for v in (codes, counts)]
    days = pa.nulls(n, pa.int64()) if day is None else pa.array(day, pa.int64())
    return lanes.batch(SKETCH_SCHEMA, sid, pa.nulls(n, pa.int32()), pa.nulls(n, pa.float64()), days, *lists, pa.nulls(n, pa.binary()))


def cell_rows(sid: int, sketch: DyadicSketch, day: int | None = None) -> pa.RecordBatch:
    none = [pa.nulls(1, SKETCH_SCHEMA.field(k).type) for k in (1, 2)], [pa.nulls(1, SKETCH_SCHEMA.field(k).type) for k in (4, 5)]
    return lanes.batch(SKETCH_SCHEMA, np.array([sid]), *none[0], pa.array([day], pa.int64()), *none[1], pa.array([sketch.to_bytes()], pa.binary()))


def counted(g: np.ndarray, code: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (group, code) in order, and how often each occurs."""
    order = np.lexsort((code, g))
    g, code = g[order], code[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (code[1:] != code[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.r_[first, len(g)]) if weight is None else np.add.reduceat(weight[order], first) if len(first) else np.zeros(0, np.int64)
    return g[first], code[first], n


def added(batches: Iterator[pa.RecordBatch], width_bits: int, percents: tuple[int, ...] | None = None) -> Iterator[pa.RecordBatch]:
    """Adds up the sketches of each sid in a stream in the order of sid; rows of percentiles pass. percents: inverts the sums.

    Holds one sid's sum, and of those that are to be inverted some that are small.
    """
    sid: int | None = None
    codes, counts, held = [], [], 0
    dense: DyadicSketch | None = None
    small: list[tuple[int, np.ndarray, np.ndarray]] = []  # sums that are to be inverted together

    def shrink() -> None:
        nonlocal codes, counts, held, dense
        if codes:
            _, c, n = counted(np.zeros(held, np.int64), np.concatenate(codes), np.concatenate(counts))
            codes, counts, held = [c], [n], len(c)
            if held > most_codes(width_bits) or dense is not None:
                sketch = DyadicSketch(width_bits).add_codes(c.astype(np.uint64), n.astype(np.float64))
                dense = sketch if dense is None else dense.merge(sketch)
                codes, counts, held = [], [], 0

    def invert() -> Iterator[pa.RecordBatch]:
        if small:
            g = np.repeat(np.arange(len(small)), [len(c) for _, c, _ in small])
            code, n = (np.concatenate([x[k] for x in small]) for k in (1, 2))
            yield value_rows(np.array([x[0] for x in small]), percents, block_percentiles(g, code.astype(np.uint64), len(small), percents, n, coded=True))
            small.clear()

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal codes, counts, held, dense
        shrink()
        if dense is not None:
            yield value_rows(np.array([sid]), percents, dense.percentiles(percents)[None]) if percents else cell_rows(sid, dense)
        elif held and percents:
            small.append((sid, codes[0], counts[0]))
            if sum(len(x[1]) for x in small) >= lanes.BLOCK_ROWS:
                yield from invert()
        elif held:
            yield code_rows(np.array([sid]), None, np.array([held]), codes[0], counts[0])
        codes, counts, held, dense = [], [], 0, None

    for b in batches:
        has = pc.or_(b.column("codes").is_valid(), b.column("cells").is_valid())
        if plain := pc.sum(pc.invert(has)).as_py():
            yield b.filter(pc.invert(has)) if plain < b.num_rows else b
        b = b.filter(has)
        of = b.column("sid").to_numpy()
        _, first = lanes.group_index(of)
        for i, a in enumerate(first):
            z = first[i + 1] if i + 1 < len(first) else len(of)
            if of[a] != sid:
                yield from close()
                sid = int(of[a])
            part = b.slice(a, z - a)
            c, n = (part.column(k).flatten().to_numpy() for k in ("codes", "counts"))
            if len(c):
                codes.append(c)
                counts.append(n)
                held += len(c)
                if held > 2 * most_codes(width_bits):
                    shrink()
            for data in part.column("cells").drop_null().to_pylist():
                sketch = DyadicSketch.from_bytes(data)
                dense = sketch if dense is None else dense.merge(sketch)
    yield from close()
    yield from invert()


def percentiles(points: DataFrame, percents: tuple[int, ...] = (50, 90, 99), target_rows: int = lanes.TARGET_ROWS) -> DataFrame:
    """(sid, pct, value): percentiles of the current values of each sid, whatever their quality.

    Null and NaN values are set aside; of repeated (sid, clock) the highest seq counts. The value is one at the
    rank ceil(pct / 100 * n), up to the error of the sketch. A series that is split over tasks is sketched in
    each, and its sketches are merged. Sids without readings, and empty tables, give no rows.
    """
    plan = lanes.LanePlan.of(points, target_rows)
    split = np.array(sorted(plan.heavy_sids()), np.int64)

    def block(b: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        x = lanes.read_block(b, 1)
        parted = np.isin(x.lane_sid, split)
        for i in np.flatnonzero(parted):
            yield cell_rows(int(x.lane_sid[i]), DyadicSketch().update(x.value[x.g == i]))
        whole = ~parted[x.g]
        if not whole.any():
            return
        number = np.cumsum(~parted) - 1
        yield value_rows(x.lane_sid[~parted], percents, block_percentiles(number[x.g[whole]], x.value[whole], int((~parted).sum()), percents))

    found = lanes.lane_pass(lanes.reading_rows(points, plan), plan, block, SKETCH_DDL)
    if plan.heavy:
        found = merged(found, percents, WIDTH_BITS)
    return found.select("sid", "pct", "value")


def merged(parts: DataFrame, percents: tuple[int, ...], width_bits: int) -> DataFrame:
    """Adds up the sketches of each sid, and inverts them; rows of percentiles pass. First where they are, then in salts of a
    sid, about as many as the root of the tasks, then by sid: no task adds up more than about that many of a sid's sums."""

    def step(rows: DataFrame, values: tuple[int, ...] | None) -> DataFrame:
        return rows.sortWithinPartitions("sid").mapInArrow(lambda batches: added(batches, width_bits, values), SKETCH_DDL)

    rows = step(parts, None)
    salts = max(1, int(parts.sparkSession.sparkContext.defaultParallelism ** 0.5), int(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    salted = rows.withColumn("_salt", F.spark_partition_id() % salts).repartition("sid", "_salt").drop("_salt")
    return step(step(salted, None).repartition("sid"), percents)


def daily_sketches(points: DataFrame, day_ticks: int = DAY_TICKS, width_bits: int = 10, target_rows: int = lanes.TARGET_ROWS) -> DataFrame:
    """(sid, day_no, codes, counts, cells): a sketch of the current values of each sid and day, to be kept and merged later.

    codes and counts where these are smaller, else cells. Null and NaN values are set aside; of repeated (sid, clock) the
    highest seq counts. A day of a long series may have several rows, one for each task that held a part of it.
    """
    plan = lanes.LanePlan.of(points, target_rows)
    limit = most_codes(width_bits)

    def block(b: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        x = lanes.read_block(b, 1)
        if not len(x.g):
            return
        day = x.clock // day_ticks
        g, first = lanes.group_index(x.g, day)
        at, code, n = counted(g, encode(x.value).astype(np.int64))
        size = np.bincount(at, minlength=len(first))
        large = size > limit
        for i in np.flatnonzero(large):
            k = at == i
            yield cell_rows(int(x.sid[first[i]]), DyadicSketch(width_bits).add_codes(code[k].astype(np.uint64), n[k].astype(np.float64)), int(day[first[i]]))
        k = ~large[at]
        yield code_rows(x.sid[first[~large]], day[first[~large]], np.cumsum(size[~large]), code[k], n[k])

    found = lanes.lane_pass(lanes.reading_rows(points, plan), plan, block, SKETCH_DDL)
    return found.select("sid", "day_no", "codes", "counts", "cells")


def merge_daily(sketches: DataFrame, percents: tuple[int, ...] = (50, 90, 99), width_bits: int = 10) -> DataFrame:
    """(sid, pct, value) from sketches of any days."""
    none = F.lit(None)
    rows = sketches.select("sid", none.cast("int").alias("pct"), none.cast("double").alias("value"), "day_no", "codes", "counts", "cells")
    return merged(rows, percents, width_bits).select("sid", "pct", "value")


def above(found: DataFrame, registry: DataFrame, percents: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """(sid, pct) of the percentiles (sid, pct, value) of registered sids that are greater than their limit; null or NaN
    limits do not count."""
    limits = registry.filter("sid is not null").groupBy("sid").agg(*[F.max(F.nanvl(f"p{p}_limit", F.lit(None).cast("double"))).alias(f"l{p}") for p in percents])
    stacked = limits.select("sid", F.explode(F.array(*[F.struct(F.lit(p).alias("pct"), F.col(f"l{p}").alias("limit")) for p in percents])).alias("x")).select("sid", "x.pct", "x.limit")
    return found.join(stacked.filter("limit is not null"), ["sid", "pct"]).filter(F.col("value") > F.col("limit")).select("sid", "pct")


def above_limit(points: DataFrame, registry: DataFrame, target_rows: int = lanes.TARGET_ROWS) -> DataFrame:
    """(sid, pct) of the percentiles of registered sids that are greater than their limit; null or NaN limits do not count."""
    return above(percentiles(points, (50, 90, 99), target_rows), registry)


def rank_errors(points: DataFrame, found: DataFrame) -> DataFrame:
    """(pct, n_sids, n_within, largest): of the percentiles (sid, pct, value) how many lie within a share of LARGEST_ERROR and
    one of the readings from their rank, and the largest distance, measured over all current readings."""
    current = merge.last_write_wins(lanes.live(points)).select("sid", "value")
    wide = found.groupBy("sid").agg(F.collect_list(F.struct("pct", F.col("value").alias("q"))).alias("p"))
    near = F.abs("q") * 2**-22 + 1e-12
    ranks = rolling.lookup(current, wide, "sid").select("sid", "value", F.explode("p").alias("p")).select("sid", "value", "p.pct", "p.q")
    below, upto = F.count(F.when(F.col("value") < F.col("q") - near, 1)), F.count(F.when(F.col("value") <= F.col("q") + near, 1))
    ranks = ranks.groupBy("sid", "pct").agg(below.alias("below"), upto.alias("upto"), F.count(F.lit(1)).alias("n")).withColumn("want", F.col("pct") / 100 * F.col("n"))
    off = F.greatest(F.lit(0.0), F.col("below") - F.col("want"), F.col("want") - F.col("upto"))
    within = off <= LARGEST_ERROR * F.col("n") + 1
    return ranks.groupBy("pct").agg(F.count(F.lit(1)).alias("n_sids"), F.count(F.when(within, 1)).alias("n_within"), F.max(off / F.col("n")).alias("largest"))
