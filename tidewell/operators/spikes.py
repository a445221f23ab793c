"""Implausible readings: limits, spikes of up to three readings, and stuck values, judged by how a series usually behaves.

``chart``, a robust exponentially weighted control chart, follows each series in clock order: a reading further from the
running mean than SUSPECT scales is suspected and clipped before it updates mean and scale, a counter holds how many
were suspected in succession, and more than EXCURSION are a new level. A spike is a run of one to EXCURSION suspected
readings after which the chart is back in control; what the chart finds is then held against the definition of a
case, ten times the median change of the series. A second counter, of readings that hardly differ, finds stuck values.

The chart forgets: it is run in anew for each SECTION readings of a series, over the WARM readings before them. So it
does not depend on where a series is cut for the tasks, and the sections of all series of a block step together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators import lanes

#: Weights of the newest reading in mean and scale; scales at which a reading is suspected; scales to which it is clipped.
MEAN_WEIGHT, SCALE_WEIGHT, SUSPECT, CLIP = 0.6, 0.05, 6.5, 0.5
#: Median changes of the series that the scale is kept between.
LEAST_SCALE, MOST_SCALE = 1.0, 1.5
#: Readings of a section of the chart, and readings before it that the chart is run in over.
SECTION, WARM = 256, 64
EXCURSION, STUCK = 3, 5
#: Median changes: by which a spike leaves; below which readings hardly differ.
LEAVES, ALIKE = 10.0, 0.05
#: A series whose runs of like readings are a greater share of its runs does not rarely agree.
AGREES = 0.10
#: Readings before and after a lane that its own readings are judged with: a section and its run-in, an excursion, a stuck run.
BEFORE_LANE, AFTER_LANE = SECTION + WARM + 8, 8
#: Lowest bit that each pass over the changes of the split series counts by, of the 64 of a double.
STEPS = (46, 30, 14, 0)
SCHEMA = "sid bigint, clock bigint, value double, reason string"
LO, HI, METER, MEDIAN, AGREEMENT, FIRST, BEFORE, AFTER, PLACE, SETTINGS = range(10)


def chart(value: np.ndarray, start: np.ndarray, median: np.ndarray, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each reading how many were suspected in succession up to it (0: in control; above EXCURSION: a new level begins
    with it), and the mean of the chart before it.

    start: True where a series (or a lane of one) begins. median: its median change, which the scale starts from and
    is kept near to. place: number of the reading in its series, from which the sections count; from the start if None.
    A reading that is not finite is suspected and ignored.
    """
    value, start, median = np.asarray(value, float), np.asarray(start, bool), np.asarray(median, float)
    n = len(value)
    counter, level = np.zeros(n, np.int8), np.zeros(n)
    if not n:
        return counter, level
    start = start.copy()
    start[0] = True
    lane = np.flatnonzero(start)
    lane_of = np.cumsum(start) - 1
    if place is None:
        place = np.arange(n) - lane[lane_of]
    own = np.flatnonzero(start | (place % SECTION == 0))
    end = np.r_[own[1:], n]
    begin = np.maximum(own - WARM, lane[lane_of[own]])
    order = np.argsort(begin - end, kind="stable")  # the longest first, so that those still running are in front
    own, end, begin = own[order], end[order], begin[order]
    usual = np.where(median[own] > 0, median[own], 1e-9)
    mean, scale, run = np.where(np.isfinite(value[begin]), value[begin], np.nan), usual * LEAST_SCALE, np.zeros(len(own), np.int8)
    length = end - begin
    running = np.searchsorted(-length, -np.arange(length[0]), "left")
    for i in range(int(length[0])):
        m = slice(0, running[i])
        at = begin[m] + i
        x, s, low = value[at], scale[m], usual[m]
        finite = np.isfinite(x)
        x = np.where(finite, x, 0.0)
        mu = np.where(np.isnan(mean[m]) & finite, x, mean[m])
        r = np.where(finite, x - mu, 0.0)
        size = np.abs(r)
        out = size > SUSPECT * s
        count = np.where(finite, np.where(out, run[m] + 1, 0), np.minimum(run[m] + 1, EXCURSION)).astype(np.int8)
        mine = at >= own[m]
        counter[at[mine]], level[at[mine]] = count[mine], mu[mine]
        new = finite & (count > EXCURSION)
        clip = CLIP * s
        mean[m] = np.where(new, x, mu + MEAN_WEIGHT * np.where(out, np.clip(r, -clip, clip), r))
        moved = s + SCALE_WEIGHT * (1.25 * np.where(out, clip, size) - s)
        scale[m] = np.where(finite & ~new, np.clip(moved, LEAST_SCALE * low, MOST_SCALE * low), s)
        run[m] = np.where(new, 0, count)
    return counter, level


def run_lengths(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """link[i]: row i goes on with the run of row i - 1. Number of the run of each row, and length of each run."""
    run = np.cumsum(~link) - 1
    return run, np.bincount(run) if len(run) else np.zeros(0, int)


def changes(x: lanes.Block) -> tuple[np.ndarray, np.ndarray]:
    """Of a block: whether a reading has one before it in its lane, and the size of the change (NaN without)."""
    left = np.zeros(len(x.g), bool)
    left[1:] = x.g[1:] == x.g[:-1]
    d = np.full(len(x.g), np.nan)
    with np.errstate(invalid="ignore"):
        d[1:] = np.abs(x.value[1:] - x.value[:-1])
    d[~left] = np.nan
    return left, d


def group_median(g: np.ndarray, d: np.ndarray, groups: int) -> np.ndarray:
    ok = ~np.isnan(d)
    g, d = g[ok], d[ok]
    o = np.lexsort((d, g))
    g, d = g[o], d[o]
    n = np.bincount(g, minlength=groups)
    first = np.cumsum(n) - n
    out = np.full(groups, np.nan)
    some = n > 0
    a, b = (first + (n - 1) // 2)[some], (first + n // 2)[some]
    with np.errstate(invalid="ignore"):
        out[some] = (d[a] + d[b]) / 2
    return out


def agreement(x: lanes.Block, left: np.ndarray, d: np.ndarray, median: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each lane: runs of two or more like readings that are not 0, and all runs. A run counts in the lane it begins
    in; the halo readings next to a lane tell whether its first run begins there and whether its last one goes on."""
    groups = len(x.lane_sid)
    link = left & (d <= ALIKE * median[x.g])
    goes_on = np.r_[link[1:], np.zeros(min(1, len(link)), bool)]
    first = ~link & ~x.halo & (x.value != 0)
    return np.bincount(x.g[first & goes_on], minlength=groups), np.bincount(x.g[first], minlength=groups)


def implausible(points: DataFrame, registry: DataFrame, target_rows: int = lanes.TARGET_ROWS) -> DataFrame:
    """(sid, clock, value, reason) of the implausible current readings of registered sids; reasons are joined by '+'.

    - ``limit``: below phys_lo or above phys_hi (a null limit does not count).
    - ``spike``: one of up to three successive readings that each differ by more than ten median changes of the
      series from the reading before and from the reading after them, while these two differ by ten or less.
      Not between two zeros of a meter, nor zeros of a meter.
    - ``stuck``: one of five or more successive readings that differ by at most ALIKE median changes each, in a
      series in which at most a share AGREES of the runs has two or more readings. Not zeros of a meter, nor
      readings between two zeros of a meter.
    A series whose median change is 0 (a setpoint) has neither spikes nor stuck values. Null and NaN values are
    set aside; of repeated (sid, clock) the highest seq counts. Empty tables give no rows.
    """
    plan = lanes.LanePlan.of(points, target_rows)
    nan = F.lit(None).cast("double")
    registered = registry.filter("sid is not null").groupBy("sid").agg(
        F.max(F.nanvl("phys_lo", nan)).alias("lo"), F.min(F.nanvl("phys_hi", nan)).alias("hi"), F.max((F.col("meas") == "meter").cast("double")).alias("meter")
    ).fillna(0.0, ["meter"])
    stream = lanes.reading_rows(points, plan).unionByName(lanes.config_rows(registered, plan, ["lo", "hi", "meter"]))
    heavy = np.array(sorted(plan.heavy_sids()), np.int64)
    schema = pa.schema([("sid", pa.int64()), ("lane", pa.int64()), ("clock", pa.int64()), ("value", pa.float64()), ("reason", pa.string())])

    def block(b: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        x = lanes.read_block(b, SETTINGS)
        if len(heavy):  # readings of split series pass, to be judged once more is known of their series
            parted = np.isin(x.lane_sid, heavy)
            p = np.flatnonzero(parted[x.g] & ~np.isnan(x.config[x.g, METER]))
            yield lanes.batch(schema, x.sid[p], x.lane[x.g[p]], x.clock[p], x.value[p], pa.nulls(len(p), pa.string()))
            x = only(x, ~parted)
        yield found(x, judge(x, np.ones(len(x.lane_sid), bool)))

    def found(x: lanes.Block, reason: np.ndarray) -> pa.RecordBatch:
        k = np.flatnonzero((reason > 0) & ~x.halo & ~np.isnan(x.config[x.g, METER]))
        return lanes.batch(schema, x.sid[k], x.lane[x.g[k]], x.clock[k], x.value[k], pa.array(REASONS).take(pa.array(reason[k])))

    ddl = "sid bigint, lane bigint, clock bigint, value double, reason string"
    out = lanes.lane_pass(stream, plan, block, ddl)
    if not plan.heavy:
        return out.drop("lane")
    # the table is read and sorted once; what follows reads the split series alone, from the checkpoint folder
    lanes.checkpoint_dir(plan.spark)
    out = out.checkpoint()
    held = with_edges(out.filter("reason is null"), plan.only_heavy(registered), plan).checkpoint()
    stats = SplitStats.of(held, plan)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lanes.blocks(batches, ("sid", "lane")):
            x = stats.put(lanes.read_block(b, SETTINGS))
            yield found(x, judge(x, np.zeros(len(x.lane_sid), bool)))

    return out.filter("reason is not null").unionByName(held.mapInArrow(again, ddl)).drop("lane")


def only(x: lanes.Block, keep: np.ndarray) -> lanes.Block:
    """The lanes of a block for which keep holds."""
    r = keep[x.g]
    number = np.cumsum(keep) - 1
    return lanes.Block(number[x.g[r]], x.sid[r], x.clock[r], x.value[r], x.halo[r], x.config[keep], x.lane_sid[keep], x.lane[keep])


def with_edges(readings: DataFrame, registered: DataFrame, plan: lanes.LanePlan) -> DataFrame:
    """Lane rows of the split series: their current readings, those around each lane, limits, and the place of each lane.

    readings: whole lanes in order, as a pass left them.
    """
    rows = readings.select("sid", "lane", "clock", F.lit(0).cast("long").alias("seq"), "value", F.lit(lanes.READING).cast("tinyint").alias("tag"))
    before = F.sum("count").over(Window.partitionBy("sid").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1))
    counted = rows.groupBy("sid", "lane").count()  # a row for each lane
    places = counted.select("sid", "lane", F.lit(lanes.CONFIG_CLOCK).alias("clock"), F.lit(PLACE).cast("long").alias("seq"), F.coalesce(before, F.lit(0)).cast("double").alias("value"), F.lit(lanes.CONFIG).cast("tinyint").alias("tag"))
    stream = (
        rows.unionByName(lanes.lane_edges(rows, plan, BEFORE_LANE, AFTER_LANE, together=True))
        .unionByName(lanes.config_rows(registered, plan, ["lo", "hi", "meter"]))
        .unionByName(places)
    )
    return stream.repartition(plan.partitions(), "sid", "lane").sortWithinPartitions("sid", "lane", "clock", "seq", "value")


REASONS = ["", "limit", "spike", "limit+spike", "stuck", "limit+stuck", "spike+stuck", "limit+spike+stuck"]


def judge(x: lanes.Block, whole: np.ndarray) -> np.ndarray:
    """Of each reading a sum of 1 (limit), 2 (spike) and 4 (stuck). whole: lanes that hold all of their series."""
    n = len(x.g)
    if not n:
        return np.zeros(0, np.int64)
    lo, hi, meter = (x.config[x.g, k] for k in (LO, HI, METER))
    meter = meter == 1
    with np.errstate(invalid="ignore"):
        limit = (x.value < lo) | (x.value > hi)
    left, d = changes(x)
    median, rate = x.config[:, MEDIAN].copy(), x.config[:, AGREEMENT].copy()
    median[whole] = group_median(x.g, d, len(median))[whole]
    many, runs = agreement(x, left, d, np.nan_to_num(median))
    with np.errstate(invalid="ignore", divide="ignore"):
        rate[whole] = (many / runs)[whole]
    m = np.nan_to_num(median)[x.g]
    varies = m > 0

    far = LEAVES * m
    rest = meter & (x.value == 0)
    counter, _ = chart(x.value, ~left, m, places(x))
    spike = np.zeros(n, bool)
    # runs that the chart suspected and after which it is back in control, by their last reading
    last = np.flatnonzero((counter[:-1] > 0) & (counter[:-1] <= EXCURSION) & (counter[1:] == 0) & (x.g[:-1] == x.g[1:]) & varies[:-1])
    for k in range(1, EXCURSION + 1):  # readings of the run that left the level; one before these may be suspected for less
        z = last[(counter[last] >= k) & (last >= k)] + 1
        a = z - k - 1  # the reading before; z: the reading after
        ok = (x.g[a] == x.g[z]) & ~(rest[a] & rest[z])
        a, z = a[ok], z[ok]
        before, after, f = x.value[a], x.value[z], far[a]
        with np.errstate(invalid="ignore"):
            ok = np.abs(before - after) <= f
            for j in range(1, k + 1):
                ok &= (np.abs(x.value[a + j] - before) > f) & (np.abs(x.value[a + j] - after) > f) & ~rest[a + j]
        for j in range(1, k + 1):
            spike[a[ok] + j] = True

    link = left & (d <= ALIKE * m) & varies
    run, length = run_lengths(link)
    first = np.flatnonzero(~link)
    last = np.r_[first[1:], n] - 1
    p, q = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
    before, after, begins = rest[p] & (x.g[p] == x.g[first]), rest[q] & (x.g[q] == x.g[first]), rest[first]
    # a run that reaches over the edge of a lane may be longer than the halo: its ends are known from all lanes
    own = np.flatnonzero(~x.halo)
    if 0 < len(own) < n:
        new = x.g[own[1:]] != x.g[own[:-1]]
        head, tail = own[np.r_[True, new]], own[np.r_[new, True]]
        opened, closed = head[link[head]], tail[np.r_[link[1:], False][tail]]
        for flag, at, k in ((begins, opened, FIRST), (before, opened, BEFORE), (after, closed, AFTER)):
            flag[run[at]] = meter[at] & (x.config[x.g[at], k] == 0)
    with np.errstate(invalid="ignore"):
        stuck = (length >= STUCK) & (rate[x.g[first]] <= AGREES) & ~begins & ~(before & after)
    return limit * 1 + spike * 2 + stuck[run] * 4


def places(x: lanes.Block) -> np.ndarray:
    """The number of each reading in its series: in its lane, and from the setting PLACE, that of the lane's first own reading."""
    groups = len(x.lane_sid)
    size = np.bincount(x.g, minlength=groups)
    first = np.cumsum(size) - size
    mine = np.flatnonzero(~x.halo)
    own = first.copy()
    own[x.g[mine][::-1]] = mine[::-1]  # the first own reading of each lane
    at = np.nan_to_num(x.config[:, PLACE]) if x.config.shape[1] > PLACE else np.zeros(groups)
    return np.arange(len(x.g)) - own[x.g] + at.astype(np.int64)[x.g]


@dataclass
class SplitStats:
    """What the judging of a split series takes from all its lanes: its median change and share of runs of like readings,
    and, by lane, the runs that reach over its edges."""

    sid: np.ndarray
    median: np.ndarray
    agreement: np.ndarray
    edges: dict[tuple[int, int], tuple[float, float, float]]

    @staticmethod
    def of(held: DataFrame, plan: lanes.LanePlan) -> SplitStats:
        """held: whole, sorted lanes of the split series with the readings around them, as with_edges makes them.

        The same numbers as of a series in one lane. Some passes select the median bit by bit, and one counts the runs against
        the median so found. They do not shuffle readings; at most as many rows as there are lanes come to the driver.
        """
        medians = split_medians(held)
        sid = np.array(sorted(medians), np.int64)
        out = SplitStats(sid, np.array([medians[s] for s in sid.tolist()], float), np.full(len(sid), np.nan), {})
        count = pa.schema([("sid", pa.int64()), ("many", pa.int64()), ("runs", pa.int64())])

        def counts(b: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            x = out.put(lanes.read_block(b, SETTINGS))
            left, d = changes(x)
            yield lanes.batch(count, x.lane_sid, *agreement(x, left, d, np.nan_to_num(x.config[:, MEDIAN])))

        runs = lane_map(held, counts, "sid bigint, many bigint, runs bigint").groupBy("sid").agg(F.sum("many").alias("many"), F.sum("runs").alias("runs"))
        rates = {r.sid: r.many / r.runs for r in runs.filter("runs > 0").collect()}
        edges = run_edges(held, out, plan)
        return SplitStats(sid, out.median, np.array([rates.get(s, np.nan) for s in sid.tolist()], float), edges)

    def put(self, x: lanes.Block) -> lanes.Block:
        """Sets the statistics in the settings of a block."""
        if len(self.sid):
            at = np.minimum(np.searchsorted(self.sid, x.lane_sid), len(self.sid) - 1)
            known = self.sid[at] == x.lane_sid
            x.config[:, MEDIAN] = np.where(known, self.median[at], np.nan)
            x.config[:, AGREEMENT] = np.where(known, self.agreement[at], np.nan)
        for i, key in enumerate(zip(x.lane_sid.tolist(), x.lane.tolist(), strict=True)):
            if key in self.edges:
                x.config[i, [FIRST, BEFORE, AFTER]] = self.edges[key]
        return x


def lane_map(held: DataFrame, block, ddl: str) -> DataFrame:
    """A pass over whole, sorted lanes where they are."""
    return held.mapInArrow(lambda batches: (out for b in lanes.blocks(batches, ("sid", "lane")) for out in block(b)), ddl)


def run_edges(held: DataFrame, stats: SplitStats, plan: lanes.LanePlan) -> dict[tuple[int, int], tuple[float, float, float]]:
    """FIRST, BEFORE and AFTER by lane: of the run of like readings that goes on from the lane before, its first reading
    and the one before that; of the run that goes on in the next, the one after it. NaN where there is none."""
    schema = pa.schema([("sid", pa.int64()), ("lane", pa.int64()), ("first", pa.float64()), ("before", pa.float64()), ("after", pa.float64())])

    def ends(b: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        x = stats.put(lanes.read_block(b, SETTINGS))
        left, d = changes(x)
        m = np.nan_to_num(x.config[:, MEDIAN])[x.g]
        opens = np.flatnonzero(~(left & (d <= ALIKE * m) & (m > 0)) & ~x.halo)
        if len(opens):
            new = x.g[opens[1:]] != x.g[opens[:-1]]
            a, z = opens[np.r_[True, new]], opens[np.r_[new, True]]
            before = np.where(left[z], x.value[np.maximum(z - 1, 0)], np.nan)
            yield lanes.batch(schema, x.lane_sid[x.g[a]], x.lane[x.g[a]], x.value[z], before, x.value[a])

    found = {(r.sid, r.lane): (r.first, r.before, r.after) for r in lane_map(held, ends, "sid bigint, lane bigint, first double, before double, after double").collect()}
    out = {}
    nan = float("nan")
    for sid, lane_starts in plan.starts.items():
        run = (nan, nan)
        for lane in lane_starts:
            out[sid, lane] = (*run, nan)
            if (sid, lane) in found:
                run = found[sid, lane][:2]
        after = nan
        for lane in reversed(lane_starts):
            out[sid, lane] = (*out[sid, lane][:2], after)
            if (sid, lane) in found:
                after = found[sid, lane][2]
    return out


def split_medians(held: DataFrame) -> dict[int, float]:
    """The median change of each split series, exactly, by its bits from the highest to the lowest: each pass counts the
    changes by some more bits, among those that agree with the middle changes in the bits known so far."""
    spark = held.sparkSession
    hist = pa.schema([("sid", pa.int64()), ("step", pa.int64()), ("n", pa.int64())])
    known = 63  # bits of a change that are not known yet; it is not negative
    sids = np.zeros(0, np.int64)
    prefix = np.zeros((0, 2), np.int64)
    ranks = np.zeros((0, 2), np.int64)
    for shift in STEPS:
        wider = known - shift

        def histogram(b: dict[str, np.ndarray], shift=shift, known=known, sids=sids, prefix=prefix) -> Iterator[pa.RecordBatch]:
            x = lanes.read_block(b, SETTINGS)
            _, d = changes(x)
            ok = ~np.isnan(d) & ~x.halo
            g, bits = x.g[ok], d[ok].view(np.int64)
            if len(sids):
                at = np.minimum(np.searchsorted(sids, x.lane_sid), len(sids) - 1)[g]
                high = bits >> known
                ok = (sids[at] == x.lane_sid[g]) & ((high == prefix[at, 0]) | (high == prefix[at, 1]))
                g, bits = g[ok], bits[ok]
            key, n = np.unique(np.stack([g, bits >> shift]), axis=1, return_counts=True)
            yield lanes.batch(hist, x.lane_sid[key[0]], key[1], n)

        counted = lane_map(held, histogram, "sid bigint, step bigint, n bigint").groupBy("sid", "step").agg(F.sum("n").alias("n")).withColumn("high", F.expr(f"shiftright(step, {wider})"))
        part = Window.partitionBy("sid", "high")
        counted = counted.withColumns({"upto": F.sum("n").over(part.orderBy("step")), "total": F.sum("n").over(part)}).withColumn("below", F.expr("upto - n"))
        if not len(sids):
            wanted = counted.withColumn("w", F.explode(F.array(F.struct(F.lit(0).alias("nth"), F.expr("(total - 1) div 2").alias("rank")), F.struct(F.lit(1).alias("nth"), F.expr("total div 2").alias("rank")))))
            wanted = wanted.select("sid", "step", "below", "upto", "w.nth", "w.rank")
        else:
            two = [(s, i, int(prefix[k, i]), int(ranks[k, i])) for k, s in enumerate(sids.tolist()) for i in (0, 1)]
            wanted = counted.join(F.broadcast(spark.createDataFrame(two, "sid bigint, nth int, high bigint, rank bigint")), ["sid", "high"])
        # two rows for each split series
        found = {(r.sid, r.nth): (r.step, r.rank - r.below) for r in wanted.filter("below <= rank and rank < upto").select("sid", "nth", "step", "rank", "below").collect()}
        sids = np.array(sorted({s for s, _ in found}), np.int64)
        prefix = np.array([[found[s, i][0] for i in (0, 1)] for s in sids.tolist()], np.int64).reshape(-1, 2)
        ranks = np.array([[found[s, i][1] for i in (0, 1)] for s in sids.tolist()], np.int64).reshape(-1, 2)
        known = shift
        if not len(sids):
            return {}
    middle = prefix.view(np.float64)
    with np.errstate(invalid="ignore"):
        return dict(zip(sids.tolist(), ((middle[:, 0] + middle[:, 1]) / 2).tolist(), strict=True))


def split_stats(rows: DataFrame, plan: lanes.LanePlan) -> DataFrame:
    """(sid, median, agreement) of the split series among lane rows; null where there is none."""
    schema = pa.schema([("sid", pa.int64()), ("lane", pa.int64()), ("clock", pa.int64()), ("value", pa.float64())])

    def current(b: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        x = lanes.read_block(b, SETTINGS)
        yield lanes.batch(schema, x.sid, x.lane[x.g], x.clock, x.value)

    readings = lanes.lane_pass(plan.only_heavy(rows), plan, current, "sid bigint, lane bigint, clock bigint, value double")
    none = plan.spark.createDataFrame([], "sid bigint, lo double, hi double, meter double")
    stats = SplitStats.of(with_edges(readings, none, plan), plan)
    got = zip(stats.sid.tolist(), stats.median.tolist(), stats.agreement.tolist(), strict=True)
    return plan.spark.createDataFrame([(s, m, None if r != r else r) for s, m, r in got], "sid bigint, median double, agreement double")
