"""Runs of repeated consecutive events, found by a regular expression over strings of symbols.

Events are mapped to Unicode code points, those of an entity are joined into a string in clock order, and a
backreference finds the repetitions; their spans are mapped back to clocks. A symbol also holds the parity of
the stretch it lies in, where a stretch ends at a pause longer than the limit, so no run crosses a pause.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators import lanes

PAUSE = 6 * 3600 * 10_000_000
REPEATS = re.compile(r"(.)\1+", re.S)
#: First code point: behind the surrogates.
FIRST_SYMBOL, LAST_SYMBOL = 0xE000, 0x10FFFF
SCHEMA = "sid bigint, event double, start_clock bigint, end_clock bigint, n_points bigint, opens boolean, closes boolean"


def symbols(g: np.ndarray, clock: np.ndarray, event: np.ndarray, pause: int) -> str:
    """One string for all entities of a block; a symbol is never followed by its like across entities or pauses."""
    kinds, code = np.unique(event, return_inverse=True)
    if FIRST_SYMBOL + 2 * len(kinds) - 1 > LAST_SYMBOL:
        raise ValueError(f"{len(kinds)} kinds of events in one block; there are symbols for {(LAST_SYMBOL - FIRST_SYMBOL + 1) // 2}")
    cut = np.ones(len(g), bool)
    cut[1:] = (g[1:] != g[:-1]) | (clock[1:] - clock[:-1] > pause)
    return (FIRST_SYMBOL + 2 * code + (np.cumsum(cut) & 1)).astype("<u4").tobytes().decode("utf-32-le")


def repeats(text: str) -> tuple[np.ndarray, np.ndarray]:
    spans = np.fromiter((i for m in REPEATS.finditer(text) for i in m.span()), np.int64)
    return spans[::2], spans[1::2]


def collapse_runs(points: DataFrame, event: Column | None = None, pause: int = PAUSE, target_rows: int = lanes.TARGET_ROWS) -> DataFrame:
    """(sid, event, start_clock, end_clock, n_points, duration): the longest runs of two or more current readings of
    a sid, successive in clock, that have the same event and lie at most ``pause`` ticks from one to the next.

    event: number of the canonical event of a row (value by default); near-identical events are those to which
    the expression gives one number, such as round(value, 1). Rows whose value is null or NaN are set aside, of
    repeated (sid, clock) the highest seq counts. Lone readings and empty tables give no rows.
    """
    plan = lanes.LanePlan.of(points, target_rows)
    split = np.array(sorted(plan.heavy_sids()), np.int64)
    schema = pa.schema([("sid", pa.int64()), ("event", pa.float64()), ("start_clock", pa.int64()), ("end_clock", pa.int64()), ("n_points", pa.int64()), ("opens", pa.bool_()), ("closes", pa.bool_())])

    def block(b: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        x = lanes.read_block(b, 1)
        if not len(x.g):
            return
        start, end = repeats(symbols(x.g, x.clock, x.value, pause))
        # the first and last run of a lane of a split series may go on in the next lane, even if it is a single reading
        parted = np.isin(x.lane_sid, split)
        size = np.bincount(x.g, minlength=len(x.lane_sid))
        head = (np.cumsum(size) - size)[parted & (size > 0)]
        tail = (np.cumsum(size) - 1)[parted & (size > 0)]
        inside = np.zeros(len(x.g) + 1, int)
        np.add.at(inside, start, 1)
        np.add.at(inside, end, -1)
        inside = np.cumsum(inside)[:-1]
        lone = np.unique(np.r_[head, tail])
        lone = lone[inside[lone] == 0]
        start, end = np.r_[start, lone], np.r_[end, lone + 1]
        opens, closes = np.isin(start, head), np.isin(end - 1, tail)
        yield lanes.batch(schema, x.sid[start], x.value[start], x.clock[start], x.clock[end - 1], end - start, opens, closes)

    found = lanes.lane_pass(lanes.reading_rows(points, plan, event), plan, block, SCHEMA)
    if plan.heavy:
        edge = F.col("opens") | F.col("closes")
        home = F.when(edge, F.xxhash64("sid")).otherwise(F.xxhash64("sid", "start_clock"))

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in lanes.blocks(batches, ("sid",)):
                link = np.zeros(len(b["sid"]), bool)
                a, z = slice(None, -1), slice(1, None)
                same = (b["sid"][z] == b["sid"][a]) & (b["event"][z] == b["event"][a])
                link[z] = same & b["closes"][a] & b["opens"][z] & (b["start_clock"][z] - b["end_clock"][a] <= pause)
                first = np.flatnonzero(~link)
                n = np.add.reduceat(b["n_points"], first)
                last = np.r_[first[1:], len(link)] - 1
                keep = n >= 2
                f, t = first[keep], last[keep]
                yes = np.zeros(len(f), bool)
                yield lanes.batch(schema, b["sid"][f], b["event"][f], b["start_clock"][f], b["end_clock"][t], n[keep], yes, yes)

        found = found.withColumn("_home", home).repartition(plan.partitions(), "_home").drop("_home").sortWithinPartitions("sid", "start_clock").mapInArrow(join, SCHEMA)
    return found.select("sid", "event", "start_clock", "end_clock", "n_points", (F.col("end_clock") - F.col("start_clock")).alias("duration"))
