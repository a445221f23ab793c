"""Irregular readings onto a regular grid: as-of merge of a sorted grid with the readings of a series.

Both neighbours of a grid point are taken from one sorted pass; between them the value is interpolated
linearly by time, unless they are further apart than the gap limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import lanes

DAY_TICKS = 864_000_000_000
GAP_LIMIT = 7 * DAY_TICKS
GRID_SCHEMA = "sid bigint, slot_clock bigint, n_slots bigint, value double, state string"
OUT_ROWS = 100_000


def steps_of(registry: DataFrame) -> DataFrame:
    """(sid, step_ticks) of registered series with a step above 0; a sid that is registered twice counts once."""
    return registry.filter("sid is not null and step_ticks > 0").groupBy("sid").agg(F.min("step_ticks").alias("step_ticks"))


def regular_grid(points: DataFrame, registry: DataFrame, gap_limit: int = GAP_LIMIT, target_rows: int = lanes.TARGET_ROWS, states: tuple[str, ...] = ("reading", "filled", "silence"), values: bool = True) -> DataFrame:
    """The series of each registered sid at its step, from its first to its last reading.

    points: sid, clock, value, seq (other columns are ignored). registry: sid, step_ticks.
    A reading lies in the slot that starts at clock - clock mod step. One row for each slot:
    - state ``reading``: a reading lies in it. value is interpolated at the start of the slot between the last
      reading before it and the first at or after it; where there is none before within the gap limit, it is
      the first reading of the slot.
    - state ``filled``: it is empty, and the occupied slots around it start at most gap_limit apart; value is
      interpolated.
    - state ``silence``: one row for all the n_slots empty slots of a longer silence, at the first; value is null.
    Null and NaN values and null sids or clocks are set aside; of repeated (sid, clock) the highest seq counts,
    and of equal seq any of the equal rows (the highest value where they differ). Interpolation next to an
    infinite reading gives null. Sids without step, or without readings, have no rows; an empty table has none.
    Without ``values`` those that are interpolated are not to be used, and the table is read once less.
    """
    plan = lanes.LanePlan.of(lanes.live(points), target_rows)
    rows = lanes.reading_rows(points, plan)
    stream = rows.unionByName(lanes.config_rows(steps_of(registry), plan, ["step_ticks"]))
    if plan.heavy:
        # where values are asked for, those of the readings before the lanes take a pass over the split series
        stream = stream.unionByName(lanes.lane_edges(rows, plan, 1, 0) if values else lanes.last_clocks(plan))
    schema = pa.schema([("sid", pa.int64()), ("slot_clock", pa.int64()), ("n_slots", pa.int64()), ("value", pa.float64()), ("state", pa.string())])

    def out(sid: np.ndarray, slot: np.ndarray, n: np.ndarray, value: np.ndarray, state: str) -> pa.RecordBatch:
        value = pa.array(value, mask=~np.isfinite(value)) if state == "filled" else pa.array(value, mask=np.isnan(value))
        return lanes.batch(schema, sid, slot, n, value, pa.array([state]).dictionary_encode().take(pa.array(np.zeros(len(sid), np.int32))).cast(pa.string()))

    def block(b: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        x = lanes.read_block(b, 1)
        keep = ~np.isnan(x.config[x.g, 0])
        g, sid, clock, value, halo = (a[keep] for a in (x.g, x.sid, x.clock, x.value, x.halo))
        if not len(g):
            return
        step = x.config[g, 0].astype(np.int64)
        slot = clock - clock % step
        left = np.zeros(len(g), bool)
        left[1:] = g[1:] == g[:-1]
        i = np.arange(len(g)) - left
        opens = ~halo & (~left | (slot != slot[i]))
        apart = slot - slot[i]
        near = left & (apart <= gap_limit)
        between = np.where(left, apart // step - 1, 0)
        with np.errstate(all="ignore"):
            slope = np.where(near, (value - value[i]) / np.maximum(clock - clock[i], 1).astype(float), np.nan)
            if "reading" in states:
                o = np.flatnonzero(opens)
                at = value[i[o]] + slope[o] * (slot[o] - clock[i[o]])
                at = np.where(near[o], np.where(np.isfinite(at), at, value[o]), value[o])
                yield out(sid[o], slot[o], np.ones(len(o), np.int64), at, "reading")
            if "silence" in states:
                o = np.flatnonzero(opens & left & ~near & (between > 0))
                yield out(sid[o], slot[i[o]] + step[o], between[o], np.full(len(o), np.nan), "silence")
            if "filled" in states:
                o = np.flatnonzero(opens & near & (between > 0))
                total = np.cumsum(between[o])
                done = 0
                while done < len(o):
                    base = total[done - 1] if done else 0
                    upto = max(done + 1, int(np.searchsorted(total, base + OUT_ROWS, "right")))
                    p = o[done:upto]
                    n = between[p]
                    r = np.repeat(p, n)
                    nth = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n) + 1
                    grid = slot[i[r]] + nth * step[r]
                    yield out(sid[r], grid, np.ones(len(r), np.int64), value[i[r]] + slope[r] * (grid - clock[i[r]]), "filled")
                    done = upto

    return lanes.lane_pass(stream, plan, block, GRID_SCHEMA)


def empty_slots(points: DataFrame, registry: DataFrame, **options) -> DataFrame:
    """The start of each empty slot that regular_grid fills."""
    return regular_grid(points, registry, states=("filled",), values=False, **options).select("sid", "slot_clock")
