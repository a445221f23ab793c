"""Points to encoded blocks and back. Series are passed lane by lane, so a long one is encoded by many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import codecs
from tidewell.operators import lanes, model
from tidewell.operators.measures import POINTS_PER_BLOCK
from tidewell.operators.merge import last_write_wins

BLOCKS_DDL = "sid bigint, dtype tinyint, min_clock bigint, max_clock bigint, n_points bigint, raw_bytes bigint, clock_bytes bigint, value_bytes bigint, quality_bytes bigint, crc bigint, block binary"


def encode_points(points: DataFrame, block: int = POINTS_PER_BLOCK, target_rows: int = lanes.TARGET_ROWS) -> DataFrame:
    """Blocks of at most ``block`` current points of a series: bounds, sizes, checksum and the encoded bytes.

    points: sid, clock, value, quality, seq; rows without a value (NaN included) are set aside. Blocks are cut by the place
    of a point in its series, so they are the same however a long series is spread over tasks: rows are numbered lane by
    lane, and go to their blocks by number.
    """
    tag = model.type_tag(dict(points.dtypes)["value"])
    kept = last_write_wins(lanes.live(points).select("sid", "clock", F.col("value").cast(model.VALUE_TYPES[tag]).alias("value"), F.coalesce("quality", F.lit(0)).cast("long").alias("quality"), "seq")).drop("seq")
    plan = lanes.LanePlan.of(points, target_rows)
    if plan.heavy:
        placed = lanes.with_position(kept, plan).withColumn("part", F.expr(f"at div {max(1, target_rows // block) * block}"))
    else:
        placed = kept.withColumn("part", F.lit(0).cast("long"))
    rows = placed.select("sid", "part", "clock", "value", "quality").repartition(plan.partitions(), "sid", "part").sortWithinPartitions("sid", "part", "clock")
    ints = [(n, pa.int64()) for n in ("min_clock", "max_clock", "n_points", "raw_bytes", "clock_bytes", "value_bytes", "quality_bytes", "crc")]
    schema = pa.schema([("sid", pa.int64()), ("dtype", pa.int8()), *ints, ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for b in lanes.blocks(batches, ("sid", "part")):
            g, first = lanes.group_index(b["sid"], b["part"])
            out: list[tuple] = []
            for a, z in zip(first, np.r_[first[1:], len(g)], strict=True):
                for i in range(a, z, block):
                    j = min(z, i + block)
                    clock, value = b["clock"][i:j], b["value"][i:j]
                    data = codecs.encode_block(tag, clock, value.tolist() if tag == model.STRING else value, b["quality"][i:j])
                    _, s1, s2, s3 = codecs.split_block(data)
                    raw = sum(model.POINT_BYTES[tag] + len(v.encode()) for v in value) if tag == model.STRING else model.POINT_BYTES[tag] * (j - i)
                    out.append((int(b["sid"][i]), tag, int(clock[0]), int(clock[-1]), j - i, raw, len(s1), len(s2), len(s3), zlib.crc32(data), data))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, BLOCKS_DDL)


def decode_points(blocks: DataFrame, tag: int, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """(sid, clock, value, quality) from blocks; blocks outside the inclusive range are not decoded, others are clipped."""
    wanted = blocks.filter(F.col("dtype") == tag)
    if lo is not None:
        wanted = wanted.filter(F.col("max_clock") >= lo)
    if hi is not None:
        wanted = wanted.filter(F.col("min_clock") <= hi)
    kinds = {model.DOUBLE: pa.float64(), model.INTEGER: pa.int64(), model.BOOLEAN: pa.bool_(), model.STRING: pa.string()}
    schema = pa.schema([("sid", pa.int64()), ("clock", pa.int64()), ("value", kinds[tag]), ("quality", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray | list, np.ndarray]] = []
        size = 0

        def give() -> pa.RecordBatch:
            sids = np.repeat([h[0] for h in held], [len(h[1]) for h in held])
            values = [v for h in held for v in h[2]] if isinstance(held[0][2], list) else np.concatenate([h[2] for h in held])
            columns = (sids, np.concatenate([h[1] for h in held]), values, np.concatenate([h[3] for h in held]).astype(np.int32))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for b in batches:
            for sid, data in zip(b.column("sid").to_pylist(), b.column("block").to_pylist(), strict=True):
                found = codecs.block_arrays(data, lo, hi)
                if len(found[0]):
                    held.append((sid, *found))
                    size += len(found[0])
                if size >= lanes.BLOCK_ROWS:
                    yield give()
                    size = 0
        if held:
            yield give()

    return wanted.select("sid", "block").mapInArrow(run, f"sid bigint, clock bigint, value {model.VALUE_TYPES[tag]}, quality int")
