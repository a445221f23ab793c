"""Filling containers of fixed capacity by minimum bin slack.

Only the number of items of each size matters for a packing, and there are at most ``capacity`` sizes, so the
plan is made from a histogram, whatever the number of items. For each container the largest size that is left
is set, and a bitset subset-sum programme over the sizes that are left (each as often as it is left) finds the
multiset that fills the rest closest to capacity. Its counts come from backtracking, and the filling is
repeated for as many containers as the items last. The items then find their places by their rank among the
items of their size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import bpe
from tidewell.operators import lanes

#: Rows of one size that one task ranks; the items of a size with more are spread over several.
RANKED_ROWS = 200_000
#: Largest sizes that are tried as the first of three.
TRIED = 32
#: Most rows of the table of capacities, which is held on the driver.
MOST_CAPACITIES = 1000


def fill(room: int, left: np.ndarray, sizes: Iterable[int]) -> dict[int, int]:
    """The multiset of the sizes (descending), each at most left[size] times, with the largest sum up to room."""
    mask = (1 << (room + 1)) - 1
    full = 1 << room
    reach = 1
    taken: list[tuple[int, int, int]] = []  # size, how many at once, sums that could be reached before
    for s in sizes:
        if s > room:
            continue
        n = min(int(left[s]), room // s)
        part = 1
        while n > 0:
            m = min(part, n)
            taken.append((s, m, reach))
            reach |= (reach << (m * s)) & mask
            n -= m
            part *= 2
        if reach & full:
            break
    goal = reach.bit_length() - 1
    out: dict[int, int] = {}
    for s, m, before in reversed(taken):
        if not before >> goal & 1:
            out[s] = out.get(s, 0) + m
            goal -= s * m
    return out


def bits(there: np.ndarray) -> int:
    """A bitset with bit i for each i of which there[i] holds."""
    return int.from_bytes(np.packbits(there, bitorder="little").tobytes(), "little")


class Left:
    """The items that are left: how many of each size, and which sizes, as a bitset in both directions."""

    def __init__(self, capacity: int, left: np.ndarray):
        self.capacity, self.left = capacity, left.copy()
        self.left[0] = 0
        self.have, self.back = bits(self.left > 0), bits(self.left[::-1] > 0)

    def add(self, size: int, n: int) -> None:
        had = self.left[size] > 0
        self.left[size] += n
        if had != (self.left[size] > 0):
            self.have ^= 1 << size
            self.back ^= 1 << (self.capacity - size)

    def sizes(self, room: int) -> Iterator[int]:
        """The sizes up to room, the largest first."""
        rest = self.have & ((1 << (room + 1)) - 1)
        while (s := rest.bit_length() - 1) > 0:
            yield s
            rest ^= 1 << s

    def exact(self, room: int, most: int = 3) -> list[int] | None:
        """Up to ``most`` sizes that fill room exactly, larger ones first, if the bitsets show some."""
        if room == 0:
            return []
        if self.have >> room & 1:
            return [room]
        if most >= 2:
            two = self.have & (self.back >> (self.capacity - room))  # sizes s for which there is room - s
            s = two.bit_length() - 1
            if s > 0 and (2 * s != room or self.left[s] > 1):
                return [s, room - s]
        if most >= 3:
            rest = self.have & ((1 << room) - 1)
            for _ in range(TRIED):
                s = rest.bit_length() - 1
                if s <= 0:
                    break
                rest ^= 1 << s
                self.add(s, -1)
                more = self.exact(room - s, 2)
                self.add(s, 1)
                if more is not None:
                    return [s, *more]
        return None


def plan(capacity: int, left: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """Fillings as (number of containers, {size: items in each}), from the number of items of each size 1..capacity.

    While more than two of the largest size that is left would fit, it is set. The window that then remains is filled by
    up to three sizes whose sum is exact, each looked up with a few operations on bitsets; where there are none, by the
    programme over all sizes that are left.
    """
    items = Left(capacity, left)
    out = []
    while items.have:
        filling: dict[int, int] = {}
        room = capacity

        def take(s: int, n: int) -> None:
            items.add(s, -n)
            filling[s] = filling.get(s, 0) + n

        while (top := (items.have & ((1 << (room + 1)) - 1)).bit_length() - 1) > 0 and (not filling or room > 2 * top):
            n = 1 if not filling else min(int(items.left[top]), room // top - 1)
            take(top, n)
            room -= n * top
        found = items.exact(room)
        for s, n in (fill(room, items.left, items.sizes(room)) if found is None else Counter(found)).items():
            take(s, n)
        for s, n in filling.items():
            items.add(s, n)
        times = min(int(items.left[s]) // m for s, m in filling.items())
        for s, m in filling.items():
            items.add(s, -m * times)
        out.append((times, filling))
    return out


def pack(sizes: DataFrame, capacities: list[tuple[int, int]], ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """Assigns items to containers: (pack_id, container_id, doc_id, piece_no, n_tokens).

    sizes: doc_id, n_tokens (null counts as 0), read three times. capacities: (pack_id, capacity above 0).
    An item up to the capacity is one piece with number 0. A longer one is cut into pieces of full capacity and
    a last piece with the rest. Containers are numbered from 1 in each pack. Items of size 0 take no space and
    are dealt out to the containers in turn (all to container 1 if there is no other item). Repeated rows are
    items of their own. Without items there are no containers.
    """
    packs = F.explode(F.array(*[F.struct(F.lit(p).alias("pack_id"), F.lit(c).cast("long").alias("capacity")) for p, c in capacities]))
    items = (
        sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n"))
        .withColumn("p", packs)
        .selectExpr("p.pack_id", "p.capacity", "doc_id", "n", "explode(sequence(0L, greatest(0L, (n + p.capacity - 1) div p.capacity - 1))) as piece_no")
        .selectExpr("pack_id", "doc_id", "piece_no", "least(capacity, n - piece_no * capacity) as size")
    )
    counts = items.groupBy("pack_id", "size").count().collect()  # at most the sum of the capacities + 1
    places: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    containers: dict[int, int] = {}
    for p, c in capacities:
        left = np.zeros(c + 1, np.int64)
        for r in counts:
            if r.pack_id == p and r["size"] > 0:
                left[r["size"]] = r["count"]
        used: dict[int, list[tuple[int, int, int]]] = {}
        at, taken = 1, dict.fromkeys(range(c + 1), 0)
        for times, filling in plan(c, left):
            for s, m in filling.items():
                used.setdefault(s, []).append((taken[s], at, m))
                taken[s] += m * times
            at += times
        containers[p] = max(1, at - 1)
        places |= {(p, s): tuple(np.array(x, np.int64) for x in zip(*u, strict=True)) for s, u in used.items()}

    # the items of a size are ranked in slices; slices of a size that has several are numbered through by their counts
    sliced = [(r.pack_id, r["size"], -(-r["count"] // ranked_rows)) for r in counts if r["count"] > ranked_rows]
    spark = sizes.sparkSession
    n = lanes.tasks(spark, sum(r["count"] for r in counts))
    stream = items.select("pack_id", "size", F.lit(0).alias("slice"), "doc_id", "piece_no", F.lit(None).cast("long").alias("offset"))
    if sliced:
        many = F.broadcast(spark.createDataFrame(sliced, "pack_id int, size bigint, slices bigint"))  # at most the sum of the capacities
        stream = items.join(many, ["pack_id", "size"], "left").select(
            "pack_id", "size", F.coalesce(F.expr("cast(pmod(xxhash64(doc_id, piece_no), slices) as int)"), F.lit(0)).alias("slice"), "doc_id", "piece_no", F.lit(None).cast("long").alias("offset")
        )
        split = stream.join(many, ["pack_id", "size"], "left_semi").groupBy("pack_id", "size", "slice").count()
        before = F.expr("sum(count) over (partition by pack_id, size order by slice rows between unbounded preceding and 1 preceding)")
        offsets = split.select("pack_id", "size", "slice", F.lit(None).cast("long").alias("doc_id"), F.lit(-1).cast("long").alias("piece_no"), F.coalesce(before, F.lit(0)).cast("long").alias("offset"))
        stream = stream.unionByName(offsets)
    schema = pa.schema([("pack_id", pa.int32()), ("container_id", pa.int64()), ("doc_id", pa.int64()), ("piece_no", pa.int64()), ("n_tokens", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, offset, seen = None, 0, 0
        for b in batches:
            col = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("pack_id", "size", "slice", "piece_no")}
            _, first = lanes.group_index(col["pack_id"], col["size"], col["slice"])
            for i, a in enumerate(first):
                z = first[i + 1] if i + 1 < len(first) else b.num_rows
                key = (int(col["pack_id"][a]), int(col["size"][a]), int(col["slice"][a]))
                if key != last:
                    last, offset, seen = key, 0, 0
                if col["piece_no"][a] < 0:  # the slice's offset comes first
                    offset = b.column("offset")[int(a)].as_py()
                    a += 1
                m = z - a
                if not m:
                    continue
                rank = offset + seen + np.arange(m)
                seen += m
                p, s, _ = key
                if s <= 0:
                    container = rank % containers[p] + 1
                else:
                    start, base, per = places[p, s]
                    at = np.searchsorted(start, rank, "right") - 1
                    container = base[at] + (rank - start[at]) // per[at]
                yield lanes.batch(schema, np.full(m, p), container, b.column("doc_id").slice(int(a), int(m)), col["piece_no"][a:z], np.full(m, s))

    return (
        stream.repartition(n, "pack_id", "size", "slice")
        .sortWithinPartitions("pack_id", "size", "slice", F.expr("piece_no >= 0"), "doc_id", "piece_no")
        .mapInArrow(place, "pack_id int, container_id bigint, doc_id bigint, piece_no bigint, n_tokens bigint")
    )


def pack_documents(documents: DataFrame, pack_sizes: DataFrame, folder: str = bpe.TOKENIZERS) -> DataFrame:
    """Packs all documents into the containers of each row of pack_sizes, by the sizes of its tokenizer.

    The sizes are written to the checkpoint folder once, so that each text is encoded once. Rows of pack_sizes
    without a capacity above 0 or a tokenizer are set aside.
    """
    spark = documents.sparkSession
    rows = pack_sizes.filter("capacity_tokens > 0 and tokenizer is not null and pack_id is not null").limit(MOST_CAPACITIES + 1).collect()
    if len(rows) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities")
    lanes.checkpoint_dir(spark)
    out = None
    for tokenizer in sorted({r.tokenizer for r in rows}):
        sizes = bpe.token_counts(documents, tokenizer, folder).checkpoint()
        packed = pack(sizes, [(r.pack_id, r.capacity_tokens) for r in rows if r.tokenizer == tokenizer])
        out = packed if out is None else out.unionByName(packed)
    return out if out is not None else spark.createDataFrame([], "pack_id int, container_id bigint, doc_id bigint, piece_no bigint, n_tokens bigint")


def packing_check(documents: DataFrame, pack_sizes: DataFrame, folder: str = bpe.TOKENIZERS) -> DataFrame:
    """(pack_id, documents, rows_of_documents, overfull, broken, tight) of pack_documents: the documents that are packed, the
    first pieces; containers that hold more than their capacity; documents within the capacity that are cut, or longer
    ones not cut into full pieces and a rest; whether the containers are at most 1 % and one more than the tokens need."""
    placed = pack_documents(documents, pack_sizes, folder).join(F.broadcast(pack_sizes.select("pack_id", F.col("capacity_tokens").alias("capacity"))), "pack_id")  # at most MOST_CAPACITIES rows
    loads = placed.groupBy("pack_id", "capacity", "container_id").agg(F.sum("n_tokens").alias("load"))
    loads = loads.groupBy("pack_id").agg(F.count(F.when(F.col("load") > F.col("capacity"), 1)).alias("overfull"), F.count(F.lit(1)).alias("containers"), F.sum("load").alias("tokens"), F.max("capacity").alias("capacity"))
    by_doc = placed.groupBy("pack_id", "capacity", "doc_id").agg(
        F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"), F.count(F.when(F.col("piece_no") == 0, 1)).alias("heads"), F.count(F.when(F.col("n_tokens") == F.col("capacity"), 1)).alias("full")
    )
    # of a doc_id that occurs several times each has its own pieces
    wrong = (F.col("pieces") < F.greatest(F.col("heads"), F.ceil(F.col("n") / F.col("capacity")))) | (F.col("pieces") - F.col("full") > F.col("heads"))
    by_doc = by_doc.groupBy("pack_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("heads").alias("rows_of_documents"), F.count(F.when(wrong, 1)).alias("broken"))
    tight = F.col("containers") <= F.ceil(F.col("tokens") / F.col("capacity")) * 1.01 + 1
    return by_doc.join(loads, "pack_id").select("pack_id", "documents", "rows_of_documents", "overfull", "broken", tight.alias("tight"))
