"""The store: databases of points under retention periods, on one path of a shared file system.

    <path>/_manifest/v-N.json                     databases, generations, tombstones, epochs of streams
    <path>/registry/commit=C/                     (rp_days, sid): the registered series of a database
    <path>/points/commit=C/gen=G/db=I/rp_days=D/shard_start=S/    Parquet files sorted by sid and clock
    <path>/tombs/commit=C/                        (sid, level, node, lo, hi, seq): keys of deletes, as changefeed makes them

A write makes a new generation and is visible once the manifest names it, in all databases at once; of equal (sid,
clock) the highest seq wins on read. seq is the number of the write times 2**36 plus the order in the batch. Compaction
merges generations of a shard, as the planner groups them, into a new one without overwritten and deleted points. There
is one writer; what a second one writes at the same time lies in directories of its own and is refused by the manifest.
Readers see the version that is there when they plan, whose files are kept until the compaction after next.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.clock import MAX_CLOCK, MIN_CLOCK, TICKS_PER_DAY, TICKS_PER_SECOND
from tidewell.operators import changefeed, merge, model, rolling, shards
from tidewell.plans import compaction
from tidewell.sources.files import Files, Manifest

DEFAULT = "default"
TOMBS_DDL = "sid bigint, level int, node bigint, lo bigint, hi bigint, seq bigint"
REGISTRY_DDL = "rp_days int, sid bigint"
STORED_DDL = model.POINTS_DDL + ", commit string, gen bigint, db int, rp_days int, shard_start bigint"
BATCH_SEQ = 2**36
#: Shards are written by rebalanced tasks of spark.sql.adaptive.advisoryPartitionSizeInBytes, so a file is rolled by bytes,
#: far below the planner's largest file; this many rows is the most where that is off.
ROWS_PER_FILE = 20_000_000
#: Age in milliseconds from which a directory that no version names is of a write that was cut off.
UNFINISHED_MS = 24 * 3600 * 1000
COUNTERS = ("writes", "points_accepted", "reads", "deletes", "compactions", "groups_merged", "files_written", "bytes_written", "shards_expired", "snapshots", "flushes", "sids_added", "sids_removed")


def observed(seen: Observation, name: str) -> int:
    """A count that was observed; 0 if the rows were known to be none and the count was dropped from the plan with them."""
    try:
        return seen.get[name]
    except Py4JJavaError:
        return 0


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        self.manifest = Manifest(self.files, self.path)
        self.is_open = False
        # shards: [generation, level, rp_days, shard_start, bytes, files, commit] each; tombs: [generation, lo, hi, commit]
        self.meta: dict = {"databases": {DEFAULT: {"id": 0, "registry": "", "shards": [], "tombs": []}}, "writes": 0, "epochs": {}, "retired": [], "next_id": 1}
        self.closed: set[str] = set()
        self.snapshots: dict[str, set[int]] = {}
        self.counters = dict.fromkeys(COUNTERS, 0)

    # ---- lifecycle -------------------------------------------------------------------------------------------
    def open(self) -> Store:
        """Loads the metadata, and removes what no version needs any more."""
        found = self.manifest.read()
        if found is None:
            self._save()
        else:
            self.meta = found
        self.is_open = True
        used = {p.split("/")[1] for p in self.meta["retired"]}
        for d in self.meta["databases"].values():
            used |= {f"commit={c}" for c in (d["registry"], *[s[6] for s in d["shards"]], *[t[3] for t in d["tombs"]])}
        for kind in ("points", "tombs", "registry"):
            for e in self.files.entries(f"{self.path}/{kind}"):
                # a younger one may be of a write that is under way
                if e.name.startswith("commit=") and e.name not in used and e.changed < time.time() * 1000 - UNFINISHED_MS:
                    self.files.delete(e.path)
        return self

    def close(self) -> None:
        self.is_open = False

    def _save(self) -> None:
        self.manifest.write(self.meta)

    def _retire(self, paths: Iterable[str]) -> None:
        """Names directories that the next version does without; those that were retired before are deleted."""
        for old in self.meta["retired"]:
            self.files.delete(f"{self.path}/{old}")
        self.meta["retired"] = list(paths)

    def _need_open(self) -> None:
        if not self.is_open:
            raise RuntimeError("the store is not open")

    # ---- databases -------------------------------------------------------------------------------------------
    def databases(self) -> list[str]:
        return sorted(self.meta["databases"])

    def contains_database(self, name: str) -> bool:
        return name in self.meta["databases"]

    def _new_database(self, name: str) -> dict:
        info = {"id": self.meta["next_id"], "registry": "", "shards": [], "tombs": []}
        self.meta["next_id"] += 1
        self.meta["databases"][name] = info
        return info

    def create_database(self, name: str) -> bool:
        if not name or "/" in name or self.contains_database(name):
            return False
        self._new_database(name)
        self._save()
        return True

    def rename_database(self, name: str, new: str) -> bool:
        if name == DEFAULT or not new or "/" in new or not self.contains_database(name) or self.contains_database(new):
            return False
        self.meta["databases"][new] = self.meta["databases"].pop(name)
        self._save()
        return True

    def delete_database(self, name: str) -> bool:
        """With all its data; the default database stays."""
        if name == DEFAULT or not self.contains_database(name):
            return False
        info = self.meta["databases"].pop(name)
        self._retire(self._directories(info))
        self._save()
        return True

    def close_database(self, name: str) -> None:
        self.closed.add(name)

    def open_database(self, name: str) -> None:
        self.closed.discard(name)

    def _info(self, name: str) -> dict:
        if not self.contains_database(name):
            raise KeyError(f"no database {name}")
        return self.meta["databases"][name]

    def _databases(self, name: str | None) -> list[str]:
        if name:
            self._info(name)
        return [d for d in ([name] if name else self.databases()) if d not in self.closed]

    # ---- registry --------------------------------------------------------------------------------------------
    def registry(self, db: str = DEFAULT) -> DataFrame:
        """(rp_days, sid)."""
        info = self._info(db)
        if not info["registry"]:
            return self.spark.createDataFrame([], REGISTRY_DDL)
        return self.spark.read.schema(REGISTRY_DDL).parquet(f"{self.path}/registry/commit={info['registry']}")

    def _sids(self, sids: Iterable[int] | DataFrame) -> DataFrame:
        return (sids.select(F.col("sid").cast("long")) if isinstance(sids, DataFrame) else self.spark.createDataFrame([(s,) for s in sids], "sid bigint")).filter("sid is not null").distinct()

    def _replace_registry(self, db: str, new: DataFrame) -> None:
        info = self._info(db)
        old, info["registry"] = info["registry"], uuid.uuid4().hex
        new.write.parquet(f"{self.path}/registry/commit={info['registry']}")
        if old:
            self.meta["retired"].append(f"registry/commit={old}")
        self._save()

    def add_sids(self, sids: Iterable[int] | DataFrame, days: int, db: str = DEFAULT) -> int:
        """Registers sids under a retention period, which is made on demand; how many were new to it."""
        self._need_open()
        now = self.registry(db)
        new = self._sids(sids).join(now.filter(F.col("rp_days") == days), "sid", "left_anti").select(F.lit(days).alias("rp_days"), "sid")
        n = new.count()
        if n:
            self._replace_registry(db, now.unionByName(new))
        self.counters["sids_added"] += n
        return n

    def remove_sids(self, sids: Iterable[int] | DataFrame, db: str = DEFAULT) -> int:
        """Removes sids from all retention periods and deletes their points; how many (period, sid) were removed."""
        self._need_open()
        gone = self._sids(sids)
        now = self.registry(db)
        lost = now.join(gone, "sid", "left_semi")
        n = lost.count()
        if n:
            self._entomb([db], lost.select("sid").distinct(), MIN_CLOCK, MAX_CLOCK)
            self._replace_registry(db, now.join(gone, "sid", "left_anti").select("rp_days", "sid"))
        self.counters["sids_removed"] += n
        return n

    # ---- points ----------------------------------------------------------------------------------------------
    def _directory(self, info: dict, shard: list[int]) -> str:
        return f"points/commit={shard[6]}/gen={shard[0]}/db={info['id']}/rp_days={shard[2]}/shard_start={shard[3]}"

    def _directories(self, info: dict) -> list[str]:
        registry = [f"registry/commit={info['registry']}"] if info["registry"] else []
        return [self._directory(info, s) for s in info["shards"]] + [f"tombs/commit={t[3]}" for t in info["tombs"]] + registry

    def _points(self, info: dict, chosen: list[list[int]]) -> DataFrame:
        """The stored rows of some shards' generations."""
        there = [f"{self.path}/{self._directory(info, s)}" for s in chosen]
        stored = self.spark.read.schema(STORED_DDL).option("basePath", f"{self.path}/points").parquet(*there) if there else self.spark.createDataFrame([], STORED_DDL)
        return stored.filter(F.col("db") == info["id"])

    def tombstones(self, db: str = DEFAULT, lo: int = MIN_CLOCK, hi: int = MAX_CLOCK) -> DataFrame:
        """Keys of the deletes that meet a range, in the form of changefeed.delete_entries."""
        there = [f"{self.path}/tombs/commit={c}" for _, a, z, c in self._info(db)["tombs"] if a <= hi and z >= lo]
        return self.spark.read.schema(TOMBS_DDL).parquet(*there) if there else self.spark.createDataFrame([], TOMBS_DDL)

    def _next(self) -> int:
        """The number of a write, delete or compaction; it is stored with the next version."""
        self.meta["writes"] += 1
        return self.meta["writes"]

    def _entomb(self, names: list[str], sids: DataFrame, lo: int, hi: int) -> None:
        for d in names:
            n = self._next()
            first, last = (None if lo <= MIN_CLOCK else lo), (None if hi >= MAX_CLOCK else hi)
            deletes = sids.select("sid", F.lit(first).cast("long").alias("lo"), F.lit(last).cast("long").alias("hi"), F.lit(n * BATCH_SEQ).alias("seq"))
            if lo <= hi:
                self._write_tombs(d, n, deletes, lo, hi)
        self._save()

    def _write_tombs(self, db: str, n: int, deletes: DataFrame, lo: int, hi: int) -> None:
        commit = uuid.uuid4().hex
        changefeed.delete_entries(deletes).write.parquet(f"{self.path}/tombs/commit={commit}")
        self._info(db)["tombs"].append([n, lo, hi, commit])

    def shards(self, db: str = DEFAULT) -> list[tuple[int, int]]:
        """(rp_days, shard_start) of the shards that are there."""
        return sorted({(s[2], s[3]) for s in self._info(db)["shards"]})

    def write(self, df: DataFrame, db: str | None = None, now: int | None = None, value: str = "value", epoch: tuple[str, int] | None = None) -> int:
        """Writes rows (sid, clock, value[, quality][, seq: order in the batch]) to each database and retention period
        in which their sid is registered; the number of points accepted, before duplicates are dropped.

        seq has to be from 0 to 2**36 - 1, else the write fails as a whole. Rows of unregistered sids are ignored, as are rows that validate() sets aside (see quarantine). With
        ``now``, expired points are dropped unless a shard for them is there already. The batch is read once; it is
        visible in all databases at once, together with the ``epoch`` (query, number) of a stream.
        """
        self._need_open()
        good, _ = model.validate(model.points_of(df, value))
        outside = F.raise_error(F.lit("seq has to be from 0 to 2**36 - 1")).cast("long")
        position = F.when(F.col("seq").between(0, BATCH_SEQ - 1), F.col("seq")).otherwise(outside)
        names = {self._info(d)["id"]: d for d in self._databases(db) if self._info(d)["registry"]}
        total = 0
        if names:
            gen = self._next()
            routes = reduce(DataFrame.unionByName, [self.registry(d).withColumn("db", F.lit(i)) for i, d in names.items()])
            routed = rolling.lookup(good.withColumn("seq", F.lit(gen * BATCH_SEQ) + position), routes, "sid")
            routed = routed.withColumn("shard_start", F.col("clock") - F.pmod(F.col("clock"), shards.width_column()))
            if now is not None:
                kept = F.lit(False)
                for i, d in names.items():
                    for p in {p for p, _ in self.shards(d)}:
                        kept |= (F.col("db") == i) & (F.col("rp_days") == p) & F.col("shard_start").isin([s for q, s in self.shards(d) if q == p])
                routed = routed.filter(~shards.expired("clock", F.col("rp_days").cast("long"), now) | kept)
            seen = Observation()
            routed = routed.observe(seen, F.count(F.lit(1)).alias("n"))
            self._write_files(routed.withColumn("gen", F.lit(gen)), [gen], {i: 1 for i in names})
            total = observed(seen, "n")
        if epoch is not None:
            self.meta["epochs"][epoch[0]] = epoch[1]
        if names or epoch is not None:
            self._save()
        self.counters["writes"] += 1
        self.counters["points_accepted"] += total
        return total

    def _write_files(self, rows: DataFrame, gens: list[int], levels: dict[int, int] | int) -> None:
        """Writes rows with gen, db, rp_days and shard_start, and adds what was written to the metadata."""
        parts = ["gen", "db", "rp_days", "shard_start"]
        commit = uuid.uuid4().hex
        at = f"{self.path}/points/commit={commit}"
        # rebalanced by shard: small shards share a task and a large one is split over several files
        out = rows.hint("rebalance", *parts).sortWithinPartitions(*parts, "sid", "clock")
        out.write.option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy(*parts).parquet(at)
        names = {d["id"]: d for d in self.meta["databases"].values()}
        for gen in gens:
            found: dict[tuple[int, int, int], list[int]] = {}
            for e in self.files.walk(f"{at}/gen={gen}"):
                if e.name.endswith(".parquet"):
                    key = tuple(int(x.split("=")[1]) for x in e.path.split("/")[-4:-1])
                    size = found.setdefault(key, [0, 0])
                    size[0] += e.n_bytes
                    size[1] += 1
            for (i, days, start), (n_bytes, n_files) in sorted(found.items()):
                names[i]["shards"].append([gen, levels if isinstance(levels, int) else levels[i], days, start, n_bytes, n_files, commit])
                self.counters["files_written"] += n_files
                self.counters["bytes_written"] += n_bytes

    @staticmethod
    def quarantine(df: DataFrame, value: str = "value") -> DataFrame:
        """The rows that write leaves out because they cannot be stored, with the fault."""
        return model.validate(model.points_of(df, value))[1]

    def read(self, sids: Iterable[int] | DataFrame, lo: int = MIN_CLOCK, hi: int = MAX_CLOCK, db: str | None = None) -> DataFrame:
        """Current points of registered sids with lo <= clock <= hi, of one or of all databases, without overwritten,
        deleted and unregistered ones. Only the shards that meet the range are read. Sort by sid and clock as needed."""
        self._need_open()
        self.counters["reads"] += 1
        parts = []
        plain = 0
        for d in self._databases(db):
            info = self._info(d)
            within = [s for s in info["shards"] if s[3] <= hi and s[3] + shards.width_seconds(s[2]) * TICKS_PER_SECOND > lo]
            if not within:
                continue
            points = merge.of_sids(self._points(info, within).filter(self._range(info, lo, hi)), sids)
            points = points.join(self.registry(d), ["rp_days", "sid"], "left_semi").select(*model.POINT_COLUMNS)
            if any(a <= hi and z >= lo for _, a, z, _ in info["tombs"]):
                points = changefeed.rows_not_deleted(points, *changefeed.split_entries(merge.of_sids(self.tombstones(d, lo, hi), sids)))
            else:
                plain += 1
            parts.append(points)
        if not parts:
            return self.spark.createDataFrame([], model.POINTS_DDL)
        if len(parts) == 1 and not plain:
            return parts[0]
        return merge.last_write_wins(reduce(DataFrame.unionByName, parts))

    def read_all(self, sids: Iterable[int] | DataFrame, db: str | None = None) -> DataFrame:
        return self.read(sids, db=db)

    def _range(self, info: dict, lo: int, hi: int) -> Column:
        """Predicate on clock and on the partition columns, so that directories outside the range are pruned."""
        found = F.lit(False)
        for days in sorted({s[2] for s in info["shards"]}):
            w = shards.width_seconds(days) * TICKS_PER_SECOND
            found |= (F.col("rp_days") == days) & F.col("shard_start").between(lo - lo % w, hi)
        return found & F.col("clock").between(lo, hi)

    def delete_range(self, sids: Iterable[int] | DataFrame, lo: int = MIN_CLOCK, hi: int = MAX_CLOCK, db: str | None = None) -> None:
        """Deletes points with lo <= clock <= hi wherever they are stored; later writes to the range are visible again."""
        self._need_open()
        self.counters["deletes"] += 1
        self._entomb(self._databases(db), self._sids(sids), lo, hi)

    def delete_ranges(self, ranges: DataFrame, db: str | None = None) -> int:
        """Deletes many ranges at once: rows (sid, lo, hi; null: open); how many. Null sids and inverted ranges are set aside."""
        self._need_open()
        good = ranges.filter("sid is not null and (lo is null or hi is null or lo <= hi)").select(F.col("sid").cast("long").alias("sid"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
        ends = good.agg(F.min(F.coalesce("lo", F.lit(MIN_CLOCK))), F.max(F.coalesce("hi", F.lit(MAX_CLOCK))), F.count(F.lit(1))).first()
        if ends[2]:
            for d in self._databases(db):
                n = self._next()
                self._write_tombs(d, n, good.withColumn("seq", F.lit(n * BATCH_SEQ)), ends[0], ends[1])
            self._save()
        self.counters["deletes"] += 1
        return ends[2]

    # ---- snapshots of what is not compacted yet ----------------------------------------------------------------
    def _fresh(self, db: str) -> set[int]:
        return {s[0] for s in self._info(db)["shards"] if s[1] == 1}

    def snapshot(self, db: str = DEFAULT) -> DataFrame:
        """The points of the writes that are not merged yet, and remembers these writes; later ones are not among them.
        An error while a snapshot is held."""
        self._need_open()
        if db in self.snapshots:
            raise RuntimeError("a snapshot is held already")
        self.snapshots[db] = self._fresh(db)
        self.counters["snapshots"] += 1
        info = self._info(db)
        return merge.last_write_wins(self._points(info, [s for s in info["shards"] if s[0] in self.snapshots[db]]).select(*model.POINT_COLUMNS))

    def clear_snapshot(self, success: bool, db: str = DEFAULT) -> int:
        """Ends a snapshot. With success its writes are merged into one generation of each shard; else they stay as they
        are. How many shards were merged."""
        held = self.snapshots.pop(db, set())
        if not success:
            return 0
        info = self._info(db)
        groups: dict[tuple[int, int], list[int]] = {}
        for g, _, days, start, _, _, _ in info["shards"]:
            if g in held:
                groups.setdefault((days, start), []).append(g)
        return self._merge(db, [(days, start, gens, 2) for (days, start), gens in sorted(groups.items())])

    def flush(self, db: str | None = None) -> int:
        """Merges what was written since the last flush into one sorted set of files a shard; of how many shards."""
        self._need_open()
        self.counters["flushes"] += 1
        n = 0
        for d in self._databases(db):
            self.snapshots[d] = self._fresh(d)
            n += self.clear_snapshot(True, d)
        return n

    # ---- maintenance -----------------------------------------------------------------------------------------
    def expire(self, now: int, db: str | None = None) -> int:
        """Drops the shards whose end is expired; how many."""
        self._need_open()
        n, gone = 0, []
        for d in self._databases(db):
            info = self._info(d)
            old = [s for s in info["shards"] if now > s[3] + shards.width_seconds(s[2]) * TICKS_PER_SECOND + s[2] * TICKS_PER_DAY]
            n += len({(s[2], s[3]) for s in old})
            gone += [self._directory(info, s) for s in old]
            info["shards"] = [s for s in info["shards"] if s not in old]
        if gone:
            self._retire(gone)
            self._save()
        self.counters["shards_expired"] += n
        return n

    def file_table(self, db: str = DEFAULT) -> list[tuple[int, int, str, int]]:
        """(rp_days, shard_start, file, bytes)."""
        info = self._info(db)
        return [(s[2], s[3], e.path, e.n_bytes) for s in info["shards"] for e in self.files.entries(f"{self.path}/{self._directory(info, s)}") if e.name.endswith(".parquet")]

    def generation_table(self, db: str = DEFAULT) -> DataFrame:
        """The generations of each shard in the form that plans.compaction takes: (shard, generation, sequence, n_bytes,
        has_tombstone, full_blocks). A shard is rp_days:shard_start; a tombstone counts if it is later and meets the shard."""
        info = self._info(db)
        rows = []
        for g, level, days, start, n_bytes, _, _ in info["shards"]:
            end = start + shards.width_seconds(days) * TICKS_PER_SECOND
            rows.append((f"{days}:{start}", g, level, n_bytes, any(t > g and lo < end and hi >= start for t, lo, hi, _ in info["tombs"]), n_bytes > compaction.LARGEST_FILE))
        return self.spark.createDataFrame(rows, "shard string, generation bigint, sequence int, n_bytes bigint, has_tombstone boolean, full_blocks boolean")

    def compact(self, db: str | None = None, full: bool = False) -> int:
        """Merges all generations of each shard that has several or a tombstone, as the planner's full plan groups them (all
        shards if full); of how many shards. What a read gives stays the same.

        A full compaction also drops the tombstones, since no point that they cover is left.
        """
        self._need_open()
        n = 0
        for d in self._databases(db):
            info = self._info(d)
            if full:
                groups = [(days, start, [s[0] for s in info["shards"] if (s[2], s[3]) == (days, start)], compaction.TOP_LEVEL) for days, start in self.shards(d)]
                n += self._merge(d, groups, list(info["tombs"]))
            else:
                n += self._merge(d, self._groups(compaction.plan_full(self.generation_table(d), 0, 0, force=True)))
        return n

    def maintain(self, now: int, last_write: int, db: str | None = None) -> int:
        """What the planner asks for: a full compaction of cold shards, else groups of levels 1 to 3 and of the top level;
        how many groups were merged."""
        self._need_open()
        n = 0
        for d in self._databases(db):
            files = self.generation_table(d)
            groups = self._groups(compaction.plan_full(files, now, last_write))
            if not groups:
                groups = [g for plan in (*[compaction.plan_level(files, k) for k in (1, 2, 3)], compaction.plan_optimize(files)) for g in self._groups(plan)]
            n += self._merge(d, groups)
        return n

    @staticmethod
    def _groups(plan: DataFrame) -> list[tuple[int, int, list[int], int]]:
        """(rp_days, shard_start, generations, level of the result): as many as there are groups of files."""
        return sorted((*map(int, r.shard.split(":")), list(r.generations), min(compaction.TOP_LEVEL, r.level + 1)) for r in plan.collect())

    def _merge(self, db: str, groups: list[tuple[int, int, list[int], int]], drop: list[list[int]] | None = None) -> int:
        """Writes each group of generations of a shard as a new one, and swaps it in, all groups at once."""
        info = self._info(db)
        old: list[list[int]] = []
        by_level: dict[int, list[tuple[int, int, int, int]]] = {}  # (generation, rp_days, shard_start, number of the group in its shard)
        count: dict[tuple[int, int], int] = {}
        for days, start, gens, level in groups:
            k = count[days, start] = count.get((days, start), -1) + 1
            by_level.setdefault(level, []).extend((g, days, start, k) for g in gens)
            old += [s for s in info["shards"] if s[0] in gens and (s[2], s[3]) == (days, start)]
        for level, members in sorted(by_level.items()):
            fresh = {k: self._next() for k in sorted({m[3] for m in members})}
            table = self.spark.createDataFrame([(g, days, start, fresh[to]) for g, days, start, to in members], "gen bigint, rp_days int, shard_start bigint, to bigint")
            chosen = [s for s in info["shards"] if (s[0], s[2], s[3]) in {m[:3] for m in members}]
            # as many rows as generations of shards
            rows = self._points(info, chosen).join(F.broadcast(table), ["gen", "rp_days", "shard_start"]).drop("gen", "commit").withColumnRenamed("to", "gen")
            if info["tombs"]:
                rows = changefeed.rows_not_deleted(rows, *changefeed.split_entries(self.tombstones(db)), latest=False)
            nth = F.row_number().over(merge.Window.partitionBy("gen", "rp_days", "sid", "clock").orderBy(F.desc("seq")))
            self._write_files(rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth"), list(fresh.values()), level)
        if groups or drop:
            info["shards"] = [s for s in info["shards"] if s not in old]
            self._retire([*[self._directory(info, s) for s in old], *[f"tombs/commit={t[3]}" for t in drop or []]])
            info["tombs"] = [t for t in info["tombs"] if t not in (drop or [])]
            self._save()
        self.counters["compactions"] += bool(groups)
        self.counters["groups_merged"] += len(groups)
        return len(groups)

    def disk_size(self, db: str | None = None) -> int:
        """Bytes of the points, tombstones and registered series."""
        return sum(e.n_bytes for d in ([db] if db else self.databases()) for e in self._walk(d))

    def _walk(self, db: str):
        info = self._info(db)
        return [e for p in self._directories(info) for e in self.files.walk(f"{self.path}/{p}")]

    def last_modified(self, db: str | None = None) -> int:
        """Milliseconds since 1970 of the latest change of a file; 0 without files."""
        return max((e.changed for d in ([db] if db else self.databases()) for e in self._walk(d)), default=0)

    def is_idle(self, db: str = DEFAULT) -> bool:
        """Nothing to compact: one generation a shard and no tombstone."""
        info = self._info(db)
        return len(info["shards"]) == len(self.shards(db)) and not info["tombs"]

    def statistics(self) -> DataFrame:
        """(database, module, counter, value): of each database its shards, files, registry and log of deletes; the counters
        of this session under the module store."""
        rows = [(None, "store", k, v) for k, v in self.counters.items()]
        rows += [(None, "store", "databases", len(self.databases())), (None, "store", "version", self.manifest.version), (None, "store", "retired_directories", len(self.meta["retired"]))]
        for d in self.databases():
            info = self._info(d)
            own = info["shards"]
            rows += [
                (d, "shard", "shards", len(self.shards(d))), (d, "shard", "retention_periods", len({s[2] for s in own})), (d, "engine", "generations", len(own)), (d, "engine", "files", sum(s[5] for s in own)),
                (d, "engine", "bytes", sum(s[4] for s in own)), (d, "cache", "unmerged_generations", sum(s[1] == 1 for s in own)), (d, "cache", "unmerged_bytes", sum(s[4] for s in own if s[1] == 1)),
                (d, "cache", "held_snapshot", int(d in self.snapshots)), (d, "log", "deletes", len(info["tombs"])),
            ]
            rows += [(d, "engine", f"level_{k}_generations", sum(s[1] == k for s in own)) for k in range(1, compaction.TOP_LEVEL + 1)]
        return self.spark.createDataFrame(rows, "database string, module string, counter string, value bigint")

    def backup(self, to: str, db: str = DEFAULT) -> None:
        """Extension: copies a database's files and its entry."""
        info = self._info(db)
        self.files.delete(to)
        for p in self._directories(info):
            self.files.copy(f"{self.path}/{p}", f"{to}/{p}")
        Manifest(self.files, to).write({"database": info})

    def restore(self, source: str, db: str) -> bool:
        """Extension: makes a new database from a backup; its generations get numbers of their own."""
        if self.contains_database(db):
            return False
        theirs = Manifest(self.files, source).read()["database"]
        info = self._new_database(db)
        number: dict[int, int] = {}
        for g in sorted({s[0] for s in theirs["shards"]} | {t[0] for t in theirs["tombs"]}):
            number[g] = self._next()
        commit = uuid.uuid4().hex
        for s in theirs["shards"]:
            mine = [number[s[0]], *s[1:6], commit]
            self.files.copy(f"{source}/{self._directory(theirs, s)}", f"{self.path}/{self._directory(info, mine)}")
            info["shards"].append(mine)
        for t in theirs["tombs"]:
            mine = [number[t[0]], *t[1:3], uuid.uuid4().hex]
            self.files.copy(f"{source}/tombs/commit={t[3]}", f"{self.path}/tombs/commit={mine[3]}")
            info["tombs"].append(mine)
        if theirs["registry"]:
            info["registry"] = commit
            self.files.copy(f"{source}/registry/commit={theirs['registry']}", f"{self.path}/registry/commit={commit}")
        # seq of restored rows must stay below those of later writes
        self.meta["writes"] = max([self.meta["writes"], *number])
        self._save()
        return True

    def epoch_done(self, query: str, epoch: int) -> bool:
        return self.meta["epochs"].get(query, -1) >= epoch
