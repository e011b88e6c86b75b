"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as small shards, without a shuffle: one or more for each input partition, each at most so many
rows, and each arrival is committed as a version of its own. A compaction groups shards of similar size (sizes in one
tier differ by a factor of ``FAN_IN`` at most), fills groups up to the target size, and merges every group of at least
``FAN_IN`` shards into one file. One job merges all groups of a round: rows are dealt by the number of their group,
which their file's name tells, so each task writes one file and no group waits for another. It then commits the next
version. Rounds follow until no tier has enough shards.

A manifest is a small file that lists parts; a part lists up to ``PART_SHARDS`` shards and never changes, so a commit
writes the parts that differ and names the others again. A commit writes the manifest under a temporary name and renames
it to its version's name without overwriting: a reader sees a version whole or not at all, and of two writers of one
version one fails, reads the newer version and tries again with the shards it has written. The rename must be atomic and
must refuse to overwrite: HDFS and local or mounted POSIX file systems do so; plain object stores don't, and need a
committer or a lock beside this. Readers take the shards of one manifest, so shards of running or failed jobs are never
seen. ``expire`` deletes old versions, the shards that they alone list, and shards of failed jobs that no version lists.

DataFrame functions only; the driver handles file names and sizes (a row for each shard), never rows of data. All
columns and all rows are kept as they are, whatever their names: nulls, repeats, empty and very long texts included; an
empty table commits a manifest whose shards hold no rows.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FAN_IN = 4
TARGET_BYTES = 64 << 20
LEAST_TIER = 1 << 16  # bytes up to which, times the fan-in, shards are of the lowest tier
PART_SHARDS = 10_000
ARRIVALS = 8
ARRIVAL_ROWS = 2_048  # in a shard of the query's arrivals: a few MB at a few KB a row, whatever the size of the input's partitions
ORPHAN_MS = 24 * 3600 * 1000
TRIES = 20


@dataclass(frozen=True)
class Shard:
    path: str
    size: int
    tier: int


class ShardStore:
    """A folder of shards and manifests, reached by Hadoop's file system API."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        self._jvm = spark._jvm
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _listed(self, folder: str) -> list:
        path = self._path(folder)
        return list(self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _put(self, path: str, value: dict | list) -> None:
        out = self._fs.create(self._path(path), False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def _get(self, path: str):
        stream = self._fs.open(self._path(path))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    # --- manifests

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._listed(f"{self.root}/manifests")]
        return sorted(int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit())

    def _body(self, version: int) -> dict:
        return self._get(self._manifest(version)) if version else {"version": 0, "schema": None, "parts": []}

    def load(self, version: int | None = None) -> tuple[int, list[Shard], str | None]:
        """(version, shards, schema) of the version, the latest by default; version 0 is the empty store."""
        version = max(self.versions(), default=0) if version is None else version
        body = self._body(version)
        return version, [Shard(**s) for p in body["parts"] for s in self._get(f"{self.root}/parts/{p}")], body["schema"]

    def commit(self, version: int, shards: list[Shard], schema: str) -> None:
        """Make the version visible at once; fails if it exists already. Parts of the version before are named again where all their shards stay."""
        body = self._body(version - 1) if version - 1 in self.versions() else self._body(0)
        wanted, parts = set(shards), []
        for p in body["parts"]:
            held = [Shard(**s) for s in self._get(f"{self.root}/parts/{p}")]
            if wanted.issuperset(held):
                parts.append(p)
                wanted.difference_update(held)
        left = [s for s in shards if s in wanted]
        for i in range(0, len(left), PART_SHARDS):
            parts.append(f"{uuid.uuid4().hex}.json")
            self._put(f"{self.root}/parts/{parts[-1]}", [asdict(s) for s in left[i : i + PART_SHARDS]])
        temp = f"{self.root}/manifests/.{uuid.uuid4().hex}.tmp"
        self._put(temp, {"version": version, "schema": schema, "parts": parts})
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(temp), self._path(self._manifest(version)), options)
        except Exception:
            self._fs.delete(self._path(temp), False)
            raise

    def _add(self, new: list[Shard], schema: str) -> int:
        """Commit new shards after the latest version; a writer that was faster costs another try, not the shards."""
        for _ in range(TRIES):
            version, shards, _ = self.load()
            try:
                self.commit(version + 1, shards + new, schema)
                return version + 1
            except Py4JJavaError:
                if max(self.versions(), default=0) <= version:
                    raise  # not a lost race
        raise RuntimeError("other writers were faster each time")

    # --- shards

    def tier(self, size: int) -> int:
        """The number of times a least shard grows by the fan-in."""
        t, edge = 0, LEAST_TIER
        while size >= edge * self.fan_in:
            t, edge = t + 1, edge * self.fan_in
        return t

    def _shards(self, folder: str) -> list[Shard]:
        found = [(s.getPath().toString(), s.getLen()) for s in self._listed(folder)]
        return [Shard(p, n, self.tier(n)) for p, n in sorted(found) if p.endswith(".parquet")]

    def _write(self, df: DataFrame, rows: int = 0) -> list[Shard]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(folder)
        return self._shards(folder)

    def append(self, df: DataFrame, rows: int = 0) -> int:
        """Add df as shards of at most so many rows (0: one for each input partition); returns the new version."""
        return self._add(self._write(df, rows), df.schema.json())

    def append_arrivals(self, df: DataFrame, arrival: Column, n: int, rows: int = 0) -> int:
        """Add df as n arrivals (arrival: a number from 0 to n-1 for each row), each a version of its own; one job writes the shards of all."""
        folder, name = f"{self.root}/data/{uuid.uuid4().hex}", f"arrival_{uuid.uuid4().hex}"
        df.withColumn(name, arrival.cast("int")).write.option("compression", "zstd").option("maxRecordsPerFile", rows).partitionBy(name).parquet(folder)
        version, _, _ = self.load()
        for i in range(n):
            new = self._shards(f"{folder}/{name}={i}")
            if new or (i == n - 1 and not version):
                version = self._add(new, df.schema.json())
        return version

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Groups to merge: neighbours in size within a tier, filled up to the target size."""
        groups: list[list[Shard]] = []
        small = [s for s in shards if s.size * 2 <= self.target]
        for tier in sorted({s.tier for s in small}):
            run: list[Shard] = []
            size = 0
            for s in sorted((s for s in small if s.tier == tier), key=lambda s: (s.size, s.path)):
                if run and size + s.size > self.target:
                    groups.append(run)
                    run, size = [], 0
                run.append(s)
                size += s.size
            groups.append(run)
        return [g for g in groups if len(g) >= self.fan_in or (len(g) > 1 and sum(s.size for s in g) * 2 > self.target)]

    def merge(self, groups: list[list[Shard]], schema: str) -> list[Shard]:
        """Each group's rows as one shard. Rows go to the task of their group; file names, a row for each shard, are broadcast."""
        names = [(s.path.rsplit("/data/", 1)[1], i) for i, g in enumerate(groups) for s in g]
        table = self.spark.createDataFrame(names, "name string, dealt int")
        rows = self._read([s.path for g in groups for s in g], schema)
        inner = F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row")
        named = rows.select(inner, F.substring_index(F.col("_metadata.file_path"), "/data/", -1).alias("name"))
        dealt = named.join(F.broadcast(table), "name").repartitionById(len(groups), F.col("dealt"))
        return self._write(dealt.select(*(F.col(f"row.`{c}`").alias(c) for c in rows.columns)))

    def compact(self) -> int:
        """Merge until no tier has enough shards, or a round leaves as many as there were; returns the latest version.

        A version that another writer commits meanwhile is kept: its shards stay, and only those merged here are replaced.
        """
        while True:
            version, shards, schema = self.load()
            groups = self.plan(shards)
            if not groups:
                return version
            merged = self.merge(groups, schema)
            gone = {s.path for g in groups for s in g}
            for _ in range(TRIES):
                try:
                    self.commit(version + 1, [s for s in shards if s.path not in gone] + merged, schema)
                    break
                except Py4JJavaError:
                    before = version
                    version, shards, _ = self.load()
                    if version <= before or not gone <= {s.path for s in shards}:
                        raise  # not a lost race, or another compaction replaced the same shards
            if len(merged) >= len(gone):
                return version + 1

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        _, shards, schema = self.load(version)
        if schema is None:
            raise ValueError("the store is empty")
        if not shards:
            return self.spark.createDataFrame([], StructType.fromJson(json.loads(schema)))
        return self._read([s.path for s in shards], schema)

    def expire(self, keep_from: int, orphan_ms: int = ORPHAN_MS) -> int:
        """Delete manifests before keep_from, and shards and parts that no manifest from there on lists; returns shards deleted.

        Shards that no manifest lists at all are those of failed or of running jobs: they go when they are older than orphan_ms.
        """
        versions = self.versions()
        live_parts = {p for v in versions if v >= keep_from for p in self._body(v)["parts"]}
        old_parts = {p for v in versions if v < keep_from for p in self._body(v)["parts"]} - live_parts
        live = {s["path"] for p in live_parts for s in self._get(f"{self.root}/parts/{p}")}
        dead = {s["path"] for p in old_parts for s in self._get(f"{self.root}/parts/{p}")} - live
        now = int(self._jvm.System.currentTimeMillis())
        folders = self._listed(f"{self.root}/data")
        files = [f for d in folders for x in self._listed(d.getPath().toString()) for f in (self._listed(x.getPath().toString()) if x.isDirectory() else [x])]
        dead |= {f.getPath().toString() for f in files if f.getPath().toString().endswith(".parquet") and now - f.getModificationTime() > orphan_ms} - live
        for p in dead:
            self._fs.delete(self._path(p), False)
        for v in versions:
            if v < keep_from:
                self._fs.delete(self._path(self._manifest(v)), False)
        for p in old_parts:
            self._fs.delete(self._path(f"{self.root}/parts/{p}"), False)
        return len(dead)


def compacted(docs: DataFrame, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, rows: int = ARRIVAL_ROWS, arrivals: int = ARRIVALS) -> tuple[ShardStore, DataFrame, dict]:
    """Append docs to a new store as small arrivals (by id, null as 0), compact, drop what older versions alone need, and read the latest version.

    Also tells what happened: the version after the arrivals and after compaction, and shards by tier before and after.
    """
    store = ShardStore(docs.sparkSession, root, target_bytes, fan_in)
    first = store.append_arrivals(docs, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(arrivals)), arrivals, rows)
    tiers = lambda: dict(Counter(s.tier for s in store.load()[1]))
    before, last = tiers(), store.compact()
    told = {"arrivals": first, "version": last, "before": before, "after": tiers()}
    store.expire(last)
    return store, store.read(), told


def digests(rows: DataFrame) -> DataFrame:
    """Per row: its columns but text, and the SHA-256 of its text."""
    return rows.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256)).drop("text")
