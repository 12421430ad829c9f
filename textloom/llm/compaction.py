"""Sharding by size-tiered compaction, with DataFrame operations only.

A table is a folder: ``data/`` holds immutable Parquet shards, ``manifests/v<n>`` the versions. A version is the list of its shards
(path, bytes, rows, tier). An arrival is written by the tasks that hold it, one small shard a task, without a shuffle, and becomes
visible when its manifest is committed: the manifest is written beside and renamed to its final name, which fails if another writer has
taken that number; then the commit is tried again on top of the newer version.

Compaction puts shards into tiers by size (tier t: ``MIN_BYTES * RATIO^t`` and more). A tier of at least ``MIN_RUN`` shards is merged: its
shards are packed into runs of up to ``target_bytes``, and each run is read by one task, which writes one file, again without a shuffle.
Shards of half the target or more are left alone. Readers of an older version keep their files until ``vacuum``, which also removes what
failed commits and lost compactions have left, once it is older than ``GRACE_MS``.

A manifest's commit needs a file system with an atomic rename that does not replace (HDFS, local disks); one that merely copies, as object
stores do, needs a lock around ``_commit``.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import hadoop_path

TARGET_BYTES = 128 << 20
MIN_BYTES = 64 << 10
RATIO = 4
MIN_RUN = 4
GRACE_MS = 24 * 3600 * 1000
MANIFEST = "path string, bytes long, rows long, tier int"


def tier_of(size: int) -> int:
    t, top = 0, MIN_BYTES * RATIO
    while size >= top:
        t, top = t + 1, top * RATIO
    return t


class ShardedTable:
    """Appends, compaction and reads of one sharded table. The driver handles manifests only: one entry a shard.

    Rows are stored as they are: null, empty and very long values, repeated rows (each stays) and columns of any name; their order is not kept.
    """

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES):
        self.spark, self.path, self.target = spark, path.rstrip("/"), target_bytes

    def versions(self) -> list[int]:
        fs, p = hadoop_path(self.spark, f"{self.path}/manifests")
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(p) if s.getPath().getName()[:1] == "v") if fs.exists(p) else []

    def manifest(self, version: int | None = None) -> list[dict]:
        """The shards of a version, the latest by default; an empty table has none."""
        version = version if version is not None else max(self.versions(), default=0)
        return [r.asDict() for r in self.spark.read.schema(MANIFEST).json(f"{self.path}/manifests/v{version}").orderBy("path").collect()] if version else []

    def _commit(self, change) -> int:
        """Write ``change(latest shards)`` as the next version by an atomic rename; on a lost race, again on the newer version."""
        jvm, tmp = self.spark._jvm, f"{self.path}/manifests/_{uuid.uuid4().hex}"
        fs = hadoop_path(self.spark, self.path)[0]
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        while True:
            version = max(self.versions(), default=0) + 1
            shards = change(self.manifest(version - 1))
            self.spark.createDataFrame([(s["path"], s["bytes"], s["rows"], s["tier"]) for s in shards], MANIFEST).coalesce(1).write.mode("overwrite").json(tmp)
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(hadoop_path(self.spark, tmp)[1].toUri(), self.spark._jsc.hadoopConfiguration())
            try:
                if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/v{version}")):
                    continue
                context.rename(jvm.org.apache.hadoop.fs.Path(tmp), jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/v{version}"), none)
                return version
            except Py4JJavaError as e:
                # another writer has taken the number meanwhile: whatever a file system calls that, its manifest is there now
                if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/v{version}")):
                    fs.delete(jvm.org.apache.hadoop.fs.Path(tmp), True)
                    raise e

    def _shards(self, folder: str, schema) -> list[dict]:
        """The shards that a write has left in a folder, with their sizes and rows."""
        fs, p = hadoop_path(self.spark, folder)
        sizes, found = {}, fs.listFiles(p, True)
        while found.hasNext():
            s = found.next()
            if s.getPath().getName().startswith("part-"):
                sizes[s.getPath().toString()] = s.getLen()
        if not sizes:
            return []
        name = lambda x: x.split(":", 1)[-1].lstrip("/")
        counts = {name(r["f"]): r["n"] for r in self.spark.read.schema(schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()}
        return [{"path": f, "bytes": b, "rows": counts.get(name(f), 0), "tier": tier_of(b)} for f, b in sorted(sizes.items())]

    def append(self, rows: DataFrame) -> int:
        """Add an arrival as small shards; returns the new version. An empty arrival makes a version without new shards."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(folder)
        new = [s for s in self._shards(folder, rows.schema) if s["rows"]]
        return self._commit(lambda old: old + new)

    def append_each(self, rows: DataFrame, by: str, arrivals: int) -> list[int]:
        """Add the arrivals 0 .. ``arrivals`` - 1, told apart by the int column ``by``, in one pass: a version each."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").partitionBy(by).parquet(folder)
        new = [s for s in self._shards(folder, rows.drop(by).schema) if s["rows"]]
        return [self._commit(lambda old, i=i: old + [s for s in new if f"/{by}={i}/" in s["path"]]) for i in range(arrivals)]

    def compact(self, schema) -> int:
        """Merge every tier with enough shards; returns the version committed (the latest one if there was nothing to merge)."""
        tiers: dict[int, list[dict]] = {}
        for s in self.manifest():
            if s["bytes"] < self.target // 2:
                tiers.setdefault(s["tier"], []).append(s)
        gone, new = set(), []
        keys = {"spark.sql.files.maxPartitionBytes": str(self.target), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
        before = {k: self.spark.conf.get(k, None) for k in keys}
        for k, v in keys.items():
            self.spark.conf.set(k, v)
        try:
            for _, shards in sorted(tiers.items()):
                if len(shards) >= MIN_RUN:
                    folder = f"{self.path}/data/{uuid.uuid4().hex}"
                    self.spark.read.schema(schema).parquet(*[s["path"] for s in shards]).write.option("compression", "zstd").parquet(folder)
                    new += [s for s in self._shards(folder, schema) if s["rows"]]
                    gone |= {s["path"] for s in shards}
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        if not gone:
            return max(self.versions(), default=0)

        def change(old: list[dict]) -> list[dict]:
            if gone - {s["path"] for s in old}:
                raise RuntimeError("another compaction has replaced the shards that this one read")
            return [s for s in old if s["path"] not in gone] + new

        return self._commit(change)

    def vacuum(self, keep: int = 1, grace_ms: int = GRACE_MS) -> int:
        """Delete the shards that none of the last ``keep`` versions lists, and folders that no commit has listed for ``grace_ms``; returns how many shards."""
        versions = self.versions()
        live = {s["path"] for v in versions[-keep:] for s in self.manifest(v)}
        dead = {s["path"] for v in versions[:-keep] for s in self.manifest(v)} - live
        for v in versions[:-keep]:
            fs, p = hadoop_path(self.spark, f"{self.path}/manifests/v{v}")
            fs.delete(p, True)
        for f in dead:
            fs, p = hadoop_path(self.spark, f)
            fs.delete(p, False)
        old = int(time.time() * 1000) - grace_ms
        for folder, name in (("manifests", lambda p: p.getName().startswith("_")), ("data", lambda p: not any(f"/{p.getName()}/" in x for x in live))):
            fs, p = hadoop_path(self.spark, f"{self.path}/{folder}")
            for s in fs.listStatus(p) if fs.exists(p) else []:
                if name(s.getPath()) and s.getModificationTime() < old:
                    fs.delete(s.getPath(), True)
        return len(dead)

    def read(self, schema, version: int | None = None) -> DataFrame:
        """All rows of a version, exactly its shards'."""
        paths = [s["path"] for s in self.manifest(version)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def spread_arrivals(docs: DataFrame, arrivals: int, by: str) -> DataFrame:
    """Rows with the number of the arrival that they come with in a new column ``by``, by their id (null: 0); rows of one id come together."""
    if by in docs.columns:
        raise ValueError(f"the rows have a column {by!r} of their own")
    return docs.withColumn(by, F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(arrivals)), F.lit(0)).cast("int"))
