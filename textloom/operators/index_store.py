"""Key-based corpus maintenance: replace by id, purge by prefix, and versioned overwrites that never touch the folder being read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``: applying it twice equals applying it once."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def purge_prefix(old: DataFrame, new: DataFrame, key: str, prefix: str) -> DataFrame:
    """``old`` without the keys that start with ``prefix``, and ``new``."""
    return old.filter(~F.coalesce(F.col(key).startswith(prefix), F.lit(False))).unionByName(new, allowMissingColumns=True)


def seed_chunks(found: DataFrame, seeds: DataFrame, curated: DataFrame) -> DataFrame:
    """Chunks of each seed: those found; the curated ones where none was found or where the seed always adds them.

    ``found`` and ``curated`` have label; ``seeds`` has label and always_add_fallback.
    """
    bare = seeds.join(found.select("label").distinct(), "label", "left_anti").select("label")
    always = seeds.filter("always_add_fallback").select("label")
    return found.unionByName(curated.join(bare.unionByName(always).distinct(), "label", "left_semi"), allowMissingColumns=True)


def seed_summary(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(label, pages, chunks)."""
    return (
        pages.groupBy("label").agg(F.count(F.lit(1)).alias("pages"))
        .join(chunks.groupBy("label").agg(F.count(F.lit(1)).alias("chunks")), "label", "full_outer")
        .select("label", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
    )


class CorpusStore:
    """A table of chunks in a folder of versions ``v<n>``; readers use the latest complete one (with its _SUCCESS mark).

    A version is whole, or a change to the ones before it: only the rows that arrive, and one row that names the key, and the prefix that goes. An upsert
    writes a change, so its files are in proportion to what arrives; ``read`` merges the changes since the last whole version, by a join with the keys that they hold, and
    ``fold`` (after ``FOLD_AFTER`` changes by itself) writes a whole version of that.
    A version is written aside and then renamed to its name. Of two writers of one version the later one finds the name taken and goes on to the next, so neither is lost.
    """

    #: Changes after which an upsert folds them.
    FOLD_AFTER = 8
    #: Bytes of files for each part of a merge.
    PART_BYTES = 16 << 20

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, p: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [n for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(self._fs(f"{self.path}/{n}/_SUCCESS")[1])]
        return sorted(int(n[1:]) for n in done)

    def _is_change(self, version: int) -> bool:
        fs, p = self._fs(f"{self.path}/v{version}/_change")
        return fs.exists(p)

    def _since_whole(self, version: int | None) -> list[int]:
        """The last whole version up to ``version``, or to the latest, and the changes after it."""
        out = []
        for v in reversed([v for v in self.versions() if version is None or v <= version]):
            out.append(v)
            if not self._is_change(v):
                return out[::-1]
        raise FileNotFoundError(f"{self.path} has no version {'' if version is None else version}")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, or of the latest: of each key those of its last arrival, without those whose prefix has gone since."""
        whole, *changes = self._since_whole(version)
        rows = self.spark.read.parquet(f"{self.path}/v{whole}")
        if not changes:
            return rows
        each = {v: self.spark.read.parquet(f"{self.path}/v{v}") for v in changes}
        # a mark is one row a change
        marks = [(v, *each[v].filter("__mark").select("__key", "__purge").first()) for v in changes]
        key, came = marks[0][1], None
        all_ = rows.withColumn("__v", F.lit(whole))
        for v, _, purge in marks:
            new = each[v].filter("NOT __mark").drop("__mark", "__key", "__purge").withColumn("__v", F.lit(v))
            if purge is not None:
                all_ = all_.filter(~F.coalesce(F.col(key).startswith(purge), F.lit(False)))
            else:
                keys = new.select(F.col(key).alias("__k"), F.lit(v).alias("__at")).distinct()
                came = keys if came is None else came.unionByName(keys)
            all_ = all_.unionByName(new, allowMissingColumns=True)
        if came is not None:
            last = came.groupBy("__k").agg(F.max("__at").alias("__at"))
            parts = self._parts([whole, *changes])
            if parts > int(self.spark.conf.get("spark.sql.shuffle.partitions")):
                # both sides dealt by key into as many parts as the files ask for, so a task's share does not grow with the store
                all_, last = all_.repartition(parts, key), last.repartition(parts, "__k")
            all_ = all_.join(last, F.col(key) == F.col("__k"), "left").filter("__at IS NULL OR __v >= __at").drop("__k", "__at")
        return all_.drop("__v")

    def _parts(self, versions: list[int]) -> int:
        """Parts of about ``PART_BYTES`` of these versions' files."""
        sizes = []
        for v in versions:
            fs, p = self._fs(f"{self.path}/v{v}")
            sizes.append(fs.getContentSummary(p).getLength())
        return -(-sum(sizes) // self.PART_BYTES)

    def fold(self) -> int:
        """Write the latest rows as a whole version; again on top of what another writer has put there meanwhile."""
        while True:
            base = max(self.versions())
            aside = self._aside(self.read(base))
            if self._commit(aside, base + 1):
                return base + 1
            fs, p = self._fs(aside)
            fs.delete(p, True)

    def _commit(self, aside: str, version: int) -> bool:
        """Rename a written folder to a version's name; False, with the folder still aside, if the name was taken."""
        fs, new = self._fs(aside)
        at = self._fs(f"{self.path}/v{version}")[1]
        if fs.exists(at):
            return False
        renamed = fs.rename(new, at)
        # renaming onto a folder that has just come moves into it
        inside = self._fs(f"{self.path}/v{version}/{new.getName()}")[1]
        if fs.exists(inside):
            fs.rename(inside, new)
            return False
        if not renamed and fs.exists(new) and not fs.exists(at):
            raise OSError(f"{aside} could not be renamed to {at}")
        return bool(renamed)

    def _aside(self, rows: DataFrame, by: list[str] | None = None) -> str:
        aside = f"{self.path}/_{uuid.uuid4().hex}"
        rows.write.partitionBy(*(by or [])).parquet(aside)
        return aside

    def rebuild(self, rows: DataFrame, by: list[str] | None = None) -> int:
        """Write all rows as the next version, partitioned by the columns ``by``."""
        aside = self._aside(rows, by)
        version = max(self.versions(), default=0) + 1
        while not self._commit(aside, version):
            version += 1
        return version

    def upsert(self, new: DataFrame, key: str, purge: str | None = None) -> int:
        """Replace by key, or by the key prefix ``purge``, as the next version, of which only ``new`` is written; a store is changed by one key throughout."""
        if not self.versions():
            return self.rebuild(new)
        kinds = {"__mark": F.lit(False), "__key": F.lit(None).cast("string"), "__purge": F.lit(None).cast("string")}
        mark = self.spark.createDataFrame([(True, key, purge)], "__mark boolean, __key string, __purge string")
        aside = self._aside(new.withColumns(kinds).unionByName(mark, allowMissingColumns=True))
        fs, p = self._fs(f"{aside}/_change")
        fs.create(p).close()
        version = max(self.versions()) + 1
        while not self._commit(aside, version):  # a change holds on top of any version
            version += 1
        if len(self._since_whole(version)) > self.FOLD_AFTER:
            return self.fold()
        return version

    def count(self) -> int:
        """Rows of the latest version (of a whole one from the files' footers); 0 without one."""
        return self.read().count() if self.versions() else 0


def with_chunk_id(rows: DataFrame, prefix: str, *parts: Column) -> DataFrame:
    """A deterministic chunk_id ``prefix::part::part``."""
    return rows.withColumn("chunk_id", F.concat_ws("::", F.lit(prefix), *parts))
