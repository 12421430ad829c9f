"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE = threading.local()


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a temporary one only where it is unset and all run on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a string path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_root(spark)}/textloom/{tag}-{uuid.uuid4().hex}"
    fs, p = hadoop_path(spark, path)
    fs.deleteOnExit(p)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, lost executors cost nothing before it."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    mark()
    _MADE.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many tables this thread has materialised, for ``release_since``."""
    _MADE.paths = getattr(_MADE, "paths", [])
    return len(_MADE.paths)


def release_since(spark: SparkSession, began: int, *keep: DataFrame) -> None:
    """Delete the tables that this thread has materialised since ``began`` and that no later plan reads; ``keep`` stay."""
    kept = [f for df in keep for f in df.inputFiles()]
    for path in _MADE.paths[began:]:
        tail = path.rsplit("/", 1)[1]
        if not any(f"/{tail}/" in f for f in kept):
            fs, p = hadoop_path(spark, path)
            fs.delete(p, True)
            _MADE.paths.remove(path)


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound the bytes of an Arrow batch to a Python worker, whatever the length of its rows (a setting of the session)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows``, written, with their place from 0 in a total order in a column ``name``; the driver reads a row a partition."""
    at = "at_" + uuid.uuid4().hex
    kept = materialize(rows.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(at, 33)
    before, starts = 0, []
    for p, n in sorted(tuple(r) for r in kept.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):
        starts += [F.lit(p).cast("long"), F.lit(before).cast("long")]
        before += n
    first = F.create_map(*starts)[part] if starts else F.lit(0)
    return kept.withColumn(name, (first + F.col(at).bitwiseAND((1 << 33) - 1)).cast("long")).drop(at)
