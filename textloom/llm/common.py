"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.scratch import bounded_batches, hadoop_path, mark, materialize, numbered, release_since, shared_path, shared_root

__all__ = ["WORD", "bounded_batches", "hadoop_path", "mark", "materialize", "new_name", "numbered", "release_since", "shared_path", "shared_root", "table", "text_of", "tidied"]

#: A word of the contracts: a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def tidied(run, forget=None):
    """A mapInArrow function that gives unused memory back to the system when a task ends: Spark keeps its workers, and they add up."""

    def wrapped(batches):
        import ctypes
        import gc

        import pyarrow as pa

        yield from run(batches)
        if forget is not None:
            forget()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return wrapped


def new_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    while base.lower() in {c.lower() for c in df.columns}:
        base += "_"
    return base


def text_of(col: str | Column) -> Column:
    """The text, an empty string if null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
