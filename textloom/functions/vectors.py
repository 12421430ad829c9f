"""Vectors as arrays: dot products and cosines, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import ColumnLike, col


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: ColumnLike) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: ColumnLike, b: ColumnLike) -> Column:
    d = norm(a) * norm(b)
    return F.when(d > 0, dot(a, b) / d).otherwise(0.0)
