"""The sliding-window limiter over sessions too large for one task: blocks of events, each judged from the calls that are live when it begins.

The live calls at the end of a block (at most ``limit`` times) are all that the next one needs. Most blocks tell them without their
predecessor: an event is admitted for sure if the event ``limit`` places before it is out of its window, and where every event of a window
is, the live calls are those events. Only blocks that are crowded throughout wait for the block before them; they are worked off in layers,
one block of every session at a time, and a layer reads its own blocks alone. Then all blocks are judged at once.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.scratch import bounded_batches, materialize, numbered, shared_path


def walk(times: np.ndarray, live, window: int, limit: int) -> tuple[list[int], list[int]]:
    """(places admitted, calls live after the last event); over-full stretches are skipped by binary search, so the steps are those of admitted calls."""
    live, out, i = deque(live), [], 0
    while limit > 0 and i < len(times):
        t = int(times[i])
        while live and t - live[0] > window:
            live.popleft()
        if len(live) < limit:
            out.append(i)
            live.append(t)
            i += 1
        else:
            i += int(np.searchsorted(times[i:], live[0] + window, side="right"))
    return out, list(live)


def known_live(times: np.ndarray, window: int, limit: int) -> list[int] | None:
    """Calls live at the end of a block whatever came before it, or None if that depends on it."""
    if limit <= 0:
        return []
    crowded = np.ones(len(times), dtype=bool)  # the block alone cannot tell for its first events
    crowded[limit:] = times[limit:] - times[:-limit] <= window
    last = np.maximum.accumulate(np.where(crowded, np.arange(len(times)), 0))
    free = np.flatnonzero(times[1:] - times[last[:-1]] > window) + 1
    if not len(free):
        return None
    at = int(free[-1])
    begin = int(np.searchsorted(times, times[at] - window, side="left"))
    return walk(times[at:], times[begin:at].tolist(), window, limit)[1]


def limited(events: DataFrame, window_us: int, limit: int, block: int) -> DataFrame:
    """(k, id, limited) for (k, us, id) rows: sorted by range, cut into blocks of at most ``block`` events of a session, judged block by block."""
    spark = events.sparkSession
    bounded_batches(spark)  # a block is one row

    @F.pandas_udf("array<bigint>")
    def known(n: pd.Series, times: pd.Series) -> pd.Series:
        return pd.Series([walk(t, (), window_us, limit)[1] if b == 0 else known_live(t, window_us, limit) for b, t in zip(n, times, strict=True)])

    @F.pandas_udf("array<bigint>")
    def after(times: pd.Series, live: pd.Series) -> pd.Series:
        return pd.Series([walk(t, x.tolist(), window_us, limit)[1] for t, x in zip(times, live, strict=True)])

    @F.pandas_udf("array<boolean>")
    def judge(times: pd.Series, live: pd.Series) -> pd.Series:
        out = []
        for t, x in zip(times, live, strict=True):
            over = np.ones(len(t), dtype=bool)
            over[walk(t, () if x is None else x.tolist(), window_us, limit)[0]] = False
            out.append(over)
        return pd.Series(out)

    placed = numbered(events, [F.col("k"), F.col("us"), F.col("id")], "place")
    first = placed.groupBy("k").agg(F.min("place").alias("first"))
    cut = placed.join(first, "k").withColumn("n", F.floor((F.col("place") - F.col("first")) / block))
    rows = cut.groupBy("k", "n").agg(F.array_sort(F.collect_list(F.struct("us", "id"))).alias("es"))
    times = F.transform("es", lambda e: e["us"])
    blocks = materialize(rows.withColumn("live", known("n", times)), "blocks")

    back = Window.partitionBy("k").orderBy("n")  # one row a block
    depth = F.col("n") - F.max(F.when(F.col("live").isNotNull(), F.col("n"))).over(back)
    ends = blocks.select("k", "n", "live")
    waiting = materialize(ends.select("k", "n", depth.alias("depth")).filter("depth > 0"), "waiting")
    layers = waiting.agg(F.max("depth")).first()[0] or 0
    done = level = ends.filter("live IS NOT NULL")
    if layers:
        path = shared_path(spark, "layers")
        blocks.select("k", "n", times.alias("times")).join(waiting, ["k", "n"]).write.partitionBy("depth").parquet(path)
        for d in range(1, layers + 1):
            own = spark.read.parquet(path).filter(F.col("depth") == d).drop("depth")
            level = materialize(own.join(level.withColumn("n", F.col("n") + 1), ["k", "n"]).select("k", "n", after("times", "live").alias("live")), "layer")
            done = done.unionByName(level)
    begun = done.select("k", (F.col("n") + 1).alias("n"), F.col("live").alias("begin"))
    judged = blocks.select("k", "n", "es").join(begun, ["k", "n"], "left").withColumn("over", judge(times, F.col("begin")))
    return judged.select("k", F.explode(F.arrays_zip(F.transform("es", lambda e: e["id"]).alias("id"), F.col("over").alias("over"))).alias("z")).select("k", F.col("z.id").alias("id"), F.col("z.over").alias("limited"))
