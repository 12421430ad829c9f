"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets: each source's share of all words by weight, none above ``MAX_REPEAT`` times its own words (the excess is dealt again by weight).
Equal blocks of ``BLOCK_WORDS`` words are the seats. Seats go to sources, and each source's seats to its shards, by the highest
quotients v / (2 s + 1); the quotas are integers. A shard's documents lie on a line in an order drawn from a seed; the line is taken
whole as often as the quota allows, and its first blocks once more.

Shards hold about ``SHARD_DOCS`` documents, and there are at most ``MAX_SHARDS`` beside one for each source; a hot source is spread over many
tasks. Sources are apportioned on the driver as long as their table has at most ``LOCAL_BYTES``. Beyond that the same targets and seats come
from aggregates over the table: each pass tries ``RATES`` rates at once, and the driver reads sums only. A source's shards, a bounded number,
are apportioned in one task. Plans and quotas are broadcast up to ``LOCAL_BYTES`` too, else joined with large tasks split.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import WORD, materialize, numbered, text_of

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
BLOCK_WORDS = 16
SHARD_DOCS = 1024
MAX_SHARDS = 65536
SEED = 20240607
LOCAL_BYTES = 8 << 20
RATES = 31
PLAN = "src string, shards long, source_size long, target double, seats long"


def targets(sizes: list[int], weights: list[float], total: float, most: float = MAX_REPEAT) -> list[float]:
    """Shares of ``total`` by weight, each at most ``most`` times its size; the excess goes to the rest by weight."""
    out, free = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = float(total)
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by the highest quotients votes / (2 s + 1), ties to the earlier entry; rounding at a common rate gives nearly all, a heap the rest."""
    v = np.asarray(votes, float)
    if seats <= 0 or v.sum() <= 0:
        return [0] * len(votes)
    low, high = 0.0, seats / v.sum() * 2 + 2 / v.max()  # seats a vote: rounding at any such rate is the method's result for its own sum
    for _ in range(200):
        rate = (low + high) / 2
        low, high = (rate, high) if np.floor(v * rate + 0.5).sum() <= seats else (low, rate)
    won = [int(x) for x in np.floor(v * low * (1 - 1e-12) + 0.5)]  # a little less, so that ties are left to the heap
    heap = [(-x / (2 * w + 1), i) for i, (x, w) in enumerate(zip(votes, won, strict=True)) if x > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(won)):
        _, i = heapq.heappop(heap)
        won[i] += 1
        heapq.heappush(heap, (-votes[i] / (2 * won[i] + 1), i))
    return won


def _sized_columns() -> list:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text_of("text"), F.lit(WORD)).cast("long").alias("size")]


def _searched(rows: DataFrame, low: float, high: float, value, most: float) -> float:
    """The largest rate, to the last digits, at which the sum of the Column value(rate), growing with it, is at most ``most``."""
    while high - low > 1e-15 * high:
        rates = [low + (high - low) * k / (RATES + 1) for k in range(1, RATES + 1)]
        sums = rows.agg(*[F.sum(value(r)).alias(f"s{k}") for k, r in enumerate(rates)]).first()
        fit = sum(x <= most for x in sums)
        low, high = ([low, *rates][fit], [*rates, high][fit])
    return low


def _plan_spread(sources: DataFrame, per_shard: int, weights: tuple, total: float, block_words: int) -> DataFrame:
    """``PLAN`` from the table of sources, by aggregates."""
    s = numbered(sources, [F.col("source").asc_nulls_last()], "i")
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int")))
    cap, live = MAX_REPEAT * F.col("words"), s.filter("words > 0")
    top, caps = live.agg(F.max(cap / F.col("weight")), F.sum(cap)).first()
    if not caps or total >= caps:
        want, given = cap.cast("double"), float(caps or 0)
    else:
        rate = _searched(live, 0.0, top * 2, lambda r: F.least(cap.cast("double"), r * F.col("weight")), total)
        full = cap / F.col("weight") <= rate * (1 + 1e-12)
        taken, free = live.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        want = F.when(full, cap.cast("double")).otherwise(F.col("weight") * ((total - (taken or 0)) / (free or 1.0)))
        given = total
    s = materialize(s.withColumn("target", F.when(F.col("words") > 0, want).otherwise(0.0)), "targets")
    seats, most = round(given / block_words), s.agg(F.max("target")).first()[0]
    won = lambda r: F.floor(F.col("target") * r + 0.5)
    rate = _searched(s, 0.0, seats / given * 2 + 2 / most, won, seats) if seats else 0.0
    s = s.withColumn("won", won(rate * (1 - 1e-12)).cast("long"))
    left = seats - (s.agg(F.sum("won")).first()[0] or 0)
    s = numbered(s, [(F.col("target") / (2 * F.col("won") + 1)).desc(), F.col("i")], "k")
    one = ((F.col("k") < left) & (F.col("target") > 0)).cast("long")
    return materialize(s.select(F.col("source").alias("src"), F.ceil(F.col("n") / per_shard).alias("shards"), F.col("words").alias("source_size"), "target", (F.col("won") + one).alias("seats")), "plan")


def _plan_local(sources: DataFrame, per_shard: int, weights: tuple, total: float, block_words: int) -> DataFrame:
    """``PLAN`` on the driver, from at most ``LOCAL_BYTES``."""
    rows = sorted(sources.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    want = targets([r["words"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], total)
    seats = sainte_lague(want, round(min(total, MAX_REPEAT * sum(r["words"] for r in rows)) / block_words))
    return sources.sparkSession.createDataFrame([(r["source"], -(-r["n"] // per_shard), r["words"], t, n) for r, t, n in zip(rows, want, seats, strict=True)], PLAN)


def _small(rows: DataFrame, key: str) -> DataFrame:
    """A side to join, broadcast if it has at most ``LOCAL_BYTES``."""
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length(key))).first()
    return F.broadcast(rows) if 64 * n + (size or 0) <= LOCAL_BYTES else rows


def _quotas(block_words: int):
    """applyInPandas over one source's shards (source, shard, words, seats): their quotas in words."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("shard")
        won = sainte_lague(pdf["words"].tolist(), int(pdf["seats"].iloc[0]))
        quota = [min(n * block_words, MAX_REPEAT * w) for n, w in zip(won, pdf["words"].tolist(), strict=True)]
        return pd.DataFrame({"src": pdf["source"].tolist(), "part": pdf["shard"].tolist(), "line": pdf["words"].tolist(), "quota_words": quota})

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, shards, shard, place, quota_words, start, passes, taken.

    ``weights`` repeat over the sources by code point, null last. ``start`` is where the document begins on its shard's line. A null text
    has size 0; a null source is a source of its own; rows alike in id are told apart by size only, in a fixed order. No document takes
    more than ``MAX_REPEAT`` times its size, and reruns agree, whatever the partitioning. Equal quotients go to the earlier source and shard. Other columns
    are not read; an empty table gives no rows.
    """
    rows = materialize(docs.select(*_sized_columns()), "sizes")
    sources = materialize(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "sources")
    kinds, count, words, size = sources.agg(F.count(F.lit(1)), F.sum("n"), F.sum("words"), F.sum(F.octet_length("source"))).first()
    per_shard = max(SHARD_DOCS, -(-(count or 0) // MAX_SHARDS))
    planned = _plan_local if 64 * kinds + (size or 0) <= LOCAL_BYTES else _plan_spread
    plan = planned(sources, per_shard, weights, share * (words or 0), block_words)
    dealt = _dealt(rows, plan, seed)
    lines = dealt.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.max("seats").alias("seats"))
    quota = materialize(lines.groupBy("source").applyInPandas(_quotas(block_words), "src string, part long, line long, quota_words long"), "quotas")
    w = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("start", F.sum("size").over(w) - F.col("size"))
    line = F.greatest("line", F.lit(1))
    rest = F.col("quota_words") % line
    once_more = F.greatest(F.lit(0), F.least("size", rest - F.col("start")))
    passes = ((F.col("quota_words") - rest) / line).cast("long")
    return placed.join(_small(quota, "src"), placed["source"].eqNullSafe(quota["src"]) & (placed["shard"] == quota["part"])).select(
        "doc_id", "source", "size", "source_size", "target", "shards", "shard", "place", "quota_words", "start", passes.alias("passes"), (passes * F.col("size") + once_more).cast("long").alias("taken")
    )


def _dealt(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Rows with their source's plan, their shard, and their place on its line, by hashes of seed, id and size alone."""
    joined = rows.join(_small(plan, "src"), rows["source"].eqNullSafe(plan["src"])).drop("src")
    return joined.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), "shards")).withColumn("place", F.xxhash64(F.lit(seed + 1), "doc_id", "size"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Whole documents in the mix's proportions, all columns kept: each row as often as ``taken / size`` rounds to, at least half a pass counting as one.

    What is taken once more on a shard's line is what lies before a cut, so a shard's passes and cut say everything: documents meet one row
    a shard, in a broadcast as long as that has at most ``LOCAL_BYTES``, and are then never shuffled. Documents of no words go with the passes of their shard.
    """
    rows = mix(docs, **options)
    short = F.col("taken") - F.col("passes") * F.col("size")
    cuts = rows.groupBy("source", "shard").agg(F.max("shards").alias("shards"), F.max("passes").alias("passes"), F.min(F.when((short * 2 < F.col("size")), F.struct("place", "doc_id", "size"))).alias("cut"))
    cuts = materialize(cuts, "cuts")
    plan = materialize(cuts.select(F.col("source").alias("src"), "shards").distinct(), "plan")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_sized_columns())
    own = _dealt(whole, plan, options.get("seed", SEED))
    cuts = cuts.select(F.col("source").alias("src"), F.col("shard").alias("part"), "passes", "cut")
    met = own.join(_small(cuts, "src"), own["source"].eqNullSafe(cuts["src"]) & (own["shard"] == cuts["part"]))
    before = F.col("cut").isNull() | (F.struct("place", "doc_id", "size") < F.col("cut"))
    copies = F.col("passes") + before.cast("long")
    return met.withColumn("copies", copies).filter("copies > 0").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
