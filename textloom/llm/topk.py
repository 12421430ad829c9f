"""Exact top-k inner-product search by a three-phase uniform threshold.

Vectors are cut into ``SLICES`` slices of dimensions: each slice is a list of partial scores, and a score is the sum over the lists.
Candidates are packed into blocks once and stay where they are. Queries come in rounds of about ``ROUND_BYTES``, so what is broadcast and what the
driver reads (a cutoff a query) has a proven bound; within a round every task goes over its own blocks.

1. Each task gathers, from the leading ``LEAD``-th part of its blocks, every query's local lists: the best partial scores of each slice. It
   resolves those few entries, and the k-th best score found for a query anywhere is a safe cutoff T, since as many real entries reach it.
2. T is broadcast. An entry that reaches T reaches T / SLICES in one slice at least. Slices are read one after the other; an entry goes as soon as
   no slice can give it that share any more, or the norms of the slices left cannot lift it to T.
3. Once few entries of a block are left (``FEW``), only their remaining partial scores are resolved, exactly, pair by pair. A task
   returns each query's k best at or above T, so what shuffles is in proportion to queries and tasks, not to pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import bounded_batches, materialize, tidied

SLICES = 4
QUERY_BLOCK = 512
CANDIDATE_BLOCK = 4096
LEAD = 8
#: Share of a block's entries below which they are resolved one by one.
FEW = 1 / 32
ROUND_BYTES = 8 << 20
PACKED = "dim int, ids binary, kind string, data binary"
FOUND = "query_id long, vec_id long, score long"


def quantise(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>): floor(256 x). Vectors null, or with a null or non-finite component, and rows without id are left out."""
    x = F.transform(F.col(f"`{vec_col}`"), lambda e: e.cast("double"))
    good = F.col(f"`{vec_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.filter(F.coalesce(good, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * 256)).alias("v"))


def _pack(size: int):
    """mapInArrow: rows (vec_id, dim, v) to blocks of at most ``size`` vectors of one length, in the smallest integers that hold them."""

    def block(dim: int, rows: list) -> pa.RecordBatch:
        data = np.concatenate([r[1] for r in rows])
        kind = next(k for k in ("<i2", "<i4", "<i8") if k == "<i8" or not len(data) or np.iinfo(k).min <= data.min() and data.max() <= np.iinfo(k).max)
        ids = np.array([r[0] for r in rows], np.int64)
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([kind]), pa.array([data.astype(kind).tobytes()], pa.binary())], ["dim", "ids", "kind", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list] = {}
        held = 0
        for batch in batches:
            for i, dim, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                rows = open_.setdefault(dim, [])
                rows.append((i, v.values.to_numpy(zero_copy_only=False).astype(np.int64)))
                held += 1
                if len(rows) >= size:
                    held -= len(rows)
                    yield block(dim, open_.pop(dim))
                elif held >= 4 * size:  # many lengths
                    for d in list(open_):
                        yield block(d, open_.pop(d))
                    held = 0
        for d, rows in open_.items():
            yield block(d, rows)

    return run


def _read(r: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(r["ids"], np.int64)
    return ids, np.frombuffer(r["data"], r["kind"]).astype(np.int64).reshape(len(ids), -1)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T without rounding."""
    most = (int(np.abs(a).max(initial=0)) + 1) * (int(np.abs(b).max(initial=0)) + 1) * max(1, a.shape[1])
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < 1 << 52 else a @ b.T


def _cuts(dim: int) -> list[tuple[int, int]]:
    return [(int(x[0]), int(x[-1]) + 1) for x in np.array_split(np.arange(dim), SLICES) if len(x)] or [(0, 0)]


def _norms(v: np.ndarray) -> np.ndarray:
    """(slices, vectors): lengths of the slices."""
    return np.array([np.sqrt((v[:, lo:hi].astype(np.float64) ** 2).sum(axis=1)) for lo, hi in _cuts(v.shape[1])])


def listed(a: np.ndarray, b: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1: (query, candidate, score) of the ``k`` best entries of each slice's list of each query, its own row aside."""
    hit = np.zeros(own.shape, bool)
    n = min(k + 1, own.shape[1])  # the query itself may be among them
    for lo, hi in _cuts(a.shape[1]):
        np.put_along_axis(hit, np.argpartition(-_exact(a[:, lo:hi], b[:, lo:hi]), n - 1, axis=1)[:, :n], True, axis=1)
    q, c = np.nonzero(hit & ~own)
    return q, c, np.einsum("ij,ij->i", a[q], b[c])


def collected(a: np.ndarray, b: np.ndarray, own: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Phases 2 and 3: (query, candidate, score) of all entries that reach their query's cutoff, and how many partial scores were read."""
    cuts = _cuts(a.shape[1])
    na, nb, t = _norms(a), _norms(b), least.astype(np.float64)[:, None]
    known, hit, read = np.zeros(own.shape, np.int64), np.zeros(own.shape, bool), 0
    for j, (lo, hi) in enumerate(cuts):
        part = _exact(a[:, lo:hi], b[:, lo:hi])
        read += part.size
        known += part
        hit |= part * float(len(cuts)) >= t * (1 - 1e-12 * np.sign(t))
        alive = ~own
        if j + 1 < len(cuts):
            room = (na[j + 1 :].T @ nb[j + 1 :]) * (1 + 1e-9) + 1
            may = hit.copy()
            for s in range(j + 1, len(cuts)):
                may |= (na[s][:, None] * nb[s][None, :] * (1 + 1e-9) + 1) * len(cuts) >= t
            alive &= may & (known + np.abs(known) * 1e-9 + room >= t)
        else:
            alive &= hit & (known >= least[:, None])
        if j + 1 == len(cuts) or alive.mean() < FEW:
            q, c = np.nonzero(alive)
            s = known[q, c]
            for lo2, hi2 in cuts[j + 1 :]:
                s = s + np.einsum("ij,ij->i", a[q, lo2:hi2], b[c, lo2:hi2])
                read += len(q)
            keep = s >= least[q]
            return q[keep], c[keep], s[keep], read
    raise AssertionError("a vector has a slice")


def _best(score: np.ndarray, q: np.ndarray, cand: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best entries of each query, ties to the smaller id."""
    order = np.lexsort((cand, -score, q))
    qs = q[order]
    first = np.r_[True, qs[1:] != qs[:-1]] if len(qs) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(qs)), 0)) if len(qs) else np.zeros(0, int)
    return order[np.arange(len(qs)) - start < k]


def _phase(queries, k: int, cutoffs):
    """mapInArrow over candidate blocks: the k best entries of each broadcast query in this task, by phase 1 or, with cutoffs, by phases 2 and 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [_read(r) for r in queries.value]
        none = np.zeros(0, np.int64)
        best = [(none, none, none) for _ in blocks]
        for batch in batches:
            for r in batch.to_pylist():
                cid, b = _read(r)
                if cutoffs is None:
                    n = max(1, min(len(cid), QUERY_BLOCK), -(-len(cid) // LEAD))
                    cid, b = cid[:n], b[:n]
                for at, (qid, a) in enumerate(blocks):
                    if a.shape[1] != b.shape[1]:
                        continue
                    own = cid[None, :] == qid[:, None]
                    q, c, s = listed(a, b, own, k) if cutoffs is None else collected(a, b, own, cutoffs.value[at])[:3]
                    q, c, s = (np.r_[x, y] for x, y in zip(best[at], (q, cid[c], s), strict=True))
                    top = _best(s, q, c, k)
                    best[at] = q[top], c[top], s[top]
        for (qid, _), (q, c, s) in zip(blocks, best, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (qid[q], c, s)], ["query_id", "vec_id", "score"])

    return tidied(run)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector for which the Column ``is_query`` over ``vec_id`` holds, its k best others.

    Scores are integer inner products of quantised vectors of equal length (an empty vector scores 0 with other empty ones); all others if
    fewer than k; ties to the smaller id. Rows alike in id and length count once, with the smallest vector of them, so a repeated query is answered once and a repeated
    row is one candidate; a row is never its own candidate. An empty table, or one without queries, gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = quantise(vectors, id_col, vec_col).withColumn("dim", F.size("v")).groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    rows = materialize(rows, "vectors")
    cands = materialize(rows.mapInArrow(_pack(CANDIDATE_BLOCK), PACKED), "candidates")
    asked = rows.filter(is_query)
    # counted as written in the widest integers
    rounds = max(1, -(-(asked.agg(F.sum(8 * (F.col("dim") + 1))).first()[0] or 0) // ROUND_BYTES))
    # in order of rounds, so that a round reads its own pages of the table
    dealt = asked.withColumn("round", F.pmod(F.xxhash64("vec_id"), F.lit(rounds)))
    queries = materialize(dealt.repartition("round").sortWithinPartitions("round"), "queries")
    found = None
    for i in range(rounds):
        mine = queries.filter(F.col("round") == i).drop("round")
        blocks = [r.asDict() for r in mine.mapInArrow(_pack(QUERY_BLOCK), PACKED).collect()]  # about ROUND_BYTES
        if not blocks:
            continue
        shared = spark.sparkContext.broadcast(blocks)
        first = cands.mapInArrow(_phase(shared, k, None), FOUND)
        cut = _ranked(first, k).groupBy("query_id").agg(F.min("score").alias("t"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
        least = {r["query_id"]: r["t"] for r in cut.collect()}  # a row a query of the round
        cutoffs = spark.sparkContext.broadcast([np.array([least.get(int(x), -(1 << 60)) for x in np.frombuffer(b["ids"], np.int64)], np.int64) for b in blocks])
        last = materialize(cands.mapInArrow(_phase(shared, k, cutoffs), FOUND), "found")
        found = last if found is None else found.unionByName(last)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    return _ranked(found, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
