"""Bloom filters of bounded size, built on the executors and broadcast.

A filter has ``BITS_PER_ROW`` bits for each row it is built from and never more than ``MAX_BITS`` (32 MB). It is made of blocks of
``2 ** BLOCK_LOG2`` bits; the two bits of a hash lie in one block. Partitions build their own blocks, a shuffle by block merges them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_PER_ROW = 16
MAX_BITS = 1 << 28
BLOCK_LOG2 = 19


def positions(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u = h.view(np.uint64)
    mask = np.uint64((1 << BLOCK_LOG2) - 1)
    block = (u >> np.uint64(40)) & np.uint64(blocks - 1)
    return block.astype(np.int64), (u & mask).astype(np.int64), ((u >> np.uint64(20)) & mask).astype(np.int64)


def _build(blocks: int):
    """mapInArrow: a partition's hashes into the non-empty blocks of its own filters: seen, and seen again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (1 << BLOCK_LOG2) // 8
        first: dict[int, np.ndarray] = {}
        again: dict[int, np.ndarray] = {}
        get = lambda v, x: (v[x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1

        def put(v: np.ndarray, x: np.ndarray) -> None:
            np.bitwise_or.at(v, x >> 3, np.left_shift(np.uint8(1), (7 - (x & 7)).astype(np.uint8)))

        for batch in batches:
            h, n = np.unique(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
            block, p, q = positions(h, blocks)
            for b in np.unique(block):
                at = block == b
                a, p1, q1 = first.setdefault(int(b), np.zeros(size, np.uint8)), p[at], q[at]
                dup = (n[at] > 1) | (get(a, p1) & get(a, q1)).astype(bool)
                if dup.any():
                    t = again.setdefault(int(b), np.zeros(size, np.uint8))
                    put(t, p1[dup])
                    put(t, q1[dup])
                put(a, p1)
                put(a, q1)
        for b, a in first.items():
            parts = [zlib.compress(x.tobytes(), 1) for x in (a, again.get(b, np.zeros(size, np.uint8)))]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([x], pa.binary()) for x in parts)], ["block", "first", "again"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow after a shuffle by block: the merged filters, in memory bounded by their size."""
    first: dict[int, np.ndarray] = {}
    again: dict[int, np.ndarray] = {}
    size = (1 << BLOCK_LOG2) // 8
    for batch in batches:
        for b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, t = (np.frombuffer(zlib.decompress(z), np.uint8) for z in (x, y))
            a0 = first.get(b, np.zeros(size, np.uint8))
            again[b] = again.get(b, np.zeros(size, np.uint8)) | t | (a0 & a)
            first[b] = a0 | a
    for b, a in first.items():
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (a, again[b]))], ["block", "first", "again"])


def _filter(hashes: DataFrame, rows: int, which: str):
    blocks = 1
    while blocks << BLOCK_LOG2 < min(MAX_BITS, rows * BITS_PER_ROW):
        blocks *= 2
    kind = "block int, first binary, again binary"
    merged = hashes.mapInArrow(_build(blocks), kind).repartition("block").mapInArrow(_merge, kind).select("block", which).collect()  # MAX_BITS / 8 bytes at most
    bits = np.zeros((blocks, (1 << BLOCK_LOG2) // 8), np.uint8)
    for r in merged:
        bits[r["block"]] |= np.frombuffer(bytes(r[which]), np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(bits)


def held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a filter holds 64-bit hashes, as far as it can tell."""
    block, p, q = positions(h, bits.shape[0])
    hit = lambda x: (bits[block, x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1
    return (hit(p) & hit(q)).astype(bool)


def _tester(shared):
    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(held(shared.value, h.to_numpy(np.int64)))

    return maybe


def repeated_filter(hashes: DataFrame, rows: int):
    """A Column function of a 64-bit hash: false only if it occurs at most once in the one-column table ``hashes``."""
    return _tester(_filter(hashes, rows, "again"))


def member_filter(hashes: DataFrame, rows: int):
    """A Column function of a 64-bit hash: false only if it does not occur in the one-column table ``hashes``."""
    return _tester(member_bits(hashes, rows))


def member_bits(hashes: DataFrame, rows: int):
    """The broadcast filter of the one-column table ``hashes``, for ``held`` in functions on batches."""
    return _filter(hashes, rows, "first")
