"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into windows of ``CHUNK`` code points that reach ``OVERLAP`` further into their successors. Windows are dealt over all
tasks and pre-tokenised from their own starts, so all but the first may begin inside a pre-token. A match of the pattern depends on nothing
before it: where a window and its successor have a boundary in common they agree from there on, so the first common boundary in the overlap
is where the one hands over to the other. Windows without a common boundary (a pre-token longer than the overlap) become one window
and are matched again, until every joint is closed; only positions are compared, and only those of long texts move for it. The pieces between
two joints are then merged by rank and a text's ids put together in order. A text of one window needs no joint and goes straight
through. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import bounded_batches, materialize, new_name, tidied

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
CHUNK, OVERLAP = 1 << 15, 1 << 9
#: Pre-tokens whose ids a worker remembers, and the longest of them.
REMEMBERED, LONGEST_REMEMBERED = 200_000, 64


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """{bytes: rank} from a file of base64 words and ranks that the driver can open."""
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


class Encoder(dict):
    """Packed ids of pre-tokens, each merged by itself by the public library's native code; forgets all when it has many, so that memory is bounded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.core.encode_single_piece(piece.encode())).tobytes()
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids

    def ids(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, pieces))


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str, ranks, pattern: str) -> Encoder:
    """One encoder of a file in each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(ranks.value, pattern)
    return _ENCODERS[path]


def _forget() -> None:
    """At the end of a task: the remembered pre-tokens go if they are many."""
    for e in _ENCODERS.values():
        if len(e) > REMEMBERED // 4:
            e.clear()


def _lists(packed: list[bytes]) -> pa.Array:
    """A column of int32 lists from their bytes."""
    offsets = np.cumsum([0, *map(len, packed)]) // 4
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _fields(df: DataFrame, *more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + list(more))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (row, text): (row, at, till, text), where till is the next window's start or null."""
    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            for at in range(0, len(text), CHUNK):
                till = at + CHUNK if at + CHUNK < len(text) else None
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([at], pa.int64()), pa.array([till], pa.int64()), pa.array([text[at : at + CHUNK + OVERLAP]])], ["row", "at", "till", "text"])


def _matched(pattern: str):
    """mapInArrow over windows: with the ends of their pre-tokens (from ``at``; without the cut end of a window that is not the last), and those in the overlaps as places in the text."""
    find = regex.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                _, at, till, text = (c[0].as_py() for c in one.columns)
                ends = np.array([0] + [m.end() for m in find.finditer(text)], np.int32)
                ends = ends if till is None else ends[ends < len(text)]
                head, tail = ends[ends < OVERLAP] + at, ends[ends >= till - at] + at if till is not None else []
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([ends]), pa.array([head], pa.list_(pa.int64())), pa.array([tail], pa.list_(pa.int64()))], [*one.schema.names, "ends", "head", "tail"])

    return run


def _stitched(windows: DataFrame, pattern: str) -> DataFrame:
    """(row, at, text, ends, since, upto): matched windows, and the places between which each one's pre-tokens count."""
    kinds = "row long, at long, till long, text string, ends array<int>, head array<long>, tail array<long>"
    match = lambda w: materialize(w.repartition("row", "at").mapInArrow(tidied(_matched(pattern)), kinds), "windows")
    known, w = match(windows), Window.partitionBy("row").orderBy("at")
    while True:
        joint = F.array_min(F.array_intersect("tail", F.lead("head").over(w)))
        joints = known.select("row", "at", "till", joint.alias("upto"))
        joints = joints.withColumn("open", F.col("till").isNotNull() & F.col("upto").isNull())
        first = ~F.coalesce(F.lag("open").over(w), F.lit(False))
        joints = joints.withColumn("since", F.coalesce(F.lag("upto").over(w), F.col("at"))).withColumn("first", F.max(F.when(first, F.col("at"))).over(w))
        joints = materialize(joints, "joints")
        whole = known.join(joints.select("row", "at", "since", "upto", "open", "first"), ["row", "at"])
        if not joints.filter("open").limit(1).count():
            return whole.select("row", "at", "text", "ends", "since", "upto")
        alike = F.max("open").over(Window.partitionBy("row", "first"))
        torn = joints.withColumn("torn", alike).filter("torn").select("row", "at", "first")
        parts = known.join(torn, ["row", "at"]).withColumn("part", F.struct("at", "till", "text"))
        one = parts.groupBy("row", F.col("first").alias("at")).agg(F.array_sort(F.collect_list("part")).alias("parts"))
        own = F.transform("parts", lambda p, i: F.when(i == F.size("parts") - 1, p["text"]).otherwise(F.substring(p["text"], F.lit(1), (p["till"] - p["at"]).cast("int"))))
        longer = one.select("row", "at", F.element_at("parts", -1)["till"].alias("till"), F.array_join(own, "").alias("text"))
        known = materialize(known.join(torn, ["row", "at"], "left_anti").unionByName(match(longer)), "windows")


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``docs`` with array<int> ids of the whole text, each match of ``pattern`` merged by itself, no special tokens.

    Null and empty texts give an empty array; repeated rows and null ids stay as they are; a column of that name is replaced, other columns
    are kept whatever they are called. Merges of equal rank go from left to right. An empty table gives no rows. ``pattern`` must match every text
    from end to end and look at nothing before a match. No text is cut short: those of more than a window are encoded in windows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop(ids_col)
    table = spark.sparkContext.broadcast(read_ranks(ranks))
    at, find = docs.columns.index(text_col), regex.compile(pattern)
    text = F.coalesce(F.col(text_col), F.lit(""))

    def straight(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks, table, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = [encoder.ids(find.findall(t)) if t else b"" for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(got)], [*part.schema.names, ids_col])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks, table, pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                row, start, t, ends, since, upto = (c[i].as_py() for c in batch.columns)
                cuts = [e for e in ends if e >= since - start and (upto is None or e <= upto - start)]
                got = encoder.ids([t[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([start], pa.int64()), _lists([got])], ["row", "at", "ids"])

    short = docs.filter(F.length(text) <= CHUNK).mapInArrow(tidied(straight, _forget), _fields(docs, f"`{ids_col}` array<int>"))
    row = new_name(docs, "row")
    long = materialize(docs.filter(F.length(text) > CHUNK).withColumn(row, F.monotonically_increasing_id()), "long")
    windows = long.select(F.col(row).alias("row"), text.alias("text")).mapInArrow(tidied(_windows), "row long, at long, till long, text string")
    coded = _stitched(windows, pattern).mapInArrow(tidied(pieces, _forget), "row long, at long, ids array<int>")
    whole = coded.groupBy(F.col("row").alias(row)).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda p: p["ids"])).alias(ids_col))
    return short.unionByName(long.join(whole, row).select(*[F.col(f"`{c}`") for c in docs.columns], ids_col))


def decode(rows: DataFrame, ids_col: str = "ids", out_col: str = "decoded", ranks: str = RANKS) -> DataFrame:
    """``rows`` with the bytes (binary) that the ids stand for; null ids give none. A column of that name is replaced; an id that the file does not have is an error."""
    bounded_batches(rows.sparkSession)
    rows = rows.drop(out_col)
    at = rows.columns.index(ids_col)
    words = [b""] * (1 + max(read_ranks(ranks).values(), default=-1))
    for word, rank in read_ranks(ranks).items():
        words[rank] = word
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(shared.value, pa.binary())
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = pc.fill_null(part.column(at), pa.scalar([], part.column(at).type))
                each = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *pc.list_value_length(lists).to_pylist()]).astype(np.int32)), table.take(lists.flatten()))
                yield pa.RecordBatch.from_arrays([*part.columns, pc.binary_join(each, pa.scalar(b"", pa.binary()))], [*part.schema.names, out_col])

    return rows.mapInArrow(tidied(run), _fields(rows, f"`{out_col}` binary"))
