"""A persisted index for ``contains``: posting lists of the texts' runs of three characters.

Rows are numbered as they are written, ``BLOCK`` to a block. For each three characters in a row (case-sensitive, as 3 code points of 21 bits in a
long) and each block there is a list of the rows whose text has them, as differences of 16-bit places. Lists are packed by the tasks that
read the texts, so only packed lists shuffle, and they are written by a hash of the characters. A search for words reads the partitions of
their characters' hashes; rows in all lists of some word are its candidates, and only these rows are read. A candidate need not
hold the word, so the search that follows (``search.lexical``, which looks for the words themselves) gives the rows it would give over the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import search
from textloom.operators.index_store import CorpusStore
from textloom.scratch import bounded_batches, materialize

BLOCK_LOG2 = 12
BUCKETS = 64
#: Entries of lists that a task packs at once.
ENTRIES = 1 << 21
#: Runs of the words that are looked up at once; a block's lists of these are at most 8 KB each.
ROUND_GRAMS = 1 << 15
#: Blocks of candidates up to which the scan of the texts is told them, so that it can skip row groups.
TOLD = 4096


def grams(text: str | None) -> np.ndarray:
    """The distinct runs of three code points of a text, as longs."""
    c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:]) if len(c) > 2 else np.zeros(0, np.int64)


def _packed(batches: Iterator) -> Iterator:
    """mapInArrow over (place, text): (gram, block, rows); a block that a task does not see whole gives several lists of a gram."""
    import pyarrow as pa

    def lists(found: list, places: list) -> pa.RecordBatch:
        g = np.concatenate(found) if found else np.zeros(0, np.int64)
        at = np.repeat(np.array(places, np.int64), [len(x) for x in found])
        by = np.lexsort((at, g))
        g, at = g[by], at[by]
        block, row = at >> BLOCK_LOG2, (at & ((1 << BLOCK_LOG2) - 1)).astype(np.uint16)
        cuts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (block[1:] != block[:-1])][: len(g)])
        step = np.diff(row, prepend=np.uint16(0)).astype(np.uint16)
        step[cuts] = row[cuts]
        ends = pa.py_buffer((2 * np.r_[cuts, len(g)]).astype(np.int32))  # a list is a stretch of the one buffer
        rows = pa.Array.from_buffers(pa.binary(), len(cuts), [None, ends, pa.py_buffer(step)])
        return pa.RecordBatch.from_arrays([pa.array(g[cuts]), pa.array(block[cuts]), rows], ["gram", "block", "rows"])

    found, places, held = [], [], 0
    for batch in batches:
        for place, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found.append(grams(text.as_py()))
            places.append(place)
            held += len(found[-1])
            if held > ENTRIES:
                yield lists(found, places)
                found, places, held = [], [], 0
    yield lists(found, places)


def _common(shared):
    """mapInArrow over (block, lists array<struct<gram, rows>>), with the words as a sorted array of grams, places in it, and where each word's begin: (place) of the rows in the lists of all grams of some word."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, places, begin = shared.value
        for batch in batches:
            out = [np.zeros(0, np.int64)]
            for block, lists in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = np.zeros((len(known), 1 << BLOCK_LOG2 - 3), np.uint8)  # a bit a row
                for at, rows in zip(np.searchsorted(known, lists.values.field(0).to_numpy()), lists.values.field(1), strict=True):
                    bits = np.zeros(1 << BLOCK_LOG2, bool)
                    bits[np.cumsum(np.frombuffer(rows.as_buffer(), np.uint16), dtype=np.int64)] = True
                    held[at] |= np.packbits(bits)
                some = np.bitwise_or.reduce(np.bitwise_and.reduceat(held[places], begin, axis=0), axis=0)
                out.append((block << BLOCK_LOG2) + np.flatnonzero(np.unpackbits(some)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out), pa.int64())], ["place"])

    return run


def _cut(words):
    """pandas function over words: their grams."""
    import pandas as pd

    return pd.Series([grams(w).tolist() for w in words])


class LexicalIndex:
    """The index of a table of texts in a folder: versions of the numbered rows and of their lists. Every column is kept; null texts hold nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.texts, self.lists = (CorpusStore(spark, f"{path.rstrip('/')}/{x}") for x in ("texts", "lists"))

    def build(self, rows: DataFrame, text: str = "text") -> int:
        """Index all of ``rows``; returns the version of the lists."""
        bounded_batches(self.spark)
        made = self.texts.rebuild(rows.withColumn("place", F.monotonically_increasing_id()).withColumn("block", F.shiftright("place", BLOCK_LOG2)))
        packed = self.texts.read(made).select("place", text).mapInArrow(_packed, "gram long, block long, rows binary")
        packed = packed.withColumn("texts", F.lit(made)).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int"))
        # one list that no word asks for: it names the texts' version, and an index of no texts is not an empty table
        packed = packed.unionByName(self.spark.createDataFrame([(-1, -1, b"", made, 0)], "gram long, block long, rows binary, texts int, bucket int"))
        return self.lists.rebuild(packed.repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(64))).sortWithinPartitions("bucket", "gram"), by=["bucket"])  # as the writer wants it, so it is sorted once

    def candidates(self, words: DataFrame, version: int | None = None) -> DataFrame:
        """The rows that may hold some of ``words`` (word): those in the lists of all of a word's characters, and all rows if a word has fewer than three.

        Null words are none. What is read of the texts is the candidates' blocks where these are ``TOLD`` or fewer, else what the join leaves.
        """
        lists = self.lists.read(version)
        texts = self.texts.read(lists.filter("bucket = 0 AND gram = -1").first()["texts"])
        asked = materialize(words.filter("word IS NOT NULL").select("word").distinct().withColumn("grams", F.pandas_udf(_cut, "array<long>")("word")), "words")
        if asked.filter(F.size("grams") == 0).limit(1).count():
            return texts.drop("place", "block")
        found = None
        for part in search.dealt(asked, F.size("grams") * (search.ROUND_BYTES // ROUND_GRAMS)):
            grams_ = [r[0] for r in part.select("grams").collect()]  # about ROUND_GRAMS
            if not grams_:
                continue
            known, places = np.unique(np.concatenate(grams_), return_inverse=True)
            shared = self.spark.sparkContext.broadcast((known, places, np.cumsum([0, *map(len, grams_[:-1])])))
            each = part.select(F.explode("grams").alias("gram")).distinct()
            buckets = [r[0] for r in each.select(F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")).distinct().collect()]  # BUCKETS at most
            # a list is moved once to its block, however many words ask for it
            met = lists.filter(F.col("bucket").isin(buckets)).select("gram", "block", "rows").join(F.broadcast(each), "gram", "left_semi")
            met = met.groupBy("block").agg(F.collect_list(F.struct("gram", "rows")).alias("lists")).mapInArrow(_common(shared), "place long")
            found = met if found is None else found.unionByName(met).distinct()
        found = materialize(found if found is not None else self.spark.createDataFrame([], "place long"), "candidates")
        blocks = [r[0] for r in found.select(F.shiftright("place", BLOCK_LOG2)).distinct().limit(TOLD + 1).collect()]
        some = texts.filter(F.col("block").isin(blocks)) if len(blocks) <= TOLD else texts
        return some.join(found, "place", "left_semi").drop("place", "block")


def lexical(queries: DataFrame, index: LexicalIndex) -> DataFrame:
    """``search.lexical`` over an index: (query_id, variant_ord, variant, chunk_id, score, rank)."""
    words = queries.select(F.explode(search.variants(F.concat("terms", "fuzzy"))).alias("word"))
    return search.lexical(queries, materialize(index.candidates(words), "candidates"))
