"""Exact de-duplication by two-pass Bloom filtering.

Pass one sets the bits of every text's hash in a filter A, and in a filter B the bits of every hash that A may have held already.
The filters of two partitions merge as ``A = A1 | A2`` and ``B = B1 | B2 | (A1 & A2)``, so a hash that occurs twice anywhere is in
the merged B: no repeat is missed. Pass two tests each row against B. Rows outside B are certainly unique and pass straight
through; only the (narrow) rest shuffles, by SHA-256, and is grouped exactly. Groups are partial aggregates, and no window gathers one, so a
text of many copies is no hot task.

``drop_duplicates`` then puts the rows to keep into a third filter. A suspect outside it certainly goes, without a shuffle; of a group only
the row that stays, and the few that the filter takes for it, shuffle whole to be told apart exactly.

A filter has ``bloom.BITS_PER_ROW`` bits a row and never more than ``bloom.MAX_BITS`` (32 MB); nothing else is broadcast. Beyond
``MAX_BITS / BITS_PER_ROW`` rows (16 million) more unique rows are tested in vain, so more (narrow) rows shuffle; results stay exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.bloom import member_filter, repeated_filter
from textloom.llm.common import bounded_batches, materialize, text_of


def _sha(text_col: str) -> Column:
    return F.sha2(text_of(text_col).cast("binary"), 256)


def _suspects(docs: DataFrame, id_col: str, text_col: str):
    """Written rows (row, doc, sha, h), the test of pass two, and the written rows that it lets through."""
    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc"), _sha(f"`{text_col}`").alias("sha"))
    rows = materialize(narrow.withColumn("h", F.xxhash64("sha")), "fingerprints")
    maybe = repeated_filter(rows.select("h"), rows.count())
    return rows, maybe, materialize(rows.filter(maybe("h")).select("row", "doc", "sha"), "suspects")


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty, so null and empty texts form one group. The row with the largest id stays
    (a null id is the smallest); of rows alike in id and text one stays. An empty table gives an empty result. Other columns are not read.
    """
    rows, maybe, suspects = _suspects(docs, id_col, text_col)
    groups = materialize(suspects.groupBy("sha").agg(F.max(F.struct("doc", "row")).alias("m"), F.count(F.lit(1)).alias("size")), "groups")
    groups = groups.select("sha", F.col("m.doc").alias("keep"), F.col("m.row").alias("keep_row"), "size")
    single = rows.filter(~maybe("h")).select("doc", "sha", F.col("doc").alias("keep"), F.lit(1).cast("long").alias("size"), F.lit(True).alias("kept"))
    joined = suspects.join(groups, "sha").select("doc", "sha", "keep", "size", (F.col("row") == F.col("keep_row")).alias("kept"))
    return single.unionByName(joined).select(F.col("doc").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of ``mark_duplicates`` with all their columns, whatever these are called.

    Rows alike in id and text, the only ones that id and text cannot tell apart, are cut to one a task before they shuffle.
    """
    _, maybe, suspects = _suspects(docs, id_col, text_col)
    keepers = suspects.groupBy("sha").agg(F.max(F.struct("doc", "row")).alias("m")).select(F.col("m.doc").alias("doc"), "sha")
    repeats = suspects.groupBy("sha", "doc").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    # one row a group: what stays, and whether several rows are just that
    stay = materialize(keepers.join(repeats.select("sha", F.col("doc").alias("twice"), F.lit(True).alias("tied")), (keepers["sha"] == repeats["sha"]) & keepers["doc"].eqNullSafe(F.col("twice")), "left").select(keepers["sha"], "doc", F.coalesce("tied", F.lit(False)).alias("tied")), "keepers")
    key = lambda sha, doc: F.xxhash64(sha, F.coalesce(doc, F.lit(-1).cast("long")), doc.isNull())
    kept = member_filter(stay.select(key(F.col("sha"), F.col("doc")).alias("h")), stay.count())
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc"), _sha(f"`{text_col}`").alias("sha"))
    state = whole.withColumn("hit", maybe(F.xxhash64("sha")))
    likely = state.filter("hit").filter(kept(key(F.col("sha"), F.col("doc"))))
    exact = likely.join(stay.select(F.col("sha").alias("s"), F.col("doc").alias("d"), "tied"), (F.col("sha") == F.col("s")) & F.col("doc").eqNullSafe(F.col("d")))
    out = state.filter("NOT hit").select("row.*").unionByName(exact.filter("NOT tied").select("row.*"))
    if stay.filter("tied").limit(1).count():
        # by another key than the join's, so that the join can still split its large tasks
        once = exact.filter("tied").groupBy(F.concat_ws("|", "sha", F.col("doc").cast("string")).alias("k")).agg(F.first("row").alias("row"))
        out = out.unionByName(once.select("row.*"))
    return out
