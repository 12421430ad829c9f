"""Job: documents to a clean corpus, ready to be cut into chunks and indexed.

    python -m jobs.clean_corpus --documents .../documents.parquet --out .../corpus [--config settings.json]

Paragraphs that stand in many documents are taken out; what is then empty, short, navigation or garbage is rejected, and of documents whose
rest is the same (whatever its case and blanks) the smallest id stays. Three outputs: ``clean`` (Parquet by source), ``rejected`` (JSON lines by source and
reason) and ``report`` (CSV, a row a source and status). Statistics are over all documents. A run replaces all outputs; with ``sources`` in the config it replaces the
partitions of these sources only, and the report still covers all. A run on the same documents gives the same outputs. An empty source
is read back as null.
"""

from __future__ import annotations

import logging

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line
from textloom.functions import text as T
from textloom.operators import blocks, chunks
from textloom.scratch import bounded_batches

LOG = logging.getLogger("jobs.clean_corpus")
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEAN = "doc_id long, lang string, n_words long, text_sha256 string, text string, source string"
REJECTED = "doc_id long, n_words long, source string, reason string"


def judged(docs: DataFrame, fraction: float, least: int, held: list[DataFrame]) -> DataFrame:
    """(doc_id, lang, source, text, n_words, reason): documents without boilerplate; ``reason`` is null for what stays.

    A null text is empty and so is one of boilerplate alone. Ids are keys: rows without one are left out, of rows alike in id the texts are taken together.
    What is kept on the executors' disks on the way is added to ``held``, for the caller to give back.
    """
    docs = docs.filter("doc_id IS NOT NULL")
    # of the paragraphs only hashes are moved; read twice, for the frequencies and for the documents that lose some
    hashes = blocks.paragraph_hashes(blocks.paragraphs(docs.select("doc_id", "text", T.facts("text").alias("f")), "doc_id", F.col("f.even")), "doc_id").persist(StorageLevel.DISK_ONLY)
    boiler = blocks.frequent(hashes, docs, fraction, least).select("h").persist(StorageLevel.DISK_ONLY)
    held += [hashes, boiler]
    LOG.info("%d boilerplate paragraphs", boiler.count())  # written, so its size is known where it is joined
    gone = hashes.select("doc_id", "h").join(boiler, "h").groupBy("doc_id").agg(F.collect_list("h").alias("gone"))
    # the one shuffle of the texts
    whole = docs.groupBy("doc_id").agg(F.min("lang").alias("lang"), F.min("source").alias("source"), F.collect_list("text").alias("texts"))
    rows = whole.join(gone.hint("merge"), "doc_id", "left").select("doc_id", "lang", "source", blocks.without(F.col("texts"), F.col("gone")).alias("text"))
    rows = rows.withColumn("f", T.facts("text"))
    f = F.col("f")
    rows = rows.withColumn("token_count", F.coalesce(f["words"].cast("long"), T.word_count("text"))).withColumn("h", T.text_hash("text", f["even"]))
    rows = rows.withColumn("reason", F.when(F.col("token_count") == 0, "empty").otherwise(chunks.drop_reason(f))).drop("f").persist(StorageLevel.DISK_ONLY)
    held.append(rows)
    # ids and hashes only: the texts stay where they are
    stay = rows.filter("reason IS NULL").select("h", "doc_id")
    again = stay.join(stay.groupBy("h").agg(F.min("doc_id").alias("first")), "h").filter("doc_id <> first").select("doc_id", F.lit("duplicate").alias("again")).persist(StorageLevel.DISK_ONLY)
    held.append(again)
    LOG.info("%d duplicates", again.count())
    both = rows.join(again, "doc_id", "left")
    return both.select("doc_id", "lang", "source", "text", F.col("token_count").alias("n_words"), F.coalesce("reason", "again").alias("reason"))


def run(spark: SparkSession, documents: str, out: str, config: dict) -> None:
    """Clean ``documents`` into ``out``."""
    before = spark.conf.get(BATCH, None)
    bounded_batches(spark)
    try:
        _run(spark, documents, out, config)
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)


def _run(spark: SparkSession, documents: str, out: str, config: dict) -> None:
    docs = spark.read.parquet(documents)
    LOG.info("read %d rows of %s", docs.count(), documents)
    held: list[DataFrame] = []
    rows = judged(docs, config["boilerplate_fraction"], config["boilerplate_min_documents"], held)
    some = config.get("sources")
    mine = rows.filter(F.col("source").isin(some)) if some else rows
    # tasks of about one size, each with few sources: a source of many documents is spread
    even = mine.hint("rebalance", "source")
    how = "dynamic" if some else "static"
    clean = even.filter("reason IS NULL").select("doc_id", "lang", "n_words", F.sha2("text", 256).alias("text_sha256"), "text", "source")
    clean.write.mode("overwrite").option("partitionOverwriteMode", how).partitionBy("source").parquet(f"{out}/clean")
    left = even.filter("reason IS NOT NULL").select("doc_id", "n_words", "source", "reason")
    left.write.mode("overwrite").option("partitionOverwriteMode", how).partitionBy("source", "reason").json(f"{out}/rejected")
    report = rows.groupBy("source", F.coalesce("reason", F.lit("kept")).alias("status")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_words").alias("words")).persist(StorageLevel.DISK_ONLY)
    held.append(report)
    report.orderBy("source", "status").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}/report")
    for r in report.groupBy("status").agg(F.sum("documents").alias("n")).orderBy("status").collect():  # a row a reason
        LOG.info("%s: %d documents", r["status"], r["n"])
    LOG.info("wrote clean, rejected and report to %s", out)
    for x in held:
        x.unpersist()


def result(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, source, status, n_words, text_sha256): the outputs as they stand."""
    clean = spark.read.schema(CLEAN).parquet(f"{out}/clean").select("doc_id", "source", F.lit("kept").alias("status"), "n_words", "text_sha256")
    left = spark.read.schema(REJECTED).json(f"{out}/rejected")
    return clean.unionByName(left.select("doc_id", "source", F.col("reason").alias("status"), "n_words", F.lit(None).cast("string").alias("text_sha256")))


if __name__ == "__main__":
    command_line("clean_corpus", run, ["documents", "out"])
