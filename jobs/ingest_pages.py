"""Job: new crawled pages to page texts and links, incrementally.

    python -m jobs.ingest_pages --pages .../pages.parquet --out .../ingested --checkpoint .../ingested/_checkpoint [--config settings.json]

A file stream takes the page files that no earlier run has taken and stops when none is left. Each of its batches is written as partitions of its own
number: ``pages`` (by batch and site) and ``links`` (by batch). A batch that is taken again after a failure has the same number and the same files
and replaces its own partitions only, so nothing is doubled or lost. ``current`` gives the newest row of each url: a page that is crawled again supersedes the old one.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line
from textloom.functions import html as H
from textloom.functions import urls as U
from textloom.operators import crawl

LOG = logging.getLogger("jobs.ingest_pages")
PAGES = "page_id long, url string, title string, n_chars long, n_links long, n_external long, text_sha256 string, text string, batch long, site string"
LINKS = "page_id long, link_ord long, dst_url string, external string, batch long"


def links_of(pages: DataFrame, allowed: tuple) -> DataFrame:
    """(page_id, link_ord, dst_url, external): resolved targets; ``external`` is the registered domain of those that leave ``allowed``."""
    return crawl.links(pages).select("page_id", "link_ord", "dst_url", U.external_domain("dst_url", allowed).alias("external"))


def texts_of(pages: DataFrame, allowed: tuple) -> DataFrame:
    """One row a page: its normalised url, or ``page:<id>`` if it has none, its site, title, visible text and numbers of links. A null html is empty."""
    raw = F.transform(H.hrefs("html"), lambda h: U.normalize(h, "url"))
    text = F.coalesce(H.visible_text("html"), F.lit(""))
    rows = pages.select("page_id", F.coalesce(U.normalize("url"), F.concat(F.lit("page:"), F.col("page_id").cast("string"))).alias("norm"), F.coalesce(H.title("html"), F.lit("")).alias("title"), text.alias("text"), F.filter(F.coalesce(raw, F.array().cast("array<string>")), lambda x: x.isNotNull()).alias("to"))
    outside = F.filter("to", lambda x: U.external_domain(x, allowed).isNotNull())
    return rows.select(
        "page_id", F.col("norm").alias("url"), "title", F.length("text").cast("long").alias("n_chars"), F.size("to").cast("long").alias("n_links"), F.size(outside).cast("long").alias("n_external"),
        F.sha2("text", 256).alias("text_sha256"), "text", F.coalesce(U.registered_domain(U.authority("norm")), F.lit("")).alias("site"),
    )


def run(spark: SparkSession, pages: str, out: str, checkpoint: str, config: dict) -> None:
    """Take the pages that have come since the last run into ``out``."""
    allowed = tuple(config["allowed_domains"])
    schema = spark.read.parquet(pages).schema
    whole = pages.rstrip("/")
    glob = f"{whole[:-1]}[{whole[-1]}]"  # a stream takes a single file, as well as a folder, only where its path is a pattern
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["max_files_per_batch"]).parquet(glob)

    def take(batch: DataFrame, number: int) -> None:
        writes = {"pages": (texts_of(batch, allowed), ["batch", "site"]), "links": (links_of(batch, allowed), ["batch"])}
        for name, (rows, by) in writes.items():
            rows.withColumn("batch", F.lit(number).cast("long")).hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{out}/{name}")
        LOG.info("batch %d: read %d pages, wrote them and their links to %s", number, batch.count(), out)

    query = new.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("took %d batches from %s", len(query.recentProgress), pages)


def current(spark: SparkSession, out: str) -> DataFrame:
    """The newest page of each url: that of the largest id, of equal ones the latest batch's."""
    rows = spark.read.schema(PAGES).parquet(f"{out}/pages").withColumn("site", F.coalesce("site", F.lit("")))  # an empty partition value is read back as null
    newest = F.max_by(F.struct(*rows.columns), F.struct("page_id", "batch")).alias("r")
    return rows.groupBy("url").agg(newest).select("r.*")


def result(spark: SparkSession, out: str) -> DataFrame:
    """(page_id, url, site, title, n_chars, n_links, n_external, text_sha256) of ``current``."""
    return current(spark, out).select("page_id", "url", "site", "title", "n_chars", "n_links", "n_external", "text_sha256")


if __name__ == "__main__":
    command_line("ingest_pages", run, ["pages", "out", "checkpoint"])
