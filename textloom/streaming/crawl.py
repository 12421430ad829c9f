"""A crawl's page log fed by a stream of url files: each run takes the files that no run has taken."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import html as H
from textloom.functions import urls as U
from textloom.operators import crawl
from textloom.sources.corpus_files import PAGES

LOG = PAGES + ", batch long, outcome string"
#: Outcomes of a response that is a page; all others are failures, with the outcome as reason.
PAGE_OUTCOMES = ("html", "pdf")


def log(spark: SparkSession, out: str) -> DataFrame:
    """The whole log: a row a url with what came of it (``crawl.route``)."""
    return spark.read.schema(LOG).option("basePath", out).parquet(out)


def page_records(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("outcome").isin(*PAGE_OUTCOMES))


def failures(entries: DataFrame) -> DataFrame:
    """(url, reason) of urls that gave no page."""
    return entries.filter(~F.col("outcome").isin(*PAGE_OUTCOMES)).select("url", F.col("outcome").alias("reason"))


def records(responses: DataFrame) -> DataFrame:
    """Responses as log entries; only HTML pages keep their body."""
    known = responses.withColumn("outcome", crawl.route(F.col("http_status"), F.col("content_type"), F.col("url")))
    is_html = F.col("outcome") == "html"
    body = F.coalesce("raw_html", F.lit(""))
    return known.select(
        "url", F.when(is_html, H.title(body)).alias("title"), F.when(is_html, body).alias("raw_html"), "fetch_timestamp", "http_status", "content_type",
        F.when(is_html, F.length(H.visible_text(body))).alias("text_len"), F.when(is_html, crawl.needs_render(body)).alias("needed_js"),
        (F.col("outcome") == "pdf").alias("is_pdf"), "outcome",
    )


def fetch_new(spark: SparkSession, asked: str, out: str, checkpoint: str, fetch: Callable[[DataFrame], DataFrame], files_per_batch: int = 1000) -> None:
    """Take all url files (JSON lines with ``url``) that no run has taken, fetch their urls and log the answers; ends when nothing is left.

    ``fetch`` turns (url) rows into responses (``fetch.fetch_all`` with a client, say). Urls are normalised; null, rejected and logged ones are not fetched,
    whatever came of them. Each batch is one write to a folder of its own, which Spark publishes when the write is through: what a killed run left
    is not read, and the batch that is taken again replaces it.
    """
    stream = spark.readStream.schema("url string").option("maxFilesPerTrigger", files_per_batch).json(asked)

    def put(batch: DataFrame, n: int) -> None:
        todo = batch.select(U.normalize("url").alias("url")).filter("url IS NOT NULL").distinct()
        if n:
            todo = todo.join(log(batch.sparkSession, out).filter(F.col("batch") < n).select("url"), "url", "left_anti")
        records(fetch(todo)).write.mode("overwrite").partitionBy("outcome").parquet(f"{out.rstrip('/')}/batch={n}")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
