"""Coverage reports: what was crawled, what is indexed, and what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import urls as U


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """(source_url, n_chunks, page_title, is_pdf): the first title and the last flag by chunk order."""
    return chunks.groupBy("source_url").agg(F.count(F.lit(1)).alias("n_chunks"), F.min_by("page_title", "chunk_index").alias("page_title"), F.max_by("is_pdf", "chunk_index").alias("is_pdf"))


def crawled_urls(pages: DataFrame) -> DataFrame:
    """(url, is_pdf): one row a url, the last flag wins."""
    return pages.groupBy("url").agg(F.max_by("is_pdf", "page_ord").alias("is_pdf"))


def missing(crawled: DataFrame, counts: DataFrame) -> DataFrame:
    """Crawled HTML urls without a chunk, in order."""
    return crawled.filter("NOT is_pdf").join(counts.select(F.col("source_url").alias("url")), "url", "left_anti").select("url").orderBy("url")


def totals(crawled: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: crawled_html, crawled_pdf, indexed_html, indexed_pdf, chunks."""
    a = crawled.agg(F.count_if(~F.col("is_pdf")).alias("crawled_html"), F.count_if("is_pdf").alias("crawled_pdf"))
    b = counts.agg(F.count_if(~F.col("is_pdf")).alias("indexed_html"), F.count_if("is_pdf").alias("indexed_pdf"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"))
    return a.crossJoin(b)  # one row each


def lookup(asked: DataFrame, crawled: DataFrame, counts: DataFrame) -> DataFrame:
    """(asked, url, n_chunks): urls by their coverage key; a url never crawled has a null url and no chunks."""
    have = crawled.join(counts.select(F.col("source_url").alias("url"), "n_chunks"), "url", "left").select("url", U.coverage_key("url").alias("key"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
    return asked.withColumn("key", U.coverage_key("asked")).join(have, "key", "left").select("asked", "url", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def text_report(total: DataFrame, absent: DataFrame, listed: int = 200) -> DataFrame:
    """One column ``value``: the totals and the first missing urls as lines, for a text sink."""
    head = total.select(F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in total.columns]).alias("value"))
    return head.unionByName(absent.orderBy("url").limit(listed).select(F.concat(F.lit("missing: "), F.col("url")).alias("value")))
