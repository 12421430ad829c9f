"""Queries that write their tables as files and read them back: each reader with its sink, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import html as H
from textloom.functions import text as T
from textloom.functions import urls as U
from textloom.plans import page_queries, text_queries
from textloom.scratch import shared_path
from textloom.sources import corpus_files
from textloom.streaming import crawl as crawl_stream


def _page_records(spark, sf):
    p = page_queries.pages(spark, sf)
    return p.select("url", H.title("html").alias("title"), F.col("html").alias("raw_html"), F.when(F.col("page_id") % 7 == 0, 404).otherwise(200).alias("http_status"), F.lit("text/html").alias("content_type"), F.length("html").alias("text_len"), U.is_pdf("url").alias("is_pdf"))


def pages_file(spark, sf):
    path = shared_path(spark, "pages_file")
    corpus_files.write_json(_page_records(spark, sf), path)
    return corpus_files.read_pages(spark, path).select("url", "title", F.sha2("raw_html", 256).alias("h"), "http_status", F.col("text_len").cast("long").alias("text_len"), "is_pdf")


def crawl_log(spark, sf):
    """Two runs of the streaming page log over growing url files; the pages play the network, with a status and a type by page."""
    asked, out, checkpoint = (shared_path(spark, t) for t in ("asked", "crawl_log", "crawl_checkpoint"))
    p = page_queries.pages(spark, sf)
    status, kind = page_queries.answer_of_page()
    first = p.groupBy(U.normalize("url").alias("url")).agg(F.min("page_id").alias("page_id"))
    network = first.join(p.select("page_id", "html"), "page_id").select("url", status.alias("http_status"), kind.alias("content_type"), F.col("html").alias("raw_html"), F.lit("").alias("fetch_timestamp"))
    for part in (p.filter("page_id % 2 = 0"), p):
        part.select("url").write.mode("append").json(asked)
        crawl_stream.fetch_new(spark, asked, out, checkpoint, lambda todo: todo.join(network, "url", "left"))
    log = crawl_stream.log(spark, out)
    return log.select("url", "outcome", "is_pdf", F.col("title"), F.col("text_len").cast("long").alias("text_len"), F.sha2("raw_html", 256).alias("h"), "needed_js")


def chunks_file(spark, sf):
    path = shared_path(spark, "chunks_file")
    d = text_queries.docs(spark, sf)
    corpus_files.write_json(d.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("source_url"), F.col("doc_id").alias("chunk_index"), "text", T.word_count("text").alias("token_count"), F.lit(False).alias("is_pdf")), path)
    return corpus_files.read_chunks(spark, path).select("chunk_id", "source_url", "chunk_index", F.sha2("text", 256).alias("h"), "token_count", "is_pdf")


def crawled_urls_file(spark, sf):
    path = shared_path(spark, "crawled_file")
    p = page_queries.pages(spark, sf)
    corpus_files.write_json(p.groupBy("url").agg(F.max(F.col("page_id") % 10 == 3).alias("is_pdf")), path)
    return corpus_files.read_crawled_urls(spark, path)


def failure_log(spark, sf):
    """Two runs that add to one log."""
    path = shared_path(spark, "failures")
    p = page_queries.pages(spark, sf)
    for run in (0, 1):
        corpus_files.append_failures(p.filter(F.col("page_id") % 5 == run).select("url", F.concat(F.lit("http-50"), F.lit(run).cast("string")).alias("reason")), path)
    return spark.read.schema("url string, reason string").option("sep", "\t").csv(path).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("urls"))


def vocabulary_file(spark, sf):
    path = shared_path(spark, "vocabulary")
    corpus_files.write_vocabulary(text_queries.vocabulary(spark, sf), path)
    return spark.read.schema("term string").json(path)


QUERIES = {f.__name__: f for f in (pages_file, chunks_file, crawled_urls_file, failure_log, vocabulary_file, crawl_log)}

ORACLE_SQL = {
    "pages_file": f"""SELECT url, title, sha256(html) AS h, CASE WHEN page_id % 7 = 0 THEN 404 ELSE 200 END::INT AS http_status, length(html) AS text_len, lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#;]*)', 1)) LIKE '%.pdf' AS is_pdf
        FROM pages JOIN ({page_queries.ORACLE_SQL["html_title"]}) USING (page_id) WHERE url IS NOT NULL""",
    "chunks_file": f"SELECT doc_id::VARCHAR AS chunk_id, source AS source_url, doc_id AS chunk_index, sha256(text) AS h, n_words AS token_count, false AS is_pdf FROM documents JOIN ({text_queries.ORACLE_SQL['word_counts']}) USING (doc_id)",
    "crawled_urls_file": "SELECT url, bool_or(page_id % 10 = 3) AS is_pdf FROM pages WHERE url IS NOT NULL GROUP BY url",
    "failure_log": "SELECT 'http-50' || (page_id % 5) AS reason, count(*) AS n, count(DISTINCT url) AS urls FROM pages WHERE page_id % 5 < 2 GROUP BY 1",
    "crawl_log": f"""WITH u AS (SELECT {page_queries._NORM} AS url, page_id, html FROM pages WHERE url IS NOT NULL),
        a AS (SELECT url, arg_min(html, page_id) AS html, min(page_id) AS page_id FROM u GROUP BY url),
        r AS (SELECT a.*, route AS outcome, title AS t FROM a JOIN ({page_queries.ORACLE_SQL["route_responses"]}) USING (page_id) JOIN ({page_queries.ORACLE_SQL["html_title"]}) USING (page_id))
        SELECT url, outcome, outcome = 'pdf' AS is_pdf, CASE WHEN outcome = 'html' THEN t END AS title, CASE WHEN outcome = 'html' THEN length({page_queries._VISIBLE}) END AS text_len,
               CASE WHEN outcome = 'html' THEN sha256(html) END AS h, CASE WHEN outcome = 'html' THEN {page_queries._NEEDS} END AS needed_js FROM r""",
    "vocabulary_file": f"SELECT term FROM ({text_queries.ORACLE_SQL['vocabulary']})",
}
