"""Readers and writers of pages, chunks, reports and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "url string, title string, raw_html string, fetch_timestamp string, http_status int, content_type string, text_len int, needed_js boolean, is_pdf boolean"
CHUNKS = "chunk_id string, source_url string, page_title string, heading_path string, chunk_index long, crawl_timestamp string, text string, token_count long, is_pdf boolean"
SEEDS = "label string, url string, max_pages int, force_browser boolean, fallback_text string, always_add_fallback boolean"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page records; blank and malformed lines are skipped."""
    return spark.read.schema(PAGES).option("mode", "DROPMALFORMED").json(path).filter("url IS NOT NULL")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records; a malformed line is an error."""
    return spark.read.schema(CHUNKS).option("mode", "FAILFAST").json(path)


def read_crawled_urls(spark: SparkSession, path: str) -> DataFrame:
    """(url, is_pdf): the last record of a url wins, in file order (one file is one ordered log; files are in order of name)."""
    rows = spark.read.schema("url string, is_pdf boolean").json(path).select("url", F.coalesce("is_pdf", F.lit(False)).alias("is_pdf"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return rows.filter("url IS NOT NULL").groupBy("url").agg(F.max_by("is_pdf", F.struct("f", "b", "i")).alias("is_pdf"))


def read_saved_html(spark: SparkSession, path: str) -> DataFrame:
    """(path, html): saved pages, a file a row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_failures(rows: DataFrame, path: str) -> None:
    """(url, reason) rows as tab-separated lines, added to the log."""
    rows.select("url", "reason").write.mode("append").option("sep", "\t").csv(path)


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """Sorted terms, a JSON record each."""
    vocab.select("term").orderBy("term").write.mode("overwrite").json(path)


def write_text_report(lines: DataFrame, path: str) -> None:
    lines.select("value").coalesce(1).write.mode("overwrite").text(path)


def read_pdf_texts(spark: SparkSession, path: str, max_mb: float) -> DataFrame:
    """(path, length, text) of PDF files: page texts joined by newlines, bad pages skipped, any failure an empty text.

    Needs the optional pypdf; without it texts are empty. Files over the size limit are not opened.
    """
    def run(content):
        def one(raw: bytes | None) -> str:
            try:
                import io

                from pypdf import PdfReader

                pages = []
                for page in PdfReader(io.BytesIO(raw)).pages:
                    try:
                        pages.append(page.extract_text() or "")
                    except Exception:  # a bad page is skipped
                        continue
                return "\n".join(pages)
            except Exception:  # any other failure is an empty text
                return ""

        return content.map(one)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    small = F.col("length") <= max_mb * 1024 * 1024
    return files.select("path", "length", F.when(small, F.pandas_udf(run, "string")(F.when(small, F.col("content")))).otherwise("").alias("text"))
