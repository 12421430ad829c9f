"""The jobs as queries: each runs twice into one new folder and returns its output after the second run; SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import clean_corpus, ingest_pages
from jobs.common import config_of
from textloom.plans import page_queries as P
from textloom.plans import text_queries as X
from textloom.scratch import shared_root


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def job1_clean_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, config = _folder(spark, "clean_corpus"), config_of("clean_corpus")
    for _ in range(2):
        clean_corpus.run(spark, f"{sf_dir}/documents.parquet", out, config)
    return clean_corpus.result(spark, out)


def job2_ingest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, config = _folder(spark, "ingest_pages"), config_of("ingest_pages")
    for _ in range(2):
        ingest_pages.run(spark, f"{sf_dir}/pages.parquet", out, f"{out}/_checkpoint", config)
    return ingest_pages.result(spark, out)


QUERIES = {"job1_clean_corpus": job1_clean_corpus, "job2_ingest_pages": job2_ingest_pages}

ORACLE_SQL = {
    "job1_clean_corpus": f"""
        WITH {X._PARAS}, {X._FREQ}, {X._BOILER},
        stripped AS (SELECT doc_id, string_agg(para, chr(10) ORDER BY pos) AS text FROM p WHERE h NOT IN (SELECT h FROM b) GROUP BY doc_id),
        whole AS (SELECT doc_id, source, coalesce(stripped.text, '') AS text FROM documents LEFT JOIN stripped USING (doc_id)),
        told AS (SELECT doc_id, source, text, {X._nw('text')} AS n, sha256({X._squeeze('text')}) AS h FROM whole),
        judged AS (SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN n < 25 THEN 'short' WHEN {X._nav('text')} THEN 'nav' WHEN {X._garbage('text')} THEN 'garbage' END AS reason FROM told),
        m AS (SELECT *, CASE WHEN reason IS NULL AND doc_id <> min(doc_id) FILTER (reason IS NULL) OVER (PARTITION BY h) THEN 'duplicate' ELSE reason END AS why FROM judged)
        SELECT doc_id, source, coalesce(why, 'kept') AS status, n::BIGINT AS n_words, CASE WHEN why IS NULL THEN sha256(text) END AS text_sha256 FROM m""",
    "job2_ingest_pages": P._LINKS + rf""",
        e AS (SELECT page_id, count(*) AS n_links, count(*) FILTER (NOT {P._of(P._IN, 'dst_url')}) AS n_external FROM l GROUP BY page_id),
        t AS (SELECT page_id, {P._NORM} AS norm, {P._TITLE} AS title, {P._VISIBLE} AS text FROM pages),
        n AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY norm ORDER BY page_id DESC) = 1)
        SELECT page_id, norm AS url, {P._of(P._DOMAIN, 'norm')} AS site, title, length(text) AS n_chars, coalesce(n_links, 0) AS n_links, coalesce(n_external, 0) AS n_external, sha256(text) AS text_sha256
        FROM n LEFT JOIN e USING (page_id)""",
}
