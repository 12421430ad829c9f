"""The jobs: against their SQL, two runs over growing input, reruns, and odd rows."""

import json
import logging
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import clean_corpus, ingest_pages, queries
from jobs.common import config_of
from tests import oracle
from tests.conftest import ROOT, SF

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_job_matches_sql(spark, name):
    before = {k: spark.conf.get(k) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    oracle.check(queries.QUERIES[name](spark, SF), oracle.connect(SF), queries.ORACLE_SQL[name])
    assert before == {k: spark.conf.get(k) for k in before}


def rows(df):
    return sorted(map(str, df.collect()))


def page(i, text):
    return i, f"https://www.Example.org/p{i % 5}/", f"<html><head><title>T{i}</title></head><body><p>{text}</p><a href='/x'>x</a><a href='https://other.net/y'>y</a><a href='mailto:a@b.cd'>m</a></body></html>"


def test_ingest_takes_only_what_is_new(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    src, out, mark, config = f"{tmp_path}/pages", f"{tmp_path}/out", f"{tmp_path}/mark", config_of("ingest_pages")

    def run():
        caplog.clear()
        ingest_pages.run(spark, src, out, mark, config)
        return [r.getMessage() for r in caplog.records if r.name == "jobs.ingest_pages" and "read" in r.getMessage()]

    spark.createDataFrame([page(i, f"first {i}") for i in range(4)], PAGES).coalesce(1).write.parquet(src)
    assert len(run()) == 1 and "read 4 pages" in caplog.text
    assert run() == []
    first = rows(ingest_pages.result(spark, out))
    assert len(first) == 4
    # page 6 is a new version of page 1's url, page 9 is new
    spark.createDataFrame([page(6, "second"), page(9, "new")], PAGES).coalesce(1).write.mode("append").parquet(src)
    said = run()
    assert len(said) == 1 and "read 2 pages" in said[0]
    got = {r["url"]: r for r in ingest_pages.result(spark, out).collect()}
    assert sorted(r["page_id"] for r in got.values()) == [0, 2, 3, 6, 9]
    assert got["https://example.org/p1"]["title"] == "T6"
    assert (got["https://example.org/p1"]["n_links"], got["https://example.org/p1"]["n_external"]) == (2, 1)
    links = spark.read.schema(ingest_pages.LINKS).parquet(f"{out}/links")
    assert links.filter("external = 'other.net'").count() == 6 and links.count() == 12
    # at once into another folder gives the same
    ingest_pages.run(spark, src, f"{tmp_path}/at_once", f"{tmp_path}/mark2", config)
    assert rows(ingest_pages.result(spark, out)) == rows(ingest_pages.result(spark, f"{tmp_path}/at_once"))


def test_a_batch_that_is_taken_again_replaces_itself(spark, tmp_path):
    src, out, mark, config = f"{tmp_path}/pages", f"{tmp_path}/out", f"{tmp_path}/mark", config_of("ingest_pages")
    spark.createDataFrame([page(i, f"text {i}") for i in range(5)], PAGES).coalesce(1).write.parquet(src)
    ingest_pages.run(spark, src, out, mark, config)
    first, files = rows(spark.read.schema(ingest_pages.PAGES).parquet(f"{out}/pages")), spark.read.parquet(f"{out}/links").count()
    for name in os.listdir(f"{mark}/commits"):  # as if the run had died before it noted that the batch is done
        os.remove(f"{mark}/commits/{name}")
    ingest_pages.run(spark, src, out, mark, config)
    assert rows(spark.read.schema(ingest_pages.PAGES).parquet(f"{out}/pages")) == first
    assert spark.read.parquet(f"{out}/links").count() == files


def test_ingest_of_odd_rows(spark, tmp_path):
    src, out = f"{tmp_path}/pages", f"{tmp_path}/out"
    odd = [(1, None, "<p>a</p>"), (2, "mailto:x@y.zz", None), (3, "https://example.org/", ""), (3, "https://example.org/", ""), (None, "https://example.org/n", "<a>no link</a>")]
    spark.createDataFrame(odd, PAGES).coalesce(1).write.parquet(src)
    ingest_pages.run(spark, src, out, f"{tmp_path}/mark", config_of("ingest_pages"))
    got = {r["url"]: r for r in ingest_pages.result(spark, out).collect()}
    assert sorted(got) == ["https://example.org/", "https://example.org/n", "page:1", "page:2"]
    assert got["page:1"]["site"] == "" and got["page:1"]["n_chars"] == 1 and got["page:2"]["n_chars"] == 0
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/none")
    ingest_pages.run(spark, f"{tmp_path}/none", f"{tmp_path}/out2", f"{tmp_path}/mark2", config_of("ingest_pages"))


def words(n, start=0):
    return " ".join(f"word{start + i}" for i in range(n)) + "."


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_clean_corpus_reasons_and_refresh(spark, tmp_path):
    notice = "This notice stands on every single page of ours."
    texts = [f"{notice}\n{words(40, i * 50)}" for i in range(8)] + [words(40, 0).upper(), notice, None, "", words(10, 900), "a b c d e f g h i j k l m n o p q r s t u v w x y z."]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}" if i != 3 else None, 0) for i, t in enumerate(texts)], DOCS)
    src, out = f"{tmp_path}/docs", f"{tmp_path}/out"
    docs.write.parquet(src)
    config = config_of("clean_corpus") | {"boilerplate_fraction": 0.3}
    clean_corpus.run(spark, src, out, config)
    status = {r["doc_id"]: r["status"] for r in clean_corpus.result(spark, out).collect()}
    assert status == {**dict.fromkeys(range(8), "kept"), 8: "duplicate", 9: "empty", 10: "empty", 11: "empty", 12: "short", 13: "garbage"}
    clean = spark.read.schema(clean_corpus.CLEAN).parquet(f"{out}/clean")
    assert clean.filter(F.col("text").contains("notice")).count() == 0 and clean.filter("source IS NULL").count() == 1
    first = rows(clean_corpus.result(spark, out))
    clean_corpus.run(spark, src, out, config)
    assert rows(clean_corpus.result(spark, out)) == first
    # only s1 is written again
    changed = docs.withColumn("text", F.when(F.col("doc_id").isin(1, 2), words(5)).otherwise(F.col("text")))
    changed.write.parquet(f"{tmp_path}/docs2")
    clean_corpus.run(spark, f"{tmp_path}/docs2", out, config | {"sources": ["s1"]})
    now = {r["doc_id"]: r["status"] for r in clean_corpus.result(spark, out).collect()}
    assert now == status | {1: "short"}
    report = {(r["source"], r["status"]): int(r["documents"]) for r in spark.read.option("header", True).csv(f"{out}/report").collect()}
    assert sum(report.values()) == 14 and report["s0", "short"] == 2  # the report is of all


def test_clean_corpus_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/docs")
    clean_corpus.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out", config_of("clean_corpus"))
    assert clean_corpus.result(spark, f"{tmp_path}/out").count() == 0


def test_command_line(tmp_path):
    (tmp_path / "own.json").write_text(json.dumps({"boilerplate_min_documents": 7}))
    assert config_of("clean_corpus", str(tmp_path / "own.json")) == {"boilerplate_fraction": 0.02, "boilerplate_min_documents": 7, "sources": None}
    done = subprocess.run([sys.executable, "-m", "jobs.ingest_pages", "--help"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and "--checkpoint" in done.stdout


ODD = ["", " ", "a", "a b\nc d.", "a  b", " a", "a\n", "a\n\nb", "a\tb! c?", "é x", "a b", "x\x1cy z", "x\x1f y", "a\r\nb", None, " ".join("abcdefghij" * 3), "\n".join(["Home x"] * 12), "Ἑλλάς ΣΑΣ\nİx"]


def test_facts_say_what_the_expressions_say(spark):
    from textloom.functions import text as T

    rows = spark.createDataFrame(list(enumerate(ODD)), "i int, text string").select("i", "text", T.facts("text").alias("f"))
    f = F.col("f")
    for got, want in ((T.looks_like_nav("text", f), T.looks_like_nav("text")), (T.looks_like_garbage("text", f), T.looks_like_garbage("text")), (T.text_hash("text", f["even"]), T.text_hash("text")), (F.coalesce(f["words"].cast("long"), T.word_count("text")), T.word_count("text"))):
        assert [r["text"] for r in rows.filter(~got.eqNullSafe(want)).collect()] == []
    assert {r["text"] for r in rows.filter("f.even").collect()} == {"", "a", "a b\nc d.", *ODD[-3:]}


def test_texts_are_moved_once_and_lose_what_a_join_would_take(spark):
    from jobs.clean_corpus import judged
    from textloom.operators import blocks

    line = "the same line of twenty letters and more"
    rows = [(i, f"own {i} words\n{line}" + ("\nx  y" if i % 2 else "\n\n" + line.upper()), "en", "s") for i in range(20)]
    rows += [(3, f"second text\n{line}", "de", "r"), (40, None, None, None), (41, line, "en", "s"), (42, "x\x1cy z", "en", "s")]
    docs, held = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), []
    got = {r["doc_id"]: r["text"] for r in judged(docs, 0.1, 5, held).collect()}
    # ids and hashes are kept on the way, no paragraphs
    assert held[0].columns == ["doc_id", "h", "counts"]
    paras = blocks.paragraphs(docs, "doc_id")
    want = {r["doc_id"]: r["text"] for r in blocks.strip_boilerplate(paras, blocks.boilerplate(paras, docs, "doc_id", 0.1, 5), "doc_id").collect()}
    assert {k: v for k, v in got.items() if v} == want and got[40] == got[41] == "" and got[3] == "own 3 words\nsecond text\nx  y"
    for x in held:
        x.unpersist()
