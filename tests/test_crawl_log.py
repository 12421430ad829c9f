"""The streaming page log: growing url files, a failed run, and calls spaced by host."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.sources import fetch
from textloom.streaming import crawl


def ask(folder, name, urls):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"url": u}) for u in urls) + "\n")


def client():
    def get(url):
        if url.endswith("down"):
            raise OSError(url)
        return fetch.Response(404, "text/html", "gone") if url.endswith("gone") else fetch.Response(200, "application/pdf" if url.endswith("pdf") else "text/html", "<title>T</title><p>" + url)

    return get


def test_runs_over_growing_files(spark, tmp_path):
    asked, out, point = tmp_path / "asked", str(tmp_path / "out"), str(tmp_path / "point")
    calls = []

    def get(todo):
        calls.append(sorted(r["url"] for r in todo.collect()))
        return todo.select("url", F.when(~F.col("url").endswith("down"), F.when(F.col("url").endswith("gone"), 404).otherwise(200)).alias("http_status"), F.lit("text/html").alias("content_type"), F.concat(F.lit("<title>T</title><p>"), "url").alias("raw_html"), F.lit("now").alias("fetch_timestamp"))

    ask(asked, "1.json", ["https://a.org/x", "https://www.a.org/x/", "http://a.org/gone", "mailto:a@b.org", None, "https://b.org/down"])
    crawl.fetch_new(spark, str(asked), out, point, get)
    first = sorted((r["url"], r["outcome"], r["title"]) for r in crawl.log(spark, out).collect())
    assert first == [("https://a.org/gone", "http-404", None), ("https://a.org/x", "html", "T"), ("https://b.org/down", "fetch-failed", None)]
    crawl.fetch_new(spark, str(asked), out, point, get)
    assert len(calls) == 1  # nothing new, no call
    ask(asked, "2.json", ["https://a.org/x", "https://c.org/y", "https://b.org/down"])

    def broken(todo):
        return get(todo).withColumn("raw_html", F.when(F.col("url").endswith("y"), F.raise_error(F.lit("killed"))).otherwise(F.col("raw_html")))

    with pytest.raises(Exception, match="killed"):
        crawl.fetch_new(spark, str(asked), out, point, broken)
    assert sorted((r["url"], r["outcome"], r["title"]) for r in crawl.log(spark, out).collect()) == first  # no half batch
    crawl.fetch_new(spark, str(asked), out, point, get)
    log = crawl.log(spark, out)
    assert sorted((r["url"], r["batch"]) for r in log.collect()) == [("https://a.org/gone", 0), ("https://a.org/x", 0), ("https://b.org/down", 0), ("https://c.org/y", 1)]
    assert calls[-1] == ["https://c.org/y"]
    assert sorted(tuple(r) for r in crawl.failures(log).collect()) == [("https://a.org/gone", "http-404"), ("https://b.org/down", "fetch-failed")]
    assert sorted(r["url"] for r in crawl.page_records(log).collect()) == ["https://a.org/x", "https://c.org/y"]


def test_with_the_fetch_hook(spark, tmp_path):
    ask(tmp_path / "asked", "1.json", ["https://a.org/x", "https://b.org/gone", "https://b.org/a.pdf"])
    crawl.fetch_new(spark, str(tmp_path / "asked"), str(tmp_path / "out"), str(tmp_path / "point"), lambda todo: fetch.fetch_all(todo, client, per_second=50))
    got = sorted((r["url"], r["outcome"], r["raw_html"], r["is_pdf"]) for r in crawl.log(spark, str(tmp_path / "out")).collect())
    assert got == [("https://a.org/x", "html", "<title>T</title><p>https://a.org/x", False), ("https://b.org/a.pdf", "pdf", None, True), ("https://b.org/gone", "http-404", None, False)]


def test_hosts_take_turns():
    urls = ["https://a.org/1", "https://a.org/2", "https://b.org/1", "https://A.org/3", None, "https://b.org/2"]
    assert fetch.in_turns(urls) == ["https://a.org/1", "https://b.org/1", None, "https://a.org/2", "https://b.org/2", "https://A.org/3"]
    now, slept = [0.0], []
    gate = fetch.Throttle(2.0, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for h in ("a", "b", "a", "b", "c", "a"):
        gate.wait(h)
    assert slept == [0.5, 0.5]  # the second calls of a and b pass together, the third of a waits
