"""Files in and out, fetching with a browser behind it, pluggable models, and the service's state."""

import json

import pytest
from pyspark.sql import functions as F

from textloom import embedders
from textloom.functions import html as H
from textloom.operators import answer, index_store, sessions
from textloom.sources import corpus_files, fetch


def test_pages_skip_what_is_malformed_and_chunks_do_not(spark, tmp_path):
    (tmp_path / "pages.jsonl").write_text('{"url": "https://x.org/a", "title": "A", "is_pdf": false}\n\nnot json\n{"title": "no url"}\n')
    assert [(r["url"], r["title"]) for r in corpus_files.read_pages(spark, f"file://{tmp_path}/pages.jsonl").collect()] == [("https://x.org/a", "A")]
    (tmp_path / "chunks.jsonl").write_text('{"chunk_id": "1", "text": "t"}\n{"chunk_id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        corpus_files.read_chunks(spark, f"file://{tmp_path}/chunks.jsonl").collect()


def test_last_record_of_a_url_wins(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text("".join(json.dumps({"url": u, "is_pdf": p}) + "\n" for u, p in (("a", True), ("b", False), ("a", False), ("b", True), ("c", None))))
    assert {r["url"]: r["is_pdf"] for r in corpus_files.read_crawled_urls(spark, f"file://{tmp_path}/log.jsonl").collect()} == {"a": False, "b": True, "c": False}


def test_saved_pages_and_pdfs(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<p>one\ntwo \xff</p>")
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    got = corpus_files.read_saved_html(spark, f"file://{tmp_path}/a.html").collect()
    assert len(got) == 1 and got[0]["path"].endswith("a.html") and got[0]["html"].startswith("<p>one\ntwo ")
    assert [(r["length"], r["text"]) for r in corpus_files.read_pdf_texts(spark, f"file://{tmp_path}", 1.0).collect()] == [(6, "")]


def test_logs_grow_and_reports_are_replaced(spark, tmp_path):
    rows = spark.createDataFrame([("https://x.org/\t\"a\"", "http-500")], "url string, reason string")
    for _ in range(2):
        corpus_files.append_failures(rows, f"file://{tmp_path}/log")
    back = spark.read.schema("url string, reason string").option("sep", "\t").csv(f"file://{tmp_path}/log")
    assert [tuple(r) for r in back.collect()] == [tuple(rows.first())] * 2
    for n in (3, 2):
        corpus_files.write_text_report(spark.range(n).select(F.col("id").cast("string").alias("value")), f"file://{tmp_path}/report")
    assert sorted(r[0] for r in spark.read.text(f"file://{tmp_path}/report").collect()) == ["0", "1"]


def test_browser_stands_in_only_where_asked():
    answers = {"ok": (200, "text/html", "<p>x</p>"), "wall": (403, "text/html", "no"), "blob": (200, "text/html", "\x01\x02"), "pdf": (200, "application/pdf", "<p>"), "gone": (404, "text/html", "<p>")}

    def plain(url):
        if url == "down":
            raise OSError(url)
        return fetch.Response(*answers[url])

    drawn = []
    run = fetch.with_browser(plain, fetch.Browser(lambda: lambda u: drawn.append(u) or f"<p>{u}</p>"))
    assert [getattr(run(u), "body", None) for u in ("ok", "wall", "blob", "pdf", "gone", "down")] == ["<p>x</p>", "<p>wall</p>", "<p>blob</p>", "<p>pdf</p>", None, "<p>down</p>"]
    assert drawn == ["wall", "blob", "pdf", "down"]
    assert fetch.with_browser(plain, fetch.Browser(lambda: lambda u: "<p>all</p>"), always=True)("ok").body == "<p>all</p>"


def test_a_browser_that_fails_stays_off():
    tries = []

    def start():
        tries.append(1)
        raise RuntimeError("no browser")

    b = fetch.Browser(start)
    assert [b.render("a"), b.render("b")] == [None, None] and b.off and len(tries) == 1


def test_fetch_all_and_page_source(spark):
    def plain(url):
        return fetch.Response(403, "text/html", "") if url.endswith("2") else fetch.Response(200, "text/html", f"<p>{url}</p>")

    urls = spark.createDataFrame([(f"https://h{i}.org/{i}",) for i in range(4)], "url string")
    got = {r["url"]: (r["http_status"], r["raw_html"]) for r in fetch.fetch_all(urls, lambda: plain, browser=lambda: lambda u: "<p>drawn</p>").collect()}
    assert got["https://h2.org/2"] == (200, "<p>drawn</p>") and got["https://h1.org/1"] == (200, "<p>https://h1.org/1</p>") and len(got) == 4
    fetch.register_page_source(spark)
    rows = spark.read.format("textloom_pages").option("urls", " ".join(f"https://h{i % 3}.org/{i}" for i in range(10))).option("fetcher", "tests.fetchers:echo").option("perPartition", "3").load()
    assert rows.rdd.getNumPartitions() == 4
    assert {r["url"]: r["raw_html"] for r in rows.collect()} == {f"https://h{i % 3}.org/{i}": f"https://h{i % 3}.org/{i}" for i in range(10)}


def test_embedders_and_counters(spark):
    rows = spark.createDataFrame([(0, "ab"), (1, None), (2, "abcd")], "id long, text string")
    made = embedders.ModelEmbedder(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], 2, "q: ", batch=2)
    assert [r["v"] for r in made.embed(rows, "text", "v").orderBy("id").collect()] == [[2, 1], [0, 1], [4, 1]]
    assert [r["v"][0] for r in made.embed(rows, "text", "v", query=True).orderBy("id").collect()] == [5, 3, 7]
    vectors = spark.createDataFrame([(0, [1.0]), (2, [2.0])], "id long, embedding array<float>")
    assert [(r["id"], r["v"]) for r in embedders.PrecomputedEmbedder(vectors, "id", 1).embed(rows, "text", "v").orderBy("id").collect()] == [(0, [1.0]), (2, [2.0])]
    count = embedders.model_tokens(lambda: lambda texts: [len(t) for t in texts])
    assert [r[0] for r in rows.orderBy("id").select(count(F.col("text"))).collect()] == [2, 0, 4]
    with pytest.raises(ValueError, match="unknown embedder"):
        embedders.get_embedder("none")


def test_rewriter_falls_back_and_answerer_does_not(spark):
    def rewrite(question, history):
        if question == "boom":
            raise OSError
        return "" if question == "blank" else f" {history}/{question} "

    rows = spark.createDataFrame([("a", ""), ("b", "h"), ("boom", "h"), ("blank", "h"), ("c", None)], "q string, h string")
    new = embedders.FunctionRewriter(lambda: rewrite).rewrite(F.col("q"), F.col("h"))
    assert {r["q"]: r["n"] for r in rows.select("q", new.alias("n")).collect()} == {"a": "a", "b": "h/b", "boom": "boom", "blank": "blank", "c": "c"}
    ps = F.array(F.struct(F.lit(1).alias("rank"), F.lit("u").alias("source_url"), F.lit("h").alias("heading_path"), F.lit("body").alias("text")))
    said = embedders.FunctionAnswerer(lambda: lambda q, c: f"{q} {'body' in c} [1]", answer.context_block).answer(F.col("q"), F.when(F.col("q") != "a", ps))
    assert {r["q"]: r["n"] for r in rows.select("q", said.alias("n")).collect()}["b"] == "b True [1]"

    def fails(question, context):
        raise OSError("no model")

    with pytest.raises(Exception, match="the answerer failed: no model"):
        rows.select(embedders.FunctionAnswerer(lambda: fails, answer.context_block).answer(F.col("q"), ps)).collect()


def test_two_writers_of_a_store_lose_nothing(spark, tmp_path):
    store = index_store.CorpusStore(spark, f"file://{tmp_path}/store")
    assert answer.health(store) == {"status": "ok", "indexed_chunks": None, "model": "extractive"}
    rows = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "id long, text string")
    assert store.rebuild(rows(1, 2)) == 1
    late = store._aside(rows(9))
    assert store.upsert(rows(3), "id") == 2
    assert not store._commit(late, 2) and store._commit(late, 3)
    assert store.versions() == [1, 2, 3] and {r["id"] for r in store.read(2).collect()} == {1, 2, 3} and store.count() == 1
    # another writer takes the number between an upsert's reading and its commit
    other, taken = index_store.CorpusStore(spark, store.path), []
    commit = store._commit

    def beaten(aside, version):
        if not taken:
            taken.append(other.upsert(rows(10), "id"))
        return commit(aside, version)

    store._commit = beaten
    assert store.upsert(rows(11), "id") == 5 and taken == [4]
    assert {r["id"] for r in store.read().collect()} == {9, 10, 11}
    assert answer.health(store)["indexed_chunks"] == 3


def test_reset_forgets_one_session(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "session string, n int")
    assert [[r["n"] for r in t.orderBy("n").collect()] for t in sessions.reset(rows, rows, "session", "a")] == [[2, 3], [2, 3]]


def test_tables_in_markdown(spark):
    page = "<body><main><h2>Fees</h2><table><tr><th>Kind</th><th> Fee</th></tr><tr><td>Car</td><td>$5 <b>a year</b></td></tr></table><p>End</p></main></body>"
    assert spark.range(1).select(H.to_markdown(F.lit(page))).first()[0] == "## Fees\n| Kind | Fee |\n| Car | $5 a year |\nEnd"
