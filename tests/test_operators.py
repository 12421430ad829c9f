"""Folds and scalar functions against short Python models, and the invariants of the corpus."""

import random
import re
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from textloom import config
from textloom.functions import text as T
from textloom.functions import urls as U
from textloom.operators import answer, blocks, chunks, crawl, curated, index_store, search, sessions
from textloom.sources import fetch


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").repartition(1)
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("x")).alias("y")).collect()]


def test_urls_resolve_like_the_standard_library(spark):
    base = "https://www.Example.org/a/b/c.html?q=1"
    refs = ["d", "./d", "../d", "../../d", "../../../d", "/x/./y/../z", "?p=2", "//other.org/k", "http://h.org/p#f", "", "e/", "..", ".", "d;p=1", "/x//y"]
    got = column(spark, refs, lambda c: U.resolve(c, F.lit(base)))
    assert [g.replace("www.Example", "www.example") for g in got] == [urljoin(base, r).split("#")[0].replace("www.Example", "www.example") if r != "http://h.org/p#f" else r for r in refs]


def test_urls_normalise(spark):
    cases = {
        "HTTP://user@WWW.Example.org:8080/a//": "https://example.org:8080/a", "https://example.org": "https://example.org/", "https://x.org/p;v=1?q#f": "https://x.org/p?q", "mailto:a@b.c": None, "me@site.org": None, "#top": None,
        "ftp://x.org/": None, " https://x.org/a ": "https://x.org/a", "javascript:void(0)": None, "": None, "tel:1": None,
    }
    assert column(spark, list(cases), U.normalize) == list(cases.values())
    assert all(urlparse(v).scheme == "https" for v in cases.values() if v)


def test_traps_and_priorities(spark):
    urls = ["https://x.org/page/4", "https://x.org/page/3", "https://x.org/page/99999999999999999999", "https://x.org/tag/a/page/12/", "https://x.org/2024/01/02/", "https://x.org/?transaction=1", "https://x.org/about", None]
    assert column(spark, urls, U.is_trap)[:7] == [True, False, True, True, True, True, False]
    assert column(spark, ["https://x.org/tax/agenda", "https://x.org/tax", "https://x.org/minutes", "https://x.org/x"], U.priority) == [0, -10, 10, 0]


def sentences_model(text):
    out = []
    for line in re.split(r"\n+", text):
        out += re.split(r"""(?<=[.!?])["')\]]?\s+(?=[A-Z0-9("'\[])""", line)
    return [x.strip() for x in out if x.strip()]


def chunk_model(text, size, overlap):
    n = lambda t: len(t.split())
    if n(text) <= size:
        return [text.strip()] if text.strip() else []
    out, cur = [], []
    for s in sentences_model(text):
        if n(s) > size:
            if cur:
                out.append(" ".join(cur))
                cur = []
            w = s.split()
            out += [" ".join(w[a : a + size]) for a in range(0, (len(w) - overlap) // (size - overlap) * (size - overlap) + 1, size - overlap) if w[a : a + size]]
            continue
        if sum(map(n, cur)) + n(s) > size and cur:
            out.append(" ".join(cur))
            tail, k = [], 0
            for x in reversed(cur):
                if k + n(x) > overlap:
                    break
                tail.insert(0, x)
                k += n(x)
            cur = tail
        cur.append(s)
    return out + ([" ".join(cur)] if cur else [])


def test_chunker_equals_model(spark):
    rng = random.Random(5)
    texts = [" ".join(" ".join(rng.choice(["Alpha", "beta", "g"]) for _ in range(rng.randint(1, 30))).capitalize() + rng.choice([".", "!", ".", ""]) for _ in range(rng.randint(0, 20))) for _ in range(120)]
    got = column(spark, texts, lambda c: chunks.chunk_section(c, 40, 10))
    assert got == [chunk_model(t, 40, 10) for t in texts]


def heading_model(md, title):
    stack, buf, out = [], [], []

    def flush():
        body = "\n".join(buf).strip()
        buf.clear()
        if body:
            path = []
            for p in [h for _, h in stack]:
                if not path or path[-1] != p:
                    path.append(p)
            out.append((" > ".join(path) or title, body))

    for raw in md.split("\n"):
        line = raw.strip()
        m = re.match(r"^(#{1,6})\s+(.*)$", line)
        if m:
            flush()
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            label = m[2].strip().strip("#").strip()
            if label:
                stack.append((len(m[1]), label))
        elif line.lower() in config.CHROME_LINES:
            pass
        else:
            buf.append(line)
    flush()
    return out


def test_heading_fold_equals_model(spark):
    rng = random.Random(7)
    lines = ["# A", "## B", "## B ##", "### C", "# ", "text one", "more text", "", "Skip to content", "menu", "#### D"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 14))) for _ in range(200)]
    got = column(spark, texts, lambda c: blocks.markdown_blocks(c, F.lit("Title")))
    assert [[(b["heading_path"], b["text"]) for b in g] for g in got] == [heading_model(t, "Title") for t in texts]


def test_ratio_and_fuzzy(spark):
    pairs = [("comissioner", "commissioner", 95.65), ("sherif", "sheriff", 92.31), ("kitten", "sitting", 61.54), ("107th", "104th", 80.0)]
    df = spark.createDataFrame([p[:2] for p in pairs], "a string, b string")
    assert [round(r[0], 2) for r in df.select(T.indel_ratio("a", "b")).collect()] == [p[2] for p in pairs]
    assert [round(r[0], 2) for r in df.select(search.ratio_udf()(F.col("a"), F.col("b"))).collect()] == [p[2] for p in pairs]
    vocab = spark.createDataFrame([("commissioner", 3), ("sheriff", 2), ("104th", 2)], "term string, n_chunks long")
    terms = spark.createDataFrame([("comissioner",), ("107th",), ("sheriff",), ("zzz",)], "term string")
    assert [(r["term"], r["match"]) for r in search.fuzzy_matches(terms, vocab).collect()] == [("comissioner", "commissioner")]


def test_limiter_equals_model(spark):
    rng = random.Random(3)
    events = [(u, t, i) for i, (u, t) in enumerate((rng.randint(0, 3), rng.randint(0, 300)) for _ in range(300))]
    df = spark.createDataFrame(events, "u int, t long, id int").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["id"]: r["limited"] for r in sessions.rate_limited(df, ["u"], "ts", "id", window_us=60_000_000, limit=4).collect()}
    hits, want = {}, {}
    for u, t, i in sorted(events, key=lambda e: (e[1], e[2])):
        live = [h for h in hits.get(u, []) if t - h <= 60]
        want[i] = len(live) >= 4
        hits[u] = live if want[i] else [*live, t]
    assert got == want


def test_citations_and_refusals(spark):
    said = ["a [1][3][1][99] b", config.SETTINGS.not_available_message, "none", "[99999999999999999999] [2]", config.SETTINGS.not_available_message + " [1]", ""]
    assert column(spark, said, lambda c: answer.citation_numbers(c, F.lit(3))) == [[1, 3], [], [], [2], [1], []]
    assert column(spark, said, answer.is_refusal) == [False, True, False, False, False, False]


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = index_store.upsert(old, new, "k")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, index_store.upsert(once, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_corpus_store(spark, tmp_path):
    store = index_store.CorpusStore(spark, f"file://{tmp_path}/index")
    assert store.count() == 0
    store.rebuild(spark.createDataFrame([("ext::a", 1), ("b", 2)], "chunk_id string, v int"))
    store.upsert(spark.createDataFrame([("ext::c", 3)], "chunk_id string, v int"), "chunk_id", purge="ext::")
    assert sorted(r[0] for r in store.read().collect()) == ["b", "ext::c"]
    assert store.versions() == [1, 2]


def test_answer_scenarios(spark):
    from textloom.embedders import HashingEmbedder

    texts = ["The sheriff office opens at nine. Call first.", "Road permits cost ten dollars. Pay at the desk.", "Parks close at dusk. Bring water."]
    rows = [(str(i), f"u{i}", "t", "h", t) for i, t in enumerate(texts * 2)]
    corpus = HashingEmbedder(64).embed(spark.createDataFrame(rows, "chunk_id string, source_url string, page_title string, heading_path string, text string"), "text", "embedding")
    vocab = search.vocabulary(corpus)
    asked = spark.createDataFrame([(1, "When does the sherif office opens at nine?"), (2, "quantum chromodynamics lagrangian zebra"), (3, "")], "query_id int, question string")
    got = {r["query_id"]: r for r in answer.answer(asked, corpus, vocab, HashingEmbedder(64)).collect()}
    assert got[1]["grounded"] and "[1]" in got[1]["answer"] and got[1]["citations"][0]["n"] == 1
    for q in (2, 3):
        assert not got[q]["grounded"] and got[q]["citations"] == [] and got[q]["answer"] == config.SETTINGS.not_available_message


def test_retries_and_throttle():
    calls, slept = [], []

    def flaky(url):
        calls.append(url)
        if len(calls) < 2:
            raise OSError
        return fetch.Response(500 if len(calls) < 3 else 200, "text/html", "x")

    assert fetch.with_retries(flaky, 3, 1.5, slept.append)("u").status == 200
    assert slept == [1.5, 2.25]  # base ** 1, base ** 2
    assert fetch.with_retries(lambda u: fetch.Response(404, "", ""), 3, 1.5, slept.append)("u").status == 404
    now = [0.0]
    gate = fetch.Throttle(2.0, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    starts = []
    for _ in range(3):
        gate.wait()
        starts.append(now[0])
    assert starts == [0.0, 0.5, 1.0]


def test_sitemaps_and_crawl(spark):
    fetched = spark.createDataFrame([("r", '<sitemapindex xmlns="x"><sitemap><loc>s1</loc></sitemap></sitemapindex>'), ("s1", '<urlset xmlns="x"><url><loc>https://a.org/1</loc></url><url><loc>https://a.org/2</loc></url></urlset>')], "url string, xml string")
    assert sorted(r[0] for r in crawl.expand_sitemaps(spark.createDataFrame([("r",)], "url string"), fetched).collect()) == ["https://a.org/1", "https://a.org/2"]
    pages = spark.createDataFrame([(1, "https://a.org/", '<a href="/b">x</a><a href="https://z.com/">y</a>'), (2, "https://a.org/b", '<a href="/c">x</a>'), (3, "https://a.org/c", "")], "page_id long, url string, html string")
    got = crawl.crawl(spark.createDataFrame([("https://a.org/",)], "url string"), fetch.table_fetch(pages), ("a.org",))
    assert sorted(r["page_id"] for r in got.collect()) == [1, 2, 3]


def test_link_grids(spark):
    html = '<div class="vc_row"><div><img alt="All Portals"></div><a class="gem-button" href="/t">Tax</a></div><div id="buttonsections"><a class="gem-button" href="/x">A <b>b</b></a></div>'
    got = curated.link_grids(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")).orderBy("page_id").collect()
    assert [(g["grid"], g["label"], g["href"]) for g in got[0]["grids"]] == [("buttons", "A b", "/x"), ("portals", "Tax", "/t")]
    assert got[1]["grids"] == []


def test_settings_from_env(monkeypatch):
    monkeypatch.setenv("MAX_PAGES", "7")
    monkeypatch.setenv("RENDER_ALL_HTML", "yes")
    monkeypatch.setenv("CHUNK_MAX_TOKENS", "")
    s = config.Settings.from_env()
    assert (s.max_pages, s.render_all_html, s.chunk_max_tokens) == (7, True, 480)


def test_nulls_and_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert chunks.chunk_documents(empty).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t ")], "doc_id long, text string")
    assert chunks.chunk_documents(odd).count() == 0
    assert pytest.approx(chunks.process_stats(chunks.chunk_documents(odd)).first()["avg_tokens"]) == 0.0
