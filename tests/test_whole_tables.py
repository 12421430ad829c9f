"""The queries over whole tables and whole texts, against Python models on small tables."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tests.test_operators import chunk_model
from textloom import config
from textloom.functions import text as T
from textloom.operators import chunks
from textloom.plans import registry


def tables(spark, tmp_path, texts, questions=()):
    """A folder with documents and benchmark."""
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(questions)), "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    return f"file://{tmp_path}"


def test_chunks_of_documents_of_any_length(spark, tmp_path):
    rng = random.Random(7)
    texts = [" ".join(" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(5, 60))).capitalize() + "." for _ in range(n)) for n in (1, 5, 30, 60, 100, 8, 45)]
    texts += [texts[3], "Too short."]
    sf = tables(spark, tmp_path, texts)
    seen, reason = set(), {}
    for i, t in enumerate(texts):
        for k, c in enumerate(chunk_model(t, 480, 100)):
            reason[i, k] = "short" if len(c.split()) < 25 else "duplicate" if c in seen else "kept"
            seen |= {c} if reason[i, k] == "kept" else set()
    assert max(k for _, k in reason) > 2
    stats = registry.QUERIES["process_stats"](spark, sf).first()
    assert stats["pieces"] == len(reason) and (stats["dropped_nav"], stats["dropped_garbage"]) == (0, 0)
    assert [stats[x] for x in ("kept", "dropped_short", "dropped_duplicate")] == [sum(v == x for v in reason.values()) for x in ("kept", "short", "duplicate")]
    want, count = [], defaultdict(int)
    for (i, k), r in sorted(reason.items()):
        if r == "kept":
            want.append((i, k, i % 50, count[i % 50]))
            count[i % 50] += 1
    assert sorted(tuple(r)[:4] for r in registry.QUERIES["chunk_index"](spark, sf).collect()) == want
    assert sorted(tuple(r) for r in registry.QUERIES["chunk_drop_reasons"](spark, sf).collect()) == sorted((i, k, r) for (i, k), r in reason.items())


def test_boost_of_every_document(spark, tmp_path):
    rng = random.Random(8)
    words = "water permit office county clerk the of road src1".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(25)]
    asked = ["water permit office of county clerk", "road road src1 water the clerk now", "too few words"]
    got = {(r["query_id"], r["chunk_id"]): r["boost"] for r in registry.QUERIES["keyword_boost"](spark, tables(spark, tmp_path, texts, asked)).collect()}
    want = {}
    for q, question in enumerate(asked[:2]):
        w = question.split()
        terms = {t for t in [*w[:6], w[1][0] + w[1]] if len(t) >= 3 and t not in config.STOPWORDS}
        for i, t in enumerate(texts):
            hits = sum(1.0 if x == f"src{i % 3}" else 0.5 * (x in t.split()) for x in terms)
            want[q, i] = round(config.SETTINGS.keyword_boost_weight * min(1.0, hits / len(terms)), 6)
    assert got == want


def test_texts_beyond_their_heads(spark, tmp_path):
    """What stands after the 80th character counts: shortcodes, markers, hashes, embeddings and every second page."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    head = "word " * 20
    texts = [head + "[gallery x] tail", head + "[2] other", head]
    sf = tables(spark, tmp_path, texts)
    rows = [(c, 0, "assistant", t + "[3]") for c, t in ((0, head), (2, head), (3, head))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{sf}/conversations.parquet")
    spark.createDataFrame([(i, "u", "") for i in range(4)], "page_id long, url string, html string").write.parquet(f"{sf}/pages.parquet")
    run = lambda name: registry.QUERIES[name](spark, sf).collect()
    assert {r["doc_id"]: r["h"] for r in run("shortcode_strip")} == {i: sha("x  " + t.replace("[gallery x]", "") + " [keep]") for i, t in enumerate(texts)}
    assert sorted((r["conv_id"], r["pos"], r["n"]) for r in run("citation_extract")) == [(0, 0, 3), (0, 1, 1), (2, 0, 3), (3, 0, 3), (3, 1, 2)]
    assert {r["conv_id"]: r["h"] for r in run("citation_strip")}[2] == sha(head.strip())
    assert {r["conv_id"]: (r["h"], r["n_citations"]) for r in run("grounding_downgrade")}[2] == (sha(rows[1][3]), 1)
    assert len(run("refusals")) == 3 and len(run("hashing_embeddings")) == 3 * 64
    assert {r["doc_id"]: r["h"] for r in run("upsert_replace")} == {0: sha("new " + texts[0]), 1: sha(texts[1]), 2: sha(texts[2])}
    assert {r["page_id"] for r in run("court_judge_asof")} == {0, 1, 2, 3}


def test_frontier_holds_every_new_link(spark, tmp_path):
    """More new urls than any budget of the query once was: all of them come back."""
    html = "".join(f'<a href="/en/new{i}">x</a>' for i in range(150))
    spark.createDataFrame([(0, "https://thther.example.org/en/0", html)], "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    got = registry.QUERIES["frontier_step"](spark, f"file://{tmp_path}").collect()
    assert sorted(r["link_ord"] for r in got) == list(range(150))


def test_boost_cuts_words_before_rows_meet_questions(spark, tmp_path):
    """An exchange stands between the words and the pairs: without one the join's code cuts them again in each pair."""
    sf = tables(spark, tmp_path, ["water permit office"], ["water permit office of county clerk"])
    plan = registry.QUERIES["keyword_boost"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    pairs, dealt, cut = (next(i for i, x in enumerate(plan) if w in x) for w in ("Join Cross", "RepartitionByExpression", "split("))
    assert pairs < dealt < cut


def test_blanks_of_any_kind_without_patterns_over_whole_texts(spark):
    """Ends are trimmed without a pattern, words need no trimmed copy, and the chunker's fold casts no state."""
    blank = [chr(c) for c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    cases = [f"{b}{a}x{b}{a}y{a}" for a in blank for b in blank] + ["", " ", "".join(blank), "x", "\u200bx\x1c"]
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", T.trim_all("t"), T.words("t"), T.word_count("t"), T.squeeze("t")).collect()
    assert len(rows) == len(cases)
    for t, trimmed, words, n, squeezed in rows:
        model = "".join(" " if c in blank else c for c in t).split(" ")
        model = [w for w in model if w]
        assert trimmed == t.strip("".join(blank)) and words == model and n == len(model) and squeezed == " ".join(model)
    assert "regexp" not in T.trim_all(F.col("t"))._jc.toString()
    assert "cast(named_struct" not in spark.range(1).select(chunks.chunk_section(F.lit("x").cast("string")))._jdf.queryExecution().analyzed().toString().lower()
