"""The lexical index: candidates hold every match, lexical search through it equals the scan, and little is read."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import search
from textloom.operators.lexical_index import LexicalIndex, grams, lexical

ROWS = "chunk_id long, text string, embedding array<double>, block string"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(900)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(12)), [rng.random() for _ in range(4)], "b") for i in range(9000)]
    rows += [(9001, None, [1.0] * 4, "b"), (9002, "", [1.0] * 4, "b"), (9003, "ab", [1.0] * 4, "b"), (9004, "naïve 日本語 🙂🙂🙂", None, "b"), (9005, "Naïve " + "z" * 100_000, [1.0] * 4, "b")]
    rows = spark.createDataFrame(rows, ROWS).repartition(2).cache()
    index = LexicalIndex(spark, f"file://{tmp_path_factory.mktemp('lexical')}")
    index.build(rows.drop("block"))
    return rows, index, words


def holding(rows, words):
    return {(r["chunk_id"], w) for r in rows.select("chunk_id", "text").collect() for w in words if w and w in (r["text"] or "")}


def test_candidates_hold_every_match(spark, corpus):
    rows, index, words = corpus
    asked = [*words[:6], "naïve", "日本語", "🙂🙂🙂", "Naïve", "zzzz", "notthere", None]
    got = {r["chunk_id"] for r in index.candidates(spark.createDataFrame([(w,) for w in asked], "word string")).collect()}
    want = {i for i, _ in holding(rows, asked)}
    assert want <= got and len(got) < 2 * len(want) < 9000
    assert {9004, 9005} <= got
    whole = index.candidates(spark.createDataFrame([("ab",)], "word string"))
    assert whole.count() == rows.count() and whole.columns == ["chunk_id", "text", "embedding"]
    assert index.candidates(spark.createDataFrame([("qqqq",)], "word string")).count() == 0
    assert index.candidates(spark.createDataFrame([], "word string")).count() == 0


def test_lexical_search_through_the_index_equals_the_scan(spark, corpus):
    rows, index, words = corpus
    asked = [(q, [0.1 * q, 0.5, 0.2, 0.9], [words[q], words[q + 50][:4]], ["notthere"]) for q in range(5)]
    queries = spark.createDataFrame(asked, "query_id long, q_vec array<double>, terms array<string>, fuzzy array<string>")
    want = sorted(map(tuple, search.lexical(queries, rows).collect()))
    assert sorted(map(tuple, lexical(queries, index).collect())) == want and len(want) > 25


def test_only_the_lists_asked_for_are_read(spark, corpus):
    _, index, words = corpus
    one = spark.createDataFrame([(words[3],)], "word string")
    plan = index.candidates(one)._jdf.queryExecution().executedPlan().toString()
    assert "In(block" in plan.replace("block IN", "In(block") or "EqualTo(block" in plan
    assert index.lists.read().select("bucket").distinct().count() == 64


def test_an_empty_table(spark, tmp_path):
    index = LexicalIndex(spark, f"file://{tmp_path}/none")
    index.build(spark.createDataFrame([], "chunk_id long, text string"))
    assert index.candidates(spark.createDataFrame([("word",)], "word string")).count() == 0


def test_grams():
    assert len(grams("aaaa")) == 1 and len(grams("ab")) == len(grams(None)) == 0 and len(grams("🙂a🙂a")) == 2


def test_a_list_is_moved_once_however_many_words_ask_for_it(spark, corpus, monkeypatch):
    from textloom.operators import lexical_index

    rows, index, words = corpus
    asked = [words[0] + x for x in ("", "a", "b", "c")] + words[:40]
    want = {i for i, _ in holding(rows, asked)}
    frame = spark.createDataFrame([(w,) for w in asked], "word string")
    seen, common = [], lexical_index._common
    monkeypatch.setattr(lexical_index, "_common", lambda shared: seen.append(shared) or common(shared))
    once = {r["chunk_id"] for r in index.candidates(frame).collect()}
    known, places, begin = seen[0].value
    assert len(seen) == 1 and len(known) < len(places) and len(begin) == len(set(asked))
    monkeypatch.setattr(lexical_index, "ROUND_GRAMS", 40)
    assert want <= once == {r["chunk_id"] for r in index.candidates(frame).collect()} and len(seen) > 2
