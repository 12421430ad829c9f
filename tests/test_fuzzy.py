"""Fuzzy matching through rare pairs of letters, against a comparison of every pair."""

import random

import pytest

from textloom.operators import search
from textloom.scratch import materialize


def ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _step(row, x, b)
    return 200.0 * row[-1] / (len(a) + len(b))


def _step(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
    return out


def sample(seed):
    rng = random.Random(seed)
    vocab = {"".join(rng.choice("abcde1") for _ in range(rng.randrange(3, 15))) for _ in range(250)} | {"aaaa", "aaaaaaaa", "banana", "abcdefghijklmnopqrst"}
    typos = set()
    for w in sorted(vocab):
        t = list(w)
        for _ in range(rng.choice([1, 1, 2, 3])):
            i = rng.randrange(len(t) + 1)
            t[i : i + rng.choice([0, 1, 1])] = rng.choice(["", "a", "z", "b"])
        typos.add("".join(t))
    return sorted(x for x in typos if len(x) >= 4), sorted(vocab)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_equal_a_comparison_of_every_pair(spark, seed):
    typos, vocab = sample(seed)
    terms, words = (spark.createDataFrame([(x,) for x in c], "term string") for c in (typos, vocab))
    got = {}
    for r in search.fuzzy_matches(terms, words).collect():
        got.setdefault(r["term"], []).append((r["rank"], r["match"], round(r["score"], 6)))
    want = {}
    for t in set(typos) - set(vocab):
        near = sorted((-s, w) for w in vocab if (s := ratio(t, w)) >= search.S.fuzzy_min_score)[: search.S.fuzzy_max_matches_per_term]
        if near:
            want[t] = [(i, w, round(-s, 6)) for i, (s, w) in enumerate(near, 1)]
    assert {t: sorted(x) for t, x in got.items()} == want and len(want) > 30


@pytest.mark.parametrize("least", [50, 70, 82, 95])
def test_candidates_hold_every_match(spark, least):
    typos, vocab = sample(3)
    terms, words = (spark.createDataFrame([(x,) for x in c], "term string") for c in (typos, vocab))
    got = {tuple(r) for r in search.fuzzy_candidates(terms, words, least).collect()}
    want = {(t, w) for t in typos for w in vocab if ratio(t, w) >= least}
    assert want <= got
    if least >= 82:
        assert len(got) < len(typos) * len(vocab) / 4


def test_no_nested_loop(spark):
    terms = spark.createDataFrame([("comissioner",)], "term string")
    plan = search.fuzzy_candidates(terms, terms.selectExpr("'commissioner' AS term"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_vocabulary_is_not_broadcast(spark):
    """Small files, yet the sizes that count are those in memory: both joins with the vocabulary are merge joins, whatever its file's size."""
    vocab = materialize(spark.range(3000).selectExpr("concat('commissioner', id) AS term"), "vocab")
    plan = search.fuzzy_matches(spark.createDataFrame([("comissioner1",)], "term string"), vocab)._jdf.queryExecution()
    assert "strategy=merge" in plan.optimizedPlan().toString()
    assert plan.executedPlan().toString().count("SortMergeJoin [m#") == 1
    typos = spark.createDataFrame([("comissioner1",)], "term string")
    assert "BroadcastHashJoin [m#" not in search.fuzzy_candidates(typos, vocab)._jdf.queryExecution().executedPlan().toString()
