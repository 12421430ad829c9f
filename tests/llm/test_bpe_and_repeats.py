"""Byte-level BPE against the public library, and runs against a scan of every period."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tests.conftest import SF
from tests.llm.test_llm import ODD, WORD, docs
from textloom.llm import bpe, queries, repeats


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.RANKS), special_tokens={})


def noise(seed, n):
    rng = random.Random(seed)
    parts = ["word", "It's", " we'll", "  ", " \n", "\t\t ", "123", " 4567", "日本", "é", "...", " !?", "x" * 90, "　", "🙂", "<|endoftext|>", "'", "'s"]
    return "".join(rng.choice(parts) for _ in range(n))


@pytest.mark.parametrize("chunk, overlap", [(1 << 15, 1 << 9), (60, 12), (9, 3)])
def test_ids_equal_the_library(spark, monkeypatch, library, chunk, overlap):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    monkeypatch.setattr(bpe, "OVERLAP", overlap)
    texts = ODD[:8] + ["é" * 700, "x " * 400, "ab" * 300 + " " * 50 + "z", " " * 200, "'s" * 90, "<|endoftext|> a"] + [noise(s, 80) for s in range(12)]
    got = bpe.decode(bpe.encode(docs(spark, texts))).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    for r in got:
        t = texts[r["doc_id"]] or ""
        assert r["ids"] == library.encode_ordinary(t), t
        assert bytes(r["decoded"]) == t.encode()
        assert (r["text"], r["__gone"]) == (texts[r["doc_id"]], "x")


def test_repeated_rows_null_ids_and_clashing_names(spark, monkeypatch, library):
    monkeypatch.setattr(bpe, "CHUNK", 40)
    monkeypatch.setattr(bpe, "OVERLAP", 8)
    rows = [(None, "long text " * 30, [1], 7, "t"), (1, "long text " * 30, None, 7, "t"), (1, "long text " * 30, None, 7, "t"), (2, None, None, None, None)]
    given = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, row long, at string")
    got = bpe.encode(given).collect()
    want = library.encode_ordinary(rows[0][1])
    assert sorted((r["doc_id"] or 0, r["ids"] == want, r["row"]) for r in got if r["text"]) == [(0, True, 7), (1, True, 7), (1, True, 7)]
    assert [r["ids"] for r in got if r["doc_id"] == 2] == [[]]
    assert bpe.encode(given.limit(0)).count() == 0
    assert [bytes(r["decoded"]) for r in bpe.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>")).collect()] == [b"", b""]


def plainly_merged(piece, ranks):
    """Of all neighbours the pair of the lowest rank is merged, the leftmost first, until no pair has a rank."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_ids_of_a_piece_equal_plain_merging():
    ranks, rng = bpe.read_ranks(bpe.RANKS), random.Random(4)
    encoder = bpe.Encoder(ranks, bpe.PATTERN)
    for _ in range(300):
        piece = "".join(rng.choice("abcdeéth日 's") for _ in range(rng.randrange(1, 150)))
        assert np.frombuffer(encoder[piece], np.int32).tolist() == plainly_merged(piece.encode(), ranks)
    assert max(map(len, encoder)) <= bpe.LONGEST_REMEMBERED


def test_op11_on_the_whole_table(spark, library):
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_byte_bpe(spark, SF).collect()
    assert len(got) == len(text)
    for r in got:
        ids = library.encode_ordinary(text[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


# runs -----------------------------------------------------------------------------------------------------------------------------------


def scanned(words, least, times):
    """(start, length, period) of all runs, by looking at every period."""
    n, best = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                best.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in best.items())


@pytest.mark.parametrize("least, times", [(24, 3), (6, 2), (4, 2), (5, 3), (2, 2)])
def test_runs_equal_a_scan(least, times):
    rng = random.Random(least)
    for _ in range(60):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            n, k = rng.randrange(0, 90), rng.choice([1, 2, 3, 5])
            t, p, a = [rng.randrange(k) for _ in range(n)], rng.randrange(1, 7), rng.randrange(n + 1)
            texts.append([t[i] if i < a else t[a + (i - a) % p] if a + p <= n else 0 for i in range(n)] if rng.random() < 0.6 else t)
        got = repeats.runs_of(np.array(sum(texts, []), np.int64), np.array([len(t) for t in texts]), least, times)
        assert [tuple(r) for r in got.tolist()] == [(i, s, n, q) for i, t in enumerate(texts) for s, n, q in sorted(scanned(t, least, times), key=lambda r: (r[0], r[2]))]


def test_leaves_are_asked_in_parts(monkeypatch):
    word = [0, 1]
    for _ in range(9):
        word = word + word[: len(word) * 2 // 3]
    whole = repeats.runs_of(np.array(word), np.array([len(word)]), 6, 2)
    monkeypatch.setattr(repeats, "LEAVES", 7)
    assert (repeats.runs_of(np.array(word), np.array([len(word)]), 6, 2) == whole).all() and len(whole)


def test_periodic_runs_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(repeats, "WORDS", 50)
    rows = [(None, None, 1), (1, [], 2), (1, ["a"] * 30, 3), (1, ["a"] * 30, 3), (2, ["x", *["é", ""] * 20, "y"], None), (3, [None, None, "b"] * 12, 4), (4, [str(i) for i in range(300)], 5)]
    given = spark.createDataFrame(rows, "doc_id long, words array<string>, runs int")
    got = repeats.periodic_runs(given, "words").collect()
    assert repeats.periodic_runs(given, "words").columns == ["doc_id", "runs", "collapsed"]
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(([tuple(x) for x in r["runs"]], r["collapsed"]))
    assert by[None] == [([], "")]
    assert sorted(by[1]) == [([], ""), ([(0, 30, 1)], "a"), ([(0, 30, 1)], "a")]
    assert by[2] == [([(1, 40, 2)], "x é  y")]
    assert by[3] == [([(0, 36, 3)], "  b")]
    assert by[4] == [([], " ".join(map(str, range(300))))]
    assert repeats.periodic_runs(given.limit(0), "words").count() == 0


def test_op12_equals_a_scan_on_the_whole_table(spark):
    docs_ = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op12_runs(spark, SF).collect()}
    assert len(got) == len(docs_)
    for d in docs_:
        w, h = WORD.findall(d["text"] or ""), zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        if len(w) > 2500:
            continue  # a scan of every period takes too long here; the SQL looks at these too
        runs = sorted(scanned(w, 24, 3), key=lambda r: (r[0], r[2]))
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        r = got[d["doc_id"]]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
