"""Token counts by a vocabulary against the public library and a plain loop, and chunks cut by them."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from textloom.functions import text as T
from textloom.operators import chunks
from textloom.wordpiece import WordPiece, WordPieceTokens

PIECES = ["[UNK]", "a", "b", "c", "th", "the", "##e", "##re", "##s", "ing", "##ing", "un", "##aff", "##able", "naive", "日", "##", ".", ",", "!", "-", "1", "##2", "##3", "x"]


@pytest.fixture(scope="module")
def vocabulary(tmp_path_factory):
    """A vocabulary of the fixture's own: all letters, and the commonest starts and ends of words of the documents."""
    letters = [chr(c) for c in range(33, 127)] + list("àâäáçéèêëíîïñóôöùûüúßœ")
    pieces = dict.fromkeys([*PIECES, *letters, *("##" + x for x in letters if x.isalnum())])
    rng = random.Random(1)
    for _ in range(600):
        pieces["".join(rng.choice("adehinorst") for _ in range(rng.randrange(2, 5)))] = None
        pieces["##" + "".join(rng.choice("adehinorst") for _ in range(rng.randrange(2, 4)))] = None
    path = tmp_path_factory.mktemp("vocab") / "vocab.txt"
    path.write_text("\n".join(pieces) + "\n", encoding="utf-8")
    return str(path), list(pieces)


def plain(word, known):
    """Greedy longest match by trying every end."""
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in known:
                out.append(piece)
                at = end
                break
        else:
            return None
    return out


ODD = [None, "", "  \n", "The theres unaffable!", "NAÏVE naïve\x00 �", "日本 日", "x" * 101, "x" * 100, "a b c", "Ünïcödé ##ing", "1,234.5-6", "é́", "İstanbul", "​zero", "ß ẞ"]


@pytest.mark.parametrize("cased", [False, True])
def test_counts_equal_the_library_and_a_plain_loop(spark, vocabulary, cased):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    path, pieces = vocabulary
    t = Tokenizer(models.WordPiece({p: i for i, p in enumerate(pieces)}, unk_token="[UNK]", max_input_chars_per_word=100))
    t.normalizer = normalizers.BertNormalizer(lowercase=not cased, strip_accents=not cased)
    t.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    model, known = WordPiece(pieces, cased), set(pieces)
    for x in texts:
        assert model.count(x) == len(t.encode(x or "", add_special_tokens=False).tokens), x
        for w in model.words(x or ""):
            assert model.cut(w) == (plain(w, known) if len(w) <= 100 else None)
    counter = WordPieceTokens(spark, f"file://{path}", cased)
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", counter(F.col("t")).alias("n"), counter.each(F.array("t", "t")).alias("two")).collect()
    assert all(r["n"] == model.count(texts[r["i"]]) and r["two"] == [r["n"]] * 2 for r in got)


def test_chunks_by_the_model_keep_its_limit(spark, vocabulary):
    path, pieces = vocabulary
    counter, model = WordPieceTokens(spark, f"file://{path}"), WordPiece(pieces)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    cut = chunks.chunk_documents(docs, counter).collect()
    words = {(r["doc_id"], r["piece_ord"]): r["text"] for r in chunks.chunk_documents(docs).collect()}
    assert all(r["token_count"] == model.count(r["text"]) for r in cut)
    assert len(cut) > len(words)  # pieces are shorter than words
    top = chunks.S.chunk_max_tokens
    over = [r for r in cut if r["token_count"] > top]
    long = {r["s"] for r in docs.select(F.explode(T.sentences(T.squeeze_blanks("text"))).alias("s")).collect() if model.count(r["s"]) > top - chunks.S.chunk_overlap_tokens}
    assert all(any(s in r["text"] or r["text"] in s for s in long) for r in over)  # an over-long sentence, or one behind an overlap
