"""A model's token count: greedy longest-match pieces over a trie, from a vocabulary file with a piece a line.

Text is cleaned and cut as uncased models have it: control characters go, Han characters and punctuation stand alone, letters are lower-cased and lose
their accents (unless ``cased``). A word is then cut from the left into the longest pieces of the vocabulary, those after the first under
``##``; a word that cannot be cut, or of more than ``LONGEST`` characters, is one unknown token. No special tokens are counted.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LONGEST = 100
#: Words whose count a worker remembers.
REMEMBERED = 200_000
#: The blocks of Han characters, first and last code point (fixed values).
HAN = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))
CONTINUED = "##"


def _stands_alone(c: str) -> bool:
    """Punctuation, which includes every ASCII symbol, and Han characters."""
    o = ord(c)
    return 33 <= o <= 47 or 58 <= o <= 64 or 91 <= o <= 96 or 123 <= o <= 126 or unicodedata.category(c)[0] == "P" or any(a <= o <= b for a, b in HAN)


class _Characters(dict):
    """What a character becomes in ``str.translate``."""

    def __missing__(self, o: int) -> str:
        c = chr(o)
        kind = unicodedata.category(c)
        if c in "\t\n\r" or kind == "Zs":
            out = " "
        elif o in (0, 0xFFFD) or kind[0] == "C":
            out = ""
        else:
            out = f" {c} " if _stands_alone(c) else c
        self[o] = out
        return out


class WordPiece:
    """Counts, and cuts, by a vocabulary."""

    def __init__(self, vocabulary: list[str], cased: bool = False):
        self.cased, self.characters, self.known = cased, _Characters(), {}
        self.first, self.next = {}, {}
        for piece in vocabulary:
            root, rest = (self.next, piece[len(CONTINUED) :]) if piece.startswith(CONTINUED) and len(piece) > len(CONTINUED) else (self.first, piece)
            for c in rest:
                root = root.setdefault(c, {})
            root[""] = piece

    def words(self, text: str) -> list[str]:
        if not self.cased:
            text = "".join(c for c in unicodedata.normalize("NFD", text.translate(self.characters)) if unicodedata.category(c) != "Mn").lower()
            return text.translate(self.characters).split()
        return text.translate(self.characters).split()

    def cut(self, word: str) -> list[str] | None:
        """The pieces of a word, or None if it is unknown."""
        out, at = [], 0
        while at < len(word) <= LONGEST:
            node, end, i = self.next if at else self.first, 0, at
            while i < len(word) and (node := node.get(word[i])) is not None:
                i += 1
                if "" in node:
                    end, piece = i, node[""]
            if not end:
                return None
            out.append(piece)
            at = end
        return out or None

    def count(self, text: str | None) -> int:
        total = 0
        for w in self.words(text or ""):
            n = self.known.get(w)
            if n is None:
                if len(self.known) > REMEMBERED:
                    self.known.clear()
                n = self.known[w] = len(self.cut(w) or (w,))
            total += n
        return total


class WordPieceTokens:
    """A token counter for Columns, in Arrow batches: of a text when called, ``each`` of an array of texts. A null text has 0 tokens."""

    def __init__(self, spark: SparkSession, path: str, cased: bool = False):
        lines = spark.read.text(path, wholetext=True).first()
        self.shared = spark.sparkContext.broadcast([x for x in (lines[0] if lines else "").split("\n") if x])
        self.cased = cased

    def _udf(self, kind: str, of):
        import pandas as pd

        shared, cased = self.shared, self.cased

        def run(parts):
            model = WordPiece(shared.value, cased)  # once a task
            for p in parts:
                yield pd.Series([of(model, x) for x in p], dtype=object if kind.startswith("array") else "int64")

        run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, kind)

    def __call__(self, text: Column) -> Column:
        return self._udf("long", lambda model, x: model.count(x))(text)

    def each(self, texts: Column) -> Column:
        return self._udf("array<long>", lambda model, xs: None if xs is None else [model.count(x) for x in xs])(texts)
