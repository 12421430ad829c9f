"""Pluggable parts: embedders, token counters, rewriters and answerers. The defaults are deterministic and need no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import config
from textloom.functions import text as T
from textloom.scratch import bounded_batches


class Embedder(Protocol):
    """``rows`` with an array<double> column ``out`` of unit vectors for the texts of ``text_col``; ``query`` marks questions."""

    dim: int

    def embed(self, rows: DataFrame, text_col: str, out: str, query: bool = False) -> DataFrame: ...


class HashingEmbedder:
    """Signed feature hashing of the terms of a text into ``dim`` places, unit length. Each term's place and sign come from its MD5."""

    prefix = ""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def column(self, text: Column) -> Column:
        dim = self.dim

        def run(parts):
            import hashlib
            import re

            import numpy as np
            import pandas as pd

            class Places(dict):
                """Places of terms; forgets all when it has many."""

                def __missing__(self, term):
                    if len(self) > 100_000:
                        self.clear()
                    n = int(hashlib.md5(term.encode()).hexdigest()[:8], 16)
                    self[term] = got = (n % dim, 1.0 if n // dim % 2 == 0 else -1.0)
                    return got

            places, terms = Places(), re.compile("[a-z0-9]{3,}")
            for p in parts:
                out = []
                for t in p:
                    at = [places[x] for x in terms.findall((t or "").lower())]
                    v = np.bincount([a for a, _ in at], [s for _, s in at], dim) if at else np.zeros(dim)
                    out.append(v / (np.sqrt((v * v).sum()) or 1.0))
                yield pd.Series(out)

        return F.pandas_udf(_iterates(run), "array<double>")(text)

    def embed(self, rows: DataFrame, text_col: str, out: str, query: bool = False) -> DataFrame:
        bounded_batches(rows.sparkSession)  # a worker holds a batch's texts, not 10,000 texts of any length
        text = F.concat(F.lit(self.prefix), F.col(text_col)) if query and self.prefix else F.col(text_col)
        return rows.withColumn(out, self.column(text))


class PrecomputedEmbedder:
    """Vectors from a table (id, embedding), joined by the rows' id."""

    def __init__(self, vectors: DataFrame, id_col: str, dim: int):
        self.vectors, self.id_col, self.dim = vectors, id_col, dim

    def embed(self, rows: DataFrame, text_col: str, out: str, query: bool = False) -> DataFrame:
        return rows.join(self.vectors.select(self.id_col, F.col("embedding").cast("array<double>").alias(out)), self.id_col)


class ModelEmbedder:
    """Any model: ``load()`` runs once a task and returns a function from a list of texts to unit vectors; batches come by Arrow."""

    def __init__(self, load: Callable[[], Callable[[list[str]], list[list[float]]]], dim: int, query_prefix: str = "", batch: int = config.SETTINGS.embedding_batch_size):
        self.load, self.dim, self.query_prefix, self.batch = load, dim, query_prefix, batch

    def embed(self, rows: DataFrame, text_col: str, out: str, query: bool = False) -> DataFrame:
        load, size = self.load, self.batch
        bounded_batches(rows.sparkSession)

        def run(parts):
            import pandas as pd

            model = load()
            for p in parts:
                texts = p.fillna("").tolist()
                yield pd.Series([list(map(float, v)) for lo in range(0, len(texts), size) for v in model(texts[lo : lo + size])])

        udf = F.pandas_udf(_iterates(run), "array<double>")
        prefix = self.query_prefix if query else ""
        return rows.withColumn(out, udf(F.concat(F.lit(prefix), F.coalesce(F.col(text_col), F.lit("")))))


def _iterates(f):
    """The iterator form of a pandas UDF is known by its annotations."""
    import pandas as pd

    f.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return f


def _iterates_two(f):
    """The same for two columns."""
    import pandas as pd

    f.__annotations__ = {"frames": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return f


_REGISTRY: dict[str, Callable[[], Embedder]] = {"hashing": HashingEmbedder}
_MADE: dict[str, Embedder] = {}


def register_embedder(name: str, make: Callable[[], Embedder]) -> None:
    _REGISTRY[name] = make
    _MADE.pop(name, None)


def get_embedder(name: str = "hashing") -> Embedder:
    """One embedder a name; an unknown name is an error."""
    if name not in _REGISTRY:
        raise ValueError(f"unknown embedder {name!r}; known: {sorted(_REGISTRY)}")
    return _MADE.setdefault(name, _REGISTRY[name]())


TokenCounter = Callable[[Column], Column]


def whitespace_tokens(text: Column) -> Column:
    """The default token counter: white-space words."""
    return T.word_count(text)


def model_tokens(load: Callable[[], Callable[[list[str]], list[int]]]) -> TokenCounter:
    """A counter by a tokenizer that ``load()`` makes once a batch stream."""

    def count(text: Column) -> Column:
        def run(parts):
            import pandas as pd

            counter = load()
            for p in parts:
                yield pd.Series(counter(p.fillna("").tolist()))

        return F.pandas_udf(_iterates(run), "long")(text)

    return count


class Rewriter(Protocol):
    """A standalone question from a follow-up and its history."""

    def rewrite(self, question: Column, history: Column) -> Column: ...


class IdentityRewriter:
    def rewrite(self, question: Column, history: Column) -> Column:
        return question


class FunctionRewriter:
    """Any model as a rewriter: ``load()`` runs once a task and returns a function (question, history) to a text.

    A question without history stays as it is and never meets the model; so does one for which the model fails or says nothing.
    """

    def __init__(self, load: Callable[[], Callable[[str, str], str | None]]):
        self.load = load

    def rewrite(self, question: Column, history: Column) -> Column:
        load = self.load

        def run(frames):
            import pandas as pd

            model = None
            for asked, before in frames:
                out = []
                for q, h in zip(asked, before, strict=True):
                    said = None
                    if h:
                        try:
                            model = model or load()
                            said = (model(q, h) or "").strip()
                        except Exception:  # the question itself will do
                            said = None
                    out.append(said or q)
                yield pd.Series(out, dtype=object)

        return F.pandas_udf(_iterates_two(run), "string")(question, F.coalesce(history, F.lit("")))


class Answerer(Protocol):
    """An answer with ``[n]`` markers from the ranked passages array<struct<rank, text, ..>>."""

    def answer(self, question: Column, passages: Column) -> Column: ...


class ExtractiveAnswerer:
    """The first sentence of each of the best passages with its marker."""

    def __init__(self, passages: int = 3):
        self.passages = passages

    def answer(self, question: Column, passages: Column) -> Column:
        best = F.slice(passages, 1, self.passages)
        said = F.transform(best, lambda p: F.concat(F.coalesce(F.try_element_at(T.sentences(p["text"]), F.lit(1)), F.lit("")), F.lit(" ["), p["rank"].cast("string"), F.lit("]")))
        return F.array_join(said, " ")


class FunctionAnswerer:
    """Any model as an answerer: ``load()`` runs once a task and returns a function (question, context) to an answer.

    ``context`` renders the passages. A call that fails is an error of the query that names its cause; nothing is answered in its place.
    """

    def __init__(self, load: Callable[[], Callable[[str, str], str]], context: Callable[[Column], Column]):
        self.load, self.context = load, context

    def answer(self, question: Column, passages: Column) -> Column:
        load = self.load

        def run(frames):
            import pandas as pd

            model = None
            for asked, given in frames:
                out = []
                for q, c in zip(asked, given, strict=True):
                    if c is None:  # a question without passages is refused before
                        out.append(None)
                        continue
                    try:
                        model = model or load()
                        out.append((model(q, c) or "").strip())
                    except Exception as e:
                        raise RuntimeError(f"the answerer failed: {e}") from e
                yield pd.Series(out, dtype=object)

        return F.pandas_udf(_iterates_two(run), "string")(question, F.when(passages.isNotNull(), self.context(passages)))
