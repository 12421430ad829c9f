"""Language identification by string kernels, Nyström landmarks and kernel ridge regression.

The kernel of two texts counts the character n-grams (n = 1 .. ``MAX_N``) present in both, over the geometric mean of their numbers: a
blended-spectrum presence kernel, on n-grams hashed to ``BUCKETS`` places. ``MAX_SAMPLE`` labelled texts at most, as many of each language,
are the training set; ``LANDMARKS`` of them span the Nyström features K(x, L) K(L, L)^-1/2, on which a ridge regression is fitted for each
language against the rest. A text's scores are K(x, L) A = P (F A): as the kernel is a product of presence vectors, F A is worked out once,
and batches of texts are scored by one product of their presence matrix P with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import bounded_batches, new_name

MAX_N = 4
BUCKETS = 1 << 16
MAX_SAMPLE = 2048
LANDMARKS = 256
RIDGE = 1e-3
#: Steepness of the scores' soft maximum.
STEEP = 4.0
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def presence(text: str, out: np.ndarray) -> None:
    """Set the places of all n-grams of a text's lower case in a row of ``BUCKETS``."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(c), np.uint64)
        for n in range(1, min(MAX_N, len(c)) + 1):
            h = (h[: len(c) - n + 1] + c[n - 1 :] + np.uint64(n)) * _A
            out[((h ^ (h >> np.uint64(31))) * _B >> np.uint64(48)).astype(np.int64)] = 1


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, packed presence)."""
    for batch in batches:
        out = []
        for t in batch.column(1):
            row = np.zeros(BUCKETS, np.uint8)
            presence(t.as_py() or "", row)
            out.append(np.packbits(row).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["lang", "bits"])


def training_sample(docs: DataFrame, may_learn: Column) -> DataFrame:
    """(lang, text): at most ``MAX_SAMPLE`` labelled rows with a text for which ``may_learn`` holds, spread evenly over the languages by a hash of the id.

    An id gives one row at most, however often it is repeated: of its rows that may be learned from, the one of the smallest hash.
    """
    may = docs.filter(F.coalesce(may_learn, F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rows = may.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang"), "text")
    known = rows.select("id", "lang", (F.xxhash64(F.lit(7), "id") / 2.0**64 + 0.5).alias("u"))
    # a language beyond the MAX_SAMPLE most frequent ones cannot have a row in the sample
    counts = known.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_SAMPLE)
    sizes = {r["lang"]: r["n"] for r in counts.collect()}
    each = max(1, MAX_SAMPLE // max(1, len(sizes)))
    # far more than enough ids pass by hash before the exact choice, so no task gets a whole language
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 8.0 * each / n))]) if sizes else F.create_map(F.lit(""), F.lit(0.0))
    w = Window.partitionBy("lang").orderBy("u", "id")
    passed = known.filter(F.col("u") < F.coalesce(share[F.col("lang")], F.lit(0.0))).distinct()
    chosen = passed.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= each).select("id").distinct()
    own = rows.join(F.broadcast(chosen), "id")  # MAX_SAMPLE ids at most
    # an id's rows meet as one value a task, never as a list
    least = own.groupBy("id").agg(F.min_by(F.struct("lang", "text"), F.struct(F.xxhash64("lang", "text"), F.col("lang"))).alias("r"))
    return least.select(F.col("r.lang").alias("lang"), F.col("r.text").alias("text"))


class Model:
    """Languages and the folded matrix F A, with its bias."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray):
        self.langs, self.weights, self.bias = langs, weights, bias

    @classmethod
    def fit(cls, labels: list[str], rows: np.ndarray) -> Model:
        """From labels and packed presence rows; works in small batches, as a row unpacked to floats takes 256 KB."""
        langs = sorted(set(labels))
        if not langs:
            return cls([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
        y = np.where(np.array(labels)[:, None] == np.array(langs)[None, :], 1.0, -1.0)
        marks = _unit(rows[_turns(labels)[:LANDMARKS]])  # landmarks in turn from each language
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        ok = values > 1e-6 * values.max()
        root = vectors[:, ok] / np.sqrt(values[ok])
        near = np.concatenate([_unit(rows[lo : lo + 64]) @ marks.T for lo in range(0, len(rows), 64)])
        z = np.c_[near.astype(np.float64) @ root, np.ones(len(rows))]
        w = 1.0 / (y > 0).sum(axis=0)  # each language weighs alike
        out = np.zeros((z.shape[1], len(langs)))
        for c in range(len(langs)):
            each = np.where(y[:, c] > 0, w[c], 1.0 / max(1, (y[:, c] < 0).sum()))
            each *= len(each) / each.sum()
            out[:, c] = np.linalg.solve(z.T @ (z * each[:, None]) + RIDGE * len(z) * np.eye(z.shape[1]) / 10, z.T @ (y[:, c] * each))
        return cls(langs, (marks.T @ (root @ out[:-1])).astype(np.float32), out[-1].astype(np.float32))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        good = [i for i, t in enumerate(texts) if self.langs and t and _LETTER.search(t)]
        p = np.zeros((min(64, len(good)), BUCKETS), np.float32)
        for lo in range(0, len(good), 64):
            at = good[lo : lo + 64]
            p[: len(at)] = 0
            for row, i in zip(p, at, strict=False):
                presence(texts[i], row)
            x = p[: len(at)]
            f = (x @ self.weights) / np.sqrt(np.maximum(1.0, x.sum(axis=1, keepdims=True))) + self.bias
            e = np.exp(STEEP * (f - f.max(axis=1, keepdims=True)).astype(np.float64))
            best = f.argmax(axis=1)
            for k, i in enumerate(at):
                names[i] = self.langs[best[k]]
                score[i] = e[k, best[k]] / e[k].sum()
        return names, score


def _unit(rows: np.ndarray) -> np.ndarray:
    """Packed presence rows as floats of unit length."""
    x = np.unpackbits(rows, axis=1).astype(np.float32)
    return x / np.sqrt(np.maximum(1.0, x.sum(axis=1, keepdims=True)))


def _turns(labels: list[str]) -> list[int]:
    seen: dict[str, int] = {}
    key = []
    for i, x in enumerate(labels):
        key.append((seen.setdefault(x, 0), x, i))
        seen[x] += 1
    return [i for _, _, i in sorted(key)]


def train(docs: DataFrame, may_learn: Column) -> Model:
    """A model from the labelled rows for which ``may_learn`` holds; what reaches the driver is bounded by ``MAX_SAMPLE`` rows of 8 KB."""
    bounded_batches(docs.sparkSession)
    got = sorted(((r["lang"], bytes(r["bits"])) for r in training_sample(docs, may_learn).mapInArrow(_bits, "lang string, bits binary").collect()))
    rows = np.frombuffer(b"".join(b for _, b in got), np.uint8).reshape(len(got), BUCKETS // 8)
    return Model.fit([k for k, _ in got], rows)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred and score in (0, 1], by the text alone.

    ``und`` with score 0 if the text is null or has no letter, or if nothing could be learned. Predictions are those of the whole text.
    Of equal scores the language of the smaller name wins. Columns that are called lang_pred or score are replaced, all others kept; repeated
    rows stay, and an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights, model.bias))

    @F.pandas_udf("lang_pred string, score double")
    def run(texts):
        import pandas as pd

        names, score = Model(*shared.value).predict(texts.tolist())
        return pd.DataFrame({"lang_pred": names, "score": score})

    told = new_name(docs, "told")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.withColumn(told, run(F.col(f"`{text_col}`"))).select(*kept, F.col(f"{told}.lang_pred"), F.col(f"{told}.score"))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4 (a null id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string")) % 4 == 2, F.lit(False))
