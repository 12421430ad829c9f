"""Quality classification by hierarchical empirical Bayes.

A document's evidence is the log-odds of a logistic regression on ``FEATURES`` of its whole text, fitted on at most ``MAX_SAMPLE`` labelled
rows. Sites give the prior: each host's quality is shrunk towards the global mean, each path's towards its host's, by the strengths that
the spread between hosts, and between the paths of a host, calls for (method of moments): a sparse site stays near what lies above it.
Site counts are sums over all documents, of labels where there are any and of the classifier's probabilities elsewhere; a document is taken
out of its own path's count. The posterior adds the path's log-odds, less the global ones, to the evidence.

All counts are grouped aggregates; the driver reads a few sums. The join of documents with their paths is of two written tables, so a
hot site is split by the skew-join rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bounded_batches, materialize

MAX_SAMPLE = 8192
RIDGE = 1.0
KEEP = 0.5
FEATURES = ("log_bytes", "log_words", "word_length", "distinct_words", "doubled_words", "upper", "digit", "stop", "pipe", "symbol", "other_mark", "decorated_words", "lines", "distinct_lines", "short_lines", "long_words")
_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?", b"|", b"!#$%&*@^~+=<>{}[]\\_", b"'\"()-/`"), 1):
    _CLASS[list(_chars)] = _i
_DECORATED = re.compile(rb"[^\s\w.,;:?'\")\x80-\xff-]{2,}(?=\s|$)")


def features(text: str | None) -> list[float]:
    """Numbers that describe the whole text; an empty one gives zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, m = len(raw), len(words)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=7) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        np.log1p(n) / 10, np.log1p(m) / 8, (n / m) / 10, len(set(words)) / m, doubled / m, *kinds[1:7] * [2, 5, 10, 10, 10, 10],
        min(1.0, len(_DECORATED.findall(raw)) / m), np.log1p(len(lines)) / 5, len(set(lines)) / len(lines), sum(len(x) < 30 for x in lines) / len(lines), sum(len(w) > 25 for w in words) / m,
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [[float(v) for v in features(t.as_py())] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])


def expand(x: np.ndarray) -> np.ndarray:
    """A constant, the features and their squares."""
    return np.c_[np.ones(len(x)), x, x**2]


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of a ridge-penalised logistic regression by Newton's method; a constant model if there is only one class."""
    z = expand(x)
    w = np.zeros(z.shape[1])
    if len(y) == 0:
        return w
    base = (y.sum() + 1) / (len(y) + 2)
    w[0] = np.log(base / (1 - base))
    if y.min() == y.max():
        return w
    penalty = np.r_[0.0, np.full(z.shape[1] - 1, RIDGE)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * np.maximum(p * (1 - p), 1e-6)[:, None]) + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The classifier, from the ``MAX_SAMPLE`` labelled documents of the smallest hashes; of a repeated id the row of the smallest hash of its text, so that no more rows reach the driver."""
    chosen = labels.select("id", "y").orderBy(F.xxhash64(F.lit(11), "id"), "id", "y").limit(MAX_SAMPLE)
    own = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id")  # MAX_SAMPLE ids at most
    least = own.groupBy("id", "y").agg(F.min_by(F.struct("text"), F.struct(F.xxhash64("text"), F.length("text"))).alias("r"))
    rows = least.select("y", F.col("r.text").alias("text")).mapInArrow(_measured, "y double, x array<double>").collect()
    rows = sorted((r["y"], tuple(r["x"])) for r in rows)
    return fit(np.array([r[1] for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([r[0] for r in rows], float))


def evidence(docs: DataFrame, w: np.ndarray) -> Column:
    """A Column function of the text: the classifier's log-odds, within 30 of 0."""
    shared = docs.sparkSession.sparkContext.broadcast(w)

    @F.pandas_udf("double")
    def run(texts):
        import pandas as pd

        x = np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))
        return pd.Series(np.clip(expand(x) @ shared.value, -30, 30))

    return run


def _strength(groups: DataFrame, n: str, s: str, above: Column, mean: float) -> float:
    """Pseudo-count of the level above, by moments: what the groups' means vary beyond what their sizes explain."""
    m = F.col(s) / F.col(n)
    r = groups.agg(F.sum(F.col(n) * (m - above) ** 2), F.sum(n), F.sum(F.col(n) * F.col(n)), F.count(F.lit(1))).first()
    if not r[1] or r[3] < 2:
        return 1e6
    within = max(mean * (1 - mean), 1e-9)
    room = r[1] - r[2] / r[1]
    between = (r[0] - (r[3] - 1) * within) / room if room > 0 else 0.0
    return float(min(1e6, max(1.0, within / between - 1))) if between > 0 else 1e6


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, keep: float = KEEP) -> DataFrame:
    """One row per document: doc_id, p_doc, host_quality, path_quality, score, kept (score >= ``keep``).

    ``host`` and ``path`` are Columns of docs (source, and source with language, by default); null is a site of its own. ``labels`` has
    (doc_id, quality 0/1); several labels of an id are averaged, null ones do not count, and a label never judges its own document. A null
    text is empty. Without labels the classifier is a constant and every score one half. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    marks = materialize(labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.avg(F.col("quality").cast("double")).alias("y")), "labels")
    w = train(docs, marks.withColumn("y", F.round("y")))
    judged = materialize(docs.select(F.col("doc_id").cast("long").alias("doc"), host.cast("string").alias("host"), path.cast("string").alias("path"), evidence(docs, w)("text").alias("logit")), "evidence")
    rows = materialize(judged.join(marks, judged["doc"] == marks["id"], "left").select("doc", "host", "path", "logit", F.coalesce("y", 1 / (1 + F.exp(-F.col("logit")))).alias("y")), "judged")
    paths = materialize(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")), "paths")
    hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s")), "hosts")
    total = hosts.agg(F.sum("host_n"), F.sum("host_s")).first()
    mean = (total[1] + 1) / (total[0] + 2) if total[0] else 0.5
    k0 = _strength(hosts, "host_n", "host_s", F.lit(mean), mean)
    hosts = hosts.withColumn("host_quality", (F.col("host_s") + k0 * mean) / (F.col("host_n") + k0))
    sites = paths.join(hosts.select(F.col("host").alias("h"), "host_quality"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    sites = materialize(sites.select(F.col("host").alias("h"), F.col("path").alias("p"), "n", "s", "host_quality"), "sites")
    k1 = _strength(sites, "n", "s", F.col("host_quality"), mean)
    joined = rows.join(sites, rows["host"].eqNullSafe(sites["h"]) & rows["path"].eqNullSafe(sites["p"]))
    without = (F.greatest(F.col("s") - F.col("y"), F.lit(0.0)) + k1 * F.col("host_quality")) / (F.col("n") - 1 + k1)
    logit = lambda p: F.log(F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9)))
    odds = F.col("logit") + logit(F.col("path_quality")) - float(np.log(mean / (1 - mean)))
    return joined.withColumn("path_quality", without).select(
        F.col("doc").alias("doc_id"), (1 / (1 + F.exp(-F.col("logit")))).alias("p_doc"), "host_quality", "path_quality", (1 / (1 + F.exp(-odds))).alias("score")
    ).withColumn("kept", F.col("score") >= keep)
