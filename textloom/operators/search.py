"""Retrieval: exact dense top-k, lexical and typo-tolerant branches, keyword boost and the hybrid ranking.

Questions come as a table and are dealt by hash into rounds of about ``ROUND_BYTES``, so what is broadcast has a checked size whatever their number. Rows stay
where they are: in a round every task goes over its rows once, in Arrow batches, and returns each question's best ones only, so what shuffles
is in proportion to questions and tasks. All search terms of a round's questions are looked for by one automaton pass over each text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textloom import config
from textloom.functions import text as T
from textloom.scratch import bounded_batches, materialize

S = config.SETTINGS
ROUND_BYTES = 4 << 20
#: Rows of an Arrow batch that are scored at once.
SLAB = 1024


def dealt(queries: DataFrame, size: Column) -> list[DataFrame]:
    """``queries`` in rounds of about ``ROUND_BYTES`` by the Column ``size``."""
    total = queries.agg(F.sum(size)).first()[0] or 0
    rounds = max(1, -(-total // ROUND_BYTES))
    return [queries.filter(F.pmod(F.xxhash64(*queries.columns), F.lit(rounds)) == i) for i in range(rounds)] if rounds > 1 else [queries]


def boosts(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, chunk_id, boost): the keyword boost of every question with every row.

    ``queries`` has query_id and terms and is broadcast a round at a time. A row's words are cut once a round; only those that some question
    of the round asks for stay beside it and are compared in each pair, which finds what all of its words would.
    """
    once = queries.select("query_id", F.array_distinct("terms").alias("once"))
    out = None
    for q in dealt(once, 8 + F.aggregate("once", F.lit(0), lambda n, t: n + F.octet_length(t) + 8)):
        known = q.select(F.explode("once").alias("t")).agg(F.collect_set("t").alias("known"))
        cut = rows.crossJoin(F.broadcast(known)).select("chunk_id", F.array_intersect("known", T.whole_words("heading_path")).alias("head"), F.array_intersect("known", T.whole_words("text")).alias("body"))
        # dealt anew: evens the pairs out, and ends the stage, in which the join would cut a row's words again for each question
        dealt_out = cut.withColumn("either", F.array_union("head", "body")).select("chunk_id", "head", "either").repartition("chunk_id")
        met = dealt_out.crossJoin(F.broadcast(q))
        hits = (F.size(F.array_intersect("once", "head")) + F.size(F.array_intersect("once", "either"))) * 0.5
        boost = F.when((F.size("once") == 0) | (F.size("either") == 0), 0.0).otherwise(S.keyword_boost_weight * F.least(F.lit(1.0), hits / F.size("once")))
        met = met.select("query_id", "chunk_id", boost.alias("boost"))
        out = met if out is None else out.unionByName(met)
    return out


def top(rows: DataFrame, by: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; tasks cut to k before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w).cast("long")).filter(F.col(rank) <= k)


def rounded(x: np.ndarray) -> np.ndarray:
    """To four places, halves up by the decimal form, as SQL's round does."""
    from decimal import ROUND_HALF_UP, Decimal

    up = np.floor(np.abs(x) * 1e4 + 0.5)
    for at in zip(*np.nonzero(np.abs(np.abs(x) * 1e4 + 0.5 - np.rint(np.abs(x) * 1e4 + 0.5)) < 1e-6), strict=True):
        up[at] = float(Decimal(repr(float(abs(x[at])))).quantize(Decimal("0.0001"), ROUND_HALF_UP)) * 1e4
    return np.copysign(np.rint(up) / 1e4, x) + 0.0


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of each row of q with each of v; sums run over the places in order, as an expression's would."""
    dot, a, b = np.zeros((len(q), len(v))), np.zeros(len(q)), np.zeros(len(v))
    for j in range(min(q.shape[1], v.shape[1])):
        if q[:, j].any():
            dot += q[:, j][:, None] * v[:, j][None, :]
    for x, n in ((q, a), (v, b)):
        for j in range(x.shape[1]):
            n += x[:, j] * x[:, j]
    d = np.sqrt(a)[:, None] * np.sqrt(b)[None, :]
    return np.divide(dot, d, out=np.zeros_like(dot), where=d > 0)


def matrix(vectors: list, width: int) -> np.ndarray:
    """Vectors as rows; null ones and those of another size or with nulls are zero."""
    none = [0.0] * width
    return np.array([x if x and len(x) == width and None not in x else none for x in vectors], np.float64).reshape(len(vectors), width)


class _Best:
    """The k best (score, id) of each of n lists, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)]
        self.least = np.full(n, -np.inf)

    def add(self, at: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        ok = score >= self.least[at]
        at, ids, score = (np.concatenate([x, y[ok]]) for x, y in zip(self.rows, (at, ids, score), strict=True))
        turn = {x: i for i, x in enumerate(sorted(set(ids), key=lambda x: (x is not None, 0 if x is None else x)))}  # a null id comes first
        place = np.array([turn[x] for x in ids], int)
        order = np.lexsort((place, -score, at))
        at, ids, score = at[order], ids[order], score[order]
        turn = np.arange(len(at)) - np.searchsorted(at, at)
        self.least[at[turn == self.k - 1]] = score[turn == self.k - 1]
        self.rows = [x[turn < self.k] for x in (at, ids, score)]


def _scan(shared, pool: int, each: int, id_type):
    """mapInArrow over (id, vector[, text]), with the questions' ids of Arrow type ``id_type``: a task's ``pool`` best rows of each broadcast question, and the ``each`` best that hold each of its variants."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids, vectors, variants = shared.value
        owner = np.array([q for q, vs in enumerate(variants) for _ in vs], np.int64)
        known: dict[str, list[int]] = {}
        for slot, v in enumerate(v for vs in variants for v in vs):
            known.setdefault(v, []).append(slot)
        slots, find = [np.array(x, np.int64) for x in known.values()], _finder(list(known))
        dense, lists, kind = _Best(len(ids), max(1, pool)), _Best(len(owner), max(1, each)), None
        for batch in batches:
            kind = batch.column(0).type
            for lo in range(0, batch.num_rows, SLAB):
                part = batch.slice(lo, SLAB)
                own = np.array(part.column(0).to_pylist(), object)
                score = rounded(cosines(vectors, matrix(part.column(1).to_pylist(), vectors.shape[1])))
                if pool:
                    k = min(pool, len(own))
                    floor = -np.partition(-score, k - 1, axis=1)[:, k - 1]
                    q, c = np.nonzero(score >= np.maximum(floor, dense.least)[:, None])
                    dense.add(q, own[c], score[q, c])
                if slots:
                    found = [(c, i) for c, t in enumerate(part.column(2).to_pylist()) for i in find(t or "")]
                    if found:
                        at = np.concatenate([slots[i] for _, i in found])
                        c = np.repeat([c for c, _ in found], [len(slots[i]) for _, i in found])
                        lists.add(at, own[c], score[owner[at], c])
        first = np.r_[0, np.cumsum([len(vs) for vs in variants])[:-1]].astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        for best, question, ord_ in ((dense, lambda at: at, lambda at: np.full(len(at), -1)), (lists, lambda at: owner[at], lambda at: at - first[owner[at]])):
            at, got, score = best.rows
            if len(at) and kind is not None:
                yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q in question(at)], id_type), pa.array(ord_(at), pa.int32()), pa.array(got.tolist(), kind), pa.array(score)], ["query", "variant_ord", "row", "score"])

    return run


def _finder(words: list[str]):
    """A function from a text to the places in ``words`` of those that it holds."""
    try:
        import ahocorasick
    except ImportError:
        return lambda t: [i for i, w in enumerate(words) if w in t]
    if not words:
        return lambda t: ()
    machine = ahocorasick.Automaton()
    for i, w in enumerate(words):
        machine.add_word(w, i)
    machine.make_automaton()
    return lambda t: {i for _, i in machine.iter(t)}


def _found(queries: DataFrame, rows: DataFrame, q_id: str, q_vec: str, r_id: str, r_vec: str, pool: int, words: str | None = None, text: str | None = None) -> DataFrame:
    """(q_id, variant_ord, r_id, score, rank): the dense ``pool`` of each question (variant_ord -1) and, with ``words``, the nearest rows whose text holds each of them.

    ``queries`` is read twice, so it should be written. Null and empty vectors, and those of another size than the questions', score 0; rows without an id take part under null.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    wanted = queries.select(q_id, F.col(q_vec).cast("array<double>").alias("vec"), (F.col(words) if words else F.array().cast("array<string>")).alias("words"))
    size = F.octet_length(F.col(q_id).cast("string")) + 8 * F.size("vec") + F.aggregate("words", F.lit(0), lambda n, w: n + F.octet_length(w) + 8)
    source = rows.select(F.col(r_id), F.col(r_vec).cast("array<double>").alias("vec"), *([F.col(text).alias("text")] if text else []))
    id_type = to_arrow_type(queries.schema[q_id].dataType)
    kinds = f"query {queries.schema[q_id].dataType.simpleString()}, variant_ord int, row {rows.schema[r_id].dataType.simpleString()}, score double"
    out = None
    for part in dealt(wanted, size):
        got = part.collect()  # about ROUND_BYTES
        width = max((len(r["vec"]) for r in got if r["vec"]), default=0)
        shared = spark.sparkContext.broadcast(([r[0] for r in got], matrix([r["vec"] for r in got], width), [r["words"] or [] for r in got]))
        if got:
            met = source.mapInArrow(_scan(shared, pool, S.lexical_matches_per_term, id_type), kinds)
            out = met if out is None else out.unionByName(met)
    out = out if out is not None else spark.createDataFrame([], kinds)
    w = Window.partitionBy("query", "variant_ord").orderBy(F.desc("score"), "row")
    most = F.when(F.col("variant_ord") < 0, pool).otherwise(S.lexical_matches_per_term)
    ranked = out.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= most)
    return ranked.select(F.col("query").alias(q_id), "variant_ord", F.col("row").alias(r_id), "score", "rank")


def knn(queries: DataFrame, rows: DataFrame, k: int, q_vec: str, r_vec: str, q_id: str, r_id: str) -> DataFrame:
    """(q_id, r_id, score, rank): the k nearest by cosine, rounded to four places; ties to the smaller id."""
    return _found(queries, rows, q_id, q_vec, r_id, r_vec, k).drop("variant_ord")


def vocabulary(chunks: DataFrame, min_count: int = S.vocab_min_count) -> DataFrame:
    """(term, n_chunks): terms that stand in enough chunks."""
    terms = chunks.select(F.explode(T.vocab_terms("heading_path", "text")).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_chunks")).filter(F.col("n_chunks") >= min_count)


def ratio_udf():
    """``text.indel_ratio`` as an Arrow UDF: the LCS by bit-parallel additions, a step a letter. (The expression form folds cell by cell.)"""

    def run(a, b):
        import pandas as pd

        def ratio(x: str, y: str) -> float:
            masks: dict[str, int] = {}
            for i, c in enumerate(x):
                masks[c] = masks.get(c, 0) | 1 << i
            every = (1 << len(x)) - 1
            v = every
            for c in y:
                u = v & masks.get(c, 0)
                v = ((v + u) | (v - u)) & every
            return 200.0 * (len(x) - v.bit_count()) / ((len(x) + len(y)) or 1)

        return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    return F.pandas_udf(run, "double")


def bigrams(c: Column) -> Column:
    """The pairs of neighbouring letters, numbered where they repeat (``na#0``, ``an#0``, ``na#1``), so that sets of them meet as often as the words share pairs."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))
    return F.when(F.length(c) < 2, F.array().cast("array<string>")).otherwise(F.transform(pairs, lambda g, i: F.concat(g, F.lit("#"), F.size(F.filter(F.slice(pairs, 1, i), lambda x: x == g)).cast("string"))))


def fuzzy_candidates(typos: DataFrame, vocab: DataFrame, least: float = S.fuzzy_min_score) -> DataFrame:
    """(term, match): pairs that may have an insert-delete ratio of ``least``, a superset of those that have it, by an equi-join.

    A term of n letters and a match of m are at most d = (1 - least) (n + m) insertions and deletions apart, x letters of the term and y of the match.
    A deletion breaks two of the term's n - 1 pairs at most, an insertion one, so n - 1 - 2x - y pairs are shared and one of the term's
    2x + y + 1 rarest pairs is among them. Only those are looked up, by pair and length. Where that is more than the term has, every
    word of that length is a candidate (under the pair ``""``); with the default score that is never so from four letters on.
    The vocabulary grows with the corpus and a file of it is much smaller than its pairs in memory, so it is never broadcast.
    """
    far = 1 - least / 100
    known = vocab.select(F.col("term").alias("match"), F.length("term").alias("m"), F.explode(F.array_append(bigrams(F.col("term")), F.lit(""))).alias("gram"))
    # letters and digits make some thousand pairs, however large the vocabulary
    often = known.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    own = typos.select("term", F.explode(bigrams(F.col("term"))).alias("gram")).join(often, "gram", "left")
    rare = own.groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram"))), lambda g: g["gram"]).alias("grams"))
    n, m = F.length("term"), F.col("m")
    lengths = F.sequence(F.ceil(n * (1 - far) / (1 + far) - 1e-9).cast("int"), F.floor(n * (1 + far) / (1 - far) + 1e-9).cast("int"))
    each = rare.withColumn("m", F.explode(lengths)).withColumn("d", F.floor(far * (n + m) + 1e-9).cast("int"))
    each = each.withColumn("d", F.col("d") - F.pmod(F.col("d") - F.abs(n - m), F.lit(2))).filter(F.col("d") >= F.abs(n - m))
    wanted = (F.col("d") + n - m) + F.floor((F.col("d") + m - n) / 2) + 1
    looked = F.when(wanted > F.size("grams"), F.array(F.lit(""))).otherwise(F.slice("grams", F.lit(1), wanted.cast("int")))
    return each.select("term", "m", F.explode(looked).alias("gram")).join(known.hint("merge"), ["m", "gram"]).select("term", "match").distinct()


def fuzzy_matches(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """(term, match, score, rank): for terms of enough letters that are no vocabulary term, the likeliest vocabulary terms.

    Candidates share a rare pair of letters; a banded edit distance, which never exceeds the insert-delete distance, comes before the exact ratio.
    """
    vocab = materialize(vocab.select("term"), "vocabulary")  # read by each of the joins
    typos = terms.select("term").distinct().filter(F.length("term") >= S.fuzzy_min_term_len).join(vocab.hint("merge"), "term", "left_anti")
    met = fuzzy_candidates(materialize(typos, "typos"), vocab)
    room = F.floor((1 - S.fuzzy_min_score / 100) * (F.length("term") + F.length("match")) + 1e-9)
    scored = met.filter(F.levenshtein("term", "match") <= room).withColumn("score", ratio_udf()(F.col("term"), F.col("match"))).filter(F.col("score") >= S.fuzzy_min_score)
    return top(scored, ["term"], [F.desc("score"), "match"], S.fuzzy_max_matches_per_term)


def analysed(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """(query_id, question, terms, fuzzy): the terms, and the corrections of the first typos that have any."""
    termed = queries.select("query_id", "question", T.query_terms("question").alias("terms"))
    each = termed.select("query_id", F.posexplode("terms").alias("pos", "term"))
    found = fuzzy_matches(each, vocab).groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "match"))), lambda m: m["match"]).alias("ms"))
    per = each.join(found, "term").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ms"))).alias("ms"))
    flat = F.flatten(F.transform(F.slice("ms", 1, S.fuzzy_max_terms), lambda m: m["ms"]))
    both = termed.join(per, "query_id", "left").withColumn("fuzzy", F.coalesce(F.array_distinct(flat), F.array().cast("array<string>")))
    return both.withColumn("fuzzy", F.array_except("fuzzy", "terms")).select("query_id", "question", "terms", "fuzzy")


def variants(terms: Column) -> Column:
    """As written, capitalised and upper-cased, without repeats, of the first terms."""
    return F.array_distinct(F.flatten(F.transform(F.slice(terms, 1, S.lexical_terms), lambda t: F.array(t, F.initcap(t), F.upper(t)))))


def lexical(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, variant_ord, variant, chunk_id, score, rank): per variant, the nearest chunks whose text holds it (case-sensitive)."""
    asked = materialize(queries.select("query_id", "q_vec", variants(F.concat("terms", "fuzzy")).alias("variants")), "asked")
    found = _found(asked, chunks, "query_id", "q_vec", "chunk_id", "embedding", 0, "variants", "text")
    named = asked.select("query_id", F.posexplode("variants").alias("variant_ord", "variant"))
    return found.join(named, ["query_id", "variant_ord"]).select("query_id", "variant_ord", "variant", "chunk_id", "score", "rank")


def keyword_boost(terms: Column, heading: Column, body: Column, weight: float = S.keyword_boost_weight) -> Column:
    """Up to ``weight``: each distinct term counts 1 as a whole word of the heading, else one half in the body, over the number of terms."""
    def boost(words: Column) -> Column:
        once = F.array_distinct(terms)
        hits = F.aggregate(once, F.lit(0.0), lambda a, t: a + F.when(F.array_contains(words["head"], t), 1.0).when(F.array_contains(words["text"], t), 0.5).otherwise(0.0))
        return F.when(F.size(once) == 0, 0.0).otherwise(weight * F.least(F.lit(1.0), hits / F.size(once)))

    return T.let(F.struct(T.tokens_set(heading).alias("head"), T.tokens_set(body).alias("text")), boost)  # words cut once, not for each term


def hybrid(queries: DataFrame, chunks: DataFrame, vocab: DataFrame, k: int = S.retrieval_top_k, pool: int = S.retrieval_candidate_pool) -> DataFrame:
    """(query_id, rank, chunk_id, score, rerank_score): dense pool and lexical branch merged, boosted and cut to k.

    ``queries`` has query_id, question, q_vec; ``chunks`` chunk_id, heading_path, text, embedding. A chunk found twice keeps its first finding;
    equal rerank scores keep the order of finding. ``score`` is the true cosine.
    """
    asked = analysed(queries, vocab).join(queries.select("query_id", "q_vec"), "query_id")
    asked = materialize(asked.withColumn("variants", variants(F.concat("terms", "fuzzy"))), "asked")
    first = _found(asked, chunks, "query_id", "q_vec", "chunk_id", "embedding", max(k, pool), "variants", "text")
    merged = first.groupBy("query_id", "chunk_id").agg(F.first("score").alias("score"), F.min(F.struct("variant_ord", "rank")).alias("found"))
    ids = merged.join(asked.select("query_id", F.concat("terms", "fuzzy").alias("boost_terms")), "query_id")
    whole = chunks.select("chunk_id", "heading_path", "text").join(ids, "chunk_id")
    ranked = whole.withColumn("rerank_score", F.round(F.col("score") + keyword_boost(F.col("boost_terms"), F.col("heading_path"), F.col("text")), 4))
    return top(ranked, ["query_id"], [F.desc("rerank_score"), "found.variant_ord", "found.rank", "chunk_id"], k).select("query_id", "rank", "chunk_id", "score", "rerank_score")


def gate(results: DataFrame, queries: DataFrame, threshold: float = S.similarity_threshold) -> DataFrame:
    """(query_id, best, relevant): whether the best true cosine reaches the threshold; no result counts as 0."""
    best = results.groupBy("query_id").agg(F.max("score").alias("best"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("best", F.lit(0.0)).alias("best")).withColumn("relevant", F.col("best") >= threshold)
