"""Heading sections to overlapping chunks, the junk filters, de-duplication and chunk numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom import config
from textloom.functions import text as T
from textloom.scratch import materialize

S = config.SETTINGS


def hard_windows(sentence: Column, size: int = S.chunk_max_tokens, overlap: int = S.chunk_overlap_tokens) -> Column:
    """An over-long sentence by words: windows of ``size`` that overlap by ``overlap``; the last one may be overlap only."""
    w = T.words(sentence)
    step = size - overlap
    starts = F.sequence(F.lit(0), (F.floor((F.size(w) - overlap) / step) * step).cast("int"), F.lit(step))
    return F.when(F.size(w) < size, F.array(F.array_join(w, " "))).otherwise(F.filter(F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, F.lit(size)), " ")), lambda x: x != ""))


def chunk_section(text: Column, size: int = S.chunk_max_tokens, overlap: int = S.chunk_overlap_tokens, counts: Column | None = None, total: Column | None = None) -> Column:
    """Chunks of a section by words, or by another counter's ``counts`` of its sentences and ``total`` of the text: whole if short enough, else sentences packed greedily; a new chunk starts with the tail sentences of the last one
    that fit in ``overlap`` tokens, and is not checked again when its first sentence joins."""
    sized = F.transform(T.sentences(text), lambda s: F.struct(s.alias("s"), F.size(T.words(s)).alias("n")))
    if counts is not None:
        sized = F.zip_with(T.sentences(text), counts, lambda s, n: F.struct(s.alias("s"), n.cast("int").alias("n")))

    def packed(xs: Column) -> Column:
        """The fold keeps places only: ``out`` has (first, end) of each chunk, or (place, -1) of an over-long sentence; the open chunk is from ``lo`` up to ``i``, of ``n`` tokens."""
        zero = F.struct(F.array().cast("array<struct<lo:int,hi:int>>").alias("out"), F.lit(0).alias("lo"), F.lit(0).alias("i"), F.lit(0).alias("n"))

        def range_(lo: Column, hi: Column) -> Column:
            return F.struct(lo.alias("lo"), hi.alias("hi"))

        def closed(st: Column) -> Column:
            return F.when(st["lo"] < st["i"], F.array_append(st["out"], range_(st["lo"], st["i"]))).otherwise(st["out"])

        def tail(st: Column) -> Column:
            start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), F.lit(False).alias("stop"))

            def add(a: Column, x: Column) -> Column:
                full = a["stop"] | (a["n"] + x["n"] > overlap)
                return F.struct((a["k"] + F.when(full, 0).otherwise(1)).alias("k"), (a["n"] + F.when(full, 0).otherwise(x["n"])).alias("n"), full.alias("stop"))

            return F.aggregate(F.reverse(F.slice(xs, st["lo"] + 1, st["i"] - st["lo"])), start, add)

        def state(out: Column, lo: Column, i: Column, n: Column) -> Column:
            return F.struct(out.alias("out"), lo.alias("lo"), i.alias("i"), n.alias("n"))

        def step(st: Column, x: Column) -> Column:
            after = st["i"] + 1
            monster = state(F.array_append(closed(st), range_(st["i"], F.lit(-1))), after, after, F.lit(0))
            fresh = T.let(tail(st), lambda t: state(closed(st), st["i"] - t["k"], after, t["n"] + x["n"]))
            grown = state(st["out"], st["lo"], after, st["n"] + x["n"])
            return F.when(x["n"] > size, monster).when((st["n"] + x["n"] > size) & (st["lo"] < st["i"]), fresh).otherwise(grown)

        def written(r: Column) -> Column:
            whole = F.array_join(F.transform(F.slice(xs, r["lo"] + 1, r["hi"] - r["lo"]), lambda x: x["s"]), " ")
            return F.when(r["hi"] < 0, hard_windows(F.element_at(xs, r["lo"] + 1)["s"], size, overlap)).otherwise(F.array(whole))

        return F.flatten(F.transform(F.aggregate(xs, zero, step, closed), written))

    def of(whole: Column) -> Column:
        short = (T.word_count(text) if total is None else total) <= size
        return F.when(whole == "", F.array().cast("array<string>")).when(short, F.array(whole)).otherwise(F.filter(T.let(sized, packed), lambda c: T.trim_all(c) != ""))

    return T.let(T.trim_all(text), of)


def pieces(blocks: DataFrame, keys: list[str], order: list[str], counter=None) -> DataFrame:
    """(keys.., order.., piece_ord, text, token_count): chunks before any filter.

    Tokens are words, or what ``counter`` counts: it is called for a text, and its ``each`` for an array of sentences. An over-long sentence is cut by words either way.
    """
    if counter is not None:
        blocks = blocks.withColumns({"__counts": counter.each(T.sentences("text")), "__total": counter(F.col("text"))})
    section = chunk_section(F.col("text")) if counter is None else chunk_section(F.col("text"), counts=F.col("__counts"), total=F.col("__total"))
    cut = blocks.select(*keys, *order, F.posexplode(section).alias("piece_ord", "chunk"))
    return cut.select(*keys, *order, F.col("piece_ord").cast("long"), F.col("chunk").alias("text")).withColumn("token_count", T.word_count("text") if counter is None else counter(F.col("text")))


def drop_reason(known: Column | None = None) -> Column:
    """The first filter that a chunk fails: short, nav, garbage, or null; ``known``: the text's ``text.facts``, where they are at hand."""
    return F.when(F.col("token_count") < S.chunk_min_tokens, "short").when(T.looks_like_nav("text", known), "nav").when(T.looks_like_garbage("text", known), "garbage")


def judged(cut: DataFrame, order: list[str]) -> DataFrame:
    """Chunks with ``reason``: of those that pass the junk filters, all but the first of a text are ``duplicate``.

    First wins by the order columns: the smallest order of a hash is a grouped minimum, so a text of many copies does not meet in one task.
    """
    marked = materialize(cut.withColumn("reason", drop_reason()).withColumn("h", T.text_hash("text")), "marked")  # else cut and judged twice
    first = marked.filter("reason IS NULL").groupBy("h").agg(F.min(F.struct(*order)).alias("first"))
    both = marked.join(first, "h", "left")
    return both.withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.struct(*order) != F.col("first"), "duplicate")).drop("first")


def numbered(chunks: DataFrame, key: str, order: list[str]) -> DataFrame:
    """chunk_index from 0 over the surviving chunks of a page, and a deterministic chunk_id."""
    w = Window.partitionBy(key).orderBy(*order)
    return chunks.withColumn("chunk_index", (F.row_number().over(w) - 1).cast("long")).withColumn("chunk_id", F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.col("chunk_index").cast("string")), 256))


def chunk_documents(docs: DataFrame, counter=None) -> DataFrame:
    """documents to judged chunks: doc_id, piece_ord, text, token_count, h, reason; by words or by another ``counter``."""
    from textloom.operators.blocks import text_blocks

    return judged(pieces(text_blocks(docs), ["doc_id"], [], counter), ["doc_id", "piece_ord"])


def corpus(docs: DataFrame) -> DataFrame:
    """The index's chunks of plain documents, in the form that the retrieval operators read."""
    kept = numbered(chunk_documents(docs).filter("reason IS NULL"), "doc_id", ["piece_ord"])
    first_line = F.substring_index(F.col("text"), "\n", 1)
    return kept.select(
        "chunk_id", "doc_id", "chunk_index", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source_url"),
        F.substring(first_line, 1, 60).alias("page_title"), F.substring(first_line, 1, 60).alias("heading_path"), "text", "token_count", F.lit(True).alias("is_pdf"),
    )


def process_stats(judged_chunks: DataFrame) -> DataFrame:
    """One row: chunks kept, average tokens, and drops by the first failing filter."""
    kept = F.col("reason").isNull()
    return judged_chunks.agg(
        F.count(F.lit(1)).alias("pieces"), F.count_if(kept).alias("kept"),
        *[F.count_if(F.col("reason") == r).alias(f"dropped_{r}") for r in ("short", "nav", "garbage", "duplicate")],
        F.coalesce(F.avg(F.when(kept, F.col("token_count"))), F.lit(0.0)).alias("avg_tokens"),
    )


def embedding_input(heading: Column, body: Column) -> Column:
    return F.when(T.trim_all(heading) != "", F.concat(heading, F.lit("\n"), body)).otherwise(body)


def metadata(chunks: DataFrame) -> DataFrame:
    """The scalar metadata of chunks, missing values by default instead of null."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    have = set(chunks.columns)
    full = chunks.withColumns({c: F.lit(None).cast("string") for c in ("source_url", "page_title", "heading_path", "crawl_timestamp", "chunk_index", "token_count", "is_pdf") if c not in have})
    return full.select("chunk_id", text("source_url"), text("page_title"), text("heading_path"), whole("chunk_index"), text("crawl_timestamp"), whole("token_count"), F.coalesce(F.col("is_pdf").cast("boolean"), F.lit(False)).alias("is_pdf"))
